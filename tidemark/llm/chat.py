"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation that
begin with the user. A conversation that is not legal is repaired at least cost: a turn may join the
turn before it, take another role, or have an empty turn put before it. The choice is a shortest path
through an automaton, found by dynamic programming. Costs of runs of turns are small matrices over
the automaton's states whose min-plus product is associative, so that a conversation of any length
is cut into ranges, each range is priced alone, and the ranges are put together by their matrices.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, table

#: States: what the last turn was. No turn yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Costs. A merge is the mildest; a turn without a known role takes any role for UNKNOWN.
MERGE, RELABEL, RELABEL_SYSTEM, INSERT, UNKNOWN = 1.0, 2.5, 4.0, 2.0, 0.5


def moves(state: int, role: int | None) -> list[tuple[float, int, int, str, int | None, int]]:
    """What may be done with a turn of ``role`` after ``state``: cost, next state, turns it begins,
    name, role of an empty turn put before it, role it takes."""
    out = []
    for take in (SYSTEM, USER, ASSISTANT):
        price = 0.0 if take == role else UNKNOWN if role is None else RELABEL_SYSTEM if SYSTEM in (take, role) else RELABEL
        name = "keep" if take == role else "relabel"
        if (state, take) in LEGAL:
            out.append((price, take, 1, name, None, take))
        if state == take:
            out.append((price + MERGE, take, 0, "merge" if take == role else "relabel+merge", None, take))
        for empty in (USER, ASSISTANT):
            if (state, empty) in LEGAL and (empty, take) in LEGAL:
                out.append((price + INSERT, take, 2, "insert" if take == role else "insert+relabel", empty, take))
    return out


#: For each role (None, system, user, assistant) and state the moves in a fixed order.
_ROLE_KEYS = (None, SYSTEM, USER, ASSISTANT)
MOVES = {r: [moves(s, r) for s in range(4)] for r in _ROLE_KEYS}
STEP = {}
for _r in _ROLE_KEYS:
    _m = np.full((4, 4, 2), np.inf)
    for _s in range(4):
        for _cost, _next, _turns, *_ in MOVES[_r][_s]:
            if (_cost, _turns) < tuple(_m[_s, _next]):
                _m[_s, _next] = _cost, _turns
    STEP[_r] = _m


def escaped(text: Column) -> Column:
    """Text in which no mark can stand: one more backslash between < and | wherever only such lie between them."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def parse(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    turns = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", rendered, re.DOTALL)
    return [(role, re.sub(r"<\\(\\*)\|", r"<\1|", text)) for role, text in turns]


def role_of(role: str | None) -> int | None:
    return ROLES.get((role or "").strip().lower())


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of matrices of (cost, turns), compared in that order."""
    out = np.full((4, 4, 2), np.inf)
    for i in range(4):
        for k in range(4):
            if np.isinf(a[i, k, 0]):
                continue
            for j in range(4):
                c = (a[i, k, 0] + b[k, j, 0], a[i, k, 1] + b[k, j, 1])
                if c < tuple(out[i, j]):
                    out[i, j] = c
    return out


def price(roles: list[int | None]) -> np.ndarray:
    """The matrix of a run of turns."""
    total = np.full((4, 4, 2), np.inf)
    for s in range(4):
        total[s, s] = 0.0
    for r in roles:
        total = product(total, STEP[r])
    return total


def best_path(roles: list[int | None], entry: int, exit_: int | None = None) -> list[tuple[float, int, int, str, int | None, int]]:
    """The cheapest moves from ``entry`` through all turns (to ``exit_``, if given); ties go to fewer
    turns, then to the lower states."""
    n = len(roles)
    value = np.full((n + 1, 4, 2), np.inf)
    for s in range(4):
        if exit_ is None or s == exit_:
            value[n, s] = 0.0
    for i in range(n - 1, -1, -1):
        for s in range(4):
            for cost, to, turns, *_ in MOVES[roles[i]][s]:
                c = (cost + value[i + 1, to, 0], turns + value[i + 1, to, 1])
                if c < tuple(value[i, s]):
                    value[i, s] = c
    out, s = [], entry
    for i in range(n):
        m = min(MOVES[roles[i]][s], key=lambda x: (x[0] + value[i + 1, x[1], 0], x[2] + value[i + 1, x[1], 1], x[1]))
        out.append(m)
        s = m[1]
    return out


def repair(turns: DataFrame, *, ranges: int | None = None, range_rows: int = 50_000, range_bytes: int = 1 << 25) -> DataFrame:
    """One row per fragment of the repaired conversations: conv_id, out_turn (from 0), range, at, role,
    text, op, cost, rendered.

    Fragments are in the order of (range, at), an empty turn before the turn that asks for it; a
    repaired turn is its fragments in that order, and so is the rendered conversation: a turn is a mark
    of its role, its text, and a mark of its end, and marks in texts are escaped, so that ``parse``
    reads the turns back. An empty turn put in is a row of its own with op "empty". Null text is empty; a null or unknown role takes any
    role; null conv_ids are one conversation; turns without a number come first, and rows with equal
    numbers go by a hash of role and text. An empty table gives no rows; other columns are ignored. A
    conversation may be of any length: rows are dealt by ranges of (conv_id, turn), of about
    ``range_rows`` rows or ``range_bytes`` of text at most each, and only a range's matrix travels.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    if not ranges:
        size = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
        ranges = max(spark.sparkContext.defaultParallelism, math.ceil(size["rows"] / range_rows), math.ceil(size["bytes"] / range_bytes))
    order = ["conv_id", "turn", "tie", "row"]
    tied = rows.withColumn("tie", F.xxhash64("role", "text")).withColumn("row", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield b.assign(range=part, at=range(at, at + len(b)), conv_id=b["conv_id"].astype("Int64"), turn=b["turn"].astype("Int64")).drop(columns=["tie", "row"])
            at += len(b)

    schema = "conv_id long, turn long, role string, text string, range int, at long"
    numbered = scratch.put(dealt.mapInPandas(number, schema), "ranges")
    roles = F.struct("at", "role")
    # within a range the roles of one conversation: at most the rows of a range; dealt out, since pricing
    # them takes longer than their bytes tell
    runs = numbered.repartition(ranges, "conv_id", "range").groupBy("conv_id", "range").agg(F.sort_array(F.collect_list(roles)).alias("roles"))

    def priced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"conv_id": b["conv_id"].astype("Int64"), "range": b["range"], "matrix": [price([role_of(x["role"]) for x in r]).ravel() for r in b["roles"]]})

    matrices = scratch.put(runs.mapInPandas(priced, "conv_id long, range int, matrix array<double>"), "matrices")

    def way(conv: int | None, parts: list) -> list[tuple]:
        """Where each range of a conversation begins and ends on the cheapest path, and after how many turns."""
        m = [np.array(x["matrix"]).reshape(4, 4, 2) for x in parts]
        rest = [np.zeros((4, 2))]  # the best from each state to the end
        for x in reversed(m):
            best = [min((x[s, t, 0] + rest[-1][t, 0], x[s, t, 1] + rest[-1][t, 1]) for t in range(4)) for s in range(4)]
            rest.append(np.array(best))
        rest.reverse()
        out, s, before = [], START, 0
        for i, x in enumerate(m):
            t = min(range(4), key=lambda t: (x[s, t, 0] + rest[i + 1][t, 0], x[s, t, 1] + rest[i + 1][t, 1], t))
            out.append((conv, parts[i]["range"], s, t, before, i == len(m) - 1))
            before += int(x[s, t, 1])
            s = t
        return out

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [w for conv, parts in zip(b["conv_id"].astype("Int64"), b["parts"], strict=True) for w in way(None if conv is pd.NA else conv, parts)]
            yield pd.DataFrame(out, columns=["conv_id", "range", "entry", "exit", "before", "last"]).astype({"conv_id": "Int64"})

    # at most one matrix for each range in a conversation's list
    lists = matrices.repartition(ranges, "conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("range", "matrix"))).alias("parts"))
    ways = scratch.put(lists.mapInPandas(joined, "conv_id long, range int, entry int, exit int, before long, last boolean"), "ways")

    def fragments_of(conv: int | None, rng: int, entry: int, exit_: int, before: int, last: bool, turns_: list) -> list[tuple]:
        out, turn = [], before - 1
        for (cost, _, begins, name, empty, take), x in zip(best_path([role_of(x["role"]) for x in turns_], entry, exit_), turns_, strict=True):
            if empty is not None:
                turn += 1
                out.append((conv, turn, NAMES[empty], "", "empty", 0.0, x["at"], rng, True, False))
            turn += 1 if begins else 0
            out.append((conv, turn, NAMES[take], x["text"], name, cost, x["at"], rng, bool(begins), False))
        if last:
            out[-1] = (*out[-1][:-1], True)
        return out

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, rng, entry, exit_, before, last, turns_ in zip(b["conv_id"].astype("Int64"), b["range"], b["entry"], b["exit"], b["before"], b["last"], b["turns"], strict=True):
                out += fragments_of(None if conv is pd.NA else conv, rng, entry, exit_, before, last, turns_)
            yield pd.DataFrame(out, columns=["conv_id", "out_turn", "role", "text", "op", "cost", "at", "range", "begins", "ends"]).astype({"conv_id": "Int64"})

    pieces = numbered.groupBy("conv_id", "range").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    whole = pieces.join(ways, pieces["conv_id"].eqNullSafe(ways["conv_id"]) & (pieces["range"] == ways["range"])).select(pieces["conv_id"], pieces["range"], "entry", "exit", "before", "last", "turns")
    fragments = whole.mapInPandas(written, "conv_id long, out_turn long, role string, text string, op string, cost double, at long, range int, begins boolean, ends boolean")
    end, none = F.lit("<|end|>\n"), F.lit("")
    opening = F.concat(F.when(F.col("out_turn") > 0, end).otherwise(none), F.lit("<|"), F.col("role"), F.lit("|>\n"))
    return fragments.select(
        "conv_id",
        "out_turn",
        "range",
        "at",
        "role",
        "text",
        "op",
        "cost",
        F.concat(F.when(F.col("begins"), opening).otherwise(F.lit("\n\n")), escaped(F.col("text")), F.when(F.col("ends"), end).otherwise(none)).alias("rendered"),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered, a row per fragment; odd rows as ``repair`` says."""
    return repair(table(spark, sf_dir, "conversations"))
