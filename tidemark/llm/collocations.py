"""Phrases whose words stand together more often than apart.

A first pass over the texts fills count-min sketches, which Spark merges; they never count too little.
A second pass adds up, exactly, only phrases that the merged sketch and all their parts let through, so
that nothing frequent is lost. Scores and the removal of parts of longer phrases are joins and sums over
the frequent phrases alone.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, table

ORDER = 4
#: Small letters for A-Z, one mark for all ends of pieces, one for white space.
_PLAIN = bytes(10 if x in b".,;:!?\n\x0b\x0c\r" else 32 if x in b" \t" else x + 32 if 65 <= x <= 90 else x for x in range(256))
_END = b"\n"
#: Tokens that are sketched at once and counted at once, phrases that a task holds, sketch blocks in a row of cells.
SKETCHED, COUNTED, HELD, BLOCKS = 1 << 21, 1 << 20, 1_000_000, 512


class Words:
    """Numbers for the words of each language, from 1; 0 is the end of a piece."""

    def __init__(self):
        self.counter = itertools.count(1)
        self.by_lang: dict[str, defaultdict] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.counts: dict[str, int] = {}

    def add(self, lang: str, text: bytes) -> None:
        d = self.by_lang.get(lang)
        if d is None:
            d = self.by_lang[lang] = defaultdict(self.counter.__next__)
            d[_END], d[b""] = 0, -1
        tokens = text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(d.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        ids = ids[ids >= 0]
        self.counts[lang] = self.counts.get(lang, 0) + int(np.count_nonzero(ids))
        self.parts += [ids, np.zeros(1, np.int32)]
        self.size += len(ids) + 1

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)

    def names(self) -> tuple[list[bytes], list[str]]:
        """Word and language of every number."""
        n = max((max(d.values()) for d in self.by_lang.values()), default=0) + 1
        words, langs = [b""] * n, [""] * n
        for lang, d in self.by_lang.items():
            for w, i in d.items():
                if i > 0:
                    words[i], langs[i] = w, lang
        return words, langs


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Words]:
    """The words of whole texts (columns lang, text as bytes), some ``size`` at a time."""
    held = Words()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.add(lang, text or b"")
            if held.size >= size:
                yield held
                held = Words()
    yield held


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def phrase_hashes(ids: np.ndarray, words: list[bytes], langs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order in turn, whether a phrase begins at a position, and its hash (of language and words)."""
    from xxhash import xxh64_intdigest

    seeds = {lang: xxh64_intdigest(lang.encode()) for lang in set(langs)}
    own = np.array([xxh64_intdigest(w, seeds[g]) for w, g in zip(words, langs, strict=True)], dtype=np.uint64)
    first = _mix(own)[ids]
    begins, h = ids > 0, first
    yield begins, h
    for k in range(1, ORDER):
        n = max(0, len(ids) - k)
        begins, h = begins[:n] & (ids[k : k + n] > 0), _mix(h[:n] * np.uint64(0x9E3779B97F4A7C15) + first[k : k + n])
        yield begins, h


def cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in the two rows of a sketch of 2**bits columns."""
    low = np.uint64(2**bits - 1)
    return [(h & low).astype(np.uint32), (h >> np.uint64(64 - bits)).astype(np.uint32)]


def sketch_bits(chars: int, least: int = 16, most: int = 28) -> int:
    """Columns grow with the text, a cell for some eight phrases, up to 2**28 (64 MiB of bits at last)."""
    return min(most, max(least, math.ceil(math.log2(max(1, chars) / 16 + 1))))


def _pack(block: np.ndarray, counts: np.ndarray) -> bytes:
    import zstandard

    steps = np.diff(block, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return len(block).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(steps.T.tobytes() + counts.astype(np.uint8).tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:], max_output_size=5 * n), dtype=np.uint8)
    steps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32), raw[4 * n :]


def fill_sketches(texts: DataFrame, bits: int, least: int) -> DataFrame:
    """row, block, data: the cells that a chunk of text has touched, with counts up to ``least``.

    A count that reaches ``least`` in one chunk decides its cell, so larger ones need not be told apart.
    """
    per = bits - int(math.log2(BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in chunks(batches, SKETCHED):
            every = [cells(h[begins], bits) for begins, h in phrase_hashes(held.ids(), *held.names())]
            for row in (0, 1):
                seen, n = np.unique(np.concatenate([c[row] for c in every]), return_counts=True)
                n, cuts = np.minimum(n, least), np.searchsorted(seen, np.arange(1, BLOCKS, dtype=np.int64) << per)
                parts = zip(np.split(seen & np.uint32(2**per - 1), cuts), np.split(n, cuts), strict=True)
                rows = [(b, _pack(s, c)) for b, (s, c) in enumerate(parts) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([row * BLOCKS + b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "data"])

    return texts.mapInArrow(run, "block int, data binary")


def merge_sketches(parts: DataFrame, bits: int, least: int) -> DataFrame:
    """block, bits: for every cell of a block whether the merged count reaches ``least``.

    Blocks are added up as they come, so a task holds the blocks of its partition and not what is merged.
    """
    size = 2 ** (bits - int(math.log2(BLOCKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total = held.setdefault(block, np.zeros(size, np.uint8))
                at, n = _unpack(data)
                total[at] = np.minimum(total[at].astype(np.uint16) + n, least)
        for block, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    return parts.repartition("block").mapInArrow(run, "block int, bits binary")


def _let_through(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    rows = [(bitmap[r][c >> 3] >> (c & 7).astype(np.uint8)) & 1 for r, c in enumerate(cells(h, bits))]
    return (rows[0] & rows[1]).astype(bool)


def count_survivors(texts: DataFrame, bitmap, bits: int) -> DataFrame:
    """lang, size, part, phrases, f: exact counts within a task of the phrases that the sketch lets through, dealt
    by hash into parts; size 0 has the number of all words. A phrase passes only if the phrases within it do.
    A task hands on what it holds, in order, when that are ``HELD`` phrases."""
    from xxhash import xxh32_intdigest

    parts = 2 ** max(4, bits - 17)

    def spelled(ids: np.ndarray, starts: np.ndarray, k: int, words: list[bytes]) -> Iterator[bytes]:
        return map(b" ".join, zip(*[[words[i] for i in ids[starts + j].tolist()] for j in range(k)], strict=True))

    def counted(held: Words, sketch: np.ndarray) -> Iterator[tuple[int, list[str], Iterator[bytes], list[int]]]:
        ids, (words, langs) = held.ids(), held.names()
        passed = rank = None
        for k, (begins, h) in enumerate(phrase_hashes(ids, words, langs)):
            if k:
                begins = begins & passed[: len(h)] & passed[1 : len(h) + 1]
            at = np.flatnonzero(begins)
            at = at[_let_through(sketch, h[at], bits)]
            passed = np.zeros(len(h), bool)
            passed[at] = True
            # a phrase is the number of the phrase without its last word, and that word: exact, without hashes
            key = (rank[at].astype(np.int64) << 32) | ids[at + k] if k else ids[at]
            _, first, of, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            rank = np.zeros(len(h), np.int32)
            rank[at] = of
            starts = at[first]
            yield k + 1, [langs[i] for i in ids[starts].tolist()], spelled(ids, starts, k + 1, words), n.tolist()

    def batches_of(total: dict) -> Iterator[pa.RecordBatch]:
        for (lang, size), d in total.items():
            dealt = sorted((xxh32_intdigest(p) % parts, p) for p in d)
            at = np.array([b for b, _ in dealt])
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            offsets = pa.array(np.append(starts, len(at)).astype(np.int32))
            names = pa.ListArray.from_arrays(offsets, pa.array([p for _, p in dealt], pa.binary()).cast(pa.string()))
            counts = pa.ListArray.from_arrays(offsets, pa.array([d[p] for _, p in dealt], pa.int64()))
            n = len(starts)
            every = pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([size] * n, pa.int32()), pa.array(at[starts].astype(np.int32)), names, counts], ["lang", "size", "part", "phrases", "f"])
            yield from (every.slice(a, 64) for a in range(0, n, 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, total = bitmap.value, defaultdict(lambda: defaultdict(int))
        for held in chunks(batches, COUNTED):
            for lang, n in held.counts.items():
                total[lang, 0][b""] += n
            for size, langs, phrases, counts in counted(held, sketch):
                for lang, phrase, n in zip(langs, phrases, counts, strict=True):
                    total[lang, size][phrase] += n
            if sum(map(len, total.values())) > HELD:
                yield from batches_of(total)
                total.clear()
        yield from batches_of(total)

    return texts.mapInArrow(run, "lang string, size int, part int, phrases array<string>, f array<long>")


def add_survivors(counted: DataFrame, least: int) -> DataFrame:
    """lang, size, phrase, f: the sums of what the tasks counted, where they reach ``least``.

    Parts stand in order in a partition, so that a task holds the phrases of one part at a time, and a
    part is a fixed share of the sketch.
    """
    by = ["lang", "size", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, defaultdict(int)

        def done() -> pa.RecordBatch:
            found = [(p, n) for p, n in total.items() if n >= least or not now[1]]
            k = len(found)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * k, pa.string()), pa.array([now[1]] * k, pa.int32()), pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["lang", "size", "phrase", "f"])

        for b in batches:
            for *key, phrases, counts in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key != now:
                    if now is not None:
                        yield done()
                    now, total = key, defaultdict(int)
                for p, n in zip(phrases, counts, strict=True):
                    total[p] += n
        if now is not None:
            yield done()

    return counted.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "lang string, size int, phrase string, f long")


def phrase_counts(docs: DataFrame, scratch: Scratch, *, least: int, text_col: str, lang_col: str) -> DataFrame:
    """lang, size, phrase, f of every phrase that occurs ``least`` times; size 0 counts all words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    chars = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    bits = sketch_bits(chars)
    rows = merge_sketches(fill_sketches(texts, bits, least), bits, least).collect()  # a bit for each cell: 64 MiB at most
    bitmap = np.zeros((2, 2**bits // 8), np.uint8)
    size = 2**bits // 8 // BLOCKS
    for r in rows:
        row, block = divmod(r["block"], BLOCKS)
        bitmap[row, block * size : (block + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    return scratch.put(add_survivors(count_survivors(texts, sent, bits), least), "phrases")


def _piece(words: Column, start: int, n: int) -> Column:
    return F.array_join(F.slice(words, start + 1, n), " ")


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def scored(frequent: DataFrame, again: DataFrame) -> DataFrame:
    """lang, size, phrase, a, l, r, score of phrases of two words or more: the cut that scores lowest counts."""
    words = F.split("phrase", " ")
    parts = frequent.where("size > 1").withColumn("w", words)
    cuts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("side"), (_piece(F.col("w"), 0, k) if s == 0 else F.array_join(F.slice(F.col("w"), k + 1, ORDER), " ")).alias("part")) for k in range(1, ORDER) for s in (0, 1)])
    lookups = parts.select("lang", "size", "phrase", F.col("f").alias("a"), F.explode(F.filter(cuts, lambda c: c["k"] < F.col("size"))).alias("c")).select("lang", "size", "phrase", "a", "c.*")
    known = again.where("size between 1 and 3").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    found = lookups.join(known, (F.col("lang") == F.col("_lang")) & (F.col("part") == F.col("_part")))
    sides = found.groupBy("lang", "size", "phrase", "a").agg(*[F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("_f"))).alias(f"s{k}{s}") for k in range(1, ORDER) for s in (0, 1)])
    exact = lambda k: F.expr(f"cast(a as decimal(20,0)) * 2000000BD div (cast(s{k}0 as decimal(20,0)) + cast(s{k}1 as decimal(20,0)))")
    best = F.array_min(F.filter(F.array(*[F.when(F.col(f"s{k}0").isNotNull(), F.struct(exact(k).alias("score"), F.lit(k).alias("k"), F.col(f"s{k}0").alias("l"), F.col(f"s{k}1").alias("r"))) for k in range(1, ORDER)]), lambda c: c.isNotNull()))
    return sides.select("lang", "size", "phrase", "a", best.alias("b")).select("lang", "size", "phrase", "a", "b.l", "b.r", "b.score")


def subsumed(candidates: DataFrame, again: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates without those that a longer one, dropped or not, holds ``percent`` in a hundred of the time."""
    w = F.split("phrase", " ")
    inner = [(n, s, k) for n in range(3, ORDER + 1) for k in range(2, n) for s in range(n - k + 1)]
    within = F.array(*[F.when(F.col("size") == n, F.struct(F.lit(k).alias("size"), _piece(F.col("w"), s, k).alias("phrase"))) for n, s, k in inner])
    longer = again.where("size > 2").withColumn("w", w).select("lang", F.col("f").alias("longer"), F.explode(F.filter(within, lambda x: x.isNotNull())).alias("x")).select("lang", "x.phrase", "longer")
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "longer")
    out = candidates.join(most, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left").drop("_lang", "_phrase")
    return out.where(F.col("longer").isNull() | (_big("longer") * 100 < _big("a") * percent)).drop("longer")


def collocations(docs: DataFrame, *, least: int = 30, percent: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang", salts: int = 32) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of two to four words, best first.

    Null texts and texts without words count for nothing, a null language is ``und``; repeated rows count
    as often as they stand there, ids and other columns are ignored, an empty table gives no rows.
    Ties go by count, then by phrase. A phrase never reaches over the end of a piece or of a text.
    """
    scratch = Scratch(docs.sparkSession)
    frequent = phrase_counts(docs, scratch, least=least, text_col=text_col, lang_col=lang_col)
    kept = subsumed(scored(frequent, scratch.again(frequent)), scratch.again(frequent), percent)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # best of each share of a language first, so that no task ranks all phrases of one
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    last = Window.partitionBy("lang").orderBy(*order)
    best = kept.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= top).drop("_r").withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top)
    totals = scratch.again(frequent).where("size = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    return best.join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of every language of the documents; odd rows as ``collocations`` says."""
    return collocations(table(spark, sf_dir, "documents"))


#: The same rows by counting every phrase.
OP13_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) p from documents),
words as (select lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') w from pieces),
totals as (select lang, sum(len(w))::bigint n from words group by 1),
grams as (
  select lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) phrase
  from words, (select unnest([1, 2, 3, 4]) k) where len(w) >= k),
f as (select lang, k size, phrase, count(*) f from grams group by 1, 2, 3 having count(*) >= 30),
cuts as (
  select lang, size, phrase, f a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') x, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') y
  from f, (select unnest([1, 2, 3]) c) where c < size),
scores as (
  select u.lang, u.size, u.phrase, u.a, u.c, g.f l, h.f r, (u.a::hugeint * 2000000 // (g.f + h.f))::bigint score
  from cuts u join f g on g.lang = u.lang and g.phrase = u.x join f h on h.lang = u.lang and h.phrase = u.y),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, c) = 1),
longer as (
  select lang, f, unnest(list_transform(list_filter([[1, 2], [2, 2], [3, 2], [1, 3], [2, 3]], lambda q: q[2] < size and q[1] + q[2] - 1 <= size), lambda q: array_to_string(string_split(phrase, ' ')[q[1]:q[1] + q[2] - 1], ' '))) part
  from f where size > 2),
most as (select lang, part, max(f) f from longer group by 1, 2),
kept as (select b.* from best b left join most m on m.lang = b.lang and m.part = b.phrase where m.f is null or 100 * m.f::hugeint < 80 * b.a::hugeint),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""
