"""Recursions over time that stay in expressions: a scan of affine maps at two levels.

A series is cut by periods. Each piece is one map from the state before it to the state after it, found
from the piece alone; maps of an asset's pieces are chained; then each piece runs from its own first state.
Pieces are independent, so a series of any length is dealt to many tasks, and a series in one piece gets
the plain recursion, number by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64


def period(ts: str, days: int) -> Column:
    """The number of the period of so many days that a time lies in."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(86_400 * days))


def _weight(alpha: float, gap: str) -> str:
    """Weight of a value after ``gap`` rows without one, whose time still passes."""
    return f"(case when {gap} = 0 then {alpha!r}D else {alpha!r}D / (pow({(1.0 - alpha)!r}D, {gap} + 1) + {alpha!r}D) end)"


def _step(s: str, gap: str, x: str, alpha: float) -> tuple[str, str]:
    """The state after a value: mean and rows since it was seen."""
    mean = f"(case when {x} is null then {s} when {s} is null then {x} else {s} + {_weight(alpha, gap)} * ({x} - {s}) end)"
    return mean, f"(case when {x} is null and {s} is not null then {gap} + 1 else 0 end)"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _values(column: str) -> str:
    return f"cast(_rows.`{column}` as array<double>)"


def _means(column: str, start: str, alpha: float) -> Column:
    """The mean after each value of a piece, from the state before it. Results are gathered by blocks, since
    to append to one array copies it."""
    mean, gap = _step("q.s", "q.gap", "x", alpha)
    inner = f"aggregate(part, named_struct('ys', cast(array() as array<double>), 's', acc.s, 'gap', acc.gap), (q, x) -> named_struct('ys', concat(q.ys, array({mean})), 's', {mean}, 'gap', {gap}))"
    blocks = f"transform(sequence(0, greatest(cast(ceil(size(xs) / {BLOCK}) as int) - 1, 0)), b -> slice(xs, b * {BLOCK} + 1, {BLOCK}))"
    merged = _let("r", inner, "named_struct('out', concat(acc.out, array(r.ys)), 's', r.s, 'gap', r.gap)")
    run = f"aggregate({blocks}, named_struct('out', cast(array() as array<array<double>>), 's', {start}.s, 'gap', {start}.gap), (acc, part) -> {merged}, acc -> flatten(acc.out))"
    return F.expr(_let("xs", _values(column), run))


def _piece(column: str, alpha: float) -> Column:
    """The map of a piece: rows before its first value, that value, then mean -> a * mean + b, rows after its last."""
    w = _weight(alpha, "acc.trail")
    later = "acc.first is not null and x is not null"
    return F.expr(
        f"aggregate({_values(column)}, named_struct('lead', 0, 'first', cast(null as double), 'a', 1D, 'b', 0D, 'trail', 0), (acc, x) -> named_struct("
        f"'lead', acc.lead + if(acc.first is null and x is null, 1, 0), 'first', coalesce(acc.first, x), "
        f"'a', if({later}, (1D - {w}) * acc.a, acc.a), 'b', if({later}, acc.b + {w} * (x - acc.b), acc.b), 'trail', if(acc.first is not null and x is null, acc.trail + 1, 0)))"
    )


def _starts(name: str, alpha: float) -> Column:
    """For an asset's pieces in order, the state before each."""
    p = f"p.`{name}`"
    met, _ = _step("acc.s", f"(acc.gap + if(acc.s is null, 0, {p}.lead))", f"{p}.first", alpha)
    mean = f"if({p}.first is null, acc.s, {p}.a * {met} + {p}.b)"
    gap = f"case when {p}.first is null then if(acc.s is null, 0, acc.gap + {p}.lead) else {p}.trail end"
    zero = "named_struct('out', cast(array() as array<struct<s:double,gap:int>>), 's', cast(null as double), 'gap', 0)"
    return F.expr(f"aggregate(_p, {zero}, (acc, p) -> named_struct('out', concat(acc.out, array(named_struct('s', acc.s, 'gap', acc.gap))), 's', {mean}, 'gap', {gap}), acc -> acc.out)")


def exponential(panel: DataFrame, columns: dict[str, tuple[str, float]], asset: str = "asset", ts: str = "ts", cut: Column | None = None) -> DataFrame:
    """Adds exponentially weighted means: name -> (column, alpha), seeded with the first value.

    A row without a value keeps the mean, but its time passes: the next value weighs more. ``cut`` numbers the
    pieces of a series, never falling with time (see ``period``); without it a series is one piece. One
    task holds one piece at a time; the two passes over the pieces share one exchange.
    """
    fields, alphas = panel.columns, {n: float(a) for n, (_, a) in columns.items()}
    rows = F.array_sort(F.collect_list(F.struct(ts, *[c for c in fields if c != ts])))
    pieces = panel.groupBy(F.col(asset).alias("_asset"), (F.lit(0) if cut is None else cut).alias("_piece")).agg(rows.alias("_rows"))
    if cut is None:
        begun = pieces.withColumn("_start", F.expr("named_struct('s', cast(null as double), 'gap', 0)"))
        begun = begun.withColumn("_start", F.struct(*[F.col("_start").alias(n) for n in columns]))
    else:
        maps = pieces.select("_asset", F.struct("_piece", *[_piece(c, alphas[n]).alias(n) for n, (c, _) in columns.items()]).alias("_p"))
        chained = maps.groupBy("_asset").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
        starts = chained.select(F.col("_asset").alias("_a"), F.inline(F.arrays_zip(F.expr("_p._piece").alias("_q"), *[_starts(n, a).alias(n) for n, a in alphas.items()])))
        starts = starts.select("_a", "_q", F.struct(*columns).alias("_start"))
        begun = pieces.join(starts, F.col("_asset").eqNullSafe(F.col("_a")) & F.col("_piece").eqNullSafe(F.col("_q")))
    means = [_means(c, f"_start.`{n}`", alphas[n]).alias(f"_y_{n}") for n, (c, _) in columns.items()]
    out = begun.select(F.inline(F.arrays_zip(F.col("_rows"), *means)))
    return out.select(*[F.col("_rows")[c].alias(c) for c in fields], *[F.col(f"_y_{n}").alias(n) for n in columns])


def lagged(panel: DataFrame, name: str, column: str, asset: str = "asset", ts: str = "ts", cut: Column | None = None) -> DataFrame:
    """Adds ``name``, the column of the asset's row before. With ``cut`` the window is that of a piece, and the
    first row of a piece takes the last of the piece before."""
    if cut is None:
        return panel.withColumn(name, F.lag(column).over(Window.partitionBy(asset).orderBy(ts)))
    rows = panel.withColumn("_piece", cut)
    last = rows.groupBy(F.col(asset).alias("_asset"), F.col("_piece").alias("_of")).agg(F.max_by(F.struct(F.col(column).alias("v")), ts).alias("_last"))
    before = last.withColumn("_last", F.lag("_last").over(Window.partitionBy("_asset").orderBy("_of")))
    w = Window.partitionBy(asset, "_piece").orderBy(ts)
    inside = rows.withColumns({"_n": F.row_number().over(w), name: F.lag(column).over(w)})
    met = inside.join(before, F.col(asset).eqNullSafe(F.col("_asset")) & F.col("_piece").eqNullSafe(F.col("_of")), "left")
    return met.withColumn(name, F.when(F.col("_n") == 1, F.col("_last")["v"]).otherwise(F.col(name))).select(*panel.columns, name)
