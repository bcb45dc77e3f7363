"""Positions and running extremes over all rows in one order, without one task that sees them all.

Rows are dealt by ranges of the order and sorted there. What a partition must know of those before it, a count
or an extreme, is one row for each partition. The dealt rows are a checkpoint in the shared folder, so that
every later step sees the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpoints

_ID = 33


def _dealt(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """The rows in ranges of the order, with ``_order_part`` and the place within it, ``_order_at``."""
    checkpoints(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_order_id", F.monotonically_increasing_id()).checkpoint()
    return ranged.withColumns({"_order_part": F.shiftright("_order_id", _ID), "_order_at": F.col("_order_id").bitwiseAND(F.lit((1 << _ID) - 1)) + 1}).drop("_order_id")


def _placed(dealt: DataFrame) -> tuple[DataFrame, Column]:
    """The dealt rows beside the number of rows before their partition (``_order_before``) and of all rows (``_order_all``)."""
    parts = dealt.groupBy("_order_part").agg(F.count(F.lit(1)).alias("_order_n"))
    so_far = Window.orderBy("_order_part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = parts.select(F.col("_order_part").alias("_order_of"), (F.sum("_order_n").over(so_far) - F.col("_order_n")).alias("_order_before"), F.sum("_order_n").over(Window.partitionBy()).alias("_order_all"))
    return dealt.join(offsets, F.col("_order_part") == F.col("_order_of")).drop("_order_of"), F.col("_order_before") + F.col("_order_at")


def numbered(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Adds the position of each row in the order, from 1. Ties must be broken by the order itself.

    Acts at once: rows are written to the shared folder in ranges of the order.
    """
    placed, position = _placed(_dealt(df, list(order)))
    return placed.withColumn(name, position).select(*df.columns, name)


def running(df: DataFrame, order: list[Column | str], least: dict[str, tuple[Column, str]], position: str = "_r", total: str = "_n") -> DataFrame:
    """Adds ``position`` and ``total``, and for each name of ``least`` an extreme that runs along the order.

    ``least``: name -> (expression, kind); the kind is ``max`` from the first row up to a row or ``min`` from the last down to
    it. Expressions may use the position and the total.
    """
    placed, at = _placed(_dealt(df, order))
    rows = placed.withColumns({position: at, total: F.col("_order_all")}).withColumns({f"_x_{n}": x for n, (x, _) in least.items()})
    so_far = (Window.unboundedPreceding, 0)
    parts = rows.groupBy(F.col("_order_part").alias("_order_of")).agg(*[(F.max if kind == "max" else F.min)(f"_x_{n}").alias(f"_e_{n}") for n, (_, kind) in least.items()])
    outside = {n: (F.max(f"_e_{n}").over(Window.orderBy("_order_of").rowsBetween(Window.unboundedPreceding, -1)) if kind == "max" else F.min(f"_e_{n}").over(Window.orderBy(F.desc("_order_of")).rowsBetween(Window.unboundedPreceding, -1))) for n, (_, kind) in least.items()}
    parts = parts.select("_order_of", *[x.alias(f"_o_{n}") for n, x in outside.items()])
    joined = rows.join(parts, F.col("_order_part") == F.col("_order_of"))
    # a minimum from the last row down runs along the reverse order: Spark grows a frame that starts at the first row, but
    # passes over all rows that follow for each row of one that ends at the last
    own = Window.partitionBy("_order_part")
    inside = {n: (F.max(f"_x_{n}").over(own.orderBy("_order_at").rowsBetween(*so_far)) if kind == "max" else F.min(f"_x_{n}").over(own.orderBy(F.desc("_order_at")).rowsBetween(*so_far))) for n, (_, kind) in least.items()}
    values = {n: (F.greatest if kind == "max" else F.least)(inside[n], F.col(f"_o_{n}")) for n, (_, kind) in least.items()}
    return joined.withColumns(values).select(*df.columns, position, total, *least)
