"""Choice of a universe of pairs: quality reasons, ranking, churn control, persistence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import STABLES
from tidemark.operators import order


def keep_reason(base: Column, quote: Column, liquidity: Column, volume: Column, min_liquidity: float, min_volume: float, quotes: list[str] | None = None, same: bool = True, stable: bool = True) -> Column:
    """accept, or the first rule that a pair breaks."""
    b, q = (F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in (base, quote))
    out = F.when(liquidity.isNull(), "missing liquidity").when(volume.isNull(), "missing volume")
    out = out.when((b == "") | (q == ""), "missing base or quote symbol").when((b == "?") | (q == "?"), "unknown base or quote symbol")
    if same:
        out = out.when(b == q, "base==quote")
    if quotes:
        out = out.when(~q.isin(*[x.upper().strip() for x in quotes]), F.concat(F.lit("quote "), q, F.lit(" not in allowlist")))
    if stable:
        out = out.when(b.isin(*STABLES) & q.isin(*STABLES), "stable/stable pair")
    return out.when(liquidity < min_liquidity, "liquidity below minimum").when(volume < min_volume, "volume below minimum").otherwise("accept")


def ranked(pairs: DataFrame, liquidity: str = "liquidity_usd", volume: str = "vol_h24", label: str = "label", address: str = "pair_address") -> DataFrame:
    """Adds rank: liquidity and volume from the largest, then label and address; see ``order``, which acts at once."""
    return order.numbered(pairs, F.desc_nulls_last(liquidity), F.desc_nulls_last(volume), F.asc(label), F.asc(address)).withColumn("rank", F.col("rank").cast("int"))


def top_pairs(candidates: DataFrame, page: int, min_liquidity: float, min_volume: float, first_by: str | None = None, **rules) -> DataFrame:
    """The first of each address (by ``first_by``) that passes the rules, the ``page`` largest of them."""
    first = candidates
    if first_by:
        first = candidates.withColumn("_rn", F.row_number().over(Window.partitionBy("pair_address").orderBy(first_by))).where("_rn = 1").drop("_rn")
    good = first.where(keep_reason(F.col("base_symbol"), F.col("quote_symbol"), F.col("liquidity_usd"), F.col("vol_h24"), min_liquidity, min_volume, **rules) == "accept")
    return good.orderBy(F.desc_nulls_last("liquidity_usd"), F.desc_nulls_last("vol_h24"), "label", "pair_address").limit(page)


def churn_controlled(previous: DataFrame, new: DataFrame, page: int, max_churn: float, failures: DataFrame | None = None, min_refreshes: int = 0, most_new: int | None = None) -> DataFrame:
    """pair_address, rank, kept: previous pairs that are chosen again or have failed fewer than
    ``min_refreshes`` times, then new ones by rank, at most ceil(previous * max_churn) and ``most_new``, a page in all.

    Both frames have pair_address and rank; a universe is a page of pairs, so its size is counted first.
    """
    n = previous.count()
    if max_churn >= 1 or n == 0:
        return new.orderBy("rank").limit(page).select("pair_address", "rank", F.lit(False).alias("kept"))
    again = previous.join(new.select("pair_address"), "pair_address", "left_semi")
    if failures is not None and min_refreshes >= 1:
        gone = previous.join(new.select("pair_address"), "pair_address", "left_anti").join(failures, "pair_address", "left")
        again = again.select("pair_address", "rank").unionByName(gone.where(F.coalesce("consecutive_failures", F.lit(0)) < min_refreshes).select("pair_address", "rank"))
    kept = again.select("pair_address", "rank", F.lit(True).alias("kept"))
    slots = max(0, min(math.ceil(n * max_churn), page - kept.count(), *([] if most_new is None else [most_new])))
    fresh = new.join(kept.select("pair_address"), "pair_address", "left_anti").orderBy("rank").limit(slots).select("pair_address", "rank", F.lit(False).alias("kept"))
    return kept.unionByName(fresh).orderBy(F.desc("kept"), "rank").limit(page)


def persistence(refreshes: DataFrame, address: str = "pair_address", ts: str = "ts", selected: str = "selected") -> DataFrame:
    """Each row with the number of refreshes in a row, up to it, in which the pair was not selected."""
    w = Window.partitionBy(address).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    marked = refreshes.withColumn("_run", F.sum(F.col(selected).cast("int")).over(w))
    return marked.withColumn("consecutive_failures", F.sum((~F.col(selected)).cast("int")).over(Window.partitionBy(address, "_run").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))).drop("_run")


def churn_log(previous: DataFrame, new: DataFrame, address: str = "pair_address") -> DataFrame:
    """pair_address, action: what was removed and what was added."""
    a, b = previous.select(address), new.select(address)
    return a.join(b, address, "left_anti").withColumn("action", F.lit("remove")).unionByName(b.join(a, address, "left_anti").withColumn("action", F.lit("add")))


def latest_allowlist(allowlist: DataFrame, limit: int = 20, ts: str = "ts") -> DataFrame:
    """Rows of the last refresh by liquidity."""
    last = allowlist.agg(F.max(ts).alias(ts))
    return allowlist.join(F.broadcast(last), ts, "left_semi").orderBy(F.desc_nulls_last("liquidity_usd"), "pair_address").limit(limit)


def allowlist_stats(allowlist: DataFrame, ts: str = "ts") -> DataFrame:
    w = allowlist.agg(F.max(ts).alias("last_ts"), F.count_distinct(ts).alias("n_refreshes"))
    return allowlist.crossJoin(F.broadcast(w)).groupBy("last_ts", "n_refreshes").agg(F.count_if(F.col(ts) == F.col("last_ts")).alias("n_last"))


def churn_verification(allowlist: DataFrame, log: DataFrame, ts: str = "ts", n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Sizes and sources of the last refreshes; actions and reasons of the last one in the log."""
    sizes = allowlist.groupBy(ts).agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source")).orderBy(F.desc(ts)).limit(n)
    last = log.agg(F.max(ts).alias(ts))
    actions = log.join(F.broadcast(last), ts, "left_semi").groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"))
    return sizes, actions
