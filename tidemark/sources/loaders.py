"""Readers of snapshot, bar and spot tables, JSON payloads, and provider fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.windows import finite
from tidemark.operators.bars import min_bars_filter, resampled_last

#: Names that a caller may ask for; anything else is refused before it reaches a path.
SNAPSHOT_TABLES = ("sol_monitor_snapshots",)
PRICE_COLUMNS = ("dex_price_usd", "price_usd")

SNAPSHOT = "ts timestamp, chain_id string, pair_address string, base_symbol string, quote_symbol string, dex_price_usd double, liquidity_usd double, vol_h24 double"
BARS = "asset string, ts timestamp, open double, high double, low double, close double, log_return double, cum_return double, roll_vol double, liquidity_usd double, vol_h24 double"
TICKS = "asset string, ts timestamp, event_id long, price double, size double"
#: A pair as a market data service lists it.
PAIR = "struct<chainId:string,pairAddress:string,baseToken:struct<symbol:string>,quoteToken:struct<symbol:string>,priceUsd:string,liquidity:struct<usd:double>,volume:struct<h24:double>,dexId:string>"


def pair_id(chain: str = "chain_id", address: str = "pair_address") -> Column:
    return F.concat_ws(":", F.col(chain), F.col(address))


def utc(text: Column) -> Column:
    """A time from ISO text (UTC), NULL where it isn't one."""
    return F.try_to_timestamp(text)


def read_table(spark: SparkSession, root: str, name: str, allowed: tuple[str, ...] | None = None, schema: str | None = None) -> DataFrame:
    """A table of the root folder; an unknown name raises, a missing table is empty where a schema is given."""
    if allowed is not None and name not in allowed:
        raise ValueError(f"unknown table: {name}")
    try:
        return spark.read.parquet(f"{root}/{name}.parquet")
    except Exception as e:
        if schema is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def only(df: DataFrame, pairs: list[tuple] | None, *columns: str) -> DataFrame:
    """Rows whose key is in a list that the caller holds."""
    if pairs is None:
        return df
    keys = df.sparkSession.createDataFrame(pairs, ", ".join(f"{c} string" for c in columns)) if pairs else df.select(*columns).limit(0)
    return df.join(F.broadcast(keys), list(columns), "left_semi")


def snapshots(df: DataFrame, price: str = "dex_price_usd", min_liquidity: float | None = None, min_volume: float | None = None, pairs: list[tuple] | None = None, strict: bool = True, liquidity: str = "liquidity_usd", volume: str = "vol_h24", ts: str = "ts") -> DataFrame:
    """Rows with a time and a positive price; liquidity and volume above (``strict``) or from their bounds."""
    out = df.withColumn(price, finite(F.col(price).try_cast("double"))).where(F.col(ts).isNotNull() & (F.col(price) > 0))
    for column, bound in ((liquidity, min_liquidity), (volume, min_volume)):
        if bound is not None:
            out = out.where(F.col(column) > bound if strict else F.col(column) >= bound)
    return only(out, pairs, "chain_id", "pair_address")


def bars(df: DataFrame, min_bars: int | None = None, assets: list[str] | None = None, close: str = "close", asset: str = "asset") -> DataFrame:
    out = df.where(F.col(close) > 0)
    if assets is not None:
        out = out.where(F.col(asset).isin(assets))
    return min_bars_filter(out, min_bars, asset) if min_bars else out


def spot_series(df: DataFrame, symbol: str, price: str = "price", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """ts, price of one symbol, positive only."""
    return df.where((F.upper(asset) == symbol.upper()) & (F.col(price) > 0)).select(ts, price)


def spot_resampled(df: DataFrame, symbol: str, freq: str = "1h", price: str = "price", asset: str = "asset", ts: str = "ts", tie: str | None = None) -> DataFrame:
    rows = df.where((F.upper(asset) == symbol.upper()) & (F.col(price) > 0))
    return resampled_last(rows, freq, price, asset, ts, tie).select(ts, price)


def with_spot(panel: DataFrame, spot: DataFrame, symbol: str, price: str = "price", value: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """The panel plus the asset <symbol>_spot: returns on the spot's own grid, at the panel's times only."""
    r = F.log(price) - F.lag(F.log(price)).over(Window.orderBy(ts))
    own = spot.select(ts, F.lit(f"{symbol}_spot").alias(asset), r.alias(value))
    times = panel.select(ts).distinct()
    return panel.select(ts, asset, value).unionByName(own.join(times, ts, "left_semi").select(ts, asset, value))


def sane_assets(panel: DataFrame, value: str = "log_return", asset: str = "asset") -> DataFrame:
    """Assets with two finite returns at least and some spread."""
    x = finite(F.col(value))
    return panel.groupBy(asset).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd")).where("n >= 2 and sd > 0").select(asset)


def research_universe(df: DataFrame, spot: DataFrame | None = None, symbol: str = "BTC", min_bars: int = scalars.MIN_BARS, base: str | None = None, quote: str | None = None, value: str = "log_return", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """The returns of a universe: no stable pairs, enough bars, spot added, only assets with sane returns."""
    out = df.where(~scalars.is_stable_pair(F.col(base), F.col(quote))) if base and quote else df
    out = min_bars_filter(out, min_bars, asset).where(F.col(value).isNotNull()).select(ts, asset, value)
    if spot is not None:
        out = with_spot(out, spot, symbol, value=value, asset=asset, ts=ts)
    return out.join(sane_assets(out, value, asset), asset, "left_semi")


def stored_or_derived_returns(df: DataFrame, stored: str = "log_return", close: str = "close", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """An asset's stored returns, or differences of log prices where it has none at all."""
    w = Window.partitionBy(asset)
    own = F.log(close) - F.lag(F.log(close)).over(w.orderBy(ts))
    return df.withColumn(stored, F.when(F.max(F.col(stored).isNotNull()).over(w), F.col(stored)).otherwise(own))


def factor_asset(panel: DataFrame, symbol: str = "BTC", asset: str = "asset") -> DataFrame:
    """The one asset that stands for the market: <symbol>-USD, else <symbol>_spot, else the first that
    carries the symbol."""
    a = F.col(asset)
    rank = F.when(a == f"{symbol}-USD", 0).when(a == f"{symbol}_spot", 1).when(scalars.is_btc_pair(a), 2)
    return panel.select(asset).distinct().withColumn("_k", rank).where("_k is not null").orderBy("_k", asset).limit(1).select(asset)


def latest_per_key(df: DataFrame, *keys: str, by: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key: what an upsert leaves."""
    order = [F.desc(by), *([F.desc(tie)] if tie else [])]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def candle_points(payload: DataFrame, column: str = "payload") -> DataFrame:
    """ts, price, volume, liquidity of the items of a JSON response; price is the close, else the middle of
    open and low, else the open, else 0."""
    item = "array<struct<unixTime:bigint,o:double,h:double,l:double,c:double,v:double,liquidity:double>>"
    body = F.from_json(column, f"success boolean, data struct<items:{item},data:{item}>")
    rows = payload.select(body.alias("b")).where("b.success").select(F.explode(F.coalesce("b.data.items", "b.data.data")).alias("x"))
    price = F.coalesce("x.c", (F.col("x.o") + F.col("x.l")) / 2, "x.o", F.lit(0.0))
    return rows.select(F.timestamp_seconds("x.unixTime").alias("ts"), price.alias("price"), F.col("x.v").alias("volume"), F.col("x.liquidity").alias("liquidity_usd"))


def pair_snapshots(payload: DataFrame, column: str = "payload", ts: str = "ts") -> DataFrame:
    """Typed snapshots of listed pairs: ``pair``, else the first of ``pairs``."""
    body = F.from_json(column, f"pair {PAIR}, pairs array<{PAIR}>")
    p = payload.select(ts, body.alias("b")).select(ts, F.coalesce("b.pair", F.get("b.pairs", 0)).alias("p"))
    price = F.col("p.priceUsd").try_cast("double")
    return p.where(F.col("p").isNotNull()).select(ts, F.col("p.chainId").alias("chain_id"), F.col("p.pairAddress").alias("pair_address"), F.col("p.baseToken.symbol").alias("base_symbol"), F.col("p.quoteToken.symbol").alias("quote_symbol"), price.alias("dex_price_usd"), F.col("p.liquidity.usd").alias("liquidity_usd"), F.col("p.volume.h24").alias("vol_h24"))


def fallback(quotes: DataFrame, priority: list[str], keep_seconds: int = 300, value: str = "price", provider: str = "provider", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """asset, ts, price, provider: of a time's quotes that of the first provider which has one, else the
    last good one if it is not older than ``keep_seconds``."""
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(provider))
    good = F.when(F.col(value) > 0, F.struct(order.alias("o"), F.col(value).alias("v"), F.col(provider).alias("p")))
    best = quotes.where(order > 0).groupBy(asset, ts).agg(F.min(good).alias("g"))
    recent = Window.partitionBy(asset).orderBy(F.unix_seconds(F.col(ts).cast("timestamp"))).rangeBetween(-keep_seconds, 0)
    kept = F.last("g", True).over(recent)
    return best.withColumn("k", kept).select(asset, ts, F.col("k.v").alias(value), F.coalesce("k.p", F.lit("none")).alias(provider), F.col("g").isNull().alias("stale"))
