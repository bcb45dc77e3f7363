"""Ticks to hourly bars as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.scalars import interval

MESSAGE = "channel string, timestamp string, events array<struct<type:string, tickers:array<struct<product_id:string, price:string, volume_24_h:string>>, trades:array<struct<product_id:string, price:string, size:string, time:string, trade_id:string>>>>"


def read_ticks(spark: SparkSession, path: str, schema: str = "asset string, ts timestamp, event_id long, price double, size double", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def from_messages(messages: DataFrame, value: str = "value", arrived: Column | None = None) -> DataFrame:
    """asset, ts, price, size of the trades in JSON messages: positive prices, no negative sizes; a trade
    without a time has that of the message, else that of its arrival."""
    m = messages.select(F.from_json(F.col(value).cast("string"), MESSAGE).alias("m"), (arrived if arrived is not None else F.current_timestamp()).alias("_at"))
    e = m.select("m.timestamp", "_at", F.explode("m.events").alias("e"))
    t = e.select("timestamp", "_at", F.explode("e.trades").alias("t"))
    price, size = F.col("t.price").try_cast("double"), F.coalesce(F.col("t.size").try_cast("double"), F.lit(0.0))
    return t.select(F.col("t.product_id").alias("asset"), F.coalesce(F.try_to_timestamp("t.time"), F.try_to_timestamp("timestamp"), "_at").alias("ts"), F.col("t.trade_id").alias("event_id"), price.alias("price"), F.greatest(size, F.lit(0.0)).alias("size")).where("price > 0")


def streaming_bars(ticks: DataFrame, freq: str = "1h", watermark: str = "10 minutes", tie: str = "event_id") -> DataFrame:
    """Open, high, low, close and volume by event time. A bar comes out once its interval is behind the
    watermark; ticks later than that are dropped, so a closed bar is never replaced by a part of it."""
    key = F.struct("ts", tie)
    w = ticks.where("price > 0").withWatermark("ts", watermark).groupBy(F.window("ts", interval(freq)), "asset")
    agg = w.agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n_ticks"))
    return agg.select("asset", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "n_ticks")


def sliding_volatility(ticks: DataFrame, freq: str = "1h", slide: str = "15 minutes", watermark: str = "10 minutes") -> DataFrame:
    w = ticks.where("price > 0").withWatermark("ts", watermark).groupBy(F.window("ts", interval(freq), slide), "asset")
    return w.agg(F.stddev_samp(F.log("price")).alias("log_price_sd"), F.count(F.lit(1)).alias("n_ticks")).select("asset", F.col("window.start").alias("ts"), "log_price_sd", "n_ticks")


def health(ticks: DataFrame, name: str = "ticks") -> DataFrame:
    """The stream with counters that a listener finds in its progress."""
    return ticks.observe(name, F.count(F.lit(1)).alias("n_ticks"), F.count_if(F.col("price") <= 0).alias("n_bad"), F.max("ts").alias("last_event"))


def write_bars(bars: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch replaces its own partition, so that a batch that runs twice leaves one copy."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(upsert)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


BAR = "asset string, ts timestamp, open double, high double, low double, close double, volume double, n_ticks long"


def arrival_bars(ticks: DataFrame, seconds: int = 3600, watermark: str = "10 minutes", arrival: str = "event_id") -> DataFrame:
    """Bars whose open and close are the first and last tick to arrive, not the earliest and latest by event time.

    The state of an asset is its open bars. Each has a timer at its end by event time; when the watermark passes
    it, the bar comes out once and its state goes. Ticks behind the watermark are dropped, as are those
    of a bar that is out already. ``arrival`` orders the
    ticks of one batch. Needs the RocksDB state store (``state_store``).
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    width = seconds * 1000

    class OpenBars(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.bars = handle.getMapState("bars", "start long", "open double, high double, low double, close double, volume double, n long")

        def handleInputRows(self, key, rows, timerValues):
            behind = timerValues.getCurrentWatermarkInMs()
            fresh = {}  # the bars of this batch, whose ticks come in parts that are in no order
            for part in rows:
                part["start"] = part["ms"] // width * width
                part = part[part["start"] + width > behind].sort_values("arrival", kind="stable")
                g = part.groupby("start")
                sums = g.agg(first=("arrival", "first"), open=("price", "first"), high=("price", "max"), low=("price", "min"), last=("arrival", "last"), close=("price", "last"), volume=("size", "sum"), n=("price", "size"))
                for start, *new in sums.itertuples():
                    old = fresh.get(start)
                    if old is not None:
                        opened, closed = (old if old[0] <= new[0] else new), (new if new[4] >= old[4] else old)
                        new = [*opened[:2], max(old[2], new[2]), min(old[3], new[3]), *closed[4:6], old[6] + new[6], old[7] + new[7]]
                    fresh[start] = new
            for start, (_, first, high, low, _, last, size, count) in fresh.items():
                at = (int(start),)
                if self.bars.containsKey(at):
                    o, h, lowest, _, v, n = self.bars.getValue(at)
                    new = (o, max(h, high), min(lowest, low), last, v + size, n + count)
                else:
                    new = (first, high, low, last, size, count)
                    self.handle.registerTimer(int(start) + width)
                self.bars.updateValue(at, (*map(float, new[:5]), int(new[5])))
            yield pd.DataFrame()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            start = expiredTimerInfo.getExpiryTimeInMs() - width
            if self.bars.containsKey((start,)):
                o, h, low, c, v, n = self.bars.getValue((start,))
                self.bars.removeKey((start,))
                yield pd.DataFrame({"asset": [key[0]], "ts": [pd.Timestamp(start, unit="ms")], "open": [o], "high": [h], "low": [low], "close": [c], "volume": [v], "n_ticks": [n]})
            else:
                yield pd.DataFrame()

        def close(self) -> None:
            pass

    rows = ticks.where("price > 0").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    rows = rows.select("asset", "ts", F.unix_millis("ts").alias("ms"), "price", F.coalesce("size", F.lit(0.0)).alias("size"), F.col(arrival).alias("arrival"))
    return rows.groupBy("asset").transformWithStateInPandas(OpenBars(), BAR, "append", "eventtime")


def state_store(spark: SparkSession) -> SparkSession:
    """The state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commit(spark: SparkSession, root: str, batch_id: int) -> None:
    """A file that says a batch is whole: it is named at once, by a rename, or not at all."""
    new, fs = _file_system(spark, f"{root}/commits/.{batch_id}")
    fs.mkdirs(new.getParent())
    fs.create(new, True).close()
    done, _ = _file_system(spark, f"{root}/commits/{batch_id}")
    if not fs.exists(done):
        fs.rename(new, done)


def run_cycle(batch: DataFrame, batch_id: int, root: str, needed: str = "SOL") -> bool:
    """One poll: spot prices, and pairs if the needed spot price is there; False where it isn't.

    Both tables are written before the batch is committed, and ``cycle_rows`` reads committed batches alone: a crash
    between the writes shows nothing of the cycle, and a batch that runs again replaces what it wrote before.
    """
    spot = batch.where("kind = 'spot' and price > 0")
    ok = not spot.where(F.col("asset") == needed).isEmpty()
    for name, rows in (("spot", spot), ("pair", batch.where("kind = 'pair'") if ok else batch.limit(0))):
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
    _commit(batch.sparkSession, root, batch_id)
    return ok


def cycle_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of one of a cycle's tables, of whole cycles alone, with their ``batch``."""
    path, fs = _file_system(spark, f"{root}/commits")
    done = sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if not f.getPath().getName().startswith(".")) if fs.exists(path) else []
    if not done:
        raise ValueError(f"no whole cycle in {root}")
    return spark.read.option("basePath", f"{root}/{name}").parquet(*[f"{root}/{name}/batch={b}" for b in done])
