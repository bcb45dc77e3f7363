"""Writers: appends, keyed overwrites, stable CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import finite


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities of double columns as NULL."""
    return df.withColumns({c: finite(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def append(df: DataFrame, path: str, *partition: str) -> None:
    nulls_for_nan(df).write.mode("append").partitionBy(*partition).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, *partition: str) -> None:
    """Replaces only the partitions that the rows belong to."""
    nulls_for_nan(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def merged(old: DataFrame, new: DataFrame, *keys: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """What an upsert by key leaves: new rows over old ones, ``keep`` columns as the old row has them.

    Of several new rows for a key the one with the greatest other values stays, so the result does not
    depend on order."""
    rest = [c for c in new.columns if c not in keys]
    newest = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in rest]))).where("_rn = 1").drop("_rn")
    o, n = old.alias("o"), newest.alias("n")
    hit = F.col(f"n.{keys[0]}").isNotNull()
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keys or c in keep else F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def stable_csv(df: DataFrame, path: str, *order: str) -> None:
    """One sorted file with a header, for results that a person reads."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def provenance(df: DataFrame, provider: str, fetched_at, status: str = "OK", price: str = "price") -> DataFrame:
    """Adds provider and quality columns; rows that are invalid while the provider is down go."""
    ok = F.coalesce(F.col(price) > 0, F.lit(False))
    out = df.withColumns({"provider_name": F.lit(provider), "fetched_at": F.lit(fetched_at).cast("timestamp"), "quality_status": F.when(ok, F.lit("OK")).otherwise(F.lit("BAD"))})
    return out.where(ok) if status == "DOWN" else out


def provider_health(events: DataFrame, threshold: int = 3, cooldown_seconds: int = 60, provider: str = "provider", ok: str = "ok", ts: str = "ts") -> DataFrame:
    """One row per provider after all its calls: failures in a row, last success, state.

    OPEN after ``threshold`` failures in a row, HALF_OPEN once ``cooldown_seconds`` have passed since the
    last of them by the newest event of any provider."""
    w = Window.partitionBy(provider).orderBy(F.desc(ts))
    seen = events.withColumn("_good", F.sum(F.col(ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    now = events.agg(F.max(ts).alias("_now"))
    per = seen.groupBy(provider).agg(F.count_if((F.col("_good") == 0) & ~F.col(ok)).alias("fail_count"), F.max(F.when(F.col(ok), F.col(ts))).alias("last_ok_at"), F.max(F.when(~F.col(ok), F.col(ts))).alias("_bad"))
    open_ = F.col("fail_count") >= threshold
    rested = F.unix_seconds("_now") - F.unix_seconds("_bad") >= cooldown_seconds
    return per.crossJoin(F.broadcast(now)).select(provider, "fail_count", "last_ok_at", F.when(open_ & rested, "HALF_OPEN").when(open_, "OPEN").otherwise("CLOSED").alias("state"))
