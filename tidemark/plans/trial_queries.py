"""Queries on identities and resampling, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import identity
from tidemark.operators import inference
from tidemark.plans import inputs, scan
from tidemark.plans.catalog import _BOOT, SQL, WIDE, _series, query, rounded

# --- identities and small facts -----------------------------------------------------------------

_PAYLOAD = """'{"family":"' || n_name || '","region":' || n_regionkey || ',"window":' || (n_nationkey % 4) || '}'"""


@query(
    "run_identities",
    f"""with d as (select n_nationkey, sha256({_PAYLOAD})[1:16] as run_id from nation)
 select n_nationkey, run_id, 'fctr_' || run_id as factor_run_id, 'rgm_' || run_id as regime_run_id, (('0x' || sha256(run_id || '|null|1')[1:16])::ubigint % 9223372036854775808)::bigint as seed from d""",
)
def run_identities(spark: SparkSession, sf: str) -> DataFrame:
    n = inputs.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("family"), F.col("n_regionkey").alias("region"), (F.col("n_nationkey") % 4).alias("window"))
    d = n.withColumn("run_id", identity.digest_of("window", "family", "region"))
    return d.select("n_nationkey", "run_id", F.concat(F.lit("fctr_"), "run_id").alias("factor_run_id"), F.concat(F.lit("rgm_"), "run_id").alias("regime_run_id"), identity.seed_of("run_id", "null").alias("seed"))


@query(
    "search_warnings",
    """select p_partkey, 'Tested: ' || p_partkey % 23 || ' signals, ' || p_size % 9 || ' portfolios.' || case when greatest(p_partkey % 23, p_size % 9) > 5 then ' Deflate the Sharpe ratio, test out of sample, trust no single best result.' else '' end
 || case when greatest(p_partkey % 23, p_size % 9) > 20 then ' Adjust p-values for the number of tests, or report medians over variants.' else '' end as warning from part""",
)
def search_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "part").select("p_partkey", inference.search_warning(F.col("p_partkey") % 23, F.col("p_size") % 9).alias("warning"))


@query(
    "sensitivity",
    f"with {WIDE} select lookback, least_return, count(*) as n, round(avg(case when log_return > least_return then log_return / lookback end), 6) as mean_gain, count_if(log_return > least_return) as n_hits from wide, (select unnest([1, 6, 24]) as lookback), (select unnest([-0.5, 0.0, 0.5]::double[]) as least_return) where log_return is not null group by 1, 2",
)
def sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    w = inputs.wide(spark, sf).where("log_return is not null")
    hit = F.col("log_return") > F.col("least_return")
    return rounded(scan.sensitivity(w, {"lookback": [1, 6, 24], "least_return": [-0.5, 0.0, 0.5]}, n=F.count(F.lit(1)), mean_gain=F.avg(F.when(hit, F.col("log_return") / F.col("lookback"))), n_hits=F.count_if(hit)))


@query(
    "break_diagnostics",
    f"""select series, 'cusum' as test, round(stat, 5) as stat, p_value, break_suspected from ({SQL['cusum_breaks']}) union all
 select series, 'sup_chow', stat, p_value, coalesce(p_value < 0.05, false) from (select distinct event_type as series from events where value > 0) left join ({SQL['sup_chow_breaks']}) using (series)""",
)
def break_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.break_diagnostics(_series(spark, sf)).withColumn("stat", F.round("stat", 5)))


# --- resampling ---------------------------------------------------------------------------------


@query("bootstrap_paths", f"with {_BOOT} select sim, round(total_return, 5) as total_return, round(sharpe, 6) as sharpe from bs")
def bootstrap_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = inputs.returns(spark, sf).where("asset = 'click' and log_return is not null").select("ts", (F.col("log_return") / 20).alias("pnl"))
    n = p.count()
    return rounded(inference.bootstrap_pnl(p, 200, 42, "block_fixed", max(20.0, n**0.5)).withColumn("total_return", F.round("total_return", 5)))
