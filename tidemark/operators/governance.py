"""Experiment registry, promotion gates, audit trail and lineage over tables."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import workspace

EXPERIMENTS = "run_id string, ts timestamp, git_commit string, spec_version string, out_dir string, notes string, tags_json string, params_json string, dataset_id string, hypothesis string"
METRICS = "run_id string, metric_name string, metric_value double"
LINEAGE = "artifact_id string, run_instance_id string, run_key string, dataset_id string, artifact_type string, relative_path string, sha256 string, created_at timestamp"
EDGES = "child_artifact_id string, parent_artifact_id string, relation string"
STATUSES = ("exploratory", "candidate", "accepted", "rejected")


def experiments(df: DataFrame, tag: str | None = None, search: str | None = None, limit: int = 200) -> DataFrame:
    """Newest first, optionally with a tag and a text in hypothesis, notes or parameters."""
    if tag:
        df = df.where(F.array_contains(F.from_json("tags_json", "array<string>"), tag))
    if search:
        text = F.lower(F.concat_ws(" ", "run_id", "hypothesis", "notes", "params_json"))
        df = df.where(F.contains(text, F.lit(search.lower())))
    return df.orderBy(F.desc("ts"), "run_id").limit(limit)


def metric_history(metrics: DataFrame, runs: DataFrame, name: str, limit: int = 500) -> DataFrame:
    return metrics.where(F.col("metric_name") == name).join(runs.select("run_id", "ts"), "run_id").orderBy(F.desc("ts"), "run_id").limit(limit).select("run_id", "ts", "metric_value")


def metric_names(metrics: DataFrame) -> DataFrame:
    return metrics.select("metric_name").distinct().orderBy("metric_name")


def run_metrics(metrics: DataFrame, run_id: str) -> DataFrame:
    return metrics.where(F.col("run_id") == run_id).select("metric_name", "metric_value")


def recent(journal: DataFrame, kind: str | None = None, n: int = 100, ts: str = "ts", kind_col: str = "signal") -> DataFrame:
    """The last n rows of a journal, of one kind if given."""
    return (journal.where(F.col(kind_col) == kind) if kind else journal).orderBy(F.desc(ts)).limit(n)


def candidates(table: DataFrame, status: str | None = None, dataset_id: str | None = None, signal: str | None = None, limit: int = 100) -> DataFrame:
    """Candidates of a status, dataset or signal, newest first."""
    for column, value in (("status", status), ("dataset_id", dataset_id), ("signal_name", signal)):
        if value is not None:
            table = table.where(F.col(column) == value)
    return table.orderBy(F.desc("created_at"), "candidate_id").limit(limit)


def new_candidates(runs: DataFrame, keys: tuple[str, ...] = ("dataset_id", "run_id", "signal_name", "horizon", "config_hash")) -> DataFrame:
    """Rows to append as exploratory candidates; the id is a hash of the keys, so that the same candidate
    comes once however often it is made."""
    return runs.dropDuplicates(list(keys)).withColumns({"candidate_id": F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256), 1, 16), "status": F.lit("exploratory")})


def events_of(events: DataFrame, candidate_id: str, ts: str = "created_at") -> DataFrame:
    """The events of one candidate in order of time."""
    return events.where(F.col("candidate_id") == candidate_id).orderBy(ts, "event_type")


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """The names of the checks that fail; a check that is NULL fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))


def gate(candidates: DataFrame, thresholds: dict[str, float], target: str = "accepted") -> DataFrame:
    """Adds decision and reasons from mean_ic, t_stat, n_obs, p_adj, turnover and regime columns.

    A candidate without a coefficient stays exploratory; one that breaks no threshold gets ``target``.
    """
    col = F.col
    known = {
        "ic_mean_min": ("mean IC too small", lambda t: F.abs(col("mean_ic")) >= t),
        "tstat_min": ("t too small", lambda t: F.abs(col("t_stat")) >= t),
        "n_obs_min": ("too few observations", lambda t: col("n_obs") >= t),
        "p_value_max": ("p too large", lambda t: col("p_adj") <= t),
        "turnover_max": ("turnover too large", lambda t: col("turnover") <= t),
        "regime_ic_min": ("IC of the worst regime too small", lambda t: col("worst_regime_ic") >= t),
    }
    bad = reasons([(known[k][0], known[k][1](F.lit(v))) for k, v in thresholds.items()])
    out = candidates.withColumn("reasons", F.when(col("mean_ic").isNull(), F.array(F.lit("no IC"))).otherwise(bad))
    return out.withColumn("decision", F.when(col("mean_ic").isNull(), "exploratory").when(F.size("reasons") == 0, target).otherwise("rejected"))


def eligibility(bundles: DataFrame, level: str, required: tuple[str, ...] = ("run_key", "dataset_id", "engine_version", "config_version", "seed_version")) -> DataFrame:
    """Adds passed and blockers: provenance must be there, and above exploratory the p-value of the family."""
    checks = [(f"{c} is missing", F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))) for c in required]
    if level in ("candidate", "accepted"):
        checks.append(("rc_p_value is missing", F.col("rc_p_value").isNotNull()))
    if level == "accepted":
        checks.append(("rc_p_value above 0.05", F.col("rc_p_value") <= 0.05))
    out = bundles.withColumn("blockers", reasons(checks)).withColumn("level", F.lit(level))
    return out.withColumn("passed", F.size("blockers") == 0)


def promote(candidates: DataFrame, reports: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Candidates with their new status and the events to append; only a passing report of the same level
    promotes, and the event is part of the promotion."""
    if target not in STATUSES:
        raise ValueError(f"unknown status: {target}")
    ok = reports.where((F.col("level") == target) & F.col("passed")).groupBy("candidate_id").agg(F.max("eligibility_report_id").alias("_report"))
    joined = candidates.join(ok, "candidate_id", "left")
    done = F.col("_report").isNotNull()
    new = joined.withColumn("status", F.when(done, F.lit(target)).otherwise(F.col("status"))).drop("_report")
    events = joined.where(done).select("candidate_id", F.lit("promoted").alias("event_type"), F.to_json(F.struct(F.lit(target).alias("status"), F.col("_report").alias("report"))).alias("payload"))
    return new, events


def unsupported(candidates: DataFrame, reports: DataFrame) -> DataFrame:
    """candidate_id of promoted candidates without a passing report of their level: must be empty before a
    write, as a trigger would have it."""
    ok = reports.where("passed").select("candidate_id", F.col("level").alias("status"))
    return candidates.where(F.col("status").isin("candidate", "accepted")).join(ok, ["candidate_id", "status"], "left_anti").select("candidate_id")


def unauditable(candidates: DataFrame, reports: DataFrame, events: DataFrame, lineage: DataFrame) -> DataFrame:
    """Accepted candidates that lack a report, an event or lineage, with what they lack."""
    acc = candidates.where("status = 'accepted'").select("candidate_id", "run_id")
    r = reports.where("passed").select("candidate_id").distinct().withColumn("_r", F.lit(True))
    e = events.select("candidate_id").distinct().withColumn("_e", F.lit(True))
    li = lineage.select(F.col("run_instance_id").alias("run_id")).distinct().withColumn("_l", F.lit(True))
    j = acc.join(r, "candidate_id", "left").join(e, "candidate_id", "left").join(li, "run_id", "left")
    lacks = reasons([("report", F.col("_r")), ("event", F.col("_e")), ("lineage", F.col("_l"))])
    return j.select("candidate_id", lacks.alias("lacks")).where(F.size("lacks") > 0)


def trace(candidates: DataFrame, reports: DataFrame, events: DataFrame, lineage: DataFrame) -> DataFrame:
    """candidate_id, kind, id: the reports, events and artifacts behind each candidate."""
    c = candidates.select("candidate_id", "run_id")
    return (
        c.join(reports, "candidate_id").select("candidate_id", F.lit("report").alias("kind"), F.col("eligibility_report_id").alias("id"))
        .unionByName(c.join(events, "candidate_id").select("candidate_id", F.lit("event").alias("kind"), F.col("event_type").alias("id")))
        .unionByName(c.join(lineage, c["run_id"] == lineage["run_instance_id"]).select("candidate_id", F.lit("artifact").alias("kind"), F.col("artifact_id").alias("id")))
    )


def _forest(spark: SparkSession, own: DataFrame, stretch: int, tile: int) -> DataFrame | None:
    """Ancestors where each node has at most one parent with parents; None if there is a cycle.

    Heights cut every path at multiples of ``stretch``. A node has the rest of its own stretch as rows, and the bottom of
    each whole stretch above it; what a bottom reaches within its stretch is kept once for all nodes below. Nodes with the
    same first bottom are lists of about ``tile``, and so is what a bottom reaches: a pair of lists is one row until tasks
    unfold it, and what is shuffled are lists. Unfolded pairs repeat the second list for each node of the first, in order
    of depth, which files keep in a fraction of a byte. Parents without parents hang on the paths; one that hangs on
    several stretches of a path is taken from the nearest: it is left out of the second list, or of that of a single node.
    """
    root, made = workspace(spark, "lineage"), itertools.count()
    col = F.col

    def put(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(made)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def paths(step: DataFrame, most: int) -> DataFrame:
        """v, a, d and what else the steps (d = 1) hold, up to ``most`` steps, by doubling."""
        last = put(step)
        found, reach = last, 1
        while reach < most:
            leap = last.where(col("d") == reach).select(col("v").alias("a"), col("a").alias("_to"))
            if leap.isEmpty():
                break
            last = put(found.join(leap, "a").withColumns({"a": col("_to"), "d": col("d") + reach}).select(*found.columns))
            found, reach = found.unionByName(last), 2 * reach
        return found

    own = put(own)
    nodes = own.select(col("artifact_id").alias("v")).distinct()
    inner = own.join(nodes.select(col("v").alias("ancestor_id")), "ancestor_id", "left_semi").select(col("artifact_id").alias("v"), col("ancestor_id").alias("p"))
    outer = own.join(nodes.select(col("v").alias("ancestor_id")), "ancestor_id", "left_anti").select(col("artifact_id").alias("a"), col("ancestor_id").alias("t"))
    up = put(nodes.join(inner, "v", "left"))
    at, most, reach = up.select("v", col("p").alias("j"), col("p").isNotNull().cast("int").alias("h")), up.count(), 1
    while not at.where("j is not null").isEmpty():
        if reach > most:
            return None
        far = at.where("j is not null").join(at.select(col("v").alias("j"), col("j").alias("_j"), col("h").alias("_h")), "j")
        at, reach = put(at.where("j is null").unionByName(far.select("v", col("_j").alias("j"), (col("h") + col("_h")).alias("h")))), 2 * reach
    up = put(up.join(at.select("v", (col("h") % stretch).alias("k")), "v"))

    near = paths(up.where("k > 0").select("v", col("p").alias("a"), F.lit(1).alias("d"), "k"), stretch)
    self_ = lambda df: df.select("v", col("v").alias("a"), F.lit(0).alias("d"))
    hang = lambda df: df.join(outer, "a").groupBy("v", "t").agg((F.min("d") + 1).alias("d"))
    within = put(hang(near.select("v", "a", "d").unionByName(self_(up))))
    result = near.select("v", col("a").alias("t"), "d").unionByName(within)

    def dealt(df: DataFrame, by: str, item: str, to: str) -> DataFrame:
        """The rows of each ``by`` dealt to lists of about ``tile``, numbered by ``to``."""
        return df.join(df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / tile).alias("_n")), by).withColumn(to, F.pmod(F.xxhash64(item), col("_n"))).drop("_n")

    tops = put(near.where("d = k").select("v", "a", "k").unionByName(up.where("k = 0").select("v", col("v").alias("a"), "k")))
    first = put(tops.join(up.where("p is not null").select(col("v").alias("a"), col("p").alias("b")), "a").select("v", "b", (col("k") + 1).alias("d")))
    if not first.isEmpty():
        first = put(dealt(first, "b", "v", "g"))
        bottoms = put(first.select(col("b").alias("v")).distinct())
        chain = paths(first.join(bottoms, "v", "left_semi").select("v", col("b").alias("a"), F.lit(1).alias("d")), most)
        chain = put(chain.unionByName(self_(bottoms)).select(col("v").alias("b"), col("a").alias("w"), (col("d") * stretch).alias("e")))
        cover = put(near.select("v", "a", "d").join(bottoms, "v", "left_semi").unionByName(self_(bottoms)))
        hung = put(hang(cover).select(col("v").alias("w"), "t", col("d").alias("q")))
        reached = hung.unionByName(cover.select(col("v").alias("w"), col("a").alias("t"), col("d").alias("q")))
        # what hangs on a nearer stretch: among the whole ones (_x), and on the node's own (_y)
        several = put(outer.join(tops.select(col("v").alias("a"), col("a").alias("_s")), "a").groupBy("t").agg(F.min("_s").alias("_l"), F.max("_s").alias("_m")).where("_l != _m").select("t"))
        shared = hung.join(several, "t", "left_semi")
        nearest = Window.partitionBy("b", "t").orderBy("e")
        out = chain.join(shared, "w").withColumn("_n", F.row_number().over(nearest)).where("_n > 1").groupBy("b", "w").agg(F.collect_set("t").alias("_x"))
        spans = put(chain.join(out, ["b", "w"], "left"))
        own_out = within.select("v", "t").join(several, "t", "left_semi").join(shared.select("w", "t"), "t").join(first, "v").join(chain.select("b", "w"), ["b", "w"])
        odd = put(own_out.groupBy("b", "g", "w", "v", "d").agg(F.collect_set("t").alias("_y")))

        below = first.groupBy("b", "g").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("vs"))
        above = dealt(reached, "w", "t", "c").groupBy("w", "c").agg(F.array_sort(F.collect_list(F.struct("q", "t"))).alias("ts"))
        aside = odd.groupBy("b", "g", "w").agg(F.collect_list("v").alias("_odd"))
        many = spans.join(first.select("b", "g").distinct(), "b").join(aside, ["b", "g", "w"], "left").join(below, ["b", "g"])
        single = odd.join(spans, ["b", "w"]).withColumn("_x", F.array_union(F.coalesce("_x", F.array()), "_y")).withColumn("vs", F.array(F.struct("d", "v")))
        tiles = many.unionByName(single.drop("v", "d", "_y"), allowMissingColumns=True).join(above, "w")
        pairs = chain.join(first.groupBy("b").agg(F.count(F.lit(1)).alias("_b")), "b").join(reached.groupBy("w").agg(F.count(F.lit(1)).alias("_w")), "w").agg(F.sum(col("_b") * col("_w"))).first()[0]
        # a task unfolds some 8 million pairs; the filter within the first inline lets rows go on one by one, where the
        # compiled form would hold all pairs of a row
        tiles = tiles.repartition(max(spark.sparkContext.defaultParallelism, pairs >> 23), "b", "g", "w", "c")
        inside = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
        ts = F.when(col("_x").isNull(), col("ts")).otherwise(F.filter("ts", lambda x: ~inside(col("_x"), x["t"])))
        nodes_of = tiles.select("e", ts.alias("ts"), F.inline(F.filter("vs", lambda x: ~inside(col("_odd"), x["v"]))))
        result = result.unionByName(nodes_of.select("v", (col("e") + col("d")).alias("e"), F.inline("ts")).select("v", "t", (col("e") + col("q")).alias("d")))
    return result.select(col("v").alias("artifact_id"), col("t").alias("ancestor_id"), col("d").cast("int").alias("depth"))


def ancestors(spark: SparkSession, edges: DataFrame, stretch: int = 256, tile: int = 2048) -> DataFrame:
    """artifact_id, ancestor_id, depth over all edges: each ancestor once, at its least depth.

    Where no node has two parents that have parents themselves, and nothing is its own ancestor, those parents form a
    forest, whose paths are put together from stretches (``_forest``). Otherwise paths double: a round takes what is exactly 2^k edges up behind all that is nearer and gives all ancestors up to
    2^(k+1) edges, as rows that are added to those found before; so rounds are as many as the depth has binary
    digits. A pair is found at its least depth first, many ways to one ancestor are one pair, and cycles end.
    """
    pair = ["artifact_id", "ancestor_id"]
    own = edges.select(F.col("child_artifact_id").alias("artifact_id"), F.col("parent_artifact_id").alias("ancestor_id")).where("artifact_id is not null and ancestor_id is not null").distinct()
    if own.join(own.select(F.col("artifact_id").alias("ancestor_id")).distinct(), "ancestor_id", "left_semi").groupBy("artifact_id").count().where("count > 1").isEmpty():
        found = _forest(spark, own, stretch, tile)
        if found is not None:
            return found
    root, schema = workspace(spark, "lineage"), own.withColumn("depth", F.lit(1)).schema
    own.withColumn("depth", F.lit(1)).write.parquet(f"{root}/0")
    written, reach = [f"{root}/0"], 1
    while True:
        # ``found`` has all up to ``reach`` edges, ``leap`` the pairs at exactly so many
        found = spark.read.schema(schema).parquet(*written)
        leap = spark.read.schema(schema).parquet(written[-1]).where(F.col("depth") == reach)
        if leap.isEmpty():
            return found
        up = leap.select(F.col("artifact_id").alias("_from"), F.col("ancestor_id").alias("_to"))
        beyond = found.join(up, F.col("ancestor_id") == F.col("_from")).groupBy("artifact_id", F.col("_to").alias("ancestor_id")).agg((F.min("depth") + reach).cast("int").alias("depth"))
        beyond.join(found.select(*pair), pair, "left_anti").write.parquet(f"{root}/{len(written)}")
        written, reach = [*written, f"{root}/{len(written)}"], 2 * reach


def encoded_cell(c: Column, kind: T.DataType) -> Column:
    """A value as text that only equal values of one kind share, whatever engine writes it.

    null n; text s, its length and itself; booleans b; whole numbers i; decimals m with their scale; dates a in days and
    times t in microseconds since 1970; binaries x in hexadecimal. Floating-point numbers are d, a whole mantissa of 53 bits
    and a power of two, exact; -0.0 is 0, NaN and infinities have names. Arrays and structs hold encoded parts.
    """
    if isinstance(kind, T.StringType):
        text = F.concat(F.lit("s"), F.length(c).cast("string"), F.lit(":"), c)
    elif isinstance(kind, T.BooleanType):
        text = F.when(c, F.lit("b1")).otherwise(F.lit("b0"))
    elif isinstance(kind, T.IntegralType):
        text = F.concat(F.lit("i"), c.cast("string"))
    elif isinstance(kind, T.DecimalType):
        text = F.concat(F.lit("m"), c.cast("string"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        x = c.cast("double")
        size = F.abs(x)
        guess = F.floor(F.log2(F.when(size < float("inf"), size))).try_cast("int")
        e = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
        # two steps, so that the power itself stays in range for the smallest numbers
        mantissa = (x * F.pow(F.lit(2.0), F.floor((52 - e) / 2)) * F.pow(F.lit(2.0), (52 - e) - F.floor((52 - e) / 2))).try_cast("long")
        plain = F.concat(F.lit("d"), mantissa.cast("string"), F.lit("e"), (e - 52).cast("string"))
        text = F.when(F.isnan(x), F.lit("dnan")).when(size == float("inf"), F.when(x > 0, F.lit("dinf")).otherwise(F.lit("d-inf"))).when(x == 0, F.lit("d0e0")).otherwise(plain)
    elif isinstance(kind, T.DateType):
        text = F.concat(F.lit("a"), F.unix_date(c).cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit("t"), F.unix_micros(c.cast("timestamp")).cast("string"))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("x"), F.hex(c))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: encoded_cell(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        text = F.concat(F.lit("{"), F.concat_ws(",", *[encoded_cell(c[f.name], f.dataType) for f in sorted(kind.fields, key=lambda f: f.name)]), F.lit("}"))
    else:
        raise ValueError(f"no encoding of {kind.simpleString()}")
    return F.coalesce(text, F.lit("n"))


def _kind(kind: T.DataType) -> str:
    return "timestamp" if isinstance(kind, T.TimestampNTZType) else kind.simpleString()


def dataset_id(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: a hash of all tables' rows that does not depend on their order or partitioning.

    Each row is hashed as its encoded cells by name of column; a table's hash is made of its schema, the count and two sums of
    row hashes, which tasks add up apart, and equal rows count as often as they occur."""
    out = None
    for name, df in sorted(tables.items()):
        fields = sorted(df.schema.fields, key=lambda f: f.name)
        h = F.sha2(F.concat_ws("|", *[encoded_cell(F.col(f"`{f.name}`"), f.dataType) for f in fields]), 256)
        part = lambda i: F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)"))  # noqa: B023, E731
        one = df.agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(20).alias("b"))
        one = one.select(F.concat_ws("|", F.lit(name), F.lit(",".join(f"{f.name}:{_kind(f.dataType)}" for f in fields)), "n", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("h"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256), 1, 16).alias("dataset_id"))


def backfilled(runs: DataFrame, value: str, column: str = "dataset_id") -> DataFrame:
    return runs.withColumn(column, F.when(F.col(column).isNull() | (F.trim(column) == ""), F.lit(value)).otherwise(F.col(column)))
