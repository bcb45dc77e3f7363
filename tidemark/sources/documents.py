"""Folders of JSON documents whose fields change from writer to writer: manifests, bundles, evidence.

Documents are parsed to VARIANT, so that no schema is inferred or fixed; what cannot be parsed is a row too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of a manifest: name -> path and kind.
MANIFEST = {"run_id": ("$.run_id", "string"), "created_utc": ("$.created_utc", "string"), "name": ("$.name", "string"), "git_commit": ("$.git_commit", "string"), "spec_version": ("$.spec.research_spec_version", "string")}
#: Fields of evidence of execution.
EVIDENCE = {"min_liquidity_usd": ("$.min_liquidity_usd", "double"), "max_participation_rate": ("$.max_participation_rate", "double"), "spread_model": ("$.spread_model", "string"), "impact_model": ("$.impact_model", "string"), "notes": ("$.notes", "string")}


def documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """path, document, corrupt: each file, or with ``lines`` each line, that matches the path.

    ``document`` is NULL where the text is no JSON value, and ``corrupt`` then has the text. An empty
    file is corrupt; a folder without files gives no rows.
    """
    try:
        text = spark.read.text(path, wholetext=not lines)
    except Exception as e:  # a folder that is not there has no documents
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType()), T.StructField("document", T.VariantType()), T.StructField("corrupt", T.StringType())]))
    return parsed(text.select(F.col("_metadata.file_path").alias("path"), "value"))


def parsed(texts: DataFrame) -> DataFrame:
    """path, document, corrupt of texts (path, value) that are stored many in a file, as small documents should be: each file
    of its own costs a folder, a rename by the driver and a task's opening."""
    document = F.try_parse_json("value")
    return texts.select("path", document.alias("document"), F.when(document.isNull(), F.col("value")).alias("corrupt"))


def field(document: Column | str, path: str, kind: str) -> Column:
    """A field of a document, NULL where it is missing or of another kind."""
    return F.try_variant_get(document, path, kind)


def fields(docs: DataFrame, named: dict[str, tuple[str, str]]) -> DataFrame:
    return docs.withColumns({n: field("document", p, k) for n, (p, k) in named.items()})


def manifests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """run_id, created_utc, name, git_commit, spec_version, outputs, path, corrupt: one row for each manifest.

    ``outputs`` are the names of the outputs in order, joined by a comma; what the document calls outputs as a
    list or a text stays as it is written. Damaged documents have only path and corrupt."""
    docs = fields(documents(spark, path, lines), MANIFEST)
    as_map = F.try_variant_get("document", "$.outputs", "map<string,variant>")
    as_text = F.coalesce(F.try_variant_get("document", "$.outputs", "string"), F.to_json(F.try_variant_get("document", "$.outputs", "variant")))
    any_ = F.try_variant_get("document", "$.outputs", "variant")
    named = F.coalesce(F.array_join(F.array_sort(F.map_keys(as_map)), ", "), as_text)
    outputs = F.when(any_.isNotNull() & ~F.is_variant_null(any_), named).otherwise(F.when(F.col("document").isNotNull(), F.lit("")))
    return docs.select("run_id", "created_utc", "name", "git_commit", F.when(F.col("document").isNotNull(), F.coalesce("spec_version", F.lit(""))).alias("spec_version"), outputs.alias("outputs"), "path", "corrupt")


def resolved(path: Column, base: Column) -> Column:
    """A path as it is if it has a root or a scheme, else below the base."""
    return F.when(path.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?/"), path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, r"^(\./)+", "")))


def evidence(candidates: DataFrame, docs: DataFrame, kinds: dict[str, dict[str, tuple[str, str]]], base: Column, id_col: str = "candidate_id", json: str = "evidence_json") -> DataFrame:
    """candidate_id, kind, path, found, fields: what each candidate's evidence points at, and what it says.

    ``json`` holds a document whose fields, one for each of ``kinds``, name other documents; those are among ``docs``
    (``documents`` of their folders). Paths meet by an equality, so candidates and documents may both be many. A field that
    is missing gives no row, a document that is missing or damaged a row that is not found.
    """
    parsed = candidates.select(F.col(id_col).alias("candidate_id"), base.alias("_base"), F.try_parse_json(json).alias("_e"))
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.try_variant_get("_e", f"$.{k}", "string").alias("_p")) for k in kinds])
    asked = parsed.select("candidate_id", "_base", F.inline(named)).where("_p is not null and trim(_p) <> ''").select("candidate_id", "kind", resolved(F.col("_p"), F.col("_base")).alias("path"))
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    there = docs.select(bare(F.col("path")).alias("_path"), "document")
    met = asked.join(there, bare(F.col("path")) == F.col("_path"), "left")
    every = {n: pk for f in kinds.values() for n, pk in f.items()}
    values = {n: F.when(F.col("kind").isin(*[k for k, f in kinds.items() if n in f]), field("document", *pk)) for n, pk in every.items()}
    return met.select("candidate_id", "kind", "path", F.col("document").isNotNull().alias("found"), *[v.alias(n) for n, v in values.items()])
