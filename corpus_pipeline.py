"""The corpus pipeline: documents through quality rules, near-duplicate removal, pseudonyms, mixing, packing.

Each stage takes all that the one before it kept, as Parquet in the shared folder. The last returns
the pieces of the packed sequences. Null and empty texts fail the quality rules, so that later stages
of a run see texts with words only; each stage alone takes them, as its operator says. Rows with
repeated or null ids are rows of their own, other columns pass through, and an empty table of
documents gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_dups, packing, pii, quality
from tidemark.llm.common import Scratch, table
from tidemark.session import ready


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weighted rules reject."""
    ready(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    ready(spark)
    return near_dups.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows where the table has it."""
    ready(spark)
    out = pii.pseudonymise(docs, pii.KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Uses each document as often as the target weights of the domains ask for."""
    ready(spark)
    return mixing.remix(docs, table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts and packs the tokenised documents into sequences."""
    ready(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_dedup),
    ("pseudonyms", pseudonyms),
    ("mixing", mix),
    ("packing", pack),
]

#: No SQL: label model, signatures, classifier and tokenizer are beyond it. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = scratch.put(out, name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        before = docs
