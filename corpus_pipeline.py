"""A corpus from documents: quality, near duplicates, benchmark leaks, secrets, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentkit.llm import jaccard_join, pairwise_quality, raking, secrets, tiling
from contentkit.llm.queries import MIXTURE, fit_quality, mixed, table
from contentkit.llm.storage import stage

#: The learned, hashed and tiled decisions of the stages have no counterpart in SQL; tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise classifier does not reject; null and empty texts are scored as any other, repeated rows alike."""
    return pairwise_quality.drop_rejected(docs, fit_quality(spark, sf_dir, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of every group linked by five-word shingles at a similarity of 0.8 or more.

    Null and blank texts link with nothing and stay; of rows that repeat an id one stays; rows without an id stay.
    """
    return jaccard_join.keep_one_per_group(docs, jaccard_join.Rule(5, 80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in whatever order of its passages; null texts stay, an empty benchmark drops nothing."""
    return tiling.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows the new text, null texts stay null."""
    clean = secrets.redact(docs, secrets.fit_battery(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked mixture, with topic and the probability of having been kept.

    Null sources, languages and topics are values of their own; rows that repeat are kept or dropped together.
    """
    own = [c for c in docs.columns if c not in ("topic", "keep_probability")]
    measured = raking.measure(docs, raking.word_count(F.col("text")), MIXTURE, keep=own)
    return mixed(measured, MIXTURE).select(*own, "topic", "keep_probability")


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
    ("hide_secrets", hide_secrets), ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), name)
    return docs
