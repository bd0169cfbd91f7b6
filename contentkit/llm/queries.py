"""Registered queries of the operators, over the whole driver tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentkit.llm import (chat, compact_windows, jaccard_join, pairwise_quality, private_spans, quality_rules, raking, secrets, suffix_dedup, tiling,
                            token_alignment, token_counts, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Labelled rows that the rules are learned from.
MAX_LABELLED = 20_000


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5


def fit_quality(spark: SparkSession, sf_dir: str, docs: DataFrame):
    """The quality model of the labels outside the held-out fold."""
    return pairwise_quality.fit(docs, table(spark, sf_dir, "labels").filter(fold() != 0))


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("label"))
    # The labelled sample of the fit is bounded and so may be broadcast; the rules judge all documents.
    sample = labels.filter("label IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rules = quality_rules.learn(quality_rules.statistics(docs.join(F.broadcast(sample), "doc_id")))
    return quality_rules.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


@query("op3_pairwise_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = pairwise_quality.score_documents(docs.select("doc_id", "text"), fit_quality(spark, sf_dir, docs)).drop("text")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= pairwise_quality.CUT).cast("int").alias("predicted"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_compact_windows")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passage_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op6_secret_battery")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs, secrets.fit_battery(docs)))


@query("op7_ngram_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), jaccard_join.Rule(3, 90))
    return found.withColumnRenamed("id", "doc_id")


@query("op8_string_tiling")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiling.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_leaked", "best_item", "best_coverage", (F.col("n_leaked") > 0).alias("contaminated"))


#: What the corpus is mixed to: languages by explicit shares, sources and topics evened out.
MIXTURE = raking.Mixture(targets={"lang": {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}})


def mixed(measured: DataFrame, mix: raking.Mixture) -> DataFrame:
    """The sampled rows of measured documents, with topic and keep_probability."""
    statistics = F.col("_statistics")
    topics = raking.topic(F.col("_statistics"), raking.fit_topics(measured, measured=statistics), measured=statistics)
    return raking.sample_mixture(measured.withColumn("topic", topics), mix, F.col("_n_tokens"), chance=F.col("_chance"))


@query("op9_source_mixture")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    docs = raking.measure(docs, raking.word_count(F.col("text")), MIXTURE, keep=["doc_id", "source", "lang"])
    kept = mixed(docs, MIXTURE)
    return kept.select("doc_id", "source", "lang", "topic", F.col("_n_tokens").alias("n_tokens"), "keep_probability")


@query("op10_chat_repair")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.link_report(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.component_report(vectors, whitening.fit(vectors))


@query("op13_private_spans")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return private_spans.digest(private_spans.scan(docs, private_spans.fit(docs)))
