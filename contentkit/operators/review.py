"""Review of extracted records and their way into the catalog (F14, S6 for extracted rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentkit.functions.variants import overlay
from contentkit.operators.skew import one_per_key
from contentkit.records import DEFAULT_CATEGORY, RECORD_COLUMNS, RECORD_SCHEMA_VERSION, is_category


def review_decisions(extracted: DataFrame, decisions: DataFrame, pending_to: str | None = None) -> DataFrame:
    """apply decisions by record id; *pending_to* is a bulk decision for what is still pending.

    *decisions*: record_id, status, name, category, notes (nulls keep the extracted value).  Of several decisions on a record
    the one with the greatest values counts, or the last one by a column ``ord`` if there is one.
    """
    order = (["ord"] if "ord" in decisions.columns else []) + ["status", "name", "category", "notes"]
    decisions = one_per_key(decisions.select("record_id", *order), ["record_id"], order)
    d = decisions.select(
        "record_id", F.col("status").alias("_status"), F.col("name").alias("_name"),
        F.col("category").alias("_category"), F.col("notes").alias("_notes"))
    joined = extracted.join(d, "record_id", "left")
    status = F.coalesce("_status", "status")
    if pending_to:
        status = F.when(status == "pending", pending_to).otherwise(status)
    return joined.withColumns({
        "status": status,
        "name": F.coalesce("_name", "name"),
        "category": F.coalesce("_category", "category"),
        "notes": F.coalesce("_notes", "notes"),
    }).select(*extracted.columns)


def accepted_records(reviewed: DataFrame, run_time: str, text: str = "text") -> DataFrame:
    """accepted and edited rows as catalog records; the source text is kept as ``_rawText``."""
    kept = reviewed.filter(F.col("status").isin("accepted", "edited"))
    raw = F.to_variant_object(F.create_map(F.lit("_rawText"), F.col(text).cast("variant")))
    return kept.select(
        "ord",
        F.col("record_id").alias("id"),
        "name",
        F.when(is_category(F.col("category")), F.col("category")).otherwise(DEFAULT_CATEGORY).alias("category"),
        "source_book", "publisher",
        F.lit("").alias("author"),
        F.col("page_number").cast("bigint").alias("page_number"),
        F.col("auto_tags").alias("tags"),
        "notes",
        overlay(F.col("structured_data"), raw).alias("raw_content"),
        F.to_timestamp(F.lit(run_time)).alias("imported_date"),
        F.lit("txt").alias("import_method"),
        F.lit(RECORD_SCHEMA_VERSION).alias("schema_version"),
    ).select(*RECORD_COLUMNS)
