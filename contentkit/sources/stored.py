"""Tolerant loading of stored records and lineage metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.functions.variants import type_of
from contentkit.records import (
    DEFAULT_CATEGORY,
    IMPORT_METHODS,
    METADATA_SCHEMA_VERSION,
    RECORD_COLUMNS,
    RECORD_SCHEMA_VERSION,
    is_category,
    record_id,
)


def _typed(value: str, key: str, kind: str, read_as: str) -> Column:
    """The value of a key when it has the wanted JSON type, else null."""
    v = F.try_variant_get(value, f"$.{key}", "variant")
    return F.when(type_of(v) == kind, F.try_variant_get(value, f"$.{key}", read_as))


def normalize_stored_records(stored: DataFrame, run_time: str, value: str = "value", order: str = "ord") -> DataFrame:
    """VARIANT objects to catalog records; every wrong or missing field gets its default.

    Rows that are not objects are dropped.
    """

    def text(key: str, fallback: str) -> Column:
        return F.coalesce(_typed(value, key, "string", "string"), F.lit(fallback))

    category, method = text("category", ""), text("importMethod", "")
    raw = F.try_variant_get(value, "$.rawContent", "variant")
    kept = stored.filter(type_of(F.col(value)) == "object")
    return kept.select(
        F.col(order).alias("ord"),
        F.coalesce(_typed(value, "id", "string", "string"), record_id(F.col(order).cast("string"), F.to_json(value))).alias("id"),
        text("name", "Unknown").alias("name"),
        F.when(is_category(category), category).otherwise(DEFAULT_CATEGORY).alias("category"),
        text("sourceBook", "").alias("source_book"),
        text("publisher", "").alias("publisher"),
        text("author", "").alias("author"),
        F.coalesce(_typed(value, "pageNumber", "number", "double").cast("bigint"), F.lit(0)).alias("page_number"),
        F.coalesce(_typed(value, "tags", "array", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        text("notes", "").alias("notes"),
        F.coalesce(F.when(type_of(raw).isin("object", "array"), raw), F.parse_json(F.lit("{}"))).alias("raw_content"),
        F.coalesce(F.try_to_timestamp(text("importedDate", "")), F.to_timestamp(F.lit(run_time))).alias("imported_date"),
        F.when(method.isin(IMPORT_METHODS), method).otherwise("json").alias("import_method"),
        text("schemaVersion", RECORD_SCHEMA_VERSION).alias("schema_version"),
    ).select(*RECORD_COLUMNS)


def normalize_metadata(df: DataFrame, run_time: str, value: str = "metadata", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lineage metadata objects with ``Unknown`` defaults; rows without an object are dropped."""

    def text(key: str, fallback: str) -> Column:
        return F.coalesce(_typed(value, key, "string", "string"), F.lit(fallback))

    return df.filter(type_of(F.col(value)) == "object").select(
        *keep,
        text("sourceBook", "Unknown").alias("source_book"),
        text("publisher", "Unknown").alias("publisher"),
        text("author", "").alias("author"),
        F.coalesce(_typed(value, "pageNumber", "number", "double").cast("bigint"), F.lit(0)).alias("page_number"),
        text("importDate", run_time).alias("import_date"),
        text("notes", "").alias("notes"),
        F.coalesce(_typed(value, "tags", "array", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.try_variant_get(value, "$.contentType", "string"), F.lit(DEFAULT_CATEGORY)).alias("content_type"),
        text("schemaVersion", METADATA_SCHEMA_VERSION).alias("schema_version"),
    )
