"""Converting records to target documents with lineage."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.functions.scalars import compact
from contentkit.operators.plan import compute_once
from contentkit.plans.conversion_packs import PACKS, Source, journal_page
from contentkit.records import LINEAGE_SCHEMA_VERSION, category_map

Pack = Callable[[Source], dict]
NO_TEXTS = "array<string>"


def nest(value) -> Column:
    """Nested dicts and lists of columns or literals as one struct expression; numbers are doubles."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dict):
        return F.struct(*[nest(v).alias(k) for k, v in value.items()])
    if isinstance(value, list):
        return F.array(*[nest(v) for v in value]) if value else F.array().cast(NO_TEXTS)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.lit(float(value))
    return F.lit(value)


def lineage(run_time: str) -> Column:
    """P10: where a document came from; one run time for the whole run."""
    return F.struct(
        F.coalesce("source_book", F.lit("")).alias("sourceBook"),
        F.coalesce("publisher", F.lit("")).alias("publisher"),
        F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("page_number", F.lit(0)).cast("bigint").alias("pageNumber"),
        F.lit(run_time).alias("importDate"),
        F.col("id").alias("recordId"),
        F.coalesce("tags", F.array().cast(NO_TEXTS)).alias("tags"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("import_method", F.lit("json")).alias("importMethod"),
        F.lit(LINEAGE_SCHEMA_VERSION).alias("schemaVersion"),
    )


def attach_lineage(records: DataFrame, run_time: str) -> DataFrame:
    return records.withColumn("lineage", lineage(run_time))


def conversion_warnings() -> Column:
    """Missing source book, publisher and page number; journals need no page."""
    return compact(
        F.when(F.coalesce("source_book", F.lit("")) == "", "Missing source book."),
        F.when(F.coalesce("publisher", F.lit("")) == "", "Missing publisher."),
        F.when((F.col("category") != "journal") & (F.coalesce("page_number", F.lit(0)) <= 0), "Missing page number."),
    )


def unpacked(records: DataFrame, payload: str = "raw_content") -> DataFrame:
    """Records with the helper columns the packs read."""
    return compute_once(compute_once(records, **Source.unpack(F.col(payload))), **Source.numbers())


@lru_cache(maxsize=256)
def _standard_system(category: str, payload: str, context: int) -> Column:
    """The system struct of a standard pack, built once per Spark context."""
    return nest(PACKS[category](Source(payload)))


def system_struct(category: str, payload: str = "raw_content", packs: Mapping[str, Pack] | None = None) -> Column:
    """The ``system`` struct of one category over unpacked records."""
    if packs and category in packs:
        return nest(packs[category](Source(payload)))
    return _standard_system(category, payload, id(SparkContext._active_spark_context))


def convert_category(
    records: DataFrame, category: str, payload: str = "raw_content", packs: Mapping[str, Pack] | None = None
) -> DataFrame:
    """P11 for one category: adds the typed ``system`` struct."""
    rows = unpacked(records.filter(F.col("category") == category), payload)
    system = system_struct(category, payload, packs)
    return rows.withColumn("system", system).drop("_texts", "_numbers")


def no_converter(category: Column) -> Column:
    return F.concat(F.lit('No converter registered for category "'), F.coalesce(category, F.lit("")), F.lit('".'))


def convert_records(
    records: DataFrame, run_time: str, packs: Mapping[str, Pack] | None = None, payload: str = "raw_content"
) -> DataFrame:
    """One pass over mixed categories; each row evaluates only its own category's pack.

    Adds document_type, pack_id, sub_type, ``system`` (VARIANT, null for journals), ``pages``
    (journals only), ``lineage``, ``warnings`` and ``errors``.  A category without a pack gets an
    error and no document.  Pass *packs* to add or override packs.
    """
    chosen = list(dict.fromkeys([*PACKS, *(packs or {})]))
    source = Source(payload)
    system = None
    for category in chosen:
        cond = F.col("category") == category
        built = F.to_variant_object(system_struct(category, payload, packs))
        system = F.when(cond, built) if system is None else system.when(cond, built)
    is_journal = F.col("category") == "journal"
    known = F.col("category").isin([*chosen, "journal"])
    page = F.array(nest(journal_page(source)))
    return unpacked(records, payload).withColumns({
        "document_type": F.try_element_at(category_map("document_type"), F.col("category")),
        "pack_id": F.coalesce(F.try_element_at(category_map("pack"), F.col("category")), F.lit("")),
        "sub_type": F.try_element_at(category_map("subtype"), F.col("category")),
        "system": system,
        "pages": F.when(is_journal, page),
        "lineage": lineage(run_time),
        "warnings": F.when(known, conversion_warnings()).otherwise(F.array().cast(NO_TEXTS)),
        "errors": F.when(known, F.array().cast(NO_TEXTS)).otherwise(F.array(no_converter(F.col("category")))),
    }).drop("_texts", "_numbers")


def document_json() -> Column:
    """The converted document as JSON: {name, type, system, flags} or {name, pages, flags}."""
    keep_nulls = {"ignoreNullFields": "false"}
    item = F.to_json(F.struct("name", F.col("sub_type").alias("type"), "system", F.col("lineage").alias("flags")), keep_nulls)
    entry = F.to_json(F.struct("name", "pages", F.col("lineage").alias("flags")), keep_nulls)
    return F.when(F.col("category") == "journal", entry).otherwise(item)
