"""Exports: JSON, CSV, raw payloads and partitioned collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.functions.rules import slug
from contentkit.functions.variants import as_map, get_text
from contentkit.operators.catalog import with_ids
from contentkit.operators.convert import document_json
from contentkit.records import category_map

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# Export names in column order.
EXPORT_NAMES = {
    "id": "id", "name": "name", "category": "category", "source_book": "sourceBook", "publisher": "publisher",
    "author": "author", "page_number": "pageNumber", "tags": "tags", "notes": "notes", "raw_content": "rawContent",
    "imported_date": "importedDate", "import_method": "importMethod", "schema_version": "schemaVersion",
}
CSV_PAYLOAD_COLUMNS = ["level", "price", "bulk", "description"]


def iso(c: Column) -> Column:
    """ISO text in UTC, whatever the session time zone."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), ISO)


def export_frame(records: DataFrame) -> DataFrame:
    """Records under their export names; times as ISO text."""
    return records.select(*[
        (iso(F.col(c)) if c == "imported_date" else F.col(c)).alias(n) for c, n in EXPORT_NAMES.items()])


def write_json(records: DataFrame, path: str, ids: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Lossless JSON lines (all records if *ids* is empty) that :func:`contentkit.sources.stored.normalize_stored_records` reads back."""
    export_frame(with_ids(records, ids)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def catalog_csv_frame(records: DataFrame) -> DataFrame:
    """The sixteen export columns, all text."""
    payload = F.col("raw_content")
    label = F.coalesce(F.try_element_at(category_map("label"), F.col("category")), F.col("category"))
    return records.select(
        "id", "name", "category", label.alias("categoryLabel"), F.col("source_book").alias("sourceBook"), "publisher",
        "author", F.col("page_number").cast("string").alias("pageNumber"), F.array_join("tags", "; ").alias("tags"), "notes",
        iso(F.col("imported_date")).alias("importedDate"), F.col("import_method").alias("importMethod"),
        *[F.coalesce(get_text(payload, c), F.lit("")).alias(c) for c in CSV_PAYLOAD_COLUMNS],
    )


def write_catalog_csv(
    records: DataFrame, path: str, ids: DataFrame | None = None, crlf: bool = False, mode: str = "errorifexists"
) -> None:
    """Quoted CSV.  With *crlf* rows end in CRLF; Spark then also writes CRLF for newlines inside cells."""
    writer = catalog_csv_frame(with_ids(records, ids)).write.mode(mode).option("header", "true").option("quoteAll", "true").option(
        "escape", '"').option("emptyValue", "")
    (writer.option("lineSep", "\r\n") if crlf else writer).csv(path)


def raw_export_json(records: DataFrame) -> DataFrame:
    """{name, category, ...payload} as JSON, payload keys winning; with a file-name slug."""
    base = F.create_map(F.lit("name"), F.col("name").cast("variant"), F.lit("category"), F.col("category").cast("variant"))
    merged = F.map_zip_with(base, as_map(F.col("raw_content")), lambda k, a, b: F.coalesce(b, a))
    return records.select("id", slug(F.col("name")).alias("file_slug"), F.to_json(F.to_variant_object(merged)).alias("json"))


def explode_raw_export(records: DataFrame) -> DataFrame:
    """S11 as a long table: one row per (record, key)."""
    base = F.create_map(F.lit("name"), F.col("name").cast("variant"), F.lit("category"), F.col("category").cast("variant"))
    merged = F.map_zip_with(base, as_map(F.col("raw_content")), lambda k, a, b: F.coalesce(b, a))
    return records.select("id", F.explode(merged).alias("key", "_v")).select("id", "key", F.to_json("_v").alias("value"))


def write_partitioned_packs(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per collection.

    Rows are rebalanced by collection: Spark splits one with most of the documents over as many
    tasks as its size asks for, and merges small ones.
    """
    out = documents.select("id", "name", "category", "document_type", "pack_id", "lineage", document_json().alias("document"))
    out.hint("rebalance", F.col("pack_id")).write.mode(mode).partitionBy("pack_id").parquet(path)
