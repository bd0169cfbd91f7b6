"""End-to-end flows composed from the operators.

Each flow stages its input once as a table in the shared scratch folder, so that the read order is
fixed, later branches do not parse the files again, and a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentkit.operators.catalog import CatalogFilter, apply_filter, sparse_pages
from contentkit.operators.extract import Detector, TextTemplate, apply_responses, build_prompts, detect_records
from contentkit.operators.merge import merge_batch, versioned_names
from contentkit.operators.publish import PublishRun, publish_run
from contentkit.operators.quality import overwrite_policy, valid_records, validate_import
from contentkit.operators.review import accepted_records, review_decisions
from contentkit.operators.skew import scratch_dir
from contentkit.operators.text import merge_ocr, segment_pages
from contentkit.plans.detectors import DETECTORS
from contentkit.plans.prompts import PROMPT_PACKS
from contentkit.plans.templates import TEMPLATES
from contentkit.records import DEFAULT_CATEGORY, RECORD_COLUMNS, record_id
from contentkit.sources.entries import drafts_to_records, entries_to_drafts, read_by_extension


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: a fixed table in the shared scratch folder."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


@dataclass(frozen=True)
class ImportRun:
    """Outcome of an import: new catalog, one action per saved row, the checked drafts, reader issues."""

    catalog: DataFrame
    actions: DataFrame
    checked: DataFrame
    issues: DataFrame


def import_folder(
    spark: SparkSession, folder: str, catalog: DataFrame, run_time: str, overwrite: bool = False,
    default_category: str = DEFAULT_CATEGORY, global_meta: dict | None = None, templates: Sequence[TextTemplate] = TEMPLATES,
) -> ImportRun:
    """Files to catalog: read, draft, validate, keep the valid, merge."""
    entries, issues = read_by_extension(
        spark, folder, templates, default_type=default_category, source_meta=global_meta)
    ordered = stage(entries.withColumn("ord", F.monotonically_increasing_id()), "entries")
    checked = validate_import(entries_to_drafts(ordered, global_meta), catalog)
    if overwrite:
        checked = overwrite_policy(checked)
    records = drafts_to_records(valid_records(checked), run_time, default_category)
    merged, actions = merge_batch(catalog, records.select(*RECORD_COLUMNS), overwrite)
    return ImportRun(merged, actions, checked, issues)


@dataclass(frozen=True)
class ExtractionRun:
    """Extracted records waiting for review, and what an outside model should be asked."""

    extracted: DataFrame
    prompts: DataFrame
    pages_to_recognise: DataFrame


def extract_pages(
    pages: DataFrame, run_book: str, publisher: str, ocr: DataFrame | None = None, detectors: Sequence[Detector] = DETECTORS
) -> ExtractionRun:
    """Pages (doc_id, page_number, text) to extracted records.

    ``pages_to_recognise`` are the sparse pages; pass the recognised text as *ocr* to use it.
    """
    sparse = sparse_pages(pages)
    full = merge_ocr(pages, ocr) if ocr is not None else pages
    blocks = segment_pages(full)
    found = detect_records(blocks, detectors)
    extracted = stage(found.select(
        F.monotonically_increasing_id().alias("ord"),
        record_id(F.col("doc_id").cast("string"), F.col("page_number").cast("string"), F.col("block_no").cast("string"),
                  F.col("match_no").cast("string")).alias("record_id"),
        "doc_id", "page_number", "name", "category", "text", "structured_data", "confidence", "auto_tags",
        F.lit(run_book).alias("source_book"), F.lit(publisher).alias("publisher"), F.lit("regex").alias("detection_method"),
        F.lit("pending").alias("status"), F.lit("").alias("notes"),
    ), "extracted")
    return ExtractionRun(extracted, build_prompts(extracted, PROMPT_PACKS), sparse)


def save_reviewed(
    extracted: DataFrame, decisions: DataFrame, catalog: DataFrame, index: DataFrame, run_time: str,
    policy: str = "replace", responses: DataFrame | None = None,
) -> tuple[DataFrame, PublishRun]:
    """Reviewed records into the catalog and on to publishing; *policy* is skip, replace or new-version.

    Publishing starts from the ids the merge kept, so replaced records are converted as well.
    """
    refined = apply_responses(extracted, responses) if responses is not None else extracted
    records = accepted_records(review_decisions(refined, decisions), run_time)
    if policy == "new-version":
        named = versioned_names(records, catalog, run_time)
        records = named.withColumn("name", F.col("versioned_name")).drop("versioned_name")
    merged, actions = merge_batch(catalog, records, overwrite=policy == "replace")
    kept = stage(merged, "catalog")
    touched = actions.filter(F.col("action").isin("added", "overwritten")).select(F.lower("name").alias("_k")).distinct()
    ids = kept.withColumn("_k", F.lower("name")).join(touched, "_k", "left_semi").select("id")
    # Selected here: a review that touched nothing publishes nothing, while an empty id list would mean all.
    return kept, publish_run(kept.join(ids, "id", "left_semi"), index, run_time, overwrite=policy != "skip")


def publish_catalog(
    catalog: DataFrame, index: DataFrame, run_time: str, flt: CatalogFilter | None = None, overwrite: bool = True
) -> PublishRun:
    """The catalog (or a filtered part of it) into the collections."""
    return publish_run(apply_filter(catalog, flt) if flt else catalog, index, run_time, overwrite=overwrite)
