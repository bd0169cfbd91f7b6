"""Report rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.functions.scalars import round_half_up
from contentkit.operators.plan import explode_rows

STATUSES = ["pending", "accepted", "rejected", "edited"]
METHODS = ["regex", "ai", "manual"]
DISPOSITIONS = ["imported", "updated", "skipped", "failed"]


def key_counts(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """A3: rows per value of *column*; the fixed *keys* are always present, other values follow."""
    counts = df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    zeros = df.sparkSession.createDataFrame([(k, 0) for k in keys], "key string, count bigint")
    return counts.unionByName(zeros).groupBy("key").agg(F.sum("count").alias("count"))


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    return key_counts(df, column, STATUSES)


def method_counts(df: DataFrame, column: str = "detection_method") -> DataFrame:
    return key_counts(df, column, METHODS)


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "category")


def dominant_category(matches: DataFrame, by: list[str] | None = None, order: str = "ord") -> DataFrame:
    """A4: the category with most matches, the first seen on a tie; "unknown" where there is none."""
    keys = by or []
    counts = matches.groupBy(*keys, "category").agg(F.count_if(F.col("category").isNotNull()).alias("_n"), F.min(order).alias("_o"))
    best = F.max_by(F.when(F.col("_n") > 0, F.col("category")), F.struct(F.col("_n"), -F.col("_o")))
    return counts.groupBy(*keys).agg(F.coalesce(best, F.lit("unknown")).alias("dominant_category"))


def run_summary(pages: DataFrame, extracted: DataFrame, errors: DataFrame, by: str = "doc_id") -> DataFrame:
    """A5: page, OCR, record and error counts per run or document."""
    page = pages.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if("was_ocr").alias("ocr_pages"),
        F.coalesce(F.avg(F.when(F.col("was_ocr"), F.col("ocr_confidence"))), F.lit(0.0)).alias("avg_ocr_confidence"),
    )
    record = extracted.groupBy(by).agg(F.count(F.lit(1)).alias("record_count"))
    error = errors.groupBy(by).agg(F.count(F.lit(1)).alias("error_count"))
    out = page.join(record, by, "left").join(error, by, "left")
    return out.withColumn(
        "ocr_pct", F.when(F.col("total_pages") > 0, round_half_up(F.col("ocr_pages") * 100 / F.col("total_pages"))).otherwise(0)
    ).fillna(0, ["record_count", "error_count"])


def confidence_band(confidence: Column) -> Column:
    """High from 0.8, medium from 0.5, low below."""
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def confidence_percent(confidence: Column) -> Column:
    return round_half_up(confidence * 100)


def confidence_bands(extracted: DataFrame, column: str = "confidence") -> DataFrame:
    return (
        extracted.groupBy(confidence_band(F.col(column)).alias("band"))
        .agg(F.count(F.lit(1)).alias("count"), F.min(confidence_percent(F.col(column))).alias("min_percent"),
             F.max(confidence_percent(F.col(column))).alias("max_percent"))
    )


def disposition_stats(results: DataFrame, column: str = "disposition") -> DataFrame:
    """Total and one count per disposition."""
    return results.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == d).alias(d) for d in DISPOSITIONS]
    )


def session_rollup(results: DataFrame, column: str = "outcome") -> DataFrame:
    """A10: success / failed / skipped and the success rate in whole percent."""
    counts = results.agg(
        F.count(F.lit(1)).alias("total_entries"),
        *[F.count_if(F.col(column) == o).alias(f"{o}_count") for o in ("success", "failed", "skipped")],
    )
    rate = F.when(F.col("total_entries") > 0, round_half_up(F.col("success_count") * 100 / F.col("total_entries")))
    return counts.withColumn("success_rate", F.coalesce(rate, F.lit(0)))


def compat_rollup(reports: DataFrame) -> DataFrame:
    """Records with a schema, and how many of them are compatible."""
    known = F.col("compatible").isNotNull()
    return reports.agg(
        F.count_if(known).alias("total"),
        F.count_if(F.col("compatible")).alias("compatible"),
        F.count_if(~F.col("compatible")).alias("incompatible"),
    )


def repair_rollup(repaired: DataFrame) -> DataFrame:
    """Repaired and unchanged records, applied actions and open issues."""
    applied = F.size(F.filter("actions", lambda a: a["action"] != "skipped"))
    return repaired.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("was_modified").alias("modified"),
        F.count_if(~F.col("was_modified")).alias("unchanged"),
        F.coalesce(F.sum(applied), F.lit(0)).alias("applied_actions"),
        F.coalesce(F.sum(F.size("remaining_issues")), F.lit(0)).alias("open_issues"),
    )


def schema_summary(fields: DataFrame, hashes: DataFrame) -> DataFrame:
    """Field count, required count and hash per schema."""
    counts = fields.groupBy("document_type", "subtype").agg(
        F.count(F.lit(1)).alias("field_count"), F.count_if("required").alias("required_count")
    )
    return counts.join(hashes, ["document_type", "subtype"], "left")


def diff_counts(diff: DataFrame) -> DataFrame:
    """Added / removed / retyped / newly required per schema."""
    return diff.groupBy("document_type", "subtype").agg(*[
        F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed_type", "newly_required")
    ])


def error_log(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per issue, with the identifying columns in *keep*."""
    return explode_rows(df.select(*keep, "issues"), F.col("issues"), "i").select(*keep, "i.level", "i.code", "i.field", "i.message")
