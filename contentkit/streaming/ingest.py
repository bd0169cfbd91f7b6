"""Incremental ingestion: files that keep arriving, taken in micro-batches.

Segmentation, detection, field extraction and content rules are stateless, so they run unchanged
on a streaming DataFrame.  Merging needs the catalog as it is, so it runs once per micro-batch, on the buckets it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contentkit.operators.bucketed import BucketedCatalog
from contentkit.operators.extract import Detector, detect_records
from contentkit.operators.text import segment_pages
from contentkit.plans.detectors import DETECTORS


def stream_pages(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Text files of a folder as pages, one per form feed; new files are picked up as they arrive."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", max_files).load(folder)
    named = files.select(F.col("_metadata.file_path").alias("doc_id"), F.split("value", "\f").alias("_pages"))
    return named.select("doc_id", F.posexplode("_pages").alias("_i", "text")).select(
        "doc_id", (F.col("_i") + 1).alias("page_number"), "text")


def stream_detected(pages: DataFrame, detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """Detected records of a stream of pages; no state, no watermark needed."""
    return detect_records(segment_pages(pages), detectors)


def merge_stream(
    records: DataFrame, catalog_path: str, checkpoint: str, overwrite: bool = False, available_now: bool = True, buckets: int = 256
) -> StreamingQuery:
    """Merge a stream of catalog records into a bucketed catalog; micro-batch n is its generation n.

    A micro-batch reads and writes only the buckets of its names.  One that runs again after a failure overwrites its own incomplete files, and
    leaves a complete generation as it is, so a restart gives the same catalog.
    """
    def merge(batch: DataFrame, n: int) -> None:
        BucketedCatalog(batch.sparkSession, catalog_path, buckets).merge(batch, overwrite, generation=n)

    writer = records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_catalog(spark: SparkSession, catalog_path: str) -> DataFrame | None:
    """The newest complete generation."""
    return BucketedCatalog(spark, catalog_path).read()
