"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local master without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="contentkit-llm-")
    return _LOCAL[app]


#: Bytes of rows that Spark hands to an Arrow function at once.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not by rows alone: ten thousand long texts would be one batch otherwise.

    A session whose spark.sql.execution.arrow.maxBytesPerBatch is smaller keeps its own bound.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write *df* as Parquet to the shared folder and read it back.

    The result depends on the written files alone, so a lost executor never recomputes what lies before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when that ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bits of the id filter: 512 bitmaps of 4 KB, whatever the input.
FILTER_BITS = 1 << 24


def prefilter(df: DataFrame, id_col: str, wanted: DataFrame, wanted_col: str, flag: str | None = None) -> DataFrame:
    """The rows of *df* whose id may be among *wanted*, to shrink the shuffle of a semi-join that follows.

    A bitmap of hashed ids with a fixed number of bits is built by Spark and broadcast (2 MB at most).  It never loses a
    wanted row; when ids fill it, it merely stops helping.  With *flag*, all rows stay and get that boolean column.
    """
    def spot(column: str):
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS))

    bitmaps = wanted.select(spot(wanted_col).alias("_spot")).groupBy(F.bitmap_bucket_number("_spot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits"))
    near = df.withColumn("_spot", spot(id_col)).withColumn("_bucket", F.bitmap_bucket_number("_spot"))
    byte = F.conv(F.hex(F.substring("_bits", (F.bitmap_bit_position("_spot") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, (F.bitmap_bit_position("_spot") % 8).cast("int")) == 1, F.lit(False))
    marked = near.join(F.broadcast(bitmaps), "_bucket", "left" if flag else "inner")
    return marked.select(*df.columns, hit.alias(flag)) if flag else marked.filter(hit).select(*df.columns)


def without_ids(df: DataFrame, id_col: str, dropped: DataFrame, repeated: DataFrame, rank: list[str] | None = None) -> DataFrame:
    """The rows of *df* whose id is not in *dropped* (id), one row for each id in *repeated* (id).

    Rows that a bitmap of both clears are passed on where they are; only the others are shuffled.  Of repeated rows, the
    one with the least values of *rank* (all columns if None) stays.
    """
    flagged = prefilter(df, id_col, dropped.select("id").union(repeated.select("id")), "id", flag="_suspect")
    clear = flagged.filter("NOT _suspect").select(*df.columns)
    suspects = flagged.filter("_suspect").join(dropped.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
    one = suspects.groupBy(id_col).agg(F.min_by(F.struct(*df.columns), F.struct(*(rank or df.columns))).alias("_row")).select("_row.*")
    return clear.unionByName(one)
