"""Lookups, rankings and broadcasts that hold when one key owns a third of the rows.

A lookup into a table with unique keys only has one skewed side.  The keys that are most frequent
on that side are resolved with a broadcast of at most ``HOT_KEYS`` rows; everything else goes
through an ordinary shuffle join in which the hot rows are spread over many partitions.  The limit only
chooses the route, so no row is ever dropped or capped.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_KEYS = 1024
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
REPLICAS = 32


def hot_lookup(
    left: DataFrame, right: DataFrame, key: str, weight: str, spread: str = "ord", hot_keys: int = HOT_KEYS
) -> DataFrame:
    """Left join of *left* with *right*, unique on *key*, where *weight* counts left rows per key.

    *key* is text.  Rows of *left* with a key among the *hot_keys* heaviest never shuffle on that key; *spread* is
    a column (unique per row) that places them instead.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    packed = right.select(key, weight, F.struct(*values).alias("_value"))
    hot = packed.orderBy(F.desc(weight), F.asc(key)).limit(hot_keys).select(
        key, F.col("_value").alias("_hot_value"), F.lit(True).alias("_hot")
    )
    cold = packed.select(F.col(key).alias("_cold_key"), F.col("_value").alias("_cold_value"))
    # A hot row needs no cold partner.  It gets a probe that matches nothing and differs from row to
    # row, so the shuffle spreads it; being a function of the row alone, a retried task repeats it.
    # (A separate salt column would not do: with a constant on the other side the optimizer turns
    # it into a filter and shuffles on the key alone.)
    scattered = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(spread), F.lit(65536)).cast("string"))
    probe = left.join(F.broadcast(hot), key, "left").withColumn(
        "_probe", F.when(F.col("_hot"), scattered).otherwise(F.col(key)))
    joined = probe.join(cold, F.col("_probe") == F.col("_cold_key"), "left")
    value = F.coalesce("_hot_value", "_cold_value")
    return joined.select(*[F.col(c) for c in left.columns], *[value[c].alias(c) for c in values])


def dim_join(left: DataFrame, dim: DataFrame, on: str | list[str], spread: str = "ord", how: str = "left") -> DataFrame:
    """Join with a derived dimension: broadcast when it is measured to be small.

    A dimension beyond the bound is replicated ``REPLICAS`` times and joined on (key, replica), so
    that a key with most of the left rows is spread over that many tasks.
    """
    keys = [on] if isinstance(on, str) else on
    dim = dim.persist()
    width = F.length(F.to_json(F.struct(*[F.col(c) for c in dim.columns])))
    rows, size = dim.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return left.join(F.broadcast(dim), keys, how)
    copies = dim.withColumn("_replica", F.explode(F.sequence(F.lit(0), F.lit(REPLICAS - 1))))
    salted = left.withColumn("_replica", F.pmod(F.xxhash64(spread), F.lit(REPLICAS)).cast("int"))
    return salted.join(copies, keys + ["_replica"], how).drop("_replica")


#: Bits of an order number inside a cell, and of a cell inside a group; at most 21 are left for the group.
CELL_BITS, GROUP_BITS = 22, 21


def rank_within(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Row number per key by *order* (unique longs of any sign and spread) without sorting a whole key in one task.

    Rows are numbered inside cells of 2 ** 22 consecutive numbers, and shifted by the rows of all cells before: of the same group of 2 ** 21
    cells, and of all groups before.  So no window sees more than that many rows of a key, whether the numbers are
    dense, hashes, or have outliers.  Rows with a null key have no rank.
    """
    def before(group: list[str], by: str) -> Column:
        window = Window.partitionBy(*keys, *group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(window), F.lit(0))

    cells = df.groupBy(*keys, F.shiftright(order, CELL_BITS).alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_group", F.shiftright("_cell", GROUP_BITS))
    groups = cells.groupBy(*keys, "_group").agg(F.sum("_n").alias("_n")).select(*keys, "_group", before([], "_group").alias("_above"))
    inside = cells.select(*keys, "_group", "_cell", before(["_group"], "_cell").alias("_inside"))
    offsets = inside.join(groups, [*keys, "_group"]).select(*keys, "_cell", (F.col("_above") + F.col("_inside")).alias("_offset"))
    local = df.withColumn("_cell", F.shiftright(order, CELL_BITS)).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(order)))
    return local.join(offsets, [*keys, "_cell"], "left").withColumn(out, F.col("_offset") + F.col("_rn")).drop("_cell", "_rn", "_offset")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared directory named by ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests on one machine) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="contentkit-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write *df* to a new table in the shared folder and read it back, so that no later use computes it again."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least(order: str, *cols: str) -> list[Column]:
    """Aggregates picking *cols* of the row with the least *order*."""
    return [F.min_by(c, order).alias(c) for c in cols]


def one_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last one by *order* (nulls first), which has to decide between rows that differ."""
    values = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values])
