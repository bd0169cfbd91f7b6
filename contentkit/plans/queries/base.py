"""Shared views of the driver tables and the query registry.

The driver tables are relational, so catalogs, batches and text blocks are derived from them:
``part`` is the catalog, ``orders`` (joined to ``part``) the import batch, and stat blocks are
rendered from ``part``, ``supplier`` and ``customer`` columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentkit.records import CATEGORY_NAMES, RECORD_COLUMNS

RUN_TIME = "2024-01-01T00:00:00.000Z"
REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query under *name* with its SQL."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = (fn, sql)
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


KEYS = {"part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id", "customer": "c_custkey"}


def busy_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for work that is heavy per row.

    A small file comes in one partition and would keep one core busy; it is spread by key.  A table
    that already has a partition per core, as any large one has, is read as it is.
    """
    df = table(spark, sf, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, KEYS[name])


def pick(values: list[str], index: Column) -> Column:
    """The element of a literal list at a zero-based position."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def pick_sql(values: list[str], index: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[CAST({index} AS INTEGER) + 1]"


METHODS = ["json", "csv", "txt", "paste"]
BULKS = ["L", "-", "2", "1.5", "heavy"]


def part_payload() -> Column:
    """Raw content of a part record."""
    return F.to_variant_object(F.struct(
        F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("level"), F.col("p_retailprice").alias("price"),
        pick(BULKS, F.col("p_partkey") % 5).alias("bulk"), F.lower("p_type").alias("type"),
        F.concat(F.lit("A "), F.col("p_name"), F.lit(".")).alias("description")))


def part_records(spark: SparkSession, sf: str) -> DataFrame:
    """``part`` as catalog records."""
    return busy_table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        pick(CATEGORY_NAMES, F.col("p_partkey") % 15).alias("category"),
        F.col("p_type").alias("source_book"),
        F.col("p_brand").alias("publisher"),
        F.lit("").alias("author"),
        F.col("p_size").cast("bigint").alias("page_number"),
        F.split("p_name", " ").alias("tags"),
        F.lit("").alias("notes"),
        part_payload().alias("raw_content"),
        F.to_timestamp(F.lit(RUN_TIME)).alias("imported_date"),
        pick(METHODS, F.col("p_partkey") % 4).alias("import_method"),
        F.lit("2.0.0").alias("schema_version"),
    ).select(*RECORD_COLUMNS)


PART_SQL = f"""rec AS (
  SELECT p_partkey AS ord, 'p' || p_partkey AS id, p_name AS name,
         {pick_sql(CATEGORY_NAMES, 'p_partkey % 15')} AS category, p_type AS source_book, p_brand AS publisher,
         CAST(p_size AS BIGINT) AS page_number, string_split(p_name, ' ') AS tags,
         {pick_sql(METHODS, 'p_partkey % 4')} AS import_method,
         p_size AS level, p_retailprice AS price, {pick_sql(BULKS, 'p_partkey % 5')} AS bulk, lower(p_type) AS kind,
         'A ' || p_name || '.' AS description
  FROM part)"""


def branded_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog whose names carry the brand, so that some repeat."""
    return part_records(spark, sf).withColumn("name", F.concat("name", F.lit(" "), "publisher"))


def order_batch(spark: SparkSession, sf: str) -> DataFrame:
    """An import batch: every order names a branded part, some in upper case, some of no known brand."""
    orders = table(spark, sf, "orders")
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    joined = orders.join(parts, F.col("o_custkey") == F.col("p_partkey"))
    name = F.concat("p_name", F.lit(" Brand#"), (F.col("o_orderkey") % 30).cast("string"))
    return joined.select(
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
        F.when(F.col("o_orderstatus") == "F", F.upper(name)).otherwise(name).alias("name"),
        pick(CATEGORY_NAMES, F.col("o_custkey") % 15).alias("category"),
        F.col("o_orderpriority").alias("source_book"),
        F.lit("orders").alias("publisher"),
        F.lit("").alias("author"),
        (F.col("o_orderkey") % 400).alias("page_number"),
        F.array("o_orderstatus").alias("tags"),
        F.lit("").alias("notes"),
        F.to_variant_object(F.struct(F.col("o_totalprice").alias("price"))).alias("raw_content"),
        F.to_timestamp(F.lit(RUN_TIME)).alias("imported_date"),
        F.lit("json").alias("import_method"),
        F.lit("1.0.0").alias("schema_version"),
    ).select(*RECORD_COLUMNS)


MERGE_SQL = f"""{PART_SQL}, cat AS (
  SELECT ord, id, name || ' ' || publisher AS name, category, source_book, publisher, page_number FROM rec),
batch AS (
  SELECT o_orderkey AS ord, 'o' || o_orderkey AS id,
         CASE WHEN o_orderstatus = 'F' THEN upper(p_name || ' Brand#' || (o_orderkey % 30))
              ELSE p_name || ' Brand#' || (o_orderkey % 30) END AS name,
         {pick_sql(CATEGORY_NAMES, 'o_custkey % 15')} AS category, o_orderpriority AS source_book, 'orders' AS publisher,
         o_orderkey % 400 AS page_number
  FROM orders JOIN part ON o_custkey = p_partkey),
held AS (SELECT lower(name) AS k, min(ord) AS held FROM cat GROUP BY 1),
stats AS (SELECT lower(name) AS k, count(*) AS n, min(ord) AS first, max(ord) AS last FROM batch GROUP BY 1),
verdict AS (SELECT s.*, h.held FROM stats s LEFT JOIN held h USING (k))"""


def flat_tags(c: str = "tags") -> Column:
    return F.array_join(c, "|")
