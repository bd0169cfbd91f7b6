"""Publishing documents into collections (M4-M8)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentkit.operators.bucketed import BucketedCatalog, Commit
from contentkit.operators.catalog import select_records
from contentkit.operators.convert import Pack, conversion_warnings, convert_records, no_converter
from contentkit.operators.merge import merge_batch
from contentkit.plans.conversion_packs import PACKS
from contentkit.records import CATEGORY, CATEGORY_NAMES, category_map

PUBLISH_ACTIONS = ("imported", "updated", "skipped")


def publish(documents: DataFrame, index: DataFrame, overwrite: bool = True) -> tuple[DataFrame, DataFrame]:
    """M4 (J3): merge documents into the published index on (pack_id, lower(name)).

    *documents* and *index* hold ord, id, name, pack_id and any payload.  Returns the new index and
    one row per document with its ``disposition``.  Documents are taken name by name.
    """
    merged, actions = merge_batch(
        index, documents, overwrite=overwrite,
        keys={"_pack": F.col("pack_id"), "_key": F.lower(F.col("name"))},
        actions=PUBLISH_ACTIONS, schema_version=None,
        order=F.struct(F.collate("name", "UNICODE"), F.col("ord")),
        check_ids=False,
    )
    return merged, actions.withColumnRenamed("action", "disposition")


def import_documents(
    documents: DataFrame, packs: DataFrame, index: DataFrame,
    skip_duplicates: bool = True, overwrite_duplicates: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """M6 (J4): publish with checks for a missing, unknown or locked collection.

    *documents*: ord, id, name, content_type, ...; *packs*: pack_id, locked (the collections that
    exist); *index*: ord, id, name, pack_id, ...  With neither flag set an existing name is created
    again, as a second document.
    """
    pairs = [x for n in CATEGORY_NAMES for x in (F.lit(n), F.lit(CATEGORY[n].pack))]
    routed = documents.withColumn("pack_id", F.try_element_at(F.create_map(*pairs), F.col("content_type")))
    # At most one row per category of the fixed list can match, so this side is at most 15 rows.
    known = packs.filter(F.col("pack_id").isin([c.pack for c in CATEGORY.values()])).groupBy("pack_id").agg(
        F.max("locked").alias("_locked"))
    checked = routed.join(F.broadcast(known), "pack_id", "left").withColumn(
        "code",
        F.when(F.col("pack_id").isNull(), "NO_PACK_CONFIG")
        .when(F.col("_locked").isNull(), "PACK_NOT_FOUND")
        .when(F.col("_locked"), "PACK_LOCKED"),
    ).drop("_locked")
    rejected = checked.filter(F.col("code").isNotNull()).select(
        *documents.columns, "pack_id", F.lit("failed").alias("outcome"), "code")
    good = checked.filter(F.col("code").isNull()).drop("code")
    columns = [c for c in index.columns if c in good.columns]
    ready = good.select(*columns)
    if overwrite_duplicates or skip_duplicates:
        merged, actions = publish(ready, index.select(*columns), overwrite=overwrite_duplicates)
        outcome = F.when(F.col("disposition") == "skipped", "skipped").when(
            F.col("disposition") == "failed", "failed").otherwise("success")
        done = actions.select("ord", outcome.alias("outcome"))
        results = good.join(done, "ord").select(
            *documents.columns, "pack_id", "outcome", F.lit(None).cast("string").alias("code"))
    else:
        merged = index.select(*columns).unionByName(ready)
        results = good.select(
            *documents.columns, "pack_id", F.lit("success").alias("outcome"), F.lit(None).cast("string").alias("code"))
    return merged, results.unionByName(rejected)


def collect_published(published: DataFrame) -> DataFrame:
    """M7: everything in the collections that carries lineage.

    What the catalog filters, sorts and facets by (F6, O2, A2) comes out of the lineage as columns of its own.
    """
    return published.filter(F.col("lineage").isNotNull()).select(
        "id", "name", F.col("category").alias("content_type"), "lineage", "pack_id", "document_type", "category",
        F.col("lineage.publisher").alias("publisher"), F.col("lineage.sourceBook").alias("source_book"),
        F.col("lineage.tags").alias("tags"), F.col("lineage.importMethod").alias("import_method"),
        F.col("lineage.importDate").alias("imported_date"),
    )


@dataclass(frozen=True)
class PublishRun:
    """Outcome of a run: the new index, one result row per record, and the records that won their key."""

    index: DataFrame
    results: DataFrame
    winners: DataFrame
    run_time: str
    packs: Mapping[str, Pack] | None = None

    def documents(self) -> DataFrame:
        """The documents to write; ``document_id`` is the id they keep in their collection."""
        return convert_records(self.winners, self.run_time, self.packs)


def publish_run(
    records: DataFrame, index: DataFrame, run_time: str, ids: DataFrame | None = None,
    categories: list[str] | None = None, overwrite: bool = True, packs: Mapping[str, Pack] | None = None,
) -> PublishRun:
    """M8: select, publish and convert.

    *index* holds ord, id, name and pack_id of what is already published.  Publishing is decided on
    these slim rows alone; only the records that win their key are converted.
    """
    selected = select_records(records, ids, categories).withColumn(
        "pack_id", F.try_element_at(category_map("pack"), F.col("category")))
    known = F.col("category").isin([*PACKS, *(packs or {}), "journal"])
    slim = selected.filter(known).select("ord", "id", "name", "pack_id", F.col("ord").alias("payload_ord"))
    held = index.select("ord", "id", "name", "pack_id", F.lit(None).cast("bigint").alias("payload_ord"))
    merged, actions = publish(slim, held, overwrite)
    winners = merged.filter(F.col("payload_ord").isNotNull()).select(
        F.col("payload_ord").alias("ord"), F.col("id").alias("document_id"))
    results = actions.select("ord", "pack_id", "disposition").join(
        selected.select("ord", "id", "name", "category", conversion_warnings().alias("warnings")), "ord"
    ).withColumn("errors", F.array().cast("array<string>"))
    unknown = selected.filter(~F.coalesce(known, F.lit(False))).select(
        "ord", F.lit("").alias("pack_id"), F.lit("skipped").alias("disposition"), "id", "name", "category",
        F.array().cast("array<string>").alias("warnings"),
        F.array(no_converter(F.col("category"))).alias("errors"))
    return PublishRun(merged, results.unionByName(unknown), selected.drop("pack_id").join(winners, "ord"), run_time, packs)


#: Columns of a stored document, besides its number and id.
STORED = ["name", "category", "document_type", "pack_id", "sub_type", "system", "pages", "lineage"]


def published_store(spark: SparkSession, root: str, buckets: int = 256) -> BucketedCatalog:
    """Published documents on disk, in buckets by (pack_id, lower(name))."""
    return BucketedCatalog(spark, root, buckets, F.concat_ws("\u0001", F.col("pack_id"), F.lower(F.col("name"))))


def publish_into(
    store: BucketedCatalog, records: DataFrame, run_time: str, ids: DataFrame | None = None, categories: list[str] | None = None,
    overwrite: bool = True, packs: Mapping[str, Pack] | None = None, run: int | None = None,
) -> tuple[Commit, DataFrame | None]:
    """M4, M8: publish *records* into documents that are there already; the commit, and one result row per selected record.

    There is one document for each (pack_id, lower(name)).  A record whose key is taken replaces the document, which keeps its id, or is skipped
    without *overwrite*.  Only records that become a document are converted, and only the buckets they fall into are written, all of it as
    one generation: until its manifest is complete, readers see the state before.  A *run* that is complete is not published again (results
    are None then).  Results hold ord, id, name, category, pack_id, disposition, warnings and errors.
    """
    pack = F.coalesce(F.try_element_at(category_map("pack"), F.col("category")), F.lit(""))
    selected = select_records(records, ids, categories).withColumn("pack_id", pack)
    known = F.coalesce(F.col("category").isin([*PACKS, *(packs or {}), "journal"]), F.lit(False))

    def convert(rows: DataFrame) -> DataFrame:
        return convert_records(rows, run_time, packs)

    schema = convert(selected.limit(0)).select("ord", "id", *STORED).schema
    commit = store.merge(
        selected.filter(known), overwrite, run, PUBLISH_ACTIONS, schema_version=None, check_ids=False,
        order=F.struct(F.collate("name", "UNICODE"), F.col("ord")), convert=convert, schema=schema)
    if commit.actions is None:
        return commit, None
    none = F.array().cast("array<string>")
    done = commit.actions.select("ord", "id", "name", "category", "pack_id", F.col("action").alias("disposition"),
                                 conversion_warnings().alias("warnings"), none.alias("errors"))
    unknown = selected.filter(~known).select("ord", "id", "name", "category", F.lit("").alias("pack_id"), F.lit("skipped").alias("disposition"),
                                             none.alias("warnings"), F.array(no_converter(F.col("category"))).alias("errors"))
    return commit, done.unionByName(unknown)
