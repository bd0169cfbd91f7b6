"""Name-keyed merging of a batch into the catalog.

The sequential rule "look the name up, then add, overwrite or skip" has a set form.  For a key k
let c be its first catalog row and b1..bn its batch rows in batch order:

=============  =====================================  ===========================================
               overwrite off                          overwrite on
=============  =====================================  ===========================================
c exists       all skipped                            c takes the payload of bn; all overwritten
c absent       b1 added, the rest skipped             b1 added with the payload of bn, rest overwritten
=============  =====================================  ===========================================

Names, numbers and ids of both sides are aggregated per key and per id in one pass (a name that owns a third of the batch
costs no more than any other); the verdicts, one slim row for each name of the batch, are written to the shared folder.
Everything else is a lookup of unique numbers: the winning rows by their batch order, the replaced ones by their catalog order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.operators.skew import hot_lookup, rank_within, stage
from contentkit.records import RECORD_SCHEMA_VERSION

MAX_VERSION = 99
VERSIONED = r"(?s)^(.*) v([2-9]|[1-9][0-9])$"


def _clashes(fresh: DataFrame, known_ids: DataFrame) -> DataFrame:
    """(_first) of the new keys whose first id is taken, by *known_ids* or by an earlier new key."""
    claims = fresh.select(F.col("_id").alias("id"), "_first").unionByName(known_ids.select("id", F.lit(None).cast("bigint").alias("_first")))
    by_id = claims.groupBy("id").agg(
        F.min("_first").alias("_keep"), F.count("_first").alias("_claims"), F.max(F.col("_first").isNull()).alias("_taken"))
    bad = by_id.filter(((F.col("_claims") > 0) & F.col("_taken")) | (F.col("_claims") > 1))
    return fresh.join(bad.select(F.col("id").alias("_id"), "_keep", "_taken"), "_id").filter(
        F.col("_taken") | (F.col("_first") != F.col("_keep"))).select("_first", F.lit(True).alias("_clash"))


def judge_batch(
    catalog: DataFrame, batch: DataFrame, keys: dict[str, Column], order: Column | None = None,
    check_ids: bool = True, known_ids: DataFrame | None = None,
) -> DataFrame:
    """The verdicts of a merge, aggregated once and written to the shared folder: one row for each key of *batch*.

    _n: its batch rows; _first, _last: order numbers of the first and the last of them; _id: the id of the first; _held: number of the first
    catalog row with the key; _clash: whether _id belongs to another record.
    *known_ids* (id) are the ids in use, those of *catalog* if None.
    """
    names = list(keys)
    sort = F.col("ord") if order is None else order
    new = batch.withColumns(keys).select(*names, "ord", "id", sort.alias("_sort"))
    kind = new.schema["_sort"].dataType
    old = catalog.withColumns(keys).select(*names, F.col("ord").alias("_old"))
    both = new.unionByName(old.withColumn("_sort", F.lit(None).cast(kind)), allowMissingColumns=True)
    first, last = (F.min("ord"), F.max("ord")) if order is None else (F.min_by("ord", "_sort"), F.max_by("ord", "_sort"))
    stats = both.groupBy(*names).agg(
        F.count("ord").alias("_n"), first.alias("_first"), last.alias("_last"), F.min_by("id", "_sort").alias("_id"), F.min("_old").alias("_held"))
    # Read again by several steps, so paid for once.
    verdict = stage(stats.filter("_n > 0"), "verdicts")
    if not check_ids:
        return verdict.withColumn("_clash", F.lit(False))
    clash = _clashes(verdict.filter(F.col("_held").isNull()), catalog.select("id") if known_ids is None else known_ids)
    return verdict.join(clash, "_first", "left").withColumn("_clash", F.coalesce("_clash", F.lit(False)))


def apply_batch(
    catalog: DataFrame, batch: DataFrame, verdict: DataFrame, keys: dict[str, Column], overwrite: bool,
    actions: tuple[str, str, str], schema_version: str | None, next_ord: Column, convert: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The new catalog and one action row per batch row, from the verdicts.

    *convert* makes catalog columns of batch rows (and keeps all others); only rows that enter the catalog are converted.
    """
    names, (added, overwritten, skipped) = list(keys), actions
    payload = [c for c in catalog.columns if c not in ("ord", "id")]
    restamp = {"schema_version": F.lit(schema_version)} if schema_version else {}
    convert = convert or (lambda rows: rows)
    # Rows that enter the catalog: for each key at most one, addressed by its unique batch order.
    take = verdict.filter(~F.col("_clash")).withColumn("ord", F.col("_last" if overwrite else "_first"))
    # New rows are numbered densely: the batch's own order may be negative, a hash or full of gaps.
    added_keys = rank_within(take.filter(F.col("_held").isNull()).select("ord", "_first", F.col("_id").alias("_new_id")), [], "_first", "_rank")
    # The payload is that of the winning row, the identity that of the first.
    fresh = convert(batch.join(added_keys, "ord")).withColumns(restamp).select(
        (next_ord + F.col("_rank") - 1).cast("bigint").alias("ord"), F.col("_new_id").alias("id"), *payload)
    if overwrite:
        again = convert(batch.join(take.filter(F.col("_held").isNotNull()).select("ord", "_held"), "ord")).withColumns(restamp)
        replace = again.select(F.col("_held").alias("ord"), F.struct(*payload).alias("_new"))
        kept = catalog.join(replace, "ord", "left").select(
            "ord", "id",
            *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in payload],
        )
    else:
        kept = catalog.select("ord", "id", *payload)
    merged = kept.unionByName(fresh).select(*catalog.columns)

    new, dim = batch.withColumns(keys), verdict.select(*names, "_n", "_first", "_held", "_clash")
    if len(names) > 1:
        joint = F.to_json(F.struct(*names))
        rows = hot_lookup(new.withColumn("_joint", joint), dim.withColumn("_joint", joint).drop(*names), "_joint", "_n")
    else:
        rows = hot_lookup(new, dim, names[0], "_n")
    repeat = overwritten if overwrite else skipped
    action = (
        F.when(F.col("_held").isNotNull(), repeat)
        .when(F.col("_clash"), "failed")
        .when(F.col("ord") == F.col("_first"), added)
        .otherwise(repeat)
    )
    reason = F.when(action == "failed", F.lit("id already used by another record"))
    return merged, rows.select(*batch.columns, action.alias("action"), reason.alias("reason"))


def merge_batch(
    catalog: DataFrame,
    batch: DataFrame,
    overwrite: bool = False,
    keys: dict[str, Column] | None = None,
    actions: tuple[str, str, str] = ("added", "overwritten", "skipped"),
    schema_version: str | None = RECORD_SCHEMA_VERSION,
    order: Column | None = None,
    check_ids: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """M1: merge *batch* into *catalog*; returns the new catalog and one action row per batch row.

    Both inputs hold the same columns, among them ``ord`` (unique) and ``id``.  The batch order is
    ``ord`` unless *order* gives another sort key (unique within a merge key).  Added rows get the numbers after the
    catalog's greatest ``ord``, in the order of their first batch rows.  A new row whose id
    is already taken by another record fails, with the other rows of its name, instead of replacing it; switch
    *check_ids* off where ids cannot collide, it saves a shuffle of all ids.  The verdicts are computed when this is
    called.  ``bucketed.BucketedCatalog`` keeps a catalog on disk and merges into the buckets that a batch touches.
    """
    keys = keys or {"_key": F.lower(F.col("name"))}
    verdict = judge_batch(catalog, batch, keys, order, check_ids)
    base = catalog.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).scalar()
    return apply_batch(catalog, batch, verdict, keys, overwrite, actions, schema_version, base)


def upsert(catalog: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2: merge with overwrite; actions are ``added`` and ``updated``, existing ids are kept."""
    return merge_batch(catalog, batch, overwrite=True, actions=("added", "updated", "skipped"))


def insert_strict(catalog: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert by id; returns the new catalog and the rows that are rejected.

    A row is rejected if its id is in the catalog or an earlier row (by ``ord``) of *rows* has it.
    """
    firsts = rows.groupBy("id").agg(F.min("ord").alias("_first"))
    known = catalog.select("id").distinct().withColumn("_known", F.lit(True))
    tagged = rows.join(firsts, "id", "left").join(known, "id", "left").withColumn(
        "_late", F.col("_known").isNotNull() | F.coalesce(F.col("ord") > F.col("_first"), F.lit(False)))
    fresh = tagged.filter("NOT _late").withColumn("schema_version", F.lit(RECORD_SCHEMA_VERSION))
    return catalog.unionByName(fresh.select(*catalog.columns)), tagged.filter("_late").select(*rows.columns)


def update_strict(catalog: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace by id (the last row by ``ord`` of each id); returns the new catalog and the rows with an unknown id."""
    payload = [c for c in catalog.columns if c not in ("ord", "id")]
    stamped = rows.withColumn("schema_version", F.lit(RECORD_SCHEMA_VERSION))
    packed = stamped.groupBy("id").agg(F.max_by(F.struct(*payload), "ord").alias("_new"))
    out = catalog.join(packed, "id", "left").select(
        "ord", "id",
        *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in payload],
    )
    return out.select(*catalog.columns), rows.join(catalog.select("id"), "id", "left_anti").select(*rows.columns)


def versioned_names(
    batch: DataFrame, catalog: DataFrame, run_stamp: str, unique: bool = True
) -> DataFrame:
    """M3: a free name for every batch row: itself, else the first free "name v2".."name v99".

    With ``unique`` (the default) equal names in the batch take successive versions; without it
    every row is resolved against the catalog alone, so equal names get the same version.  When no
    version is free the name is suffixed with *run_stamp* (and a counter in unique mode).
    """
    keyed = batch.withColumn("_key", F.lower("name"))
    taken = catalog.select(F.lower("name").alias("_key")).distinct()
    stats = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("_first"))
    held = stats.join(taken.withColumn("_held", F.lit(True)), "_key", "left").withColumn(
        "_held", F.coalesce("_held", F.lit(False))
    )
    clashing = held.filter(F.col("_held") | (F.col("_n") > 1) if unique else F.col("_held"))
    # Versions in use, read off the names that end in one: at most 98 per base name.
    names = taken.select("_key")
    if unique:
        names = names.union(stats.select("_key"))
    used = (
        names.select(F.regexp_extract("_key", VERSIONED, 1).alias("_base"), F.regexp_extract("_key", VERSIONED, 2).alias("_v"))
        .filter(F.col("_v") != "")
        .groupBy(F.col("_base").alias("_key"))
        .agg(F.collect_set(F.col("_v").cast("int")).alias("_used"))
    )
    every = F.sequence(F.lit(2), F.lit(MAX_VERSION))
    free = clashing.join(used, "_key", "left").select(
        "_key", F.array_except(every, F.coalesce("_used", F.array().cast("array<int>"))).alias("_free"))
    dim = held.join(free, "_key", "left")
    if unique:
        ranked = rank_within(keyed, ["_key"], "ord", "_rank")
    else:
        ranked = keyed.withColumn("_rank", F.lit(1))
    rows = hot_lookup(ranked, dim, "_key", "_n")
    # Rank 1 keeps its name when the catalog does not hold it; later ranks take later free versions.
    slot = F.when(F.col("_held"), F.col("_rank")).otherwise(F.col("_rank") - 1)
    version = F.when(slot > 0, F.get(F.coalesce("_free", F.array().cast("array<int>")), (slot - 1).cast("int")))
    late = F.concat("name", F.lit(f" {run_stamp}"), F.concat(F.lit("-"), slot.cast("string")) if unique else F.lit(""))
    name = (
        F.when(slot == 0, F.col("name"))
        .when(version.isNotNull(), F.concat("name", F.lit(" v"), version.cast("string")))
        .otherwise(late)
    )
    return rows.withColumn("_named", name).select(
        *batch.columns, F.col("_named").alias("versioned_name")
    )


def resolve_action(documents: DataFrame, names: DataFrame, policy: str) -> DataFrame:
    """M5: create, update or skip each document given the existing names and a duplicate policy."""
    keyed = documents.withColumn("_key", F.lower("name"))
    stats = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    have = names.select(F.lower("name").alias("_key")).distinct().withColumn("_exists", F.lit(True))
    rows = hot_lookup(keyed, stats.join(have, "_key", "left"), "_key", "_n")
    clash = "update" if policy == "replace" else "skip"
    action = F.when(F.col("_exists"), clash).otherwise("create")
    return rows.select(*documents.columns, action.alias("action"))
