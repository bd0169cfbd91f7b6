"""Work on nested objects without a bound on their depth (P8, and what C1 needs).

An expression can only go as many levels down as it was written for.  Merging goes ``LEVELS`` levels down inside the row; where two
objects still meet below that, which few documents have, the pair becomes a row of its own in a table of pairs, which is merged
the same way, until no pair is left.  The results then go back up, table by table, each put where its pair was taken from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.functions.variants import as_map
from contentkit.operators.plan import compute_once
from contentkit.operators.skew import stage

#: Levels of objects that one step goes down.
LEVELS = 4
#: Rows that one task sorts or groups.  Spark cuts partitions by compressed bytes, and objects that are much alike are compressed to so
#: little that one task would hold a large part of all rows.
ROWS = 1 << 14
PAIRS = "array<struct<at:string,base:variant,top:variant>>"


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _step(at: Column, key: Column) -> Column:
    """The place of a key below a place; lengths keep places apart whatever the keys contain."""
    return F.concat(at, F.length(key).cast("string"), F.lit(":"), key)


def _pairs(base: Column, top: Column, at: Column, levels: int) -> Column:
    """The places *levels* levels down where an object meets an object."""
    common = F.map_filter(
        F.map_zip_with(as_map(base), as_map(top), lambda k, x, y: F.when(is_object(x) & is_object(y), F.struct(x.alias("x"), y.alias("y")))),
        lambda k, both: both.isNotNull())
    entries = F.map_entries(common)
    if levels == 1:
        return F.transform(entries, lambda e: F.struct(_step(at, e["key"]).alias("at"), e["value"]["x"].alias("base"), e["value"]["y"].alias("top")))
    return F.flatten(F.transform(entries, lambda e: _pairs(e["value"]["x"], e["value"]["y"], _step(at, e["key"]), levels - 1)))


def _merged(base: Column, top: Column, at: Column, below: Column, levels: int) -> Column:
    """The overlay of two objects; what lies *levels* levels down is looked up in *below* (place to object)."""

    def both(k: Column, x: Column, y: Column) -> Column:
        place = _step(at, k)
        inner = F.try_element_at(below, place) if levels == 1 else _merged(x, y, place, below, levels - 1)
        return F.when(is_object(x) & is_object(y), inner).otherwise(F.coalesce(y, x))

    return F.to_variant_object(F.map_zip_with(as_map(base), as_map(top), both))


def _dealt(table: DataFrame, key: str, rows: int) -> DataFrame:
    """*table* by *key* in partitions of about ROWS of *rows* rows."""
    return table.repartition(1 + rows // ROWS, key)


def _no_results() -> Column:
    return F.create_map().cast("map<string,variant>")


def deep_merge(docs: DataFrame, base: str, top: str, out: str, levels: int = LEVELS) -> DataFrame:
    """Add *out*, the recursive overlay of the objects in *base* and *top* (VARIANT): objects merge, everything else is replaced.

    A key in *top* wins, also with JSON null; what is no object (or null) on either side counts as an empty object there.  Any depth is
    merged in full: rows in which objects meet no deeper than *levels* are merged in place, the others are taken out, written
    once with a number of their own, and put together bottom-up.
    """
    kept = docs.columns
    start = F.lit("")
    flagged = compute_once(docs, _pairs=_pairs(F.col(base), F.col(top), start, levels))
    flat = flagged.filter(F.size("_pairs") == 0).select(*kept, _merged(F.col(base), F.col(top), start, _no_results(), levels).alias(out))
    # Each table holds pairs (_row, _base, _top) with the places below them where pairs are left (_pairs).
    rows = stage(flagged.filter(F.size("_pairs") > 0).select("*", F.monotonically_increasing_id().alias("_row")), "deep-rows")
    if rows.isEmpty():
        return flat
    tables = [rows.select("_row", F.col(base).alias("_base"), F.col(top).alias("_top"), "_pairs")]
    while True:
        left = tables[-1].filter(F.size("_pairs") > 0).select(F.col("_row").alias("_parent"), F.explode("_pairs").alias("_p"))
        below = left.select("_parent", F.col("_p.at").alias("_at"), F.col("_p.base").alias("_base"), F.col("_p.top").alias("_top"))
        below = compute_once(below, _pairs=_pairs(F.col("_base"), F.col("_top"), start, levels))
        tables.append(stage(below.select("*", F.monotonically_increasing_id().alias("_row")), "deep-pairs"))
        if tables[-1].filter(F.size("_pairs") > 0).isEmpty():
            break
    results = None
    counts = [table.count() for table in tables]
    for k in reversed(range(len(tables))):
        table = tables[k]
        if results is None:
            ready = table.withColumn("_below", _no_results())
        else:
            dealt = _dealt(table, "_row", counts[k]).join(_dealt(results, "_row", counts[k]), "_row", "left")
            ready = dealt.withColumn("_below", F.coalesce("_below", _no_results()))
        done = ready.withColumn("_out", _merged(F.col("_base"), F.col("_top"), start, F.col("_below"), levels))
        if k == 0:
            return flat.unionByName(_dealt(rows, "_row", counts[0]).join(done.select("_row", F.col("_out").alias(out)), "_row").select(*kept, out))
        # The pairs of one parent lie in one document, so they are no more than its keys.
        results = stage(_dealt(done.select(F.col("_parent").alias("_row"), "_at", "_out"), "_row", counts[k]).groupBy("_row").agg(
            F.map_from_entries(F.collect_list(F.struct("_at", "_out"))).alias("_below")), "deep-results")
