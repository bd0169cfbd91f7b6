"""M and lookup-join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentkit.operators import merge as M
from contentkit.operators import publish as P
from contentkit.operators.bucketed import BucketedCatalog
from contentkit.operators.convert import convert_records
from contentkit.operators.maintained import MaintainedFacets
from contentkit.operators.skew import scratch_dir
from contentkit.plans.queries.base import (
    MERGE_SQL, PART_SQL, RUN_TIME, branded_catalog, order_batch, part_records, query, table,
)
from contentkit.records import CATEGORIES

SHOWN = ["id", "name", "category", "source_book", "page_number", "schema_version"]
KEPT = "id, name, category, source_book, page_number"


@query("m1_merge_keep", f"""WITH {MERGE_SQL}
SELECT {KEPT}, '2.0.0' AS schema_version FROM cat
UNION ALL SELECT {KEPT}, '2.0.0' FROM batch JOIN verdict v ON lower(name) = v.k AND ord = v.first WHERE v.held IS NULL""")
def m1(spark, sf):
    return M.merge_batch(branded_catalog(spark, sf), order_batch(spark, sf))[0].select(*SHOWN)


@query("m1_merge_overwrite", f"""WITH {MERGE_SQL}
SELECT c.id, coalesce(b.name, c.name) AS name, coalesce(b.category, c.category) AS category,
       coalesce(b.source_book, c.source_book) AS source_book, coalesce(b.page_number, c.page_number) AS page_number,
       '2.0.0' AS schema_version
FROM cat c LEFT JOIN verdict v ON v.held = c.ord LEFT JOIN batch b ON b.ord = v.last
UNION ALL
SELECT f.id, l.name, l.category, l.source_book, l.page_number, '2.0.0'
FROM verdict v JOIN batch f ON f.ord = v.first JOIN batch l ON l.ord = v.last WHERE v.held IS NULL""")
def m1_overwrite(spark, sf):
    return M.merge_batch(branded_catalog(spark, sf), order_batch(spark, sf), overwrite=True)[0].select(*SHOWN)


@query("m1_actions", f"""WITH {MERGE_SQL}
SELECT b.id, b.name, CASE WHEN v.held IS NOT NULL OR b.ord <> v.first THEN 'skipped' ELSE 'added' END AS action
FROM batch b JOIN verdict v ON lower(b.name) = v.k""")
def m1_actions(spark, sf):
    return M.merge_batch(branded_catalog(spark, sf), order_batch(spark, sf))[1].select("id", "name", "action")


@query("m2_upsert_actions", f"""WITH {MERGE_SQL}
SELECT b.id, CASE WHEN v.held IS NOT NULL OR b.ord <> v.first THEN 'updated' ELSE 'added' END AS action
FROM batch b JOIN verdict v ON lower(b.name) = v.k""")
def m2(spark, sf):
    return M.upsert(branded_catalog(spark, sf), order_batch(spark, sf))[1].select("id", "action")


def _bucketed(spark, sf, overwrite):
    """The catalog in buckets, and the orders merged into it in two batches: those with even keys first."""
    store = BucketedCatalog(spark, scratch_dir(spark, "catalog"), buckets=16)
    store.load(branded_catalog(spark, sf))
    for half in (0, 1):
        store.merge(order_batch(spark, sf).filter(F.col("ord") % 2 == half), overwrite)
    return store.read().select(*SHOWN)


HALVES_SQL = MERGE_SQL + """,
turns AS (SELECT lower(name) AS k, arg_min(ord, (ord % 2) * 1000000000000 + ord) AS first, arg_max(ord, (ord % 2) * 1000000000000 + ord) AS last FROM batch GROUP BY 1),
ruled AS (SELECT t.*, h.held FROM turns t LEFT JOIN held h USING (k))"""


@query("m1_bucketed_merge", f"""WITH {HALVES_SQL}
SELECT {KEPT}, '2.0.0' AS schema_version FROM cat
UNION ALL SELECT {KEPT}, '2.0.0' FROM batch JOIN ruled v ON lower(name) = v.k AND ord = v.first WHERE v.held IS NULL""")
def m1_bucketed(spark, sf):
    return _bucketed(spark, sf, False)


@query("m2_bucketed_upsert", f"""WITH {HALVES_SQL}
SELECT c.id, coalesce(b.name, c.name) AS name, coalesce(b.category, c.category) AS category,
       coalesce(b.source_book, c.source_book) AS source_book, coalesce(b.page_number, c.page_number) AS page_number,
       '2.0.0' AS schema_version
FROM cat c LEFT JOIN ruled v ON v.held = c.ord LEFT JOIN batch b ON b.ord = v.last
UNION ALL
SELECT f.id, l.name, l.category, l.source_book, l.page_number, '2.0.0'
FROM ruled v JOIN batch f ON f.ord = v.first JOIN batch l ON l.ord = v.last WHERE v.held IS NULL""")
def m2_bucketed(spark, sf):
    return _bucketed(spark, sf, True)


def _incoming(spark, sf):
    """One row per customer; ids of existing parts and new ones."""
    base = part_records(spark, sf).limit(0)
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ord"),
        F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "p").otherwise("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("name"), F.lit("equipment").alias("category"), F.col("c_mktsegment").alias("source_book"))
    return base.unionByName(rows, allowMissingColumns=True)


@query("m2b_insert_strict", f"""WITH {PART_SQL}
SELECT id, name FROM rec UNION ALL
SELECT 'c' || c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT 'p' || c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'
  AND 'p' || c_custkey NOT IN (SELECT id FROM rec)""")
def m2b_insert(spark, sf):
    return M.insert_strict(part_records(spark, sf), _incoming(spark, sf))[0].select("id", "name")


@query("m2b_insert_rejects", f"""WITH {PART_SQL}
SELECT 'p' || c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND 'p' || c_custkey IN (SELECT id FROM rec)""")
def m2b_rejects(spark, sf):
    return M.insert_strict(part_records(spark, sf), _incoming(spark, sf))[1].select("id", "name")


@query("m2b_update_strict", f"""WITH {PART_SQL}
SELECT rec.id, coalesce(c_name, name) AS name FROM rec
LEFT JOIN customer ON c_mktsegment = 'BUILDING' AND 'p' || c_custkey = rec.id""")
def m2b_update(spark, sf):
    return M.update_strict(part_records(spark, sf), _incoming(spark, sf))[0].select("id", "name")


@query("m3_versioned_names_parity", f"""WITH {MERGE_SQL}
SELECT id, CASE WHEN v.held IS NULL THEN name ELSE name || ' v2' END AS versioned_name
FROM batch JOIN verdict v ON lower(name) = v.k""")
def m3_parity(spark, sf):
    return M.versioned_names(order_batch(spark, sf), branded_catalog(spark, sf), "run", unique=False).select("id", "versioned_name")


@query("m3_versioned_names", f"""WITH {MERGE_SQL},
r AS (SELECT id, name, v.held, row_number() OVER (PARTITION BY lower(name) ORDER BY ord) AS rk
      FROM batch JOIN verdict v ON lower(name) = v.k),
s AS (SELECT *, CASE WHEN held IS NULL THEN rk - 1 ELSE rk END AS slot FROM r)
SELECT id, CASE WHEN slot = 0 THEN name WHEN slot <= 98 THEN name || ' v' || (slot + 1) ELSE name || ' run-' || slot END AS versioned_name
FROM s""")
def m3(spark, sf):
    return M.versioned_names(order_batch(spark, sf), branded_catalog(spark, sf), "run").select("id", "versioned_name")


@query("m5_resolve_action", f"""WITH {MERGE_SQL}
SELECT id, CASE WHEN v.held IS NOT NULL THEN 'update' ELSE 'create' END AS action FROM batch JOIN verdict v ON lower(name) = v.k""")
def m5(spark, sf):
    return M.resolve_action(order_batch(spark, sf), branded_catalog(spark, sf), "replace").select("id", "action")


def _as_documents(df):
    pairs = [x for c in CATEGORIES for x in (F.lit(c.name), F.lit(c.pack))]
    return df.select("ord", "id", "name", F.try_element_at(F.create_map(*pairs), F.col("category")).alias("pack_id"), "source_book")


PACK_CASE = "CASE category " + " ".join(f"WHEN '{c.name}' THEN '{c.pack}'" for c in CATEGORIES) + " END"
PUBLISH_SQL = f"""{MERGE_SQL},
idx AS (SELECT ord, id, name, {PACK_CASE} AS pack_id, source_book FROM cat),
docs AS (SELECT ord, id, name, {PACK_CASE} AS pack_id, source_book FROM batch),
pheld AS (SELECT pack_id, lower(name) AS k, min(ord) AS held FROM idx GROUP BY 1, 2),
pfirst AS (SELECT ord, row_number() OVER (PARTITION BY pack_id, lower(name) ORDER BY name DESC, ord) AS rn,
                  row_number() OVER (PARTITION BY pack_id, lower(name) ORDER BY name, ord DESC) AS rl FROM docs)"""


@query("m4_publish", f"""WITH {PUBLISH_SQL}
SELECT d.id, d.pack_id, CASE WHEN h.held IS NOT NULL OR f.rn > 1 THEN 'updated' ELSE 'imported' END AS disposition
FROM docs d JOIN pfirst f USING (ord) LEFT JOIN pheld h ON h.pack_id = d.pack_id AND h.k = lower(d.name)""")
def m4(spark, sf):
    docs, index = _as_documents(order_batch(spark, sf)), _as_documents(branded_catalog(spark, sf))
    return P.publish(docs, index)[1].select("id", "pack_id", "disposition")


@query("m4_published_index", f"""WITH {PUBLISH_SQL},
f AS (SELECT d.*, p.rn, p.rl FROM docs d JOIN pfirst p USING (ord)),
last AS (SELECT * FROM f WHERE rl = 1), first AS (SELECT * FROM f WHERE rn = 1)
SELECT i.id, coalesce(l.name, i.name) AS name, i.pack_id, coalesce(l.source_book, i.source_book) AS source_book
FROM idx i LEFT JOIN pheld h ON h.held = i.ord
LEFT JOIN last l ON l.pack_id = h.pack_id AND lower(l.name) = h.k
UNION ALL
SELECT a.id, l.name, l.pack_id, l.source_book FROM first a JOIN last l ON a.pack_id = l.pack_id AND lower(a.name) = lower(l.name)
LEFT JOIN pheld h ON h.pack_id = a.pack_id AND h.k = lower(a.name) WHERE h.held IS NULL""")
def m4_index(spark, sf):
    docs, index = _as_documents(order_batch(spark, sf)), _as_documents(branded_catalog(spark, sf))
    return P.publish(docs, index)[0].select("id", "name", "pack_id", "source_book")


@query("m6_import_documents", f"""WITH {PUBLISH_SQL},
typed AS (SELECT b.*, CASE WHEN b.source_book = '5-LOW' THEN 'unheard' ELSE b.category END AS ct FROM batch b),
routed AS (SELECT t.*, {PACK_CASE.replace('category', 'ct', 1)} AS pack FROM typed t),
ok AS (SELECT *, row_number() OVER (PARTITION BY pack, lower(name) ORDER BY name DESC, ord) AS rn FROM routed
       WHERE pack IS NOT NULL AND pack NOT IN ('weapons', 'npcs'))
SELECT r.id, CASE WHEN ok.ord IS NULL THEN 'failed' WHEN h.held IS NOT NULL OR ok.rn > 1 THEN 'skipped' ELSE 'success' END AS outcome,
       CASE WHEN r.pack IS NULL THEN 'NO_PACK_CONFIG' WHEN r.pack = 'npcs' THEN 'PACK_NOT_FOUND' WHEN r.pack = 'weapons' THEN 'PACK_LOCKED' END AS code
FROM routed r LEFT JOIN ok USING (ord) LEFT JOIN pheld h ON h.pack_id = r.pack AND h.k = lower(r.name)""")
def m6(spark, sf):
    batch = order_batch(spark, sf)
    docs = batch.select("ord", "id", "name", "source_book", F.when(
        F.col("source_book") == "5-LOW", "unheard").otherwise(F.col("category")).alias("content_type"))
    # The collections that exist are those of the catalog; one is missing and one is locked.
    packs = _as_documents(branded_catalog(spark, sf)).select("pack_id").distinct().filter("pack_id <> 'npcs'").withColumn(
        "locked", F.col("pack_id") == "weapons")
    return P.import_documents(docs, packs, _as_documents(branded_catalog(spark, sf)))[1].select("id", "outcome", "code")


@query("m7_collect_published", f"""WITH {PART_SQL}
SELECT id, name, category AS content_type, publisher FROM rec WHERE publisher <> 'Brand#1'""")
def m7(spark, sf):
    docs = convert_records(part_records(spark, sf), RUN_TIME).withColumn(
        "lineage", F.when(F.col("publisher") != "Brand#1", F.col("lineage")))
    return P.collect_published(docs).select("id", "name", "content_type", F.col("lineage.publisher").alias("publisher"))


@query("m8_publish_run", f"""WITH {PART_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY category, lower(name) ORDER BY ord) AS rn FROM rec
      WHERE category IN ('weapon', 'npc', 'spell', 'journal')
        AND id IN (SELECT 'p' || l_partkey FROM lineitem WHERE l_returnflag = 'R'))
SELECT id, category, CASE WHEN rn > 1 THEN 'updated' ELSE 'imported' END AS disposition FROM r""")
def m8(spark, sf):
    ids = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"))
    records = part_records(spark, sf)
    index = records.limit(0).select("ord", "id", "name", F.lit("").alias("pack_id"))
    return P.publish_run(records, index, RUN_TIME, ids, ["weapon", "npc", "spell", "journal"]).results.select("id", "category", "disposition")


@query("m8_written_documents", f"""WITH {PART_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY category, lower(name) ORDER BY ord) AS rn,
             row_number() OVER (PARTITION BY category, lower(name) ORDER BY ord DESC) AS rl FROM rec WHERE category = 'armor')
SELECT f.id AS document_id, l.id AS record_id, l.name, CAST(l.level AS DOUBLE) AS level
FROM r f JOIN r l ON lower(f.name) = lower(l.name) WHERE f.rn = 1 AND l.rl = 1""")
def m8_documents(spark, sf):
    records = part_records(spark, sf)
    index = records.limit(0).select("ord", "id", "name", F.lit("").alias("pack_id"))
    documents = P.publish_run(records, index, RUN_TIME, categories=["armor"]).documents()
    return documents.select(
        "document_id", F.col("lineage.recordId").alias("record_id"), "name",
        F.try_variant_get("system", "$.level", "double").alias("level"))


@query("m8_published_twice", f"""WITH {PART_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY category, lower(name) ORDER BY ord) AS rn,
             row_number() OVER (PARTITION BY category, lower(name) ORDER BY ord DESC) AS rl FROM rec)
SELECT f.id AS document_id, l.id AS record_id, l.name, {PACK_CASE.replace('category', 'l.category', 1)} AS pack_id
FROM r f JOIN r l ON f.category = l.category AND lower(f.name) = lower(l.name) WHERE f.rn = 1 AND l.rl = 1""")
def m8_twice(spark, sf):
    """Two runs into the same collections: the second replaces what the first has written."""
    store = P.published_store(spark, scratch_dir(spark, "published"), buckets=8)
    for _ in range(2):
        P.publish_into(store, part_records(spark, sf), RUN_TIME)
    return store.read().select(F.col("id").alias("document_id"), F.col("lineage.recordId").alias("record_id"), "name", "pack_id")


@query("a2_maintained_facets", f"""WITH {HALVES_SQL},
final AS (
  SELECT coalesce(b.category, c.category) AS category, coalesce(b.source_book, c.source_book) AS source_book, coalesce(b.publisher, c.publisher) AS publisher
  FROM cat c LEFT JOIN ruled v ON v.held = c.ord LEFT JOIN batch b ON b.ord = v.last
  UNION ALL SELECT l.category, l.source_book, l.publisher FROM ruled v JOIN batch l ON l.ord = v.last WHERE v.held IS NULL)
SELECT 'category' AS facet, category AS value, count(*) AS count FROM final GROUP BY 2
UNION ALL SELECT 'publisher', publisher, count(*) FROM final WHERE publisher <> '' GROUP BY 2
UNION ALL SELECT 'sourceBook', source_book, count(*) FROM final WHERE source_book <> '' GROUP BY 2""")
def a2_maintained(spark, sf):
    """Facet counts carried along through two merges; only changed buckets are counted again."""
    store = BucketedCatalog(spark, scratch_dir(spark, "catalog"), buckets=16)
    store.load(branded_catalog(spark, sf))
    counts = MaintainedFacets(store)
    for half in (0, 1):
        counts.refresh()
        store.merge(order_batch(spark, sf).filter(F.col("ord") % 2 == half), overwrite=True)
    return counts.refresh().filter(F.col("facet").isin("category", "publisher", "sourceBook"))
