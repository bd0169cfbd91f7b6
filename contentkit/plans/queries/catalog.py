"""F, A1, A2 and O queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentkit.operators import catalog as C
from contentkit.operators.bucketed import BucketedCatalog
from contentkit.operators.catalog import CatalogFilter
from contentkit.operators.review import accepted_records, review_decisions
from contentkit.operators.skew import scratch_dir
from contentkit.operators.text_index import TextIndex
from contentkit.plans.queries.base import PART_SQL, RUN_TIME, flat_tags, part_records, pick, pick_sql, query, table
from contentkit.records import with_category_dim

SHOWN = ["id", "name", "category", "publisher"]
FLAGSHIP = CatalogFilter(
    search_text="RED", categories=["weapon", "armor", "spell", "npc", "feat"], source_books=["ECONOMY", "PROMO", "LARGE"])


@query("f1_catalog_query", f"""WITH {PART_SQL}
SELECT id, name, category, publisher FROM rec
WHERE (contains(lower(name), 'red') OR len(list_filter(tags, lambda t: contains(lower(t), 'red'))) > 0
       OR contains(lower(source_book), 'red'))
  AND category IN ('weapon', 'armor', 'spell', 'npc', 'feat') AND source_book IN ('ECONOMY', 'PROMO', 'LARGE')""")
def f1(spark, sf):
    return C.catalog_query(part_records(spark, sf), FLAGSHIP).select(*SHOWN)


@query("f2_search_text", f"""WITH {PART_SQL}
SELECT id, name, category, publisher FROM rec
WHERE contains(lower(name), 'bol') OR contains(lower(source_book), 'bol')
   OR len(list_filter(tags, lambda t: contains(lower(t), 'bol'))) > 0""")
def f2(spark, sf):
    return C.apply_filter(part_records(spark, sf), CatalogFilter(search_text="Bol")).select(*SHOWN)


@query("f3_attribute_filters", f"""WITH {PART_SQL}
SELECT id, name, category, publisher FROM rec
WHERE category IN ('weapon', 'hazard') AND publisher IN ('Brand#2', 'Brand#17', 'Brand#9') AND source_book IN ('SMALL', 'MEDIUM')""")
def f3(spark, sf):
    flt = CatalogFilter(categories=["weapon", "hazard"], publishers=["Brand#2", "Brand#17", "Brand#9"], source_books=["SMALL", "MEDIUM"])
    return C.apply_filter(part_records(spark, sf), flt).select(*SHOWN)


@query("f4_tags_all", f"""WITH {PART_SQL}
SELECT id, name, category, publisher FROM rec WHERE list_has_all(tags, ['hot', 'gear'])""")
def f4(spark, sf):
    return C.apply_filter(part_records(spark, sf), CatalogFilter(tags=["hot", "gear"])).select(*SHOWN)


@query("f5_import_method", f"WITH {PART_SQL} SELECT id, name, category, publisher FROM rec WHERE import_method = 'csv'")
def f5(spark, sf):
    return C.apply_filter(part_records(spark, sf), CatalogFilter(import_method="csv")).select(*SHOWN)


@query("f6_browse_filter", f"""WITH {PART_SQL}
SELECT id, name, category, publisher FROM rec WHERE contains(lower(name), 'small') AND list_has_all(tags, ['rod'])""")
def f6(spark, sf):
    return C.browse_filter(part_records(spark, sf), CatalogFilter(search_text="SMALL", tags=["rod"])).select(*SHOWN)


@query("f7_lookup_by_name", f"""WITH {PART_SQL},
k AS (SELECT DISTINCT lower(upper(p_name)) AS k FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY ord) AS rn FROM rec)
WHERE rn = 1 AND lower(name) IN (SELECT k FROM k)""")
def f7_name(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("key"))
    keys = table(spark, sf, "lineitem").select("l_partkey").distinct().join(parts, "l_partkey").select("key")
    return C.lookup_many(part_records(spark, sf), keys, "name").select("id", "name")


@query("f7_lookup_by_id", f"""WITH {PART_SQL}
SELECT id, name FROM rec WHERE id IN (SELECT 'p' || l_partkey FROM lineitem WHERE l_quantity >= 48)""")
def f7_id(spark, sf):
    keys = table(spark, sf, "lineitem").filter("l_quantity >= 48").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("key"))
    return C.lookup_many(part_records(spark, sf), keys).select("id", "name")


@query("f7_names_present", f"""WITH {PART_SQL},
k AS (SELECT DISTINCT s_name AS key FROM supplier UNION SELECT DISTINCT upper(p_name) FROM part)
SELECT key, lower(key) IN (SELECT lower(name) FROM rec) AS present FROM k""")
def f7_present(spark, sf):
    keys = table(spark, sf, "supplier").select(F.col("s_name").alias("key")).union(table(spark, sf, "part").select(F.upper("p_name")))
    return C.names_present(part_records(spark, sf), keys)


@query("f8_status_filter", "SELECT event_id, event_type AS status, user_id FROM events WHERE event_type = 'error'")
def f8(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("status"), "user_id")
    return C.value_filter(rows, "status", "error")


@query("f8_failed_only", "SELECT event_id, user_id, false AS valid FROM events WHERE NOT (value >= 25)")
def f8_failed(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", (F.col("value") >= 25).alias("valid"))
    return C.failed_only(rows)


@query("f9_sparse_pages", "SELECT doc_id, length(text) AS text_length FROM documents WHERE length(text) < 100")
def f9(spark, sf):
    return C.sparse_pages(table(spark, sf, "documents")).select("doc_id", F.length("text").alias("text_length"))


@query("f10_select_records", f"""WITH {PART_SQL}
SELECT id, name, category FROM rec WHERE category IN ('weapon', 'theme', 'journal')
  AND id IN (SELECT 'p' || l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def f10(spark, sf):
    ids = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"))
    return C.select_records(part_records(spark, sf), ids, ["weapon", "theme", "journal"]).select("id", "name", "category")


def _edits(spark, sf):
    supplier = table(spark, sf, "supplier")
    return supplier.select(
        F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("id"),
        F.concat(F.lit("seen by "), "s_name").alias("notes"), F.array(F.lit("checked"), "s_name").alias("tags"),
        F.col("s_suppkey").alias("ord"),
    ).union(table(spark, sf, "nation").select(
        F.concat(F.lit("x"), F.col("n_nationkey").cast("string")), F.col("n_name"), F.array("n_name"), F.col("n_nationkey").cast("bigint")))


@query("f12_update_notes_tags", f"""WITH {PART_SQL},
e AS (SELECT 'p' || s_nationkey AS id, arg_max(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1)
SELECT rec.id, CASE WHEN e.id IS NULL THEN '' ELSE 'seen by ' || s_name END AS notes,
       CASE WHEN e.id IS NULL THEN array_to_string(tags, '|') ELSE 'checked|' || s_name END AS tags
FROM rec LEFT JOIN e ON rec.id = e.id""")
def f12(spark, sf):
    out, _ = C.update_notes_tags(part_records(spark, sf), _edits(spark, sf))
    return out.select("id", "notes", flat_tags().alias("tags"))


@query("f12_unknown_edits", "SELECT 'x' || n_nationkey AS id, n_name AS notes FROM nation")
def f12_rejects(spark, sf):
    _, rejects = C.update_notes_tags(part_records(spark, sf), _edits(spark, sf))
    return rejects.select("id", "notes")


@query("f13_delete_by_ids", f"""WITH {PART_SQL}
SELECT id, name FROM rec WHERE id NOT IN (SELECT 'p' || s_suppkey FROM supplier)""")
def f13(spark, sf):
    ids = table(spark, sf, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("id"))
    return C.delete_by_ids(part_records(spark, sf), ids).select("id", "name")


DECISIONS = ["accepted", "rejected", "edited"]


def _reviewed(spark, sf):
    extracted = part_records(spark, sf).select(
        "ord", F.col("id").alias("record_id"), "name", "category", "source_book", "publisher", "page_number",
        F.col("tags").alias("auto_tags"), "notes", F.col("raw_content").alias("structured_data"),
        F.lit("pending").alias("status"), F.concat(F.lit("text of "), "name").alias("text"))
    status = pick(DECISIONS, F.col("c_custkey") % 3)
    decisions = table(spark, sf, "customer").select(
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("record_id"), status.alias("status"),
        F.when(status == "edited", F.col("c_name")).alias("name"),
        F.when(status == "edited", F.lower("c_mktsegment")).alias("category"),
        F.when(status == "edited", F.lit("fixed")).alias("notes"))
    return review_decisions(extracted, decisions, pending_to="accepted")


REVIEW_SQL = f"""{PART_SQL},
d AS (SELECT 'p' || c_custkey AS id, {pick_sql(DECISIONS, 'c_custkey % 3')} AS status, c_name, c_mktsegment FROM customer),
r AS (SELECT rec.*, coalesce(d.status, 'accepted') AS status,
             CASE WHEN d.status = 'edited' THEN c_name ELSE name END AS new_name,
             CASE WHEN d.status = 'edited' THEN lower(c_mktsegment) ELSE category END AS new_category
      FROM rec LEFT JOIN d ON rec.id = d.id)"""


@query("f14_review_decisions", f"WITH {REVIEW_SQL} SELECT id AS record_id, status, new_name AS name, new_category AS category FROM r")
def f14(spark, sf):
    return _reviewed(spark, sf).select("record_id", "status", "name", "category")


@query("f14_accepted_records", f"""WITH {REVIEW_SQL}
SELECT id, new_name AS name, CASE WHEN status = 'edited' THEN 'equipment' ELSE new_category END AS category,
       CASE WHEN status = 'edited' THEN 'fixed' ELSE '' END AS notes, 'txt' AS import_method,
       'text of ' || name AS raw_text, CAST(level AS BIGINT) AS level
FROM r WHERE status IN ('accepted', 'edited')""")
def f14_records(spark, sf):
    return accepted_records(_reviewed(spark, sf), RUN_TIME).select(
        "id", "name", "category", "notes", "import_method",
        F.try_variant_get("raw_content", "$._rawText", "string").alias("raw_text"),
        F.try_variant_get("raw_content", "$.level", "bigint").alias("level"))


@query("a1_count_by_category", f"WITH {PART_SQL} SELECT category, count(*) AS count FROM rec GROUP BY 1")
def a1(spark, sf):
    return C.count_by_category(part_records(spark, sf)).select("category", "count")


@query("a1_count_all", "SELECT count(*) AS total FROM part")
def a1_all(spark, sf):
    return C.count_all(part_records(spark, sf))


@query("a2_facet_publishers", "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand <> ''")
def a2(spark, sf):
    return C.facet_values(part_records(spark, sf), "publisher")


@query("a2_facet_tags", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS value FROM part")
def a2_tags(spark, sf):
    return C.facet_values(part_records(spark, sf), "tags")


@query("a2_facets", f"""WITH {PART_SQL}, f AS (
  SELECT 'publisher' AS facet, publisher AS value FROM rec UNION ALL SELECT 'sourceBook', source_book FROM rec
  UNION ALL SELECT 'importMethod', import_method FROM rec UNION ALL SELECT 'tags', unnest(tags) FROM rec)
SELECT facet, value, count(*) AS count FROM f GROUP BY 1, 2""")
def a2_all(spark, sf):
    return C.facets(part_records(spark, sf))


@query("j4_category_dimension", f"""WITH {PART_SQL}
SELECT document_type, count(*) AS records, count(DISTINCT category) AS categories FROM (
  SELECT *, CASE WHEN category = 'journal' THEN 'JournalEntry'
                 WHEN category IN ('npc', 'vehicle', 'starship', 'hazard') THEN 'Actor' ELSE 'Item' END AS document_type
  FROM rec) GROUP BY 1""")
def j4(spark, sf):
    return with_category_dim(part_records(spark, sf)).groupBy("document_type").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("category").alias("categories"))


@query("o1_sort_records", f"WITH {PART_SQL} SELECT id, source_book, name FROM rec")
def o1(spark, sf):
    return C.sort_records(part_records(spark, sf), "sourceBook", ascending=False).select("id", "source_book", "name")


@query("o2_sort_documents", f"WITH {PART_SQL} SELECT id, category, name FROM rec")
def o2(spark, sf):
    return C.sort_records(part_records(spark, sf), "contentType").select("id", "category", "name")


def _templates(spark, sf):
    return part_records(spark, sf).select(
        "ord", F.col("id").alias("uuid"), "name", F.col("category").alias("subtype"), F.col("raw_content").alias("snapshot"))


@query("o3_sort_templates", f"WITH {PART_SQL} SELECT id AS uuid, category AS subtype, name FROM rec")
def o3(spark, sf):
    return C.sort_templates(_templates(spark, sf)).select("uuid", "subtype", "name")


@query("o4_recent_runs", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def o4(spark, sf):
    return C.recent_runs(table(spark, sf, "events"), order="ts", tiebreak="event_id").select("event_id", "user_id")


@query("j10_first_templates", f"""WITH {PART_SQL}
SELECT category AS subtype, arg_min(id, ord) AS uuid, arg_min(CAST(level AS BIGINT), ord) AS level FROM rec GROUP BY 1""")
def j10(spark, sf):
    return C.first_templates(_templates(spark, sf)).select(
        "subtype", "uuid", F.try_variant_get("snapshot", "$.level", "bigint").alias("level"))


@query("f2_indexed_search", f"""WITH {PART_SQL}
SELECT id, name, category, publisher FROM rec
WHERE contains(lower(name), 'bol') OR contains(lower(source_book), 'bol')
   OR len(list_filter(tags, lambda t: contains(lower(t), 'bol'))) > 0""")
def f2_indexed(spark, sf):
    """The search by trigram lists, over a catalog kept in buckets."""
    store = BucketedCatalog(spark, scratch_dir(spark, "catalog"), buckets=16)
    store.load(part_records(spark, sf))
    return TextIndex(store, parts=8).search("BOL").select(*SHOWN)
