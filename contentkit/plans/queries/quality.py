"""Q, A7, A8, A13 and J1 queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentkit.operators import quality as Q
from contentkit.operators import rollups as R
from contentkit.operators.convert import convert_records
from contentkit.plans.content_rules import FIELD_RULES, REQUIRED_PATHS
from contentkit.plans.queries.base import (
    MERGE_SQL, PART_SQL, RUN_TIME, branded_catalog, order_batch, busy_table, part_records, query, table,
)


def _entries(spark, sf):
    """Orders as npc entries and line items as weapon entries, with values inside and outside the rules."""
    orders = busy_table(spark, sf, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("entry_id"), F.lit("npc").alias("content_type"),
        F.to_variant_object(F.struct(
            F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
            (F.col("o_custkey") % 40).alias("cr"), F.col("o_totalprice").alias("xp"),
            F.when(F.col("o_orderstatus") == "F", "CE").when(F.col("o_orderstatus") == "O", "N").otherwise("XX").alias("alignment"),
            F.col("o_orderpriority").alias("hp"))).alias("data"))
    customer = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entry_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "spell").otherwise("unheard").alias("content_type"),
        F.to_variant_object(F.struct(
            F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("c_name")).alias("name"),
            (F.col("c_nationkey") % 9).alias("level"), F.lit("evo").alias("school"))).alias("data"))
    return orders.unionByName(customer)


ENTRY_SQL = """e AS (
  SELECT 'o' || o_orderkey AS entry_id, o_custkey % 40 AS cr, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
issues AS (
  SELECT entry_id, 'npc' AS content_type, 'VALUE_TOO_LOW' AS code, 'cr' AS field FROM e WHERE cr < 0.125
  UNION ALL SELECT entry_id, 'npc', 'VALUE_TOO_HIGH', 'cr' FROM e WHERE cr > 30
  UNION ALL SELECT entry_id, 'npc', 'INVALID_ENUM_VALUE', 'alignment' FROM e WHERE st NOT IN ('F', 'O')
  UNION ALL SELECT 'c' || c_custkey, 'spell', 'REQUIRED_FIELD_MISSING', 'name' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3
  UNION ALL SELECT 'c' || c_custkey, 'spell', 'VALUE_TOO_HIGH', 'level' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 9 > 6
  UNION ALL SELECT 'c' || c_custkey, 'unheard', 'NO_SCHEMA', NULL FROM customer WHERE c_mktsegment <> 'BUILDING')"""


@query("q1_validate_content", f"WITH {ENTRY_SQL} SELECT entry_id, content_type, code, field FROM issues")
def q1(spark, sf):
    return R.error_log(Q.validate_content(_entries(spark, sf), FIELD_RULES), ["entry_id", "content_type"]).select(
        "entry_id", "content_type", "code", "field")


@query("q2_rule_packs", f"""WITH {PART_SQL}
SELECT id, category, CASE WHEN level > 20 THEN 'VALUE_TOO_HIGH' ELSE NULL END AS level_code
FROM rec WHERE category IN ('weapon', 'armor', 'equipment', 'augmentation', 'vehicle')""")
def q2(spark, sf):
    entries = part_records(spark, sf).filter(
        F.col("category").isin("weapon", "armor", "equipment", "augmentation", "vehicle"))
    out = Q.validate_content(entries, FIELD_RULES, payload="raw_content", category="category")
    level = F.filter("issues", lambda i: i["field"] == "level")
    return out.select("id", "category", F.get(level, F.lit(0))["code"].alias("level_code"))


def _drafts(spark, sf):
    batch = order_batch(spark, sf)
    return batch.select(
        "ord",
        F.when(F.col("page_number") == 7, F.lit("  ")).otherwise(F.concat(F.lit(" "), "name")).alias("name"),
        F.when(F.col("page_number") == 8, F.lit(None)).when(F.col("page_number") == 9, "gadget").otherwise(F.col("category")).alias("category"),
        F.when(F.col("page_number") == 10, "").otherwise(F.col("source_book")).alias("source_book"),
        "publisher", F.col("page_number").cast("double").alias("page_number"), "raw_content")


DRAFT_SQL = f"""{MERGE_SQL},
d AS (SELECT b.ord, CASE WHEN page_number = 7 THEN '' ELSE name END AS name,
             CASE WHEN page_number = 8 THEN NULL WHEN page_number = 9 THEN 'gadget' ELSE category END AS category,
             CASE WHEN page_number = 10 THEN '' ELSE source_book END AS source_book, page_number,
             name <> '' AND page_number <> 7 AND held.k IS NOT NULL AS dup
      FROM batch b LEFT JOIN held ON lower(b.name) = held.k),
i AS (SELECT ord, 'error' AS level, 'MISSING_NAME' AS code FROM d WHERE name = ''
  UNION ALL SELECT ord, 'error', 'MISSING_CATEGORY' FROM d WHERE category IS NULL
  UNION ALL SELECT ord, 'error', 'INVALID_CATEGORY' FROM d WHERE category = 'gadget'
  UNION ALL SELECT ord, 'error', 'DUPLICATE_NAME' FROM d WHERE dup
  UNION ALL SELECT ord, 'warning', 'MISSING_SOURCE_BOOK' FROM d WHERE source_book = ''
  UNION ALL SELECT ord, 'warning', 'MISSING_PAGE_NUMBER' FROM d WHERE page_number = 0)"""


@query("q3_validate_import", f"WITH {DRAFT_SQL} SELECT ord, level, code FROM i")
def q3(spark, sf):
    checked = Q.validate_import(_drafts(spark, sf), branded_catalog(spark, sf))
    return R.error_log(checked, ["ord"]).select("ord", "level", "code")


@query("q4_overwrite_policy", f"""WITH {DRAFT_SQL}
SELECT ord, CASE code WHEN 'DUPLICATE_NAME' THEN 'warning' ELSE level END AS level,
       CASE code WHEN 'DUPLICATE_NAME' THEN 'WILL_OVERWRITE' ELSE code END AS code FROM i""")
def q4(spark, sf):
    checked = Q.overwrite_policy(Q.validate_import(_drafts(spark, sf), branded_catalog(spark, sf)))
    return R.error_log(checked, ["ord"]).select("ord", "level", "code")


@query("q5_valid_records", f"""WITH {DRAFT_SQL}
SELECT ord, name FROM (SELECT d.ord, ' ' || d.name AS name FROM d WHERE ord NOT IN (SELECT ord FROM i WHERE level = 'error'))""")
def q5(spark, sf):
    return Q.valid_records(Q.validate_import(_drafts(spark, sf), branded_catalog(spark, sf))).select("ord", "name")


@query("q6_required_paths", f"""WITH {PART_SQL}
SELECT id, category, CASE category WHEN 'class' THEN 'system.hpPerLevel' WHEN 'vehicle' THEN 'system.details.level' ELSE '' END AS missing FROM rec""")
def q6(spark, sf):
    docs = convert_records(part_records(spark, sf), RUN_TIME)
    whole = F.to_variant_object(F.create_map(F.lit("name"), F.col("name").cast("variant"), F.lit("system"), "system"))
    out = Q.required_paths(docs.withColumn("document", whole), REQUIRED_PATHS)
    return out.select("id", "category", F.array_join("missing_paths", "|").alias("missing"))


@query("a7_validation_rollup", f"""WITH {DRAFT_SQL}
SELECT (SELECT count(*) FROM d) AS total_checked,
       (SELECT count(*) FROM d WHERE ord NOT IN (SELECT ord FROM i WHERE level = 'error')) AS valid,
       (SELECT count(DISTINCT ord) FROM i WHERE level = 'error') AS invalid,
       (SELECT count(DISTINCT ord) FROM i WHERE level = 'warning') AS with_warnings,
       (SELECT array_to_string(list_sort(list(DISTINCT code)), '|') FROM i WHERE level = 'error') AS error_codes,
       (SELECT array_to_string(list_sort(list(DISTINCT code)), '|') FROM i WHERE level = 'warning') AS warning_codes""")
def a7(spark, sf):
    out = Q.validation_rollup(Q.validate_import(_drafts(spark, sf), branded_catalog(spark, sf)))
    return out.withColumns({c: F.array_join(c, "|") for c in ("error_codes", "warning_codes")})


@query("a8_content_rollup", f"""WITH {ENTRY_SQL},
t AS (SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS n,
             (SELECT count(DISTINCT entry_id) FROM issues WHERE code <> 'NO_SCHEMA') AS bad)
SELECT n AS total_checked, n - bad AS passed, bad AS failed, CAST(floor((n - bad) * 100.0 / n + 0.5) AS BIGINT) AS pass_rate FROM t""")
def a8(spark, sf):
    return Q.content_rollup(Q.validate_content(_entries(spark, sf), FIELD_RULES))


@query("a13_error_log", f"WITH {ENTRY_SQL} SELECT code, count(*) AS count FROM issues GROUP BY 1")
def a13(spark, sf):
    log = R.error_log(Q.validate_content(_entries(spark, sf), FIELD_RULES), ["entry_id"])
    return log.groupBy("code").agg(F.count(F.lit(1)).alias("count"))
