"""X1, X2, X3, X5 and X6 queries over stat blocks rendered from part rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentkit.operators import extract as X
from contentkit.plans.detectors import DETECTORS
from contentkit.plans.prompts import PROMPT_PACKS, RESPONSE_FIELDS, prompt_pack
from contentkit.plans.queries.base import PART_SQL, busy_table, pick, pick_sql, query, table
from contentkit.plans.templates import ARMOR_TEMPLATE, NPC_TEMPLATE, TEMPLATES, WEAPON_TEMPLATE


def render(spark, sf, *pieces: str):
    """One text block per part; a piece in braces is a column, the rest is text."""
    cols = []
    for piece in pieces:
        cols.append(F.expr(piece[1:-1]).cast("string") if piece.startswith("{") else F.lit(piece))
    return busy_table(spark, sf, "part").select(F.col("p_partkey").alias("block_id"), F.concat(*cols).alias("text"))


WEAPON_PIECES = (
    "{upper(p_name)}", "\nSmall arm\nLevel ", "{p_size}", "; Price ", "{cast(p_retailprice as bigint)}", "\nDamage 1d", "{p_size}",
    " F; Range ", "{p_size * 10}", " ft.\nCapacity ", "{p_size + 20}", " charges; Usage ", "{p_size % 4 + 1}",
    "\nBulk ", "{p_size % 3 + 1}", "; Special ", "{lower(p_type)}", " edge\nA trusted tool.")
ARMOR_PIECES = (
    "{upper(p_name)}", "\nHeavy Armor\nLevel ", "{p_size}", "\nPrice ", "{cast(p_retailprice as bigint)}", "\nEAC Bonus +", "{p_size + 1}",
    "; KAC Bonus +", "{p_size + 3}", "\nMax Dex Bonus ", "{p_size % 6 + 1}", "; Armor Check Penalty -", "{p_size % 4}",
    "\nSpeed Adjustment -5 ft.; Upgrade Slots ", "{p_size % 5}", "; Bulk 2\nPlates for hard days.")
NPC_PIECES = (
    "{initcap(p_name)}", " CR ", "{p_size}", "\nXP ", "{p_size * 400}", "\nCE humanoid\nInit +2; Perception +9\nHP ", "{p_size * 10}",
    "\nEAC ", "{p_size + 10}", "; KAC ", "{p_size + 12}", "\nFort +3; Ref -1; Will +", "{p_size % 7}",
    "\nSpeed 30 ft.\nMelee fist +", "{p_size}", "\nRanged bow +2\nStr +4; Dex +", "{p_size % 5}",
    "; Con +1; Int +0; Wis +2; Cha -1\nSkills Stealth +", "{p_size}", "\nLanguages Common\nLurks in docks.")


def _read(v: str, kind: str = "bigint"):
    return F.try_variant_get("data", f"$.{v}", kind).alias(v)


@query("x1_extract_fields", """SELECT p_partkey AS block_id, upper(p_name) AS name, CAST(p_size AS BIGINT) AS level,
  CAST(floor(p_retailprice) AS BIGINT) AS price, CAST(p_size * 10 AS BIGINT) AS "range", CAST(p_size + 20 AS BIGINT) AS capacity,
  CAST(p_size % 4 + 1 AS BIGINT) AS usage, CAST(p_size % 3 + 1 AS VARCHAR) AS bulk,
  lower(p_type) || ' edge' AS special FROM part""")
def x1(spark, sf):
    out = X.extract_fields(render(spark, sf, *WEAPON_PIECES), WEAPON_TEMPLATE.rules)
    return out.select("block_id", _read("name", "string"), *[_read(f) for f in ("level", "price", "range", "capacity", "usage")],
                      _read("bulk", "string"), _read("special", "string"))


@query("x2_armor_template", """SELECT p_partkey AS block_id, CAST(p_size AS BIGINT) AS level, CAST(floor(p_retailprice) AS BIGINT) AS price,
  CAST(NULL AS BIGINT) AS eac, CAST(p_size % 5 AS BIGINT) AS "upgradeSlots", '2' AS bulk FROM part""")
def x2_armor(spark, sf):
    out = X.extract_fields(render(spark, sf, *ARMOR_PIECES), ARMOR_TEMPLATE.rules)
    return out.select("block_id", *[_read(f) for f in ("level", "price", "eac", "upgradeSlots")], _read("bulk", "string"))


@query("x2_npc_template", """SELECT p_partkey AS block_id, CAST(p_size AS BIGINT) AS cr, CAST(p_size * 400 AS BIGINT) AS xp, 'CE' AS alignment,
  'humanoid' AS type, CAST(p_size * 10 AS BIGINT) AS hp, CAST(p_size + 10 AS BIGINT) AS eac, CAST(p_size + 12 AS BIGINT) AS kac,
  CAST(3 AS BIGINT) AS fort, CAST(-1 AS BIGINT) AS ref, CAST(p_size % 7 AS BIGINT) AS will, '30 ft.' AS speed FROM part""")
def x2_npc(spark, sf):
    chosen, _ = X.pick_template(TEMPLATES, "npc-block", "weapon")
    assert chosen is NPC_TEMPLATE
    out = X.extract_fields(render(spark, sf, *NPC_PIECES), chosen.rules)
    return out.select("block_id", *[_read(f) for f in ("cr", "xp", "hp", "eac", "kac", "fort", "ref", "will")],
                      *[_read(f, "string") for f in ("alignment", "type", "speed")])


def _mixed(spark, sf):
    w = render(spark, sf, *WEAPON_PIECES).withColumn("source", F.lit("weapon"))
    a = render(spark, sf, *ARMOR_PIECES).withColumn("source", F.lit("armor"))
    n = render(spark, sf, *NPC_PIECES).withColumn("source", F.lit("npc"))
    return w.unionByName(a).unionByName(n)


@query("x3_score_categories", """SELECT p_partkey AS block_id, 'weapon' AS source, 'weapon' AS category, 8 AS score FROM part
UNION ALL SELECT p_partkey, 'armor', 'armor', 8 FROM part
UNION ALL SELECT p_partkey, 'npc', 'npc', 6 FROM part
UNION ALL SELECT p_partkey, 'npc', 'armor', 4 FROM part""")
def x3(spark, sf):
    return X.score_categories(_mixed(spark, sf), DETECTORS).select("block_id", "source", "category", "score")


@query("x4_detect_mixed", """SELECT source, category, count(*) AS records FROM (
  SELECT 'weapon' AS source, 'weapon' AS category FROM part UNION ALL SELECT 'armor', 'armor' FROM part
  UNION ALL SELECT 'npc', 'npc' FROM part UNION ALL SELECT 'npc', 'armor' FROM part) GROUP BY 1, 2""")
def x4(spark, sf):
    return X.detect_records(_mixed(spark, sf), DETECTORS).groupBy("source", "category").agg(F.count(F.lit(1)).alias("records"))


@query("x4_detect_documents", """SELECT doc_id, 'equipment' AS category, 'Kit of Goods' AS name, CAST(doc_id % 20 + 1 AS BIGINT) AS level, n_chars || ' credits' AS price,
  'L' AS bulk, 'equipment' AS tags FROM documents""")
def x4_documents(spark, sf):
    """Every document behind a short stat line, through all detectors."""
    text = F.concat(
        F.lit("Kit of Goods\nLevel "), (F.col("doc_id") % 20 + 1).cast("string"), F.lit("; Price "), F.col("n_chars").cast("string"),
        F.lit(" credits; Bulk L\n"), F.col("text"))
    found = X.detect_records(busy_table(spark, sf, "documents").select("doc_id", text.alias("text")), DETECTORS)
    data = F.col("structured_data")
    return found.filter("category = 'equipment'").select(
        "doc_id", "category", "name", F.try_variant_get(data, "$.level", "bigint").alias("level"),
        F.try_variant_get(data, "$.price", "string").alias("price"), F.try_variant_get(data, "$.bulk", "string").alias("bulk"),
        F.array_join("auto_tags", "|").alias("tags"))


CATS = ["weapon", "journal", "npc", "theme"]


def _unsure(spark, sf):
    from contentkit.plans.queries.base import part_records
    return part_records(spark, sf).select(
        F.col("id").alias("record_id"), pick(CATS, F.col("ord") % 4).alias("category"), "source_book",
        (F.col("page_number") / 50.0).alias("confidence"), F.concat(F.lit("text of "), "name").alias("text"),
        F.col("raw_content").alias("structured_data"), F.lit("regex").alias("detection_method"))


_WEAPON, _NPC = (prompt_pack(c, RESPONSE_FIELDS[c]) for c in ("weapon", "npc"))


@query("x5_build_prompts", f"""WITH {PART_SQL}, e AS (SELECT id, source_book, name, level, {pick_sql(CATS, 'ord % 4')} AS category FROM rec)
SELECT id AS record_id, category, 'Extract ' || category || ' data from this text from ' || source_book || ':' || chr(10) || chr(10) || 'text of ' || name AS user_prompt
FROM e WHERE level / 50.0 < 0.7 AND category IN ('weapon', 'npc')""")
def x5(spark, sf):
    return X.build_prompts(_unsure(spark, sf), PROMPT_PACKS).select("record_id", "category", "user_prompt")


@query("x6_apply_responses", f"""WITH {PART_SQL}, r AS (SELECT *, CASE WHEN ord % 5 = 0 THEN 'good' WHEN ord % 5 = 1 THEN 'bad' WHEN ord % 5 = 2 THEN 'list' WHEN ord % 5 = 3 THEN 'null' ELSE 'none' END AS resp FROM rec)
SELECT id AS record_id, CASE WHEN resp IN ('good', 'null') THEN 'ai' ELSE 'regex' END AS detection_method,
       CASE WHEN resp IN ('good', 'null') THEN greatest(CAST(level AS DOUBLE) / 50, CAST(0.9 AS DOUBLE)) ELSE CAST(level AS DOUBLE) / 50 END AS confidence,
       CASE WHEN resp = 'good' THEN 99 WHEN resp = 'null' THEN NULL ELSE CAST(level AS BIGINT) END AS level, name FROM r""")
def x6(spark, sf):
    i = F.col("p_partkey") % 5
    body = F.when(i == 0, '{"level": 99, "extra": "x"}').when(i == 1, "no json {").when(i == 2, "[1, 2]").when(i == 3, '{"level": null}')
    responses = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("record_id"), body.alias("body")).filter(
        F.col("body").isNotNull())
    return X.apply_responses(_unsure(spark, sf), responses).select(
        "record_id", "detection_method", "confidence", F.try_variant_get("structured_data", "$.level", "bigint").alias("level"),
        F.try_variant_get("structured_data", "$.name", "string").alias("name"))
