"""V0 and P1-P10 queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentkit.functions import rules as V
from contentkit.operators import conform as P
from contentkit.operators.convert import attach_lineage
from contentkit.operators.nested import deep_merge
from contentkit.operators.normalize import normalize_values
from contentkit.plans.mapping_rules import BASE_RULES, FIELD_MAPS, SKELETONS, flat_file_rules, merged_file_rules
from contentkit.plans.queries.base import BULKS, PART_SQL, RUN_TIME, part_records, pick, pick_sql, query, table

ALIGN = ["Lawful Good", "CE", "true", "odd", ""]
SIZES = ["Diminutive", "LARGE size", "colossal", "huge", "none"]
DEX = ["", "-", "3", "none", "0"]
CRS = ["1/2", "1/0", "7", "x", "0"]
ABIL = ["Strength", "wis", "CHA", "luck", "Int"]
SPEC = {"bulk": "parseBulk", "cr": "parseCR", "dex": "parseMaxDex", "ability": "parseAbility", "size": "parseSize", "alignment": "parseAlignment"}


def _texts(spark, sf):
    i = F.col("p_partkey") % 5
    return table(spark, sf, "part").select(
        "p_partkey", pick(BULKS, i).alias("bulk"), pick(CRS, i).alias("cr"), pick(DEX, i).alias("dex"), pick(ABIL, i).alias("ability"),
        pick(SIZES, i).alias("size"), pick(ALIGN, i).alias("alignment"))


@query("v0_normalize_values", f"""SELECT p_partkey, ([0.1::DOUBLE, 0, 2, 1.5, 1])[p_partkey % 5 + 1] AS bulk, ([0.5::DOUBLE, NULL, 7, 1, 1])[p_partkey % 5 + 1] AS cr,
  ([99::DOUBLE, 99, 3, 5, 5])[p_partkey % 5 + 1] AS dex, {pick_sql(['str', 'wis', 'cha', 'str', 'int'], 'p_partkey % 5')} AS ability,
  {pick_sql(['diminutive', 'large', 'colossal', 'huge', 'medium'], 'p_partkey % 5')} AS size, {pick_sql(['lg', 'ce', 'n', 'n', 'n'], 'p_partkey % 5')} AS alignment FROM part""")
def v0(spark, sf):
    return normalize_values(_texts(spark, sf), SPEC)[0]


@query("v0_fallback_counts", """WITH c AS (SELECT p_partkey % 5 AS k FROM part)
SELECT 'bulk' AS "column", CAST(0 AS BIGINT) AS blank, count_if(k = 4) AS fallback, count_if(k < 4) AS parsed FROM c
UNION ALL SELECT 'cr', 0, count_if(k >= 3), count_if(k < 3) FROM c
UNION ALL SELECT 'dex', count_if(k = 0), count_if(k >= 3), count_if(k IN (1, 2)) FROM c
UNION ALL SELECT 'ability', 0, count_if(k IN (0, 3)), count_if(k IN (1, 2, 4)) FROM c
UNION ALL SELECT 'size', 0, count_if(k = 4), count_if(k < 4) FROM c
UNION ALL SELECT 'alignment', count_if(k = 4), count_if(k IN (2, 3)), count_if(k < 2) FROM c""")
def v0_counts(spark, sf):
    return normalize_values(_texts(spark, sf), SPEC)[1].drop("rule")


WORDS = ["fire & cold", "B, p", "sonic", "odd", "electricity,force"]
LISTS = ["1, 3; 25", "x", "20", "", "2;2"]
SKILLS = ["Sense Motive +5, Stealth -2", "none", "Athletics +1, athletics +3", "", "Pilot+4"]


@query("v_list_rules", f"""SELECT p_partkey, {pick_sql(['F|C', 'B|P', 'So', 'ODD', 'E|force'], 'p_partkey % 5')} AS damage,
  {pick_sql(['1|3', '', '20', '', '2|2'], 'p_partkey % 5')} AS levels, {pick_sql(['sensemotive:5|stealth:-2', '', 'athletics:3', '', 'pilot:4'], 'p_partkey % 5')} AS skills,
  {pick_sql(['1|3|25', 'x', '20', '', '2|2'], 'p_partkey % 5')} AS items FROM part""")
def v_lists(spark, sf):
    i = F.col("p_partkey") % 5
    skills = F.array_sort(F.transform(F.map_entries(V.skills(pick(SKILLS, i))), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(V.damage_types(pick(WORDS, i)), "|").alias("damage"),
        F.array_join(F.transform(V.levels(pick(LISTS, i)), lambda x: x.cast("string")), "|").alias("levels"), F.array_join(skills, "|").alias("skills"),
        F.array_join(V.items(pick(LISTS, i)), "|").alias("items"))


@query("v_scalar_rules", """SELECT p_partkey, CAST(CASE p_size WHEN 1 THEN 400 WHEN 2 THEN 600 WHEN 3 THEN 800 WHEN 4 THEN 1200 WHEN 5 THEN 1600
   ELSE CASE WHEN p_size <= 25 THEN CASE WHEN p_size % 2 = 0 THEN 600 * 2 ** (p_size // 2 - 1) ELSE 800 * 2 ** ((p_size - 3) // 2) END ELSE 400 END END AS DOUBLE) AS xp,
  CAST(floor((p_size - 10) / 2.0) AS DOUBLE) AS ability_mod,
  left(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 40) AS slug,
  CASE WHEN p_type = 'SMALL' THEN 'small' WHEN p_type = 'LARGE' THEN 'large' ELSE 'medium' END AS size FROM part""")
def v_scalars(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", V.xp_for_cr(F.col("p_size").cast("string")).alias("xp"), V.ability_mod(F.col("p_size").cast("double")).alias("ability_mod"),
        V.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"), V.substring_rule("size")(F.col("p_type")).alias("size"))


@query("p1_conform_weapon", f"""WITH {PART_SQL}
SELECT id, CAST(level AS DOUBLE) AS level, price, CASE bulk WHEN 'L' THEN 0.1 WHEN '-' THEN 0 WHEN '2' THEN 2 WHEN '1.5' THEN 1.5 ELSE 1 END::DOUBLE AS bulk,
       '1d6' AS formula, CAST(30 AS DOUBLE) AS range_value, description, false AS equipped FROM rec WHERE category = 'weapon'""")
def p1_weapon(spark, sf):
    out = P.conform(part_records(spark, sf), BASE_RULES["weapon"], "weapon")
    return out.select("id", "system.level", "system.price", "system.bulk", F.col("system.damage")[0]["formula"].alias("formula"),
                      F.col("system.range.value").alias("range_value"), F.col("system.description.value").alias("description"), "system.equipped")


@query("p1_conform_all", f"""WITH {PART_SQL}
SELECT id, category, CASE WHEN category IN ('weapon', 'armor', 'spell') THEN CAST(level AS DOUBLE) END AS level,
       CASE WHEN category = 'npc' THEN 10.0 END::DOUBLE AS eac FROM rec""")
def p1_all(spark, sf):
    out = P.conform_all(part_records(spark, sf), BASE_RULES)
    return out.select("id", "category", F.try_variant_get("system", "$.level", "double").alias("level"),
                      F.try_variant_get("system", "$.attributes.eac.value", "double").alias("eac"))


@query("p1_seeded_defaults", f"""WITH {PART_SQL}
SELECT id, 'gold' AS coin, CAST(level AS DOUBLE) AS level, true AS flag, 'kept' AS keep FROM rec WHERE category = 'armor'""")
def p1_seeds(spark, sf):
    seeds = [("money.coin", "gold"), ("level", 3), ("flag", True), ("keep", "kept")]
    out = P.conform(part_records(spark, sf), [P.exact("level", "level", "number"), P.exact("keep", "absent", "string")], "armor", seeds)
    return out.select("id", "system.money.coin", "system.level", "system.flag", "system.keep")


@query("p2_exact_rules", f"""WITH {PART_SQL}
SELECT id, CAST(level AS VARCHAR) AS level_text, CASE WHEN bulk IN ('2', '1.5') THEN CAST(bulk AS DOUBLE) ELSE 0 END AS bulk_number,
       'none' AS absent_default, CAST(NULL AS VARCHAR) AS absent, 'Source key "nothing" absent' AS reason FROM rec""")
def p2(spark, sf):
    rules = [P.exact("a.level", "level", "string"), P.exact("a.bulk", "bulk", "number"), P.exact("b", "nothing", "string", "none"),
             P.exact("c", "nothing", "string")]
    out = P.conform(part_records(spark, sf), rules)
    return out.select("id", F.col("system.a.level").alias("level_text"), F.col("system.a.bulk").alias("bulk_number"),
                      F.col("system.b").alias("absent_default"), F.col("system.c").alias("absent"), F.col("skipped_rules")[0]["reason"].alias("reason"))


@query("p3_alias_rules", f"""WITH {PART_SQL} SELECT id, kind AS label, 'A|' || kind AS joined FROM rec""")
def p3(spark, sf):
    rules = [P.alias("label", "kind", "type", "name", coerce="string"), P.alias("list", "type", coerce="array")]
    out = P.conform(part_records(spark, sf), rules)
    return out.select("id", "system.label", F.concat(F.lit("A|"), F.array_join("system.list", "|")).alias("joined"))


@query("p4_transform_rules", f"""WITH {PART_SQL}
SELECT id, CASE bulk WHEN 'L' THEN 0.1 WHEN '-' THEN 0 WHEN '2' THEN 2 WHEN '1.5' THEN 1.5 ELSE 1 END::DOUBLE AS bulk, upper(name) AS shout,
       'Transform "unheard" not registered' AS reason FROM rec""")
def p4(spark, sf):
    rules = [P.transform("bulk", "bulk", "parseBulk"), P.transform("shout", "name", "shout"), P.transform("x", "name", "unheard")]
    out = P.conform(part_records(spark, sf), rules, transforms={**V.TRANSFORMS, "shout": F.upper})
    return out.select("id", "system.bulk", "system.shout", F.col("skipped_rules")[0]["reason"].alias("reason"))


@query("p5_computed_rules", f"WITH {PART_SQL} SELECT id, CAST(level * 2 AS DOUBLE) AS twice, CASE WHEN level > 25 THEN name ELSE 'low' END AS label FROM rec")
def p5(spark, sf):
    rules = [P.default("label", "low"),
             P.computed("twice", "try_variant_get(raw_content, '$.level', 'double') * 2", "number"),
             P.computed("label", "if(try_variant_get(raw_content, '$.level', 'int') > 25, name, null)")]
    return P.conform(part_records(spark, sf), rules).select("id", "system.twice", "system.label")


@query("p6_default_rules", f"WITH {PART_SQL} SELECT id, false AS equipped, CAST(7 AS DOUBLE) AS n, 'x' AS s FROM rec")
def p6(spark, sf):
    rules = [P.default("equipped", False), P.default("n", 7), P.default("s", "x")]
    return P.conform(part_records(spark, sf), rules).select("id", "system.equipped", "system.n", "system.s")


@query("p7_nested_rules", f"WITH {PART_SQL} SELECT id, CAST(level AS DOUBLE) AS inner_level, kind AS inner_type, true AS gone FROM rec")
def p7(spark, sf):
    rules = [P.nested("box", P.exact("level", "level", "number"), P.exact("deep.type", "type", "string")),
             P.nested("gone", P.exact("z", "absent", "string"))]
    return P.conform(part_records(spark, sf), rules).select(
        "id", F.col("system.box.level").alias("inner_level"), F.col("system.box.deep.type").alias("inner_type"), F.col("system.gone").isNull().alias("gone"))


@query("p8_deep_merge", f"""WITH {PART_SQL}
SELECT id, CAST(level AS BIGINT) AS a_x, CAST(2 AS BIGINT) AS a_y, CAST(level AS BIGINT) AS a_z_q, '[9]' AS list, '"flat"' AS b FROM rec""")
def p8(spark, sf):
    base = F.parse_json(F.lit('{"a": {"x": 1, "y": 2, "z": {"p": 1}}, "list": [1, 2], "b": {"c": 1}}'))
    level = F.try_variant_get("raw_content", "$.level", "bigint")
    top = F.to_variant_object(F.struct(
        F.struct(level.alias("x"), F.struct(level.alias("q")).alias("z")).alias("a"), F.array(F.lit(9)).alias("list"), F.lit("flat").alias("b")))
    m = F.col("m")
    return deep_merge(part_records(spark, sf).select("id", base.alias("base"), top.alias("top")), "base", "top", "m").select(
        "id", F.try_variant_get(m, "$.a.x", "bigint").alias("a_x"), F.try_variant_get(m, "$.a.y", "bigint").alias("a_y"),
        F.try_variant_get(m, "$.a.z.q", "bigint").alias("a_z_q"), F.to_json(F.try_variant_get(m, "$.list", "variant")).alias("list"),
        F.to_json(F.try_variant_get(m, "$.b", "variant")).alias("b"))


#: Objects inside objects of the query below.
DEEP = 13


@query("p8_deep_merge_levels", f"""WITH {PART_SQL}
SELECT id, CAST(k AS BIGINT) AS depth, 'low' AS base_only, CAST(level + k AS BIGINT) AS both, CASE WHEN k % 2 = 0 THEN 'high' END AS top_only
FROM rec, generate_series(0, {DEEP - 1}) g(k)""")
def p8_levels(spark, sf):
    """Objects nested deeper than one step goes: every level keeps the keys of both sides."""
    level = F.try_variant_get("raw_content", "$.level", "bigint")

    def nest(parts):
        """JSON text of objects inside objects, from the innermost."""
        text = F.lit("{}")
        for k in reversed(range(DEEP)):
            text = F.concat(F.lit("{"), *parts(k), F.lit(', "in": '), text, F.lit("}"))
        return F.parse_json(text)

    base = nest(lambda k: [F.lit(f'"base_only": "low", "both": {k}')])
    top = nest(lambda k: [F.lit('"both": '), (level + k).cast("string"), F.lit(', "top_only": "high"' if k % 2 == 0 else "")])
    merged = deep_merge(part_records(spark, sf).select("id", base.alias("base"), top.alias("top")), "base", "top", "m")
    at = [F.struct(F.lit(k).cast("bigint").alias("depth"), *[F.try_variant_get("m", "$" + ".in" * k + f".{c}", t).alias(c) for c, t in (
        ("base_only", "string"), ("both", "bigint"), ("top_only", "string"))]) for k in range(DEEP)]
    return merged.select("id", F.explode(F.array(*at)).alias("x")).select("id", "x.*")


@query("p9_apply_field_map", f"""WITH {PART_SQL}
SELECT id, name, CASE WHEN category IN ('npc', 'hazard', 'starship', 'race', 'theme', 'class', 'archetypeFeature', 'feat', 'journal') THEN NULL
        WHEN category = 'vehicle' THEN NULL ELSE CAST(level AS BIGINT) END AS level,
       CASE WHEN category = 'weapon' THEN '1d6' END AS formula, CASE WHEN category = 'journal' THEN NULL ELSE description END AS description, 'Unknown' AS publisher FROM rec""")
def p9(spark, sf):
    entries = part_records(spark, sf).select(
        "id", F.col("category").alias("content_type"), F.col("raw_content").alias("data"),
        F.struct(F.col("source_book"), F.lit(None).cast("string").alias("publisher"), F.lit(None).cast("string").alias("author"), "page_number",
                 F.lit(None).cast("string").alias("notes"), "tags").alias("metadata"))
    out = P.apply_field_map(entries, FIELD_MAPS, SKELETONS, RUN_TIME)
    level = F.when(F.col("content_type") != "feat", F.try_variant_get("system", "$.level", "bigint"))
    return out.select("id", "name", level.alias("level"), F.try_variant_get("system", "$.damage[0].formula", "string").alias("formula"),
                      F.try_variant_get("system", "$.description.value", "string").alias("description"), F.col("document_metadata.publisher").alias("publisher"))


@query("p1_field_files", f"WITH {PART_SQL} SELECT id, CAST(level AS DOUBLE) AS merged_level, bulk AS flat_bulk, CAST(99 AS DOUBLE) AS max_dex FROM rec WHERE category = 'armor'")
def p1_files(spark, sf):
    merged = P.conform(part_records(spark, sf), merged_file_rules("armor"), "armor").select("id", F.col("system.level").alias("merged_level"))
    flat = P.conform(part_records(spark, sf), flat_file_rules("armor"), "armor").select(
        "id", F.col("system.bulk").alias("flat_bulk"), F.col("system.maxDexBonus").alias("max_dex"))
    return merged.join(flat, "id")


@query("p10_attach_lineage", f"""WITH {PART_SQL}
SELECT id, source_book, page_number, import_method, '3.0.0' AS schema_version, '{RUN_TIME}' AS import_date FROM rec""")
def p10(spark, sf):
    out = attach_lineage(part_records(spark, sf), RUN_TIME)
    return out.select(F.col("lineage.recordId").alias("id"), F.col("lineage.sourceBook").alias("source_book"),
                      F.col("lineage.pageNumber").alias("page_number"), F.col("lineage.importMethod").alias("import_method"),
                      F.col("lineage.schemaVersion").alias("schema_version"), F.col("lineage.importDate").alias("import_date"))
