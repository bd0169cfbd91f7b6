"""S queries: write files from the driver tables, read them back through the readers.

Files go to a new folder under the shared directory the session names (see ``scratch_dir``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from contentkit.operators.convert import convert_records
from contentkit.operators.skew import scratch_dir
from contentkit.plans.queries.base import PART_SQL, RUN_TIME, part_records, pick_sql, query, table
from contentkit.plans.queries.extraction import WEAPON_PIECES, render
from contentkit.plans.templates import TEMPLATES
from contentkit.sources import entries as E
from contentkit.sources import exports as X
from contentkit.sources import stored as ST


def _csv(spark, sf):
    path = scratch_dir(spark, "csv")
    table(spark, sf, "part").select(
        F.when(F.col("p_size") > 40, "").otherwise(F.lower("p_type")).alias(" Type"), F.col("p_name").alias("Name"), F.lit("old").alias("LEVEL "),
        F.col("p_size").alias("Lvl2"), F.col("p_retailprice").alias("Price"), F.lit("").alias("Source_Book"), F.col("p_brand").alias("Publisher"),
        F.concat(F.col("p_size").cast("string"), F.lit(" ff")).alias("Page"), F.replace("p_name", F.lit(" "), F.lit(", ")).alias("Tags"),
        F.lit('says "hi", ok').alias("Remark"),
    ).write.option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    return path


@query("s1_csv_entries", """SELECT p_name AS name, CASE WHEN p_size > 40 THEN 'gear' ELSE lower(p_type) END AS content_type, 'old' AS level,
  CAST(p_size AS BIGINT) AS lvl2, p_retailprice AS price, p_brand AS publisher, 'House' AS source_book,
  CAST(p_size AS BIGINT) AS page_number, replace(p_name, ' ', '|') AS tags, 'says "hi", ok' AS remark FROM part""")
def s1(spark, sf):
    entries, _ = E.read_entries_csv(spark, _csv(spark, sf), default_type="gear", source_meta={"source_book": "House"})

    def data(key, kind):
        return F.try_variant_get("data", f"$.{key}", kind).alias(key)

    return entries.select(
        data("name", "string"), "content_type", data("level", "string"), data("lvl2", "bigint"), data("price", "double"),
        F.col("metadata.publisher").alias("publisher"), F.col("metadata.source_book").alias("source_book"),
        F.col("metadata.page_number").alias("page_number"), F.array_join("metadata.tags", "|").alias("tags"), data("remark", "string"))


@query("s1_csv_splittable", "SELECT count(*) AS entries, CAST(sum(p_size) AS BIGINT) AS levels, count(DISTINCT p_partkey) AS refs FROM part")
def s1_split(spark, sf):
    path = scratch_dir(spark, "csv1")
    table(spark, sf, "part").select("p_name", "p_size").toDF("name", "level").coalesce(1).write.option("header", "true").csv(path)
    entries, _ = E.read_entries_csv(spark, path, multi_line=False, max_columns=4)
    return entries.agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.try_variant_get("data", "$.level", "bigint")).alias("levels"),
        F.countDistinct("source_ref").alias("refs"))


CELLS = ["", "TRUE", "false", "12", "1.5", "1d", "6,280", " 7 ", "1e3", "0x10"]


@query("s2_coerce_scalars", f"""SELECT p_partkey, {pick_sql(['null', 'boolean', 'boolean', 'number', 'number', 'string', 'string', 'number', 'number', 'string'], 'p_partkey % 10')} AS kind,
  {pick_sql(['null', 'true', 'false', '12', '1.5', '"1d"', '"6,280"', '7', '1000.0', '"0x10"'], 'p_partkey % 10')} AS json FROM part""")
def s2(spark, sf):
    from contentkit.functions.variants import type_of
    from contentkit.plans.queries.base import pick
    value = E.coerce_scalars(pick(CELLS, F.col("p_partkey") % 10))
    return table(spark, sf, "part").select("p_partkey", value.alias("v")).select("p_partkey", type_of(F.col("v")).alias("kind"), F.to_json("v").alias("json"))


def _json_docs(spark, sf):
    """One JSON document per order priority and customer: items under a root path, with an odd element."""
    orders = table(spark, sf, "orders")
    item = F.concat(F.lit('{"type": "'), "o_orderstatus", F.lit('", "name": "n'), F.col("o_orderkey").cast("string"), F.lit('", "pageNumber": '),
                    F.col("o_custkey").cast("string"), F.lit(', "tags": ["a", "b"], "total": '), F.col("o_totalprice").cast("string"), F.lit("}"))
    docs = orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("items"), F.min("o_orderkey").alias("k"))
    body = F.when(F.col("o_custkey") % 10 == 0, F.concat(F.lit('{"a": {"b": [7, '), "items", F.lit("]}}"))).when(
        F.col("o_custkey") % 10 == 1, "{broken").when(F.col("o_custkey") % 10 == 2, '{"a": 1}').otherwise(
        F.concat(F.lit('{"a": {"b": ['), "items", F.lit("]}}")))
    path = scratch_dir(spark, "json")
    docs.select(body.alias("value")).write.text(path)
    return path


@query("s3_json_entries", """SELECT 'n' || o_orderkey AS name, o_orderstatus AS content_type, o_custkey AS page_number, 'a|b' AS tags, o_totalprice AS total
FROM orders WHERE o_custkey % 10 NOT IN (1, 2)""")
def s3(spark, sf):
    entries, _ = E.read_entries_json(spark, _json_docs(spark, sf), root_path="a.b", lines=True)
    return entries.select(
        F.try_variant_get("data", "$.name", "string").alias("name"), "content_type", F.col("metadata.page_number").alias("page_number"),
        F.array_join("metadata.tags", "|").alias("tags"), F.try_variant_get("data", "$.total", "double").alias("total"))


@query("q7_parse_warnings", """SELECT CASE o_custkey % 10 WHEN 0 THEN 'INVALID_ENTRY' WHEN 1 THEN 'JSON_PARSE_ERROR' ELSE 'JSON_ROOT_PATH_ERROR' END AS code,
  count(DISTINCT o_custkey) AS count FROM orders WHERE o_custkey % 10 < 3 GROUP BY 1""")
def q7(spark, sf):
    _, issues = E.read_entries_json(spark, _json_docs(spark, sf), root_path="a.b", lines=True)
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("count"))


@query("s3_events_json", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS count FROM events GROUP BY 1")
def s3_events(spark, sf):
    texts = table(spark, sf, "events").select(F.lit("events").alias("source_file"), F.col("props").alias("_text"))
    entries, _ = E.parse_json_entries(texts)
    return entries.groupBy(F.try_variant_get("data", "$.k", "bigint").alias("k")).agg(F.count(F.lit(1)).alias("count"))


def _text_files(spark, sf):
    blocks = render(spark, sf, *WEAPON_PIECES)
    brand = table(spark, sf, "part").select(F.col("p_partkey").alias("block_id"), "p_size")
    return blocks.join(brand, "block_id").select(
        F.concat(F.lit("f"), F.col("block_id").cast("string")).alias("source_file"), F.concat(F.lit("\n\n"), "text", F.lit("\n\n\n?\n\n")).alias("text"))


@query("s4_text_entries", """SELECT 'f' || p_partkey AS source_file, 'block:0' AS source_ref, 'weapon' AS content_type, upper(p_name) AS name, CAST(p_size AS BIGINT) AS level FROM part""")
def s4(spark, sf):
    entries, _ = E.read_text_blocks(_text_files(spark, sf), TEMPLATES, category="weapon")
    return entries.select("source_file", "source_ref", "content_type", F.try_variant_get("data", "$.name", "string").alias("name"),
                          F.try_variant_get("data", "$.level", "bigint").alias("level"))


@query("s4_text_issues", "SELECT 'NO_DATA_EXTRACTED' AS code, 'block:1' AS source_ref, count(*) AS count FROM part")
def s4_issues(spark, sf):
    _, issues = E.read_text_blocks(_text_files(spark, sf), TEMPLATES, category="weapon")
    return issues.groupBy("code", "source_ref").agg(F.count(F.lit(1)).alias("count"))


@query("s5_mixed_directory", """SELECT 'csv' AS import_method, 'weapon' AS content_type, count(*) AS entries, CAST(sum(p_size) AS BIGINT) AS levels FROM part
UNION ALL SELECT 'txt', 'weapon', count(DISTINCT p_brand), NULL FROM part""")
def s5(spark, sf):
    base = scratch_dir(spark, "mixed")
    part = table(spark, sf, "part")
    part.select(F.lit("weapon").alias("type"), F.concat(F.lit("c "), "p_name").alias("name"), F.col("p_size").alias("level")).coalesce(4).write.option(
        "header", "true").csv(base)
    heads = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("\n\n"), F.upper(F.translate("p_brand", "#0123456789", " ABCDEFGHIJ")), F.lit("\n\n")).alias("value"))
    heads.coalesce(2).write.mode("append").text(base)
    entries, _ = E.read_by_extension(spark, base, TEMPLATES, text_category="weapon")
    return entries.groupBy("import_method", "content_type").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.try_variant_get("data", "$.level", "bigint")).alias("levels"))


@query("s6_entries_to_records", """SELECT p_name AS name, CASE WHEN p_size > 40 THEN 'feat' WHEN p_size > 20 THEN 'weapon' ELSE 'feat' END AS category,
  'House' AS source_book, p_brand AS publisher, CAST(p_size AS BIGINT) AS page_number, replace(p_name, ' ', '|') AS tags, '2.0.0' AS schema_version FROM part""")
def s6(spark, sf):
    entries, _ = E.read_entries_csv(spark, _csv(spark, sf), default_type="feat", source_meta={"source_book": "House"})
    kind = F.when(F.try_variant_get("data", "$.lvl2", "bigint").between(21, 40), "weapon").otherwise(F.col("content_type"))
    records = E.entries_to_records(entries.withColumn("content_type", kind), RUN_TIME, import_method="csv", default_category="feat")
    return records.select("name", "category", "source_book", "publisher", "page_number", F.array_join("tags", "|").alias("tags"), "schema_version")


@query("s7_stored_records", """SELECT 'p' || p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'Unknown' ELSE p_name END AS name,
  CASE WHEN p_size % 5 = 1 THEN 'equipment' ELSE 'weapon' END AS category, CASE WHEN p_size % 5 = 2 THEN 0 ELSE p_size END::BIGINT AS page_number,
  CASE WHEN p_size % 5 = 3 THEN 'json' ELSE 'csv' END AS import_method, CASE WHEN p_size % 5 = 4 THEN 0 ELSE 1 END AS keys FROM part""")
def s7(spark, sf):
    k = F.col("p_size") % 5
    obj = F.to_variant_object(F.struct(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.when(k == 0, F.lit(5).cast("variant")).otherwise(F.col("p_name").cast("variant")).alias("name"),
        F.when(k == 1, "gadget").otherwise("weapon").alias("category"), F.when(k == 2, F.lit("x").cast("variant")).otherwise(F.col("p_size").cast("variant")).alias("pageNumber"),
        F.when(k == 3, "fax").otherwise("csv").alias("importMethod"),
        F.when(k == 4, F.lit("text").cast("variant")).otherwise(F.parse_json(F.lit('{"a": 1}'))).alias("rawContent")))
    stored = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), obj.alias("value"))
    junk = table(spark, sf, "region").select((F.col("r_regionkey") - 100).cast("bigint").alias("ord"), F.col("r_name").cast("variant").alias("value"))
    out = ST.normalize_stored_records(stored.unionByName(junk), RUN_TIME)
    keys = F.size(F.map_keys(F.try_variant_get("raw_content", "$", "map<string,variant>")))
    return out.select("id", "name", "category", "page_number", "import_method", keys.alias("keys"))


@query("s8_lineage_metadata", """SELECT c_custkey, CASE WHEN c_nationkey > 12 THEN c_mktsegment ELSE 'Unknown' END AS source_book, 'Unknown' AS publisher,
  CAST(c_nationkey AS BIGINT) AS page_number, 'equipment' AS content_type, '1.0.0' AS schema_version FROM customer""")
def s8(spark, sf):
    meta = F.to_variant_object(F.struct(
        F.when(F.col("c_nationkey") > 12, F.col("c_mktsegment").cast("variant")).otherwise(F.lit(3).cast("variant")).alias("sourceBook"),
        F.col("c_nationkey").alias("pageNumber")))
    out = ST.normalize_metadata(table(spark, sf, "customer").select("c_custkey", meta.alias("metadata")), RUN_TIME, keep=("c_custkey",))
    return out.select("c_custkey", "source_book", "publisher", "page_number", "content_type", "schema_version")


@query("s9_json_export", f"""WITH {PART_SQL} SELECT id, name, category, publisher, page_number, array_to_string(tags, '|') AS tags, CAST(level AS BIGINT) AS level, bulk FROM rec""")
def s9(spark, sf):
    path = scratch_dir(spark, "export")
    X.write_json(part_records(spark, sf), path)
    back = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.parse_json("value").alias("value"))
    out = ST.normalize_stored_records(back, RUN_TIME)
    return out.select("id", "name", "category", "publisher", "page_number", F.array_join("tags", "|").alias("tags"),
                      F.try_variant_get("raw_content", "$.level", "bigint").alias("level"), F.try_variant_get("raw_content", "$.bulk", "string").alias("bulk"))


@query("s9_json_subset", f"WITH {PART_SQL} SELECT id, name FROM rec WHERE id IN (SELECT 'p' || s_suppkey FROM supplier)")
def s9_subset(spark, sf):
    path = scratch_dir(spark, "subset")
    ids = table(spark, sf, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("id"))
    X.write_json(part_records(spark, sf), path, ids)
    return spark.read.schema("id string, name string").json(path)


@query("s10_csv_export", f"""WITH {PART_SQL} SELECT id, name, category, publisher, CAST(page_number AS VARCHAR) AS "pageNumber", array_to_string(tags, '; ') AS tags,
  '{RUN_TIME}' AS "importedDate", CAST(level AS VARCHAR) AS level, bulk, description FROM rec""")
def s10(spark, sf):
    path = scratch_dir(spark, "catalog")
    X.write_catalog_csv(part_records(spark, sf), path)
    back = spark.read.option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    return back.select("id", "name", "category", "publisher", "pageNumber", "tags", "importedDate", "level", "bulk", "description")


@query("s11_raw_export", f"""WITH {PART_SQL} SELECT id, 'name' AS key, '"' || name || '"' AS value FROM rec UNION ALL SELECT id, 'category', '"' || category || '"' FROM rec
UNION ALL SELECT id, 'level', CAST(level AS VARCHAR) FROM rec UNION ALL SELECT id, 'bulk', '"' || bulk || '"' FROM rec
UNION ALL SELECT id, 'type', '"' || kind || '"' FROM rec UNION ALL SELECT id, 'description', '"' || description || '"' FROM rec
UNION ALL SELECT 'p' || p_partkey, 'price', CAST(p_retailprice AS VARCHAR) FROM part""")
def s11(spark, sf):
    return X.explode_raw_export(part_records(spark, sf))


@query("s11_file_slugs", f"WITH {PART_SQL} SELECT id, replace(name, ' ', '-') AS file_slug FROM rec")
def s11_slugs(spark, sf):
    return X.raw_export_json(part_records(spark, sf)).select("id", "file_slug")


@query("s12_partitioned_packs", """SELECT CASE p_partkey % 15 WHEN 0 THEN 'weapons' WHEN 1 THEN 'armor' WHEN 2 THEN 'equipment' WHEN 3 THEN 'augmentations' WHEN 4 THEN 'feats'
  WHEN 5 THEN 'spells' WHEN 6 THEN 'species' WHEN 7 THEN 'themes' WHEN 8 THEN 'classes' WHEN 9 THEN 'archetypes' WHEN 10 THEN 'vehicles' WHEN 11 THEN 'starships'
  WHEN 12 THEN 'npcs' WHEN 13 THEN 'hazards' ELSE 'journals' END AS pack_id, count(*) AS documents, count(DISTINCT p_name) AS names FROM part GROUP BY 1""")
def s12(spark, sf):
    path = scratch_dir(spark, "packs")
    X.write_partitioned_packs(convert_records(part_records(spark, sf), RUN_TIME), path)
    back = spark.read.parquet(path)
    name = F.try_variant_get(F.parse_json("document"), "$.name", "string")
    return back.groupBy("pack_id").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct(name).alias("names"))

