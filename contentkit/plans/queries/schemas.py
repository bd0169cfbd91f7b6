"""C queries: discovery, hashing, diff, compatibility, repair, profiles and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentkit.operators import repair as RP
from contentkit.operators import rollups as R
from contentkit.operators import schema as S
from contentkit.plans.mapping_rules import BASE_RULES
from contentkit.plans.queries.base import PART_SQL, busy_table, part_records, query, table
from contentkit.records import CATEGORIES, category_map

SUBTYPES = [(c.document_type, c.subtype, c.name) for c in CATEGORIES if c.has_schema]
CATEGORY_ROWS = ", ".join(f"('{d}', '{s}', '{c}')" for d, s, c in SUBTYPES)


def _documents(spark, sf):
    """Customers as nested documents; one market segment is one subtype."""
    odd = F.col("c_nationkey") < 5
    text = F.concat(
        F.lit('{"name": "'), "c_name", F.lit('", "level": '), F.when(odd, F.lit('"five"')).otherwise(F.col("c_nationkey").cast("string")),
        F.lit(', "home": {"nation": '), F.col("c_nationkey").cast("string"), F.lit(', "deep": {"x": true}}, "tags": ["a"], "parts": [{"k": '),
        F.col("c_custkey").cast("string"), F.lit('}], "none": null}'))
    return busy_table(spark, sf, "customer").select(
        F.lit("Item").alias("document_type"), F.col("c_mktsegment").alias("subtype"), F.col("c_custkey").alias("ord"),
        F.parse_json(text).alias("document"))


DOC_SQL = """d AS (SELECT c_mktsegment AS subtype, c_custkey, c_nationkey, c_nationkey < 5 AS odd FROM customer),
f AS (SELECT subtype, count(*) AS n, count_if(odd) AS n_odd,
             min(CASE WHEN odd THEN c_custkey END) AS odd_first, min(CASE WHEN NOT odd THEN c_custkey END) AS even_first FROM d GROUP BY 1),
p AS (SELECT subtype, n, unnest(['name', 'home', 'home.nation', 'home.deep', 'home.deep.x', 'tags', 'parts', 'parts[0].k', 'none', 'level']) AS path,
             n_odd, odd_first, even_first FROM f)"""
DOC_TYPE = """CASE path WHEN 'name' THEN 'string' WHEN 'home' THEN 'object' WHEN 'home.deep' THEN 'object' WHEN 'home.deep.x' THEN 'boolean'
  WHEN 'tags' THEN 'array' WHEN 'parts' THEN 'array' WHEN 'none' THEN 'null'
  WHEN 'level' THEN CASE WHEN n_odd > n - n_odd OR (n_odd = n - n_odd AND odd_first < even_first) THEN 'string' ELSE 'number' END ELSE 'number' END"""


@query("c1_discover_schema", f"""WITH {DOC_SQL}
SELECT subtype, path, {DOC_TYPE} AS type, n AS occurrences, path = 'none' AS nullable,
       CAST(CASE WHEN path = 'level' AND n_odd > 0 AND n_odd < n THEN 2 ELSE 1 END AS BIGINT) AS type_count FROM p""")
def c1(spark, sf):
    return S.discover_schema(_documents(spark, sf)).select("subtype", "path", "type", "occurrences", "nullable", "type_count")


@query("c1_first_document", f"""WITH {DOC_SQL}, g AS (SELECT subtype, arg_min(odd, c_custkey) AS odd, arg_min(c_nationkey, c_custkey) AS nk FROM d GROUP BY 1)
SELECT subtype, path, CASE WHEN path = 'level' AND g.odd THEN '"five"' WHEN path IN ('level', 'home.nation') THEN CAST(nk AS VARCHAR) ELSE 'other' END AS default_json
FROM p JOIN g USING (subtype)""")
def c1_first(spark, sf):
    out = S.discover_schema(_documents(spark, sf), first_only=True)
    return out.select("subtype", "path", F.when(F.col("path").isin("level", "home.nation"), F.col("default_json")).otherwise("other").alias("default_json"))


@query("c1_deep_paths", """WITH n AS (SELECT count(*) AS n FROM customer), d AS (SELECT unnest(generate_series(1, 9)) AS k)
SELECT 'top' || repeat('.in', k - 1) AS path, 'object' AS type, n AS occurrences FROM d, n
UNION ALL SELECT 'top' || repeat('.in', k - 1) || '.n', 'number', n FROM d, n
UNION ALL SELECT 'top' || repeat('.in', 8) || '.in', 'array', n FROM n
UNION ALL SELECT 'top' || repeat('.in', 8) || '.in[0].end', 'boolean', n FROM n""")
def c1_deep(spark, sf):
    """Objects deeper than one step expands, with an array at the bottom."""
    text = F.lit('[{"end": true}]')
    for k in reversed(range(9)):
        text = F.concat(F.lit('{"n": '), (F.col("c_nationkey") + k).cast("string"), F.lit(', "in": '), text, F.lit("}"))
    docs = busy_table(spark, sf, "customer").select(
        F.lit("Item").alias("document_type"), F.lit("deep").alias("subtype"), F.col("c_custkey").alias("ord"),
        F.parse_json(F.concat(F.lit('{"top": '), text, F.lit("}"))).alias("document"))
    return S.discover_schema(docs).select("path", "type", "occurrences")


@query("c1_map_objects", """WITH n AS (SELECT count(*) AS n FROM customer)
SELECT unnest(['name', 'by_id', 'by_id.*', 'by_id.*.segment']) AS path, unnest(['string', 'object', 'object', 'string']) AS type, n AS occurrences FROM n""")
def c1_maps(spark, sf):
    """An object with an id as its key: its entries are one path."""
    entry = F.concat(F.lit('{"name": "x", "by_id": {"c'), F.col("c_custkey").cast("string"), F.lit('": {"segment": "'), "c_mktsegment", F.lit('"}}}'))
    docs = busy_table(spark, sf, "customer").select(
        F.lit("Item").alias("document_type"), F.lit("map").alias("subtype"), F.col("c_custkey").alias("ord"), F.parse_json(entry).alias("document"))
    return S.discover_schema(docs, map_keys=40).select("path", "type", "occurrences")


@query("c2_schema_hash", f"""WITH {DOC_SQL}, s AS (SELECT subtype, array_to_string(list_sort(list(path)), '|') AS t FROM p GROUP BY 1)
SELECT subtype, lower(lpad(to_hex(list_reduce(list_transform(string_split(t, ''), lambda c: CAST(ord(c) AS BIGINT)),
       lambda h, c: xor((h * 33) & CAST(4294967295 AS BIGINT), c), CAST(5381 AS BIGINT))), 8, '0')) AS schema_hash FROM s""")
def c2(spark, sf):
    return S.schema_hash(S.discover_schema(_documents(spark, sf))).select("subtype", "schema_hash")


def _fields(spark, sf):
    """A schema per subtype: the payload keys but bulk, a nested leaf, and one field per region."""
    region = table(spark, sf, "region").select(
        (100 + F.col("r_regionkey")).alias("ord"), F.lower("r_name").alias("path"), F.lit("string").alias("type"),
        (F.col("r_regionkey") < 2).alias("required"),
        F.when(F.col("r_regionkey") == 0, '"dark"').when(F.col("r_regionkey") == 4, "5").alias("default_json"))
    keys = [("level", "string"), ("level.deep", "number"), ("name", "array"), ("price", "number"), ("type", "string"), ("description", "string")]
    own = part_records(spark, sf).groupBy().agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(p).alias("path"), F.lit(t).alias("type"), F.lit(False).alias("required"),
                 F.lit(None).cast("string").alias("default_json")) for i, (p, t) in enumerate(keys)])).alias("f")).select("f.*")
    subtype = F.array(*[F.struct(F.lit(d).alias("document_type"), F.lit(s).alias("subtype")) for d, s, _ in SUBTYPES])
    return own.unionByName(region).withColumn("s", F.explode(subtype)).select(
        "s.document_type", "s.subtype", "ord", "path", "type", "required", F.lit(False).alias("nullable"), "default_json")


def _typed_records(spark, sf):
    known = F.col("category") != "journal"
    return part_records(spark, sf).withColumns({
        "document_type": F.when(known, F.element_at(category_map("document_type"), F.col("category"))),
        "subtype": F.when(known, F.element_at(category_map("subtype"), F.col("category")))})


@query("c3_schema_compat", f"""WITH {PART_SQL}, r AS (SELECT array_to_string(list(lower(r_name) ORDER BY r_regionkey) FILTER (WHERE r_regionkey < 2), '|') AS req,
  array_to_string(list(lower(r_name) ORDER BY r_regionkey) FILTER (WHERE r_regionkey >= 2), '|') AS opt FROM region)
SELECT id, CASE WHEN category <> 'journal' THEN req ELSE '' END AS missing_required, CASE WHEN category <> 'journal' THEN opt ELSE '' END AS missing_optional,
       CASE WHEN category <> 'journal' THEN 'bulk' ELSE '' END AS unknown_fields,
       CASE WHEN category <> 'journal' THEN 'Add "africa" with value "dark" (default).|Add "america" (string), e.g. "".' ELSE '' END AS suggestions,
       CASE WHEN category <> 'journal' THEN false END AS compatible FROM rec, r""")
def c3(spark, sf):
    out = S.schema_compat(_typed_records(spark, sf), _fields(spark, sf))
    joined = {c: F.coalesce(F.array_join(c, "|"), F.lit("")) for c in ("missing_required", "missing_optional", "unknown_fields")}
    said = F.coalesce(F.array_join(F.transform("suggestions", lambda s: s["suggestion"]), "|"), F.lit(""))
    return out.withColumns(joined).select("id", *joined, said.alias("suggestions"), "compatible")


@query("c3_compat_counts", f"""WITH {PART_SQL}, r AS (SELECT count(*) FILTER (WHERE r_regionkey < 2) AS req, count(*) FILTER (WHERE r_regionkey >= 2) AS opt FROM region)
SELECT id, CASE WHEN category <> 'journal' THEN req END AS missing_required, CASE WHEN category <> 'journal' THEN opt END AS missing_optional,
       CASE WHEN category <> 'journal' THEN 1 END AS unknown_keys, CASE WHEN category <> 'journal' THEN false END AS compatible FROM rec, r""")
def c3_counts(spark, sf):
    return S.compat_counts(_typed_records(spark, sf), _fields(spark, sf)).select("id", "missing_required", "missing_optional", "unknown_keys", "compatible")


@query("c3_missing_paths", f"""WITH {PART_SQL} SELECT ord, lower(r_name) AS path, r_regionkey < 2 AS required FROM rec, region WHERE category <> 'journal'""")
def c3_missing(spark, sf):
    return S.missing_paths(_typed_records(spark, sf), _fields(spark, sf), required_only=False)


@query("a11_compat_rollup", f"""WITH {PART_SQL} SELECT count_if(category <> 'journal') AS total, CAST(0 AS BIGINT) AS compatible,
  count_if(category <> 'journal') AS incompatible FROM rec""")
def a11(spark, sf):
    return R.compat_rollup(S.schema_compat(_typed_records(spark, sf), _fields(spark, sf)))


def _half(spark, sf, late: bool):
    orders = table(spark, sf, "orders").filter((F.col("o_orderdate") >= "1998-01-01") == F.lit(late))
    return orders.groupBy(
        F.lit("Item").alias("document_type"), F.col("o_orderpriority").alias("subtype"),
        F.concat(F.lit("k"), (F.col("o_custkey") % 200).cast("string")).alias("path"),
    ).agg(F.min("o_orderstatus").alias("type"), (F.min("o_orderkey") % 2 == 1).alias("required"))


HALF_SQL = """h AS (SELECT o_orderdate >= TIMESTAMP '1998-01-01' AS late, o_orderpriority AS subtype, 'k' || (o_custkey % 200) AS path,
  min(o_orderstatus) AS type, min(o_orderkey) % 2 = 1 AS required FROM orders GROUP BY 1, 2, 3),
j AS (SELECT coalesce(p.subtype, c.subtype) AS subtype, coalesce(p.path, c.path) AS path, p.type AS pt, c.type AS ct, p.required AS pr, c.required AS cr
      FROM (SELECT * FROM h WHERE NOT late) p FULL JOIN (SELECT * FROM h WHERE late) c ON p.subtype = c.subtype AND p.path = c.path),
x AS (SELECT subtype, path, 'added' AS change FROM j WHERE pt IS NULL UNION ALL SELECT subtype, path, 'removed' FROM j WHERE ct IS NULL
      UNION ALL SELECT subtype, path, 'changed_type' FROM j WHERE pt <> ct UNION ALL SELECT subtype, path, 'newly_required' FROM j WHERE NOT pr AND cr)"""


@query("c4_schema_diff", f"WITH {HALF_SQL} SELECT subtype, path, change FROM x")
def c4(spark, sf):
    return S.schema_diff(_half(spark, sf, False), _half(spark, sf, True)).select("subtype", "path", "change")


@query("c4_diff_report", f"""WITH {HALF_SQL} SELECT subtype, array_to_string(list_sort(list(path) FILTER (WHERE change = 'added')), '|') AS added,
  array_to_string(list_sort(list(path) FILTER (WHERE change = 'changed_type')), '|') AS changed_type, false AS is_compatible FROM x GROUP BY 1""")
def c4_report(spark, sf):
    out = S.diff_report(_half(spark, sf, False), _half(spark, sf, True))
    blank = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|"))
    return out.select("subtype", blank("added").alias("added"), blank("changed_type").alias("changed_type"), "is_compatible")


@query("a12_diff_counts", f"""WITH {HALF_SQL} SELECT subtype, count_if(change = 'added') AS added, count_if(change = 'removed') AS removed,
  count_if(change = 'changed_type') AS changed_type, count_if(change = 'newly_required') AS newly_required FROM x GROUP BY 1""")
def a12_diff(spark, sf):
    return R.diff_counts(S.schema_diff(_half(spark, sf, False), _half(spark, sf, True))).drop("document_type")


@query("c5_changed_schemas", """WITH h AS (SELECT DISTINCT o_orderdate >= TIMESTAMP '1998-01-01' AS late, o_orderpriority AS subtype, 'k' || (o_custkey % 200) AS path FROM orders),
s AS (SELECT late, subtype, list_sort(list(path)) AS paths FROM h GROUP BY 1, 2)
SELECT c.subtype FROM s c LEFT JOIN s p ON p.subtype = c.subtype AND NOT p.late WHERE c.late AND (p.paths IS NULL OR p.paths <> c.paths)""")
def c5(spark, sf):
    return S.changed_schemas(S.schema_hash(_half(spark, sf, False)), S.schema_hash(_half(spark, sf, True))).select("subtype")


@query("c9_profile_staleness", """WITH h AS (SELECT DISTINCT o_orderdate >= TIMESTAMP '1998-01-01' AS late, o_orderpriority AS subtype, 'k' || (o_custkey % 200) AS path FROM orders),
s AS (SELECT late, subtype, list_sort(list(path)) AS paths FROM h GROUP BY 1, 2)
SELECT c.subtype, p.paths IS NULL OR p.paths <> c.paths AS stale FROM s c LEFT JOIN s p ON p.subtype = c.subtype AND NOT p.late WHERE c.late""")
def c9(spark, sf):
    return S.profile_staleness(S.schema_hash(_half(spark, sf, False)), S.schema_hash(_half(spark, sf, True))).select("subtype", "stale")


@query("a12_schema_summary", f"""WITH {HALF_SQL}, c AS (SELECT subtype, count(*) AS field_count, count_if(required) AS required_count FROM h WHERE late GROUP BY 1)
SELECT subtype, field_count, required_count FROM c""")
def a12(spark, sf):
    now = _half(spark, sf, True)
    return R.schema_summary(now, S.schema_hash(now)).filter(F.col("schema_hash").isNotNull()).select("subtype", "field_count", "required_count")


def _repair_inputs(spark, sf):
    """The compatibility schema, with a bulk field and one template per subtype."""
    fields = _fields(spark, sf)
    bulk = fields.filter("path = 'type'").withColumns({"path": F.lit("bulk"), "type": F.lit("number"), "ord": F.lit(50)})
    rows = _typed_records(spark, sf)
    template = rows.filter(F.col("subtype").isNotNull()).select(
        "ord", F.col("id").alias("uuid"), "name", "subtype", F.to_variant_object(F.struct(F.col("name").alias("europe"))).alias("snapshot"))
    return rows, fields.unionByName(bulk), template


REPAIR_SQL = f"""{PART_SQL}, dim(document_type, subtype, category) AS (VALUES {CATEGORY_ROWS}),
t AS (SELECT category, arg_min(name, ord) AS first_name FROM rec WHERE category <> 'journal' GROUP BY 1),
q AS (SELECT rec.*, t.first_name FROM rec LEFT JOIN t USING (category))"""


@query("c6_repair_records", f"""WITH {REPAIR_SQL}
SELECT id, CASE WHEN category = 'journal' THEN '' ELSE 'level:normalized|name:normalized|' || CASE WHEN bulk IN ('2', '1.5') THEN 'bulk:normalized|' ELSE '' END ||
         'africa:filled_default|america:skipped|asia:skipped|europe:filled_template|middle east:filled_default' END AS actions,
       CASE WHEN category = 'journal' THEN CAST(level AS VARCHAR) ELSE '"' || level || '"' END AS level,
       CASE WHEN category = 'journal' THEN '"' || bulk || '"' WHEN bulk = '2' THEN '2' WHEN bulk = '1.5' THEN '1.5' ELSE '"' || bulk || '"' END AS bulk,
       CASE WHEN category = 'journal' THEN '"' || name || '"' ELSE '["' || name || '"]' END AS name,
       CASE WHEN category <> 'journal' THEN '"' || first_name || '"' END AS europe,
       category <> 'journal' AS was_modified, CAST(1 AS INTEGER) AS open_issues FROM q""")
def c6(spark, sf):
    out = RP.repair_records(*_repair_inputs(spark, sf))

    def shown(key):
        return F.to_json(F.try_variant_get("repaired", f"$.{key}", "variant")).alias(key)

    acts = F.array_join(F.transform("actions", lambda a: F.concat(a["field"], F.lit(":"), a["action"])), "|")
    return out.select("id", acts.alias("actions"), shown("level"), shown("bulk"), shown("name"), shown("europe"), "was_modified",
                      F.size("remaining_issues").alias("open_issues"))


@query("c7_before_after", f"""WITH {REPAIR_SQL}
SELECT id, CASE WHEN category <> 'journal' THEN false END AS compatible, category <> 'journal' AS was_modified FROM q""")
def c7(spark, sf):
    return RP.before_after(*_repair_inputs(spark, sf)).select("id", "compatible", "was_modified")


@query("a11_repair_rollup", f"""WITH {REPAIR_SQL}
SELECT count(*) AS total, count_if(category <> 'journal') AS modified, count_if(category = 'journal') AS unchanged,
       CAST(sum(CASE WHEN category = 'journal' THEN 0 WHEN bulk IN ('2', '1.5') THEN 6 ELSE 5 END) AS BIGINT) AS applied_actions,
       count(*) AS open_issues FROM q""")
def a11_repair(spark, sf):
    return R.repair_rollup(RP.repair_records(*_repair_inputs(spark, sf)))


def _category_fields(spark, sf):
    """Schema paths per category: what the payloads hold, plus targets that only the rules know."""
    docs = part_records(spark, sf).filter(F.col("category").isin(list(BASE_RULES))).select(
        F.lit("Item").alias("document_type"), F.col("category").alias("subtype"), "ord",
        F.to_variant_object(F.struct(
            F.try_variant_get("raw_content", "$.level", "bigint").alias("level"),
            F.try_variant_get("raw_content", "$.type", "string").alias("type"),
            F.struct(F.col("name").alias("value"), F.lit("").alias("chat")).alias("description"),
            F.array(F.struct(F.lit("1d4").alias("formula"))).alias("damage"))).alias("document"))
    return S.discover_schema(docs).select(
        F.col("subtype").alias("category"), "path", "type", (F.col("path") == "type").alias("required"), "default_json", "ord")


RULE_ROWS = ", ".join(f"('{c}', {i}, '{r.kind}', '{r.target}')" for c, g in BASE_RULES.items() for i, r in enumerate(g))
COVER_SQL = f"""{PART_SQL}, rule(category, ord, kind, t) AS (VALUES {RULE_ROWS}),
f AS (SELECT DISTINCT category, unnest(['level', 'type', 'description', 'description.value', 'description.chat', 'damage', 'damage[0].formula']) AS p
      FROM rec WHERE category IN ('weapon', 'armor', 'feat', 'spell', 'npc')),
rel AS (SELECT f.category, f.p, r.ord, r.t FROM f JOIN rule r ON f.category = r.category AND (f.p = r.t OR starts_with(f.p, r.t || '.') OR starts_with(f.p, r.t || '[')
        OR starts_with(r.t, f.p || '.') OR starts_with(r.t, f.p || '[')))"""


@query("c10_uncovered_paths", f"""WITH {COVER_SQL}
SELECT category, p AS schema_path, p = 'type' AS required, regexp_replace(regexp_extract(p, '([^.]*)$', 1), '\\[.*$', '') AS suggested_source_key
FROM f WHERE (category, p) NOT IN (SELECT category, p FROM rel)""")
def c10(spark, sf):
    return S.rule_coverage(S.rule_table(spark, BASE_RULES), _category_fields(spark, sf))[0]


@query("c10_stale_rules", f"""WITH {COVER_SQL}
SELECT category, t AS target_path FROM rule WHERE kind <> 'default' AND (category, ord) NOT IN (SELECT category, ord FROM rel)""")
def c10_stale(spark, sf):
    return S.rule_coverage(S.rule_table(spark, BASE_RULES), _category_fields(spark, sf))[1].select("category", "target_path")


@query("c10_coverage_report", f"""WITH {COVER_SQL},
g AS (SELECT category, p FROM f WHERE (category, p) NOT IN (SELECT category, p FROM rel)),
s AS (SELECT category FROM rule WHERE kind <> 'default' AND (category, ord) NOT IN (SELECT category, ord FROM rel))
SELECT c.category, (SELECT count(*) FROM g WHERE g.category = c.category AND p = 'type') AS missing_required,
       (SELECT count(*) FROM g WHERE g.category = c.category AND p <> 'type') AS missing_optional,
       (SELECT count(*) FROM s WHERE s.category = c.category) AS stale_rules, false AS is_valid
FROM (SELECT DISTINCT category FROM f) c""")
def c10_report(spark, sf):
    return S.coverage_report(S.rule_table(spark, BASE_RULES), _category_fields(spark, sf))


@query("c8_build_profile", f"""WITH {COVER_SQL}
SELECT category, kind, t AS target_path, CAST(NULL AS VARCHAR) AS source_key, CAST(NULL AS VARCHAR) AS coerce FROM rule
UNION ALL SELECT category, 'exact', p, regexp_extract(p, '([^.]*)$', 1),
  CASE p WHEN 'level' THEN 'number' WHEN 'damage' THEN 'array' WHEN 'description' THEN NULL ELSE 'string' END
FROM f WHERE (category, p) NOT IN (SELECT category, t FROM rule)""")
def c8(spark, sf):
    return S.build_profile(S.rule_table(spark, BASE_RULES), _category_fields(spark, sf)).select(
        "category", "kind", "target_path", "source_key", "coerce")
