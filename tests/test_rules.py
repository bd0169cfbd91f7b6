import json

from pyspark.sql import functions as F

from contentkit.operators import conform as P
from contentkit.operators import quality as Q
from contentkit.operators import repair as RP
from contentkit.operators import schema as S
from contentkit.operators.convert import convert_records, document_json
from contentkit.operators.extract import apply_responses, detect_records
from contentkit.plans.content_rules import FIELD_RULES
from contentkit.plans.detectors import DETECTORS

NOW = "2024-01-01T00:00:00.000Z"


def payloads(spark, *objects, category="weapon"):
    rows = [(i, f"r{i}", f"n{i}", category, json.dumps(o)) for i, o in enumerate(objects)]
    return spark.createDataFrame(rows, "ord bigint, id string, name string, category string, j string").withColumn("raw_content", F.parse_json("j"))


def test_content_rules(spark):
    rows = payloads(
        spark, {"name": "a", "level": "3x", "subtype": "small arm", "weaponType": "melee", "usage": 0, "bulk": 2},
        {"name": "", "level": 21, "type": "odd", "weaponType": "melee", "range": "far", "rarity": ""})
    out = Q.validate_content(rows, FIELD_RULES, "raw_content", "category")
    codes = {r.id: sorted((i.field, i.code) for i in r.issues) for r in out.collect()}
    assert codes["r0"] == [("bulk", "TYPE_MISMATCH"), ("usage", "VALUE_TOO_LOW")]
    assert codes["r1"] == [("level", "VALUE_TOO_HIGH"), ("name", "REQUIRED_FIELD_MISSING"), ("range", "TYPE_MISMATCH"), ("type", "INVALID_ENUM_VALUE")]
    texts = [i.message for r in out.filter("id = 'r1'").collect() for i in r.issues if i.field == "level"]
    assert texts == ["Field 'level' value 21 exceeds maximum 20."]


def test_import_checks_do_not_flag_duplicates_inside_the_batch(spark):
    drafts = spark.createDataFrame([(0, " Sword ", "weapon", "b", "p", 1.0), (1, "sword", "weapon", "b", "p", 1.0), (2, "NEW", "weapon", "b", "p", 1.0),
                                    (3, "new", "weapon", None, "", 0.0)], "ord bigint, name string, category string, source_book string, publisher string, page_number double")
    drafts = drafts.withColumn("raw_content", F.parse_json(F.lit('{"name": "x"}')))
    catalog = spark.createDataFrame([("SWORD",)], "name string")
    got = {r.ord: [i.code for i in r.issues] for r in Q.validate_import(drafts, catalog).collect()}
    assert got[0] == got[1] == ["DUPLICATE_NAME", "EMPTY_RAW_CONTENT"] and got[2] == ["EMPTY_RAW_CONTENT"]
    assert got[3] == ["MISSING_SOURCE_BOOK", "MISSING_PUBLISHER", "MISSING_PAGE_NUMBER", "EMPTY_RAW_CONTENT"]
    relaxed = {r.ord: r.valid for r in Q.overwrite_policy(Q.validate_import(drafts, catalog)).collect()}
    assert relaxed == {0: True, 1: True, 2: True, 3: True}


def test_later_rules_win_and_skips_are_reported(spark):
    rules = [P.default("a.b", "first"), P.exact("a.b", "x", "string"), P.exact("a.c[1].d", "y", "number"), P.exact("z", "none", "string")]
    out = P.conform(payloads(spark, {"x": "second", "y": "4"}, {"y": "q"}), rules).orderBy("ord").collect()
    assert [r.system.a.b for r in out] == ["second", "first"]
    assert [r.skipped_rules[0].reason for r in out] == ['Source key "none" absent', 'Source key "x" absent']


def test_coercions(spark):
    rules = [P.exact("n", "v", "number"), P.exact("b", "v", "boolean"), P.exact("l", "v", "array"), P.exact("s", "v", "string")]
    out = P.conform(payloads(spark, {"v": True}, {"v": "a;b, c"}, {"v": ["x", "y"]}, {"v": 3}, {"v": None}), rules).orderBy("ord").collect()
    assert [r.system.n for r in out] == [1, 0, 0, 3, None]
    assert [r.system.b for r in out] == [True, False, False, False, None]
    assert [r.system.l for r in out] == [["true"], ["a", "b", "c"], ["x", "y"], ["3"], None]


def test_whole_value_and_part_of_it(spark):
    maps = {"weapon": {"damage": "system.damage", "damageFormula": "system.damage[0].formula"}}
    skeleton = {"weapon": {"damage": [{"formula": "1d6", "type": "B"}], "keep": {"x": 1}}}
    rows = payloads(spark, {"name": "a"}, {"name": "a", "damage": "2d4"}, {"damageFormula": "3d3"}).withColumnsRenamed(
        {"raw_content": "data", "category": "content_type"}).drop("name").withColumn("metadata", F.struct(*[
            F.lit(None).cast("string").alias(c) for c in ("source_book", "publisher", "author", "notes")],
            F.lit(None).cast("bigint").alias("page_number"), F.lit(None).cast("array<string>").alias("tags")))
    out = P.apply_field_map(rows, maps, skeleton, NOW).orderBy("ord").select("name", "missing_name", F.to_json("system").alias("j")).collect()
    assert [json.loads(r.j)["damage"] for r in out] == [[{"formula": "1d6", "type": "B"}], "2d4", [{"formula": "3d3", "type": "B"}]]
    assert [r.missing_name for r in out] == [False, False, True] and out[2].name == "Unnamed Entry"


def test_repair_ladder(spark):
    fields = spark.createDataFrame([
        ("Item", "weapon", 0, "level", "number", True, None), ("Item", "weapon", 1, "flag", "boolean", False, None),
        ("Item", "weapon", 2, "list", "array", False, None), ("Item", "weapon", 3, "a", "string", False, '"dflt"'),
        ("Item", "weapon", 4, "t", "string", False, '"x"'), ("Item", "weapon", 5, "gone", "string", True, None),
        ("Item", "weapon", 6, "a.leaf", "number", False, "9")],
        "document_type string, subtype string, ord int, path string, type string, required boolean, default_json string")
    rows = payloads(spark, {"level": "7", "flag": " YES ", "list": "p, q", "extra": 1}, {"level": "x", "flag": "perhaps", "list": 4}).withColumns(
        {"document_type": F.lit("Item"), "subtype": F.lit("weapon")})
    templates = spark.createDataFrame([(1, "u2", "n", "weapon", '{"t": "second"}'), (0, "u1", "n", "weapon", '{"t": "first"}')],
                                      "ord bigint, uuid string, name string, subtype string, s string").select("ord", "uuid", "name", "subtype", F.parse_json("s").alias("snapshot"))
    out = RP.repair_records(rows, fields, templates).orderBy("ord").select("*", F.to_json("repaired").alias("r")).collect()
    assert json.loads(out[0].r) == {"level": 7, "flag": True, "list": ["p", "q"], "extra": 1, "a": "dflt", "t": "first"}
    assert json.loads(out[1].r) == {"level": "x", "flag": "perhaps", "list": [4], "a": "dflt", "t": "first"}
    assert [(a.field, a.action) for a in out[1].actions] == [("list", "normalized"), ("a", "filled_default"), ("t", "filled_template"), ("gone", "skipped")]
    assert len(out[0].remaining_issues) == 1 and out[0].was_modified


def test_schema_properties(spark):
    docs = payloads(spark, {"a": {"b": [{"c": 1}]}, "d": None}, {"a": {"b": []}, "e": "x"}).withColumns(
        {"document_type": F.lit("Item"), "subtype": F.lit("s"), "document": F.col("raw_content")})
    fields = S.discover_schema(docs)
    assert {r.path: r.type for r in fields.collect()} == {"a": "object", "a.b": "array", "a.b[0].c": "number", "d": "null", "e": "string"}
    assert S.schema_diff(fields, fields).count() == 0
    first = S.discover_schema(docs, first_only=True)
    forward = {(r.path, r.change) for r in S.schema_diff(first, fields).collect()}
    backward = {(r.path, r.change) for r in S.schema_diff(fields, first).collect()}
    assert forward == {("e", "added")} and backward == {("e", "removed")}


def test_schema_hash(spark):
    def djb(text):
        h = 5381
        for ch in text:
            h = ((h * 33) & 0xFFFFFFFF) ^ ord(ch)
        return f"{h:08x}"

    fields = spark.createDataFrame([("Item", "s", p) for p in ("b", "a.c", "a", "a")], "document_type string, subtype string, path string")
    assert S.schema_hash(fields).first().schema_hash == djb("a|a|a.c|b")


def test_block_can_pass_several_detectors(spark):
    text = "STEEL COAT\nLevel 3\nEAC bonus +4; KAC bonus +5\nDamage 1d6 F; Range 30 ft.\nCapacity 20\nUsage 1\nA coat that shoots."
    found = {r.category: r for r in detect_records(spark.createDataFrame([(1, text)], "id int, text string"), DETECTORS).collect()}
    assert set(found) == {"weapon", "armor"} and found["weapon"].name == "STEEL COAT"
    assert detect_records(spark.createDataFrame([(1, "nothing here"), (2, None), (3, "")], "id int, text string"), DETECTORS).count() == 0


def test_veto(spark):
    text = "Quick Draw (Combat)\nBenefit: You act first.\nDamage 1d6"
    df = spark.createDataFrame([(1, text), (2, text.replace("Damage 1d6", "more"))], "id int, text string")
    assert [(r.id, r.category) for r in detect_records(df, DETECTORS).collect() if r.category == "feat"] == [(2, "feat")]


def test_responses_overlay_only_objects(spark):
    base = spark.createDataFrame([("a", 0.4), ("b", 0.95), ("c", 0.4)], "record_id string, confidence double").withColumns(
        {"structured_data": F.parse_json(F.lit('{"x": 1, "y": 2}')), "detection_method": F.lit("regex")})
    responses = spark.createDataFrame([("a", '{"y": null, "z": 3}'), ("b", '{"x": 5}'), ("c", "[1]")], "record_id string, body string")
    got = {r.record_id: (r.detection_method, r.confidence, json.loads(r.j)) for r in apply_responses(base, responses).withColumn("j", F.to_json("structured_data")).collect()}
    assert got == {"a": ("ai", 0.9, {"x": 1, "y": None, "z": 3}), "b": ("ai", 0.95, {"x": 5, "y": 2}), "c": ("regex", 0.4, {"x": 1, "y": 2})}


def test_conversion_edges(spark):
    rows = payloads(spark, {"weaponType": "", "type": "Dagger", "range": "", "price": "6,280", "bulk": "x"}, {}).withColumns({
        "source_book": F.lit("B"), "publisher": F.lit(""), "author": F.lit(""), "page_number": F.lit(0).cast("bigint"),
        "tags": F.array().cast("array<string>"), "notes": F.lit(""), "import_method": F.lit("json")})
    out = convert_records(rows, NOW).select("*", document_json().alias("d")).orderBy("ord").collect()
    first, second = (json.loads(r.d)["system"] for r in out)
    assert first["type"] == "Dagger" and first["weaponType"] == "melee" and first["price"] == 0 and first["bulk"] == 1
    assert first["range"]["value"] == 0 and second["range"]["value"] == 30 and second["damage"][0]["type"]["values"] == ["B"]
    assert out[0].warnings == ["Missing publisher.", "Missing page number."]
    extra = convert_records(rows.withColumn("category", F.lit("gizmo")), NOW, packs={"gizmo": lambda s: {"n": s.num("range", default=4)}})
    assert extra.filter("size(errors) = 0").count() == 2
