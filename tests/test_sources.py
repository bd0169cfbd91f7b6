import json

import pytest
from pyspark.sql import functions as F

from contentkit.operators.extract import pick_template
from contentkit.plans.templates import TEMPLATES
from contentkit.sources import entries as E
from contentkit.sources import exports as X
from contentkit.sources import stored as ST

NOW = "2024-01-01T00:00:00.000Z"


def data(df):
    return {r.source_ref: json.loads(r.j) for r in df.select("source_ref", F.to_json("data").alias("j")).collect()}


def test_csv_edge_cases(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'Type,Name,Level,level,tags,Page_Number,notes\n'
        'weapon,"A, ""b""",1,7,"x, y",12p,\n'
        '\n'
        ',"two\nlines",,\n'
        'armor,c,1,2,,,n,extra,cells\n')
    (tmp_path / "b.csv").write_text("contentType;x\nfeat;TRUE\n")
    entries, issues = E.read_entries_csv(spark, str(tmp_path / "a.csv"), source_meta={"notes": "given"})
    rows = {r.source_ref: r for r in entries.collect()}
    assert data(entries) == {"row:2": {"name": 'A, "b"', "level": 7}, "row:3": {"name": "two\nlines", "level": None}, "row:4": {"name": "c", "level": 2}}
    assert [rows[k].content_type for k in ("row:2", "row:3", "row:4")] == ["weapon", "equipment", "armor"]
    assert rows["row:2"].metadata.tags == ["x", "y"] and rows["row:2"].metadata.page_number == 12
    assert rows["row:2"].metadata.notes == "given" and rows["row:4"].metadata.notes == "n"
    other, warned = E.read_entries_csv(spark, str(tmp_path / "b.csv"), delimiter=";")
    assert data(other) == {"row:2": {"x": True}} and other.first().content_type == "feat"
    assert issues.count() == 0 and [r.code for r in warned.collect()] == ["MISSING_NAME"]


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,level\nx,1\n")
    (tmp_path / "b.csv").write_text("price,name,kind\n5,y,z\n")
    entries, _ = E.read_entries_csv(spark, str(tmp_path))
    got = sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in entries.select(F.to_json("data")).collect())
    assert got == ['{"kind": "z", "name": "y", "price": 5}', '{"level": 1, "name": "x"}']


def test_csv_rows_of_split_files_are_numbered(spark, tmp_path):
    (tmp_path / "big.csv").write_text("name,n\n" + "".join(f"row{i},{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        entries, _ = E.read_entries_csv(spark, str(tmp_path), multi_line=False, max_columns=4)
        got = entries.select(F.regexp_extract("source_ref", r"(\d+)", 1).cast("int").alias("r"), F.try_variant_get("data", "$.n", "int").alias("n"))
        assert got.filter("r <> n + 2").count() == 0 and got.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_too_wide_raises(spark, tmp_path):
    (tmp_path / "w.csv").write_text(",".join(f"c{i}" for i in range(9)) + "\n" + ",".join("1" * 9) + "\n")
    try:
        E.read_entries_csv(spark, str(tmp_path), max_columns=4)[0].collect()
        raise AssertionError("expected an error")
    except Exception as e:
        assert "max_columns" in str(e)


def test_json_forms(spark):
    texts = spark.createDataFrame([
        ("arr", '[{"type": "weapon", "name": "a", "sourceBook": "B", "x": {"y": 1}}, 5, {"contentType": "feat"}]'),
        ("obj", '{"name": "solo", "pageNumber": 3, "tags": ["t"]}'), ("bad", "{"), ("num", "7"), ("empty", " ")], "source_file string, _text string")
    entries, issues = E.parse_json_entries(texts, source_meta={"publisher": "P"})
    rows = {(r.source_file, r.source_ref): r for r in entries.collect()}
    assert rows[("arr", "index:0")].content_type == "weapon" and rows[("arr", "index:0")].metadata.source_book == "B"
    assert rows[("arr", "index:2")].content_type == "feat" and rows[("obj", "index:0")].metadata.page_number == 3
    assert rows[("obj", "index:0")].metadata.publisher == "P"
    assert sorted((r.source_file, r.code) for r in issues.collect()) == [
        ("arr", "INVALID_ENTRY"), ("arr", "MISSING_NAME"), ("bad", "JSON_PARSE_ERROR"), ("empty", "JSON_PARSE_ERROR"), ("num", "JSON_NO_ENTRIES")]


def test_json_root_path(spark):
    texts = spark.createDataFrame([("a", '{"p": {"q": [{"name": "x"}]}}'), ("b", '{"p": 1}')], "source_file string, _text string")
    entries, issues = E.parse_json_entries(texts, root_path="p.q")
    assert entries.count() == 1 and [r.code for r in issues.collect()] == ["JSON_ROOT_PATH_ERROR"]


def test_templates():
    assert pick_template(TEMPLATES, "nope", "armor")[0].id == "armor-block"
    assert [n[1] for n in pick_template(TEMPLATES, "nope", "armor")[1]] == ["TEMPLATE_NOT_FOUND"]
    chosen, notes = pick_template(TEMPLATES, None, "theme")
    assert chosen is None and notes[0][1] == "NO_TEMPLATE"


def test_records_round_trip_through_json(spark, tmp_path):
    texts = spark.createDataFrame([("a", '[{"type": "weapon", "name": "x", "tags": ["q"], "notes": "n", "level": 2}, {"type": "odd"}]')], "source_file string, _text string")
    records = E.entries_to_records(E.parse_json_entries(texts)[0], NOW, {"source_book": "G"}, "json").cache()
    assert sorted((r.name, r.category, r.source_book, r.notes) for r in records.collect()) == [("", "equipment", "G", ""), ("x", "weapon", "G", "n")]
    X.write_json(records, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).select(F.monotonically_increasing_id().alias("ord"), F.parse_json("value").alias("value"))
    again = ST.normalize_stored_records(back, NOW)
    flat = lambda d: sorted(map(tuple, d.withColumn("raw_content", F.to_json("raw_content")).drop("ord").collect()))
    assert flat(records) == flat(again)


def test_catalog_csv_quoting(spark, tmp_path):
    texts = spark.createDataFrame([("a", '{"type": "npc", "name": "a \\"b\\", c", "bulk": "L"}')], "source_file string, _text string")
    X.write_catalog_csv(E.entries_to_records(E.parse_json_entries(texts)[0], NOW, import_method="json").coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*.csv")).read_text()
    assert text.splitlines()[0].startswith('"id","name","category","categoryLabel"') and '"a ""b"", c","npc","NPC"' in text


@pytest.mark.parametrize("limit", [20, 1 << 24])
def test_large_json_arrays_are_split_before_they_are_values(spark, monkeypatch, limit):
    """The same entries and issues whether an array is parsed whole or element by element."""
    monkeypatch.setattr(E, "SPLIT_BYTES", limit)
    texts = spark.createDataFrame([
        ("a", '[{"name":"x","v":1.5},{"name":"","b":[1,{"c":null}]},"{\\"name\\":\\"q\\"}",3,null,[1]]'),
        ("b", '{"name":"solo","v":2,"pad":"xxxxxxxxxxxxxxx"}'),
        ("c", '[{"name":"x"},{"name":"cut off he'),
        ("e", '[{"name":"aaaaaaaaaaaaa"}] trailing'),
    ], "source_file string, _text string")
    entries, issues = E.parse_json_entries(texts.filter("source_file <> 'e'"))
    assert sorted((r.source_file, r.source_ref, r.d) for r in entries.selectExpr("*", "to_json(data) d").collect()) == [
        ("a", "index:0", '{"name":"x","v":1.5}'), ("a", "index:1", '{"b":[1,{"c":null}],"name":""}'),
        ("b", "index:0", '{"name":"solo","pad":"xxxxxxxxxxxxxxx","v":2}')]
    assert sorted((r.source_file, r.source_ref or "", r.code) for r in issues.collect()) == [
        ("a", "index:1", "MISSING_NAME"), *[("a", f"index:{i}", "INVALID_ENTRY") for i in (2, 3, 4, 5)], ("c", "", "JSON_PARSE_ERROR")]
    nested = spark.createDataFrame([
        ("p", '{"a":{"b":[{"name":"k"},{"name":"l"}]},"z":1}'), ("r", '{"a":{"c":[{"name":"k"},{"name":"l"}]}}')],
        "source_file string, _text string")
    entries, issues = E.parse_json_entries(nested, root_path="a.b")
    assert sorted(r.source_ref for r in entries.collect()) == ["index:0", "index:1"]
    assert [(r.source_file, r.code) for r in issues.collect()] == [("r", "JSON_ROOT_PATH_ERROR")]


def test_files_are_read_whole(spark, tmp_path):
    """Arrays and text blocks that run over several lines are one document each."""
    (tmp_path / "a.json").write_text(json.dumps([{"name": "x", "v": 1}, {"name": "y", "v": 2}], indent=2))
    (tmp_path / "b.json").write_text('{\n  "name": "z",\n  "v": 3\n}\n')
    entries, issues = E.read_entries_json(spark, str(tmp_path))
    got = sorted((r.n, r.source_ref) for r in entries.select("source_ref", F.try_variant_get("data", "$.name", "string").alias("n")).collect())
    assert got == [("x", "index:0"), ("y", "index:1"), ("z", "index:0")]
    assert issues.count() == 0
    entries, issues = E.read_by_extension(spark, str(tmp_path), TEMPLATES)
    assert entries.count() == 3
    assert issues.filter("code = 'JSON_PARSE_ERROR'").count() == 0
