"""Lookup sides with several rows per key never double the rows they are looked up for."""

from contentkit.operators.skew import one_per_key
from contentkit.operators.text import merge_ocr


def test_one_per_key(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", None, "z"), ("b", None, "q")], "k string, o int, v string")
    assert sorted((r.k, r.o, r.v) for r in one_per_key(rows, ["k"], ["o", "v"]).collect()) == [("a", 3, None), ("b", None, "q")]


def test_merge_ocr_keeps_one_row_per_page(spark):
    pages = spark.createDataFrame([("d", 1, "old"), ("d", 2, "two")], "doc_id string, page_number int, text string")
    ocr = spark.createDataFrame([("d", 1, "low", 0.2), ("d", 1, "high", 0.9), ("d", 1, "  ", 1.0)], "doc_id string, page_number int, text string, confidence double")
    got = sorted((r.page_number, r.text, r.ocr_confidence) for r in merge_ocr(pages, ocr).collect())
    assert got == [(1, "high", 0.9), (2, "two", None)]


def test_strict_insert_and_update_with_repeated_ids(spark):
    from contentkit.operators import merge as M
    from contentkit.records import RECORD_COLUMNS
    from pyspark.sql import functions as F

    def records(rows):
        frame = spark.createDataFrame(rows, "ord long, id string, name string")
        types = {"payload": "variant"}
        for c in RECORD_COLUMNS:
            if c not in frame.columns:
                frame = frame.withColumn(c, F.parse_json(F.lit("{}")) if types.get(c) else F.lit(None).cast("string"))
        return frame.select(*RECORD_COLUMNS)

    catalog = records([(1, "a", "A")])
    out, late = M.insert_strict(catalog, records([(5, "n", "second"), (4, "n", "first"), (6, "a", "known")]))
    assert sorted((r.id, r.name) for r in out.select("id", "name").collect()) == [("a", "A"), ("n", "first")]
    assert sorted(r.name for r in late.select("name").collect()) == ["known", "second"]
    out, _ = M.update_strict(catalog, records([(2, "a", "one"), (3, "a", "two")]))
    assert [(r.id, r.name) for r in out.select("id", "name").collect()] == [("a", "two")]
