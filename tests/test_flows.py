import json

import pytest
from pyspark.sql import functions as F

from contentkit.operators.skew import scratch_dir
from contentkit.plans import flows as W
from contentkit.records import RECORD_COLUMNS
from contentkit.streaming import ingest as G

NOW = "2024-01-01T00:00:00.000Z"
EMPTY = ("ord bigint, id string, name string, category string, source_book string, publisher string, author string, page_number bigint, "
         "tags array<string>, notes string, raw_content variant, imported_date timestamp, import_method string, schema_version string")
PAGE = ("FLAME ROD\nLevel 3; Price 900\nDamage 1d6 F; Range 30 ft.\nCapacity 20 charges; Usage 1\nA small arm that burns bright.\n\n"
        "a tail that is long enough to be a block of its own, but holds nothing at all")


def test_import_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("type,name,level\nweapon,Rod,1\nodd,Bad,2\nweapon,,3\n")
    (tmp_path / "in" / "b.JSON").write_text(json.dumps([{"type": "armor", "name": "rod"}, {"type": "armor", "name": "Coat"}]))
    catalog = spark.createDataFrame([], EMPTY)
    run = W.import_folder(spark, str(tmp_path / "in"), catalog, NOW)
    names = sorted(r.name.lower() for r in run.catalog.collect())
    assert names == ["coat", "rod"]
    assert sorted(r.action for r in run.actions.collect()) == ["added", "added", "skipped"]
    assert run.checked.filter("not valid").count() == 2 and [r.code for r in run.issues.collect()] == ["MISSING_NAME"]


@pytest.mark.parametrize("policy,disposition", [("replace", "updated"), ("new-version", "imported")])
def test_pages_to_published(spark, policy, disposition):
    pages = spark.createDataFrame([(1, 1, PAGE), (1, 2, "tiny")], "doc_id int, page_number int, text string")
    run = W.extract_pages(pages, "Book", "Maker")
    rows = run.extracted.collect()
    assert [(r.name, r.category, r.page_number) for r in rows] == [("FLAME ROD", "weapon", 1)]
    assert run.pages_to_recognise.count() == 1
    decisions = run.extracted.select("record_id", F.lit("accepted").alias("status"), *[F.lit(None).cast("string").alias(c) for c in ("name", "category", "notes")])
    catalog = spark.createDataFrame([(0, "old", "Flame Rod", "weapon", "", "", "", 0, [], "", None, None, "json", "2.0.0")], EMPTY).withColumn(
        "raw_content", F.parse_json(F.lit("{}")))
    index = spark.createDataFrame([(0, "doc", "flame rod", "weapons")], "ord bigint, id string, name string, pack_id string")
    kept, published = W.save_reviewed(run.extracted, decisions, catalog.select(*RECORD_COLUMNS), index, NOW, policy)
    assert [r.disposition for r in published.results.collect()] == [disposition]
    assert published.documents().count() == 1 and kept.count() == (1 if policy == "replace" else 2)


def test_streams_equal_batches(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    for i in range(3):
        (folder / f"f{i}.txt").write_text(PAGE.replace("ROD", f"ROD {'XYZ'[i]}") + "\f" + PAGE.replace("ROD", "WAND"))
    found = G.stream_detected(G.stream_pages(spark, str(folder), max_files=1))
    q = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c0")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.name for r in spark.table("found").collect()) == ["FLAME ROD X", "FLAME ROD Y", "FLAME ROD Z"] + ["FLAME WAND"] * 3
    records = found.select(
        F.xxhash64("doc_id", "page_number", "block_no").alias("ord"), F.sha2(F.concat("doc_id", F.col("page_number").cast("string")), 256).alias("id"),
        "name", "category", F.lit("s").alias("schema_version"))
    G.merge_stream(records, str(tmp_path / "cat"), str(tmp_path / "c1")).awaitTermination(180)
    names = [r.name for r in G.latest_catalog(spark, str(tmp_path / "cat")).collect()]
    assert sorted(names) == ["FLAME ROD X", "FLAME ROD Y", "FLAME ROD Z", "FLAME WAND"]


def test_scratch_folder_follows_the_session(spark, tmp_path):
    spark.conf.set("spark.checkpoint.dir", str(tmp_path)) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first != second
