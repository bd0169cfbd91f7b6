import random

from contentkit.operators import bucketed as B
from contentkit.operators import text_index as T
from contentkit.operators.catalog import search_text
from tests.test_merge import frame

SCHEMA = "ord bigint, id string, name string, tags array<string>, notes string, source_book string"
WORDS = ["steel", "Steal", "straße", "ÉPÉE", "red dragon", "aa", "aaaa", "x", "", "100% 'quoted'", "漢字かな"]


def rows(rng, first, count, prefix):
    pick = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 3)))
    return [(first + k, f"{prefix}{k}", f"{pick()} {prefix}{k}", None if rng.random() < 0.2 else [pick() for _ in range(rng.randint(0, 2))],
             rng.choice([None, pick()]), pick()) for k in range(count)]


def test_search_equals_the_scan_on_all_needles(spark, tmp_path):
    rng = random.Random(4)
    store = B.BucketedCatalog(spark, str(tmp_path / "c"), buckets=8)
    index = T.TextIndex(store, parts=4)
    assert index.search("steel") is None
    needles = ["steel", "STE", "st", "", "aaa", "aaaaa", "épée", "ße s", "n dragon st", "漢字か", "'quoted'", "none here", "red dragon", "t17"]
    for turn in range(2):
        batch = spark.createDataFrame(rows(rng, 0, 60, f"t{turn}"), SCHEMA)
        store.merge(batch, schema_version=None)
        if turn:  # names that are replaced lose their old words
            old = [(r.ord, "z", r.name, ["swapped"], None, "") for r in store.read().limit(9).collect()]
            commit = store.merge(spark.createDataFrame(old, SCHEMA), overwrite=True, schema_version=None)
            assert index.refresh() and commit.rewritten and index.refresh() == []
        for needle in needles if turn else needles[:4]:
            want = store.read().filter(search_text(needle)) if needle else store.read()
            assert sorted(r.ord for r in index.search(needle).collect()) == sorted(r.ord for r in want.collect()), needle
    assert sorted(r.ord for r in index.search("swapped").collect()) and index.search("swapped").columns == store.read().columns


def test_few_records_are_read(spark, tmp_path):
    store = B.BucketedCatalog(spark, str(tmp_path / "c"), buckets=32)
    base = spark.range(3000).selectExpr("id AS ord", "concat('i', id) AS id", "concat('common name ', id) AS name", "array('common') AS tags", "'' AS notes", "'' AS source_book")
    store.load(base)
    index = T.TextIndex(store, parts=4)
    assert [r.ord for r in index.search("NAME 2718").collect()] == [2718]
    found = index.candidates("name 2718").collect()
    assert len(found) < 10 and index.candidates("common").count() == 3000
    assert frame(spark, []).count() == 0
