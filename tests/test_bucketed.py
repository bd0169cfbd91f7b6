import random

import pytest
from pyspark.sql import functions as F

from contentkit.operators import bucketed as B
from contentkit.operators import merge as M
from tests.test_merge import SCHEMA, frame


def plain(df):
    return sorted((r.id, r.name, r.category) for r in df.collect())


@pytest.mark.parametrize("overwrite", [False, True])
def test_buckets_equal_the_whole_merge(spark, tmp_path, overwrite):
    rnd = random.Random(5)
    store, state = B.BucketedCatalog(spark, str(tmp_path / "c"), buckets=16), frame(spark, [])
    for turn in range(3):
        rows = [(rnd.randrange(10**6) * 3 + turn, f"t{turn}-{i % 45}", rnd.choice(["hot", f"n{rnd.randrange(40)}", f"N{i}"]), f"c{turn}-{i}", "1") for i in range(50)]
        rows = list({r[0]: r for r in rows}.values())
        commit = store.merge(frame(spark, rows), overwrite)
        state, actions = M.merge_batch(state, frame(spark, rows), overwrite)
        got = store.read()
        assert plain(got) == plain(state) and commit.generation == turn
        assert sorted((r.ord, r.id) for r in got.collect()) == sorted((r.ord, r.id) for r in state.collect())
        assert sorted((r.ord, r.action) for r in commit.actions.collect()) == sorted((r.ord, r.action) for r in actions.collect())
        state = frame(spark, [tuple(r[c] for c in state.columns) for r in state.collect()])


def test_a_small_batch_rewrites_few_buckets(spark, tmp_path):
    store = B.BucketedCatalog(spark, str(tmp_path / "c"), buckets=64)
    store.merge(frame(spark, [(i, f"a{i}", f"name {i}", "old", "1") for i in range(2000)]))
    before = {r.part: r.gens for r in store.manifest().collect() if r.kind == "data"}
    batch = frame(spark, [(i, f"b{i}", f"NAME {i}", "new", "1") for i in range(5)] + [(i, f"b{i}", f"more {i}", "new", "1") for i in range(5, 10)])
    commit = store.merge(batch, overwrite=True)
    after = {r.part: r.gens for r in store.manifest().collect() if r.kind == "data"}
    assert 0 < len(commit.rewritten) <= 10 and {b for b in after if after[b] != before.get(b)} == set(commit.rewritten)
    assert {r.action for r in commit.actions.collect()} == {"added", "overwritten"} and store.read().count() == 2005
    # Without overwriting, names that are held change nothing, so nothing is written.
    assert store.merge(batch).rewritten == []
    assert sorted(r.name for r in store.lookup(spark.createDataFrame([("NAME 3",), ("more 7",)], "name string")).collect()) == ["NAME 3", "more 7"]


def test_a_rerun_gives_the_same_manifest(spark, tmp_path):
    store = B.BucketedCatalog(spark, str(tmp_path / "c"), buckets=8)
    first, second = frame(spark, [(i, f"a{i}", f"n{i}", "x", "1") for i in range(30)]), frame(spark, [(i, f"b{i}", f"n{i + 20}", "y", "1") for i in range(30)])
    store.merge(first, True, generation=0)
    store.merge(second, True, generation=1)
    rows, manifest = plain(store.read()), sorted(map(tuple, store.manifest().collect()), key=str)
    assert store.merge(second, True, generation=1).actions is None
    # Killed before its manifest was complete: files are there, the old state is what is read, and a repetition gives the same.
    store.folder.remove(f"{store.root}/manifest/gen=1/_SUCCESS")
    assert store.generation() == 0 and len(plain(store.read())) == 30
    store.merge(second, True, generation=1)
    assert plain(store.read()) == rows and sorted(map(tuple, store.manifest().collect()), key=str) == manifest


def test_ids_are_known_across_buckets_and_compactions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "ID_FILES", 2)
    store = B.BucketedCatalog(spark, str(tmp_path / "c"), buckets=4)
    for turn in range(5):
        commit = store.merge(frame(spark, [(i, f"t{turn}-{i}", f"turn {turn} {i}", "x", "1") for i in range(12)]))
        assert {r.action for r in commit.actions.collect()} == {"added"}
    clash = store.merge(frame(spark, [(0, "t0-3", "other", "x", "1"), (1, "t4-1", "more", "x", "1"), (2, "new", "third", "x", "1")]))
    assert {r.ord: r.action for r in clash.actions.collect()} == {0: "failed", 1: "failed", 2: "added"}
    kept = plain(store.read())
    assert store.vacuum() and plain(store.read()) == kept and store.vacuum() == []
    assert max(len(r.gens) for r in store.manifest().collect()) <= 3


def test_empty_batches_and_catalogs(spark, tmp_path):
    store = B.BucketedCatalog(spark, str(tmp_path / "c"), buckets=4)
    assert store.read() is None and store.generation() is None
    assert store.merge(frame(spark, [])).rewritten == [] and store.read().count() == 0
    store.merge(frame(spark, [(0, "a", "n", "x", "1")]))
    assert store.read().schema == spark.createDataFrame([], SCHEMA).schema and store.read().filter(F.col("schema_version") == "2.0.0").count() == 1
