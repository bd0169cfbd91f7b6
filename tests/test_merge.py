import random

import pytest
from pyspark.sql import functions as F

from contentkit.operators import merge as M
from contentkit.operators import skew as K

SCHEMA = "ord bigint, id string, name string, category string, schema_version string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sequential(catalog, batch, overwrite):
    """The row-by-row rule, as a check."""
    store = {r[1]: list(r) for r in sorted(catalog)}
    actions = {}
    for ord_, id_, name, category, _ in sorted(batch):
        hit = next((k for k, v in store.items() if v[2].lower() == name.lower()), None)
        if hit is None:
            store[id_] = [None, id_, name, category, "2.0.0"]
            actions[ord_] = "added"
        elif overwrite:
            store[hit] = [None, hit, name, category, "2.0.0"]
            actions[ord_] = "overwritten"
        else:
            actions[ord_] = "skipped"
    return [(v[1], v[2], v[3]) for v in store.values()], actions


@pytest.mark.parametrize("overwrite", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_the_sequential_rule(spark, overwrite, seed):
    rnd = random.Random(seed)
    names = ["a", "A", "b", "B ", " b", "c", "d", "D", "e"]
    catalog = [(i, f"c{i}", rnd.choice(names), f"cat{i}", "2.0.0") for i in range(6)]
    # Two thirds of the batch share one name.
    batch = [(i, f"n{i}", "hot" if i % 3 else rnd.choice(names), f"new{i}", "1.0.0") for i in range(90)]
    merged, actions = M.merge_batch(frame(spark, catalog), frame(spark, batch), overwrite)
    want, want_actions = sequential(catalog, batch, overwrite)
    rows = [(r.id, r.name, r.category) for r in merged.orderBy("ord").collect()]
    assert rows == want
    assert {r.ord: r.action for r in actions.collect()} == want_actions


def test_merge_is_idempotent_with_overwrite(spark):
    catalog = frame(spark, [(0, "x", "a", "k", "2.0.0")])
    batch = frame(spark, [(0, "n0", "B", "k", "1"), (1, "n1", "b", "l", "1"), (2, "n2", "A", "m", "1")])
    once, _ = M.merge_batch(catalog, batch, True)
    twice, actions = M.merge_batch(once, batch, True)
    key = lambda df: sorted((r.id, r.name, r.category) for r in df.collect())
    assert key(once) == key(twice)
    assert {r.action for r in actions.collect()} == {"overwritten"}


def test_id_collisions_fail_instead_of_replacing(spark):
    catalog = frame(spark, [(0, "x", "a", "k", "2.0.0")])
    batch = frame(spark, [(0, "x", "new", "k", "1"), (1, "y", "p", "k", "1"), (2, "y", "q", "k", "1")])
    merged, actions = M.merge_batch(catalog, batch)
    assert {(r.ord, r.action) for r in actions.collect()} == {(0, "failed"), (1, "added"), (2, "failed")}
    assert sorted(r.name for r in merged.collect()) == ["a", "p"]


def test_results_do_not_depend_on_partitioning(spark):
    batch = frame(spark, [(i, f"n{i}", f"k{i % 7}", str(i), "1") for i in range(200)])
    catalog = frame(spark, [(0, "x", "K3", "k", "2.0.0")])
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(M.merge_batch(catalog, batch.coalesce(1))[0]) == key(M.merge_batch(catalog, batch.repartition(8, "ord"))[0])


def test_versioned_names(spark):
    catalog = frame(spark, [(0, "a", "Sword", "k", "2"), (1, "b", "sword v2", "k", "2")])
    batch = frame(spark, [(i, f"n{i}", "SWORD", "k", "1") for i in range(3)] + [(3, "m", "axe", "k", "1"), (4, "o", "Axe", "k", "1")])
    got = {r.ord: r.versioned_name for r in M.versioned_names(batch, catalog, "t").collect()}
    assert got == {0: "SWORD v3", 1: "SWORD v4", 2: "SWORD v5", 3: "axe", 4: "Axe v2"}
    parity = {r.ord: r.versioned_name for r in M.versioned_names(batch, catalog, "t", unique=False).collect()}
    assert parity == {0: "SWORD v3", 1: "SWORD v3", 2: "SWORD v3", 3: "axe", 4: "Axe"}


def test_versions_run_out(spark):
    catalog = frame(spark, [(0, "a", "x", "k", "2")])
    batch = frame(spark, [(i, f"n{i}", "x", "k", "1") for i in range(120)])
    names = [r.versioned_name for r in M.versioned_names(batch, catalog, "late").collect()]
    assert len(set(names)) == 120 and sum(n.startswith("x late-") for n in names) == 120 - 98


@pytest.mark.parametrize("hot_keys", [0, 1, 100])
def test_hot_lookup_equals_a_plain_join(spark, hot_keys):
    left = spark.range(1000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"))
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).filter("key <> 'k7'")
    got = K.hot_lookup(left, right, "key", "n", hot_keys=hot_keys)
    want = left.join(right.drop("n"), "key", "left").select("ord", "key", "first")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) if hot_keys else True
    assert got.count() == 1000


def test_hot_rows_are_spread_by_the_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(4000).select(F.col("id").alias("ord"), F.lit("hot").alias("key"))
        right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
        out = K.hot_lookup(left, right, "key", "n").withColumn("p", F.spark_partition_id())
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert out.select("p").distinct().count() == 8
        assert out.filter("first = 0").count() == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("numbers", ["dense", "hash", "outlier", "signs"])
def test_rank_within_matches_row_number(spark, numbers):
    n = F.col("id")
    order = {"dense": n, "hash": F.xxhash64("id"), "outlier": F.when(n == 7, F.lit(2**62)).otherwise(n * 3), "signs": (n - 250) * F.lit(2**40)}[numbers]
    df = spark.range(500).select(order.alias("ord"), F.when(n % 2 == 0, "hot").otherwise("x").alias("k"))
    got = {(r.k, r.ord): r.rank for r in K.rank_within(df, ["k"], "ord", "rank").collect()}
    for k in ("hot", "x"):
        ordered = sorted(o for kk, o in got if kk == k)
        assert [got[(k, o)] for o in ordered] == list(range(1, len(ordered) + 1))
    over_all = {r.ord: r.rank for r in K.rank_within(df, [], "ord", "rank").collect()}
    assert [over_all[o] for o in sorted(over_all)] == list(range(1, 501))


def test_dim_join_routes_agree(spark, monkeypatch):
    left = spark.range(300).select(F.col("id").alias("ord"), (F.col("id") % 4).cast("string").alias("k"))
    dim = spark.createDataFrame([("0", "a"), ("1", "b"), ("2", "c")], "k string, v string")
    small = sorted(map(tuple, K.dim_join(left, dim, "k").select("ord", "v").collect()), key=str)
    monkeypatch.setattr(K, "BROADCAST_ROWS", 1)
    large = sorted(map(tuple, K.dim_join(left, dim, "k").select("ord", "v").collect()), key=str)
    assert small == large and len(large) == 300


def test_strict_insert_and_update(spark):
    catalog = frame(spark, [(0, "x", "a", "k", "2"), (1, "y", "b", "k", "2")])
    rows = frame(spark, [(5, "x", "new", "z", "1"), (6, "w", "w", "z", "1")])
    out, rejects = M.insert_strict(catalog, rows)
    assert sorted(r.id for r in out.collect()) == ["w", "x", "y"] and [r.id for r in rejects.collect()] == ["x"]
    out, rejects = M.update_strict(catalog, rows)
    assert {r.id: r.name for r in out.collect()} == {"x": "new", "y": "b"} and [r.id for r in rejects.collect()] == ["w"]


@pytest.mark.parametrize("ords", [[-40, -7, -1], [2**62, -(2**62), 2**63 - 2], [3, 17_179_869_184, 25_769_803_776]])
def test_chained_merges_hold_for_any_batch_order_numbers(spark, ords):
    """Three merges in a row: negative, huge and partition-based numbers never meet a number in use."""
    state, want = frame(spark, [(50, "x", "n50", "old", "2.0.0"), (51, "y", "n51", "old", "2.0.0")]), {"x": "old", "y": "old"}
    for turn in range(3):
        rows = [(o, f"t{turn}-{i}", f"name {turn} {i}", f"c{turn}", "1") for i, o in enumerate(ords)]
        rows.append((ords[0] + 1, f"again{turn}", "N50", f"again{turn}", "1"))
        merged, _ = M.merge_batch(state, frame(spark, rows), overwrite=True)
        got = merged.collect()
        want |= {r[1]: r[3] for r in rows[:-1]} | {"x": f"again{turn}"}
        assert {r.id: r.category for r in got} == want
        numbers = [r.ord for r in got]
        assert len(set(numbers)) == len(numbers) and max(numbers) < 51 + 1 + len(numbers)
        fresh = [r.id for r in sorted(got, key=lambda r: r.ord)][-3:]
        assert fresh == [f"t{turn}-{i}" for i in sorted(range(3), key=lambda i: ords[i])]
        state = spark.createDataFrame([tuple(r[c] for c in state.columns) for r in got], SCHEMA)
