import random

from contentkit.operators import bucketed as B
from contentkit.operators import maintained as F
from contentkit.operators import publish as P
from contentkit.plans.queries.base import RUN_TIME, part_records
from tests.test_merge import frame

SF = "/root/testdata/sf0.001"


def documents(store):
    return sorted((r.pack_id, r.name, r.id, r.lineage.recordId) for r in store.read().collect())


def test_two_runs_leave_one_document_per_key(spark, tmp_path):
    store, records = P.published_store(spark, str(tmp_path / "p"), 8), part_records(spark, SF)
    first, results = P.publish_into(store, records, RUN_TIME, categories=["weapon", "npc"])
    assert {r.disposition for r in results.collect()} <= {"imported", "updated"} and first.generation == 0
    one = documents(store)
    assert len(one) == len({(p, n.lower()) for p, n, _, _ in one}) > 0
    again, results = P.publish_into(store, records, RUN_TIME, categories=["weapon", "npc"])
    assert documents(store) == one and {r.disposition for r in results.collect()} == {"updated"}
    _, results = P.publish_into(store, records, RUN_TIME, overwrite=False)
    got = {r.category: r.disposition for r in results.collect() if r.category in ("weapon", "npc")}
    assert set(got.values()) == {"skipped"} and set(one) <= set(documents(store)) and len(documents(store)) > len(one)


def test_a_killed_run_leaves_the_old_state(spark, tmp_path):
    store, records = P.published_store(spark, str(tmp_path / "p"), 4), part_records(spark, SF)
    P.publish_into(store, records, RUN_TIME, categories=["armor"], run=0)
    old = documents(store)
    P.publish_into(store, records, RUN_TIME, categories=["armor", "feat"], run=1)
    new = documents(store)
    store.folder.remove(f"{store.root}/manifest/gen=1/_SUCCESS")
    assert documents(store) == old
    P.publish_into(store, records, RUN_TIME, categories=["armor", "feat"], run=1)
    assert documents(store) == new and len(new) > len(old)
    assert P.publish_into(store, records, RUN_TIME, run=1)[1] is None and documents(store) == new


def test_categories_without_a_converter_are_reported(spark, tmp_path):
    store = P.published_store(spark, str(tmp_path / "p"), 4)
    records = part_records(spark, SF).limit(3).replace({"weapon": "nothing"}, subset=["category"])
    records = records.withColumn("category", records.category.substr(1, 0))
    _, results = P.publish_into(store, records, RUN_TIME)
    rows = results.collect()
    assert {r.disposition for r in rows} == {"skipped"} and all(r.errors for r in rows) and store.read().count() == 0


def test_facets_equal_a_recount_after_three_merges(spark, tmp_path):
    rnd = random.Random(3)
    store = B.BucketedCatalog(spark, str(tmp_path / "c"), 8)
    kept = F.MaintainedFacets(store)
    assert kept.refresh().count() == 0
    base = part_records(spark, SF)
    rows = base.collect()
    for turn in range(3):
        picked = [r.asDict() | {"publisher": f"pub{rnd.randrange(3 + turn)}", "tags": [rnd.choice("abc"), ""], "category": rnd.choice(["feat", "spell"])}
                  for r in rnd.sample(rows, 40)]
        batch = spark.createDataFrame([tuple(p[c] for c in base.columns) for p in picked], base.schema)
        store.merge(batch, overwrite=True, check_ids=False)
        if turn != 1:  # one refresh spans two generations
            got = sorted(map(tuple, kept.refresh().collect()))
            assert got == sorted(map(tuple, F.all_counts(store.read()).collect())) and all(n > 0 for _, _, n in got)
            assert {r.category: r["count"] for r in kept.by_category().collect()} == {v: n for f, v, n in got if f == "category"}
    store.vacuum()
    assert sorted(map(tuple, kept.refresh().collect())) == got
    assert frame(spark, []).count() == 0
