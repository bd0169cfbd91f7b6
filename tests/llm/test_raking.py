"""Raking under caps against plain loops, the margins it reaches, the topics and the sample."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentkit.llm import queries, raking


def cells_of(spark, sizes, names=("source", "lang")):
    return spark.createDataFrame([(*k, n) for k, n in sizes.items()], ", ".join(f"{n} string" for n in names) + ", tokens long")


def test_without_caps_it_is_plain_proportional_fitting(spark):
    sizes = {k: 100 * (n + 1) for n, k in enumerate(itertools.product("ab", "xyz"))}
    mix = raking.Mixture(("source", "lang"), {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.5, "y": 0.25, "z": 0.25}}, budget=0.1, tolerance=1e-9, sweeps=40)
    rows = raking.probabilities(raking.rake(cells_of(spark, sizes), mix)).collect()
    total = sum(sizes.values())
    w = {k: v / total for k, v in sizes.items()}
    for _ in range(200):
        for axis, goals in ((0, mix.targets["source"]), (1, mix.targets["lang"])):
            sums = {v: sum(x for k, x in w.items() if k[axis] == v) for v in goals}
            w = {k: v * goals[k[axis]] / sums[k[axis]] for k, v in w.items()}
    for r in rows:
        assert abs(r.kept / (0.1 * total) - w[r.source, r.lang]) < 1e-6 and abs(r.probability - r.kept / r.tokens) < 1e-12


@pytest.mark.parametrize("seed", range(4))
def test_margins_are_met_under_caps(spark, seed):
    rng = random.Random(seed)
    sizes = {k: rng.randint(200, 4000) for k in itertools.product("abcde", "xyz", "pq")}
    mix = raking.Mixture(("source", "lang", "topic"), {"lang": {"x": 0.5, "y": 0.3, "z": 0.2}, "topic": {"p": 0.6, "q": 0.4}}, budget=0.72, sweeps=200)
    raked = raking.rake(cells_of(spark, sizes, ("source", "lang", "topic")), mix)
    rows = raked.collect()
    assert all(0 <= r.kept <= r.tokens * (1 + 1e-12) for r in rows) and any(r.kept >= r.tokens * (1 - 1e-9) for r in rows)
    report = raking.margins(raked, mix).collect()
    assert all(abs(r.kept - r.reachable) < 0.002 for r in report)
    assert abs(sum(r.kept for r in rows) - raking.goals(raked.select("source", "lang", "topic", "tokens"), mix)[0]) < 0.002 * sum(sizes.values())


def test_many_cells_are_raked_as_a_table(spark, monkeypatch):
    rng = random.Random(9)
    sizes = {k: rng.randint(200, 4000) for k in itertools.product("abc", "xyz")}
    mix = raking.Mixture(("source", "lang"), {"lang": {"x": 0.5, "y": 0.3, "z": 0.2}}, budget=0.6, sweeps=4, tolerance=0)
    here = {(r.source, r.lang): r.kept for r in raking.rake(cells_of(spark, sizes), mix).collect()}
    monkeypatch.setattr(raking, "CELLS", 0)
    there = {(r.source, r.lang): r.kept for r in raking.rake(cells_of(spark, sizes), mix).collect()}
    assert here.keys() == there.keys() and all(abs(here[k] - there[k]) < 1e-6 * sizes[k] for k in here)


def test_unreachable_targets_are_kept_whole_and_listed(spark):
    sizes = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 20, ("b", "y"): 3000}
    mix = raking.Mixture(("lang",), {"lang": {"x": 0.5, "y": 0.5}}, budget=0.5)
    raked = raking.rake(cells_of(spark, sizes), mix)
    report = {r.value: r for r in raking.margins(raked, mix).collect()}
    assert report["x"].wished == pytest.approx(0.5) and report["x"].reachable < 0.02 and report["x"].kept == pytest.approx(report["x"].reachable, abs=1e-4)
    assert sum(r.kept for r in raked.collect()) == pytest.approx(0.5 * 4030, rel=1e-3)
    none = raking.rake(cells_of(spark, sizes), raking.Mixture(("lang",), {"lang": {"w": 1.0}}))
    assert all(r.kept == 0 for r in none.collect())
    half = raking.rake(cells_of(spark, sizes), raking.Mixture(("lang",), {"lang": {"x": 1.0}}, budget=0.9)).collect()
    assert sum(r.kept for r in half) == pytest.approx(30, rel=1e-3)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n", raking.word_count(F.col("text")))
    docs = docs.withColumn("topic", raking.topic(F.col("text"), raking.fit_topics(docs)))
    report = raking.margins(raking.fit_cells(docs, queries.MIXTURE, F.col("n")), queries.MIXTURE).collect()
    assert all(abs(r.kept - r.reachable) < 0.002 for r in report), [r for r in report if abs(r.kept - r.reachable) >= 0.002]
    got = queries.QUERIES["op9_source_mixture"](spark, sf).collect()
    # The sample: each document is in it by its own hash and its cell's probability, and its tokens follow the margins.
    chance = {r.doc_id: r.c for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.lit(queries.MIXTURE.seed), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)).alias("c")).collect()}
    assert all(chance[r.doc_id] < r.keep_probability for r in got)
    kept, total = sum(r.n_tokens for r in got), sum(r.n for r in docs.select("n").collect())
    assert abs(kept / total - queries.MIXTURE.budget) < 0.06
    for r in report:
        if r.margin == "lang":
            assert abs(sum(g.n_tokens for g in got if g.lang == r.value) / kept - r.kept) < 0.08


def test_topics_follow_the_form_of_a_text(docs_of):
    rows = [(k, "word and other words in a line of prose " * (5 + k % 3)) for k in range(40)] + [(100 + k, "12 345 67; 89 | 10 " * 8) for k in range(40)] + [
        (200 + k, "SHOUTING LOUDLY ALL THE TIME " * 9) for k in range(40)]
    docs = docs_of([*rows, (300, None), (301, " "), (302, "")])
    centres = raking.fit_topics(docs, topics=3)
    got = {r.doc_id: r.t for r in docs.select("doc_id", raking.topic(F.col("text"), centres).alias("t")).collect()}
    groups = [{got[i] for i, _ in rows if i // 100 == k} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set().union(*groups)) == 3 and got[300] is got[301] is got[302] is None
    assert np.array_equal(centres, raking.fit_topics(docs.repartition(7), topics=3))
    assert raking.fit_topics(docs.limit(0)).shape == (0, 6) and docs.select(raking.topic(F.col("text"), raking.fit_topics(docs.limit(0)))).distinct().count() == 1


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows).withColumn("topic", F.lit(None).cast("string")).withColumn("keep_probability", F.lit(9.0)).withColumn("row", F.lit(1)).withColumn("m0", F.lit(2))
    got = raking.sample_mixture(docs, raking.Mixture(budget=1.0), raking.word_count(F.col("text")))
    assert sorted(got.columns) == sorted(docs.columns) and got.count() <= len(odd_rows) and got.filter("keep_probability > 1").count() == 0
    assert {r.doc_id for r in got.collect()} >= {4, 5, 6} and raking.sample_mixture(docs.limit(0), raking.Mixture(), raking.word_count(F.col("text"))).count() == 0


def test_topics_are_fitted_on_all_documents(docs_of):
    """Rows of another form, one in two thousand, are a cluster of their own wherever a sample would have been taken."""
    rows = [(k, f"word and other words in a line of prose {k} " * (5 + k % 3)) for k in range(8000)] + [(9000 + k, "12 345 67; 89 | 10 " * (8 + k)) for k in range(2)]
    docs = docs_of(rows)
    centres = raking.fit_topics(docs, topics=2)
    got = {r.doc_id: r.t for r in docs.select("doc_id", raking.topic(F.col("text"), centres).alias("t")).collect()}
    assert got[9000] == got[9001] == "topic-1" and {got[k] for k in range(8000)} == {"topic-0"}
    points = np.unique(np.array([tuple(r) for r in docs.select(*[F.round(c * raking.STEPS) for c in raking.statistics(F.col("text"))]).collect()]), axis=0)
    owner = np.square(points[:, None] - centres[None] * raking.STEPS).sum(2).argmin(1)
    assert np.allclose(centres, [points[owner == k].mean(0) / raking.STEPS for k in range(2)], atol=1e-9)
