"""Ordinary columns that have the names of an operator's own."""

from pyspark.sql import functions as F

from contentkit.llm import quality_rules


def test_quality_rules_replace_their_own_names(docs_of):
    docs = docs_of([(1, "some words here"), (1, "some words here"), (2, None)])
    for name in ("n_words", "word_length", "_text", "_stats", "rule", "kept", "base_failed", "a.b"):
        docs = docs.withColumn(name, F.lit("mine"))
    got = quality_rules.judge(docs, [])
    assert len(set(got.columns)) == len(got.columns) and {"_text", "_stats", "a.b"} <= set(got.columns)
    rows = got.collect()
    assert sorted(r.n_words for r in rows) == [0, 3, 3] and all(r["_text"] == r["a.b"] == "mine" for r in rows) and {r.rule for r in rows} == {0}
