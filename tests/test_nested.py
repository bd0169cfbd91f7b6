import json
import random

import pytest
from pyspark.sql import functions as F

from contentkit.operators import nested as N


def recursive(base, top):
    """The rule, key by key."""
    out = dict(base) if isinstance(base, dict) else {}
    for key, value in (top if isinstance(top, dict) else {}).items():
        out[key] = recursive(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def some(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.25:
        return rng.choice([1, "x", None, True, [1, {"a": 2}], {}, 2.5])
    return {rng.choice(["a", "b", "a.b", "1:a", "", "é\"", "c"]): some(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def merge(spark, pairs, levels=N.LEVELS):
    rows = spark.createDataFrame([(k, None if b is None else json.dumps(b), None if t is None else json.dumps(t)) for k, (b, t) in enumerate(pairs)],
                                 "id int, b string, t string")
    docs = rows.select("id", F.parse_json("b").alias("base"), F.parse_json("t").alias("top"), F.lit("kept").alias("_at"))
    out = N.deep_merge(docs, "base", "top", "merged", levels)
    assert out.columns == ["id", "base", "top", "_at", "merged"]
    return {r.id: json.loads(r.j) for r in out.select("id", F.to_json("merged").alias("j")).collect()}


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_merge_equals_the_recursive_rule(spark, levels):
    rng = random.Random(levels)
    pairs = [(some(rng, rng.randint(0, 9)), some(rng, rng.randint(0, 9))) for _ in range(120)] + [(None, {"a": 1}), ({"a": 1}, None), ([1], {"b": {}}), ("x", 3)]
    got = merge(spark, pairs, levels)
    assert len(got) == len(pairs)
    for k, (base, top) in enumerate(pairs):
        assert got[k] == recursive(base, top), (base, top)


def test_fifty_levels(spark):
    def nest(leaf, side):
        for k in reversed(range(50)):
            leaf = {f"k{k}": leaf, side: k, "both": {"who": side, side: [k]}}
        return leaf

    pairs = [(nest({"x": 1, "y": 2}, "low"), nest({"y": 3, "z": {}}, "high")), ({"a": 1}, {"b": 2})]
    got = merge(spark, pairs)
    assert got == {k: recursive(b, t) for k, (b, t) in enumerate(pairs)}
    at = got[0]
    for k in range(50):
        assert at["low"] == at["high"] == k and at["both"] == {"who": "high", "low": [k], "high": [k]}
        at = at[f"k{k}"]
    assert at == {"x": 1, "y": 3, "z": {}}


def test_no_rows(spark):
    assert merge(spark, []) == {}


def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Objects that are much alike shrink to a few bytes a row; deep rows are dealt out by their number all the same."""
    monkeypatch.setattr(N, "ROWS", 50, raising=False)
    deep = F.parse_json(F.lit('{"a": ' * 9 + "1" + "}" * 9))
    docs = spark.range(1000).select("id", deep.alias("base"), deep.alias("top"))
    held = N.deep_merge(docs, "base", "top", "merged").select("id").rdd.glom().map(len).collect()
    assert sum(held) == 1000 and max(held) <= 2 * N.ROWS
