import json

from pyspark.sql import functions as F

from contentkit.operators import schema as S

NO_FIELDS = "document_type string, subtype string, ord int, path string, type string, required boolean, default_json string"


def docs(spark, values):
    rows = spark.createDataFrame([("Item", "x", k, json.dumps(v)) for k, v in enumerate(values)], "document_type string, subtype string, ord int, j string")
    return rows.select("document_type", "subtype", "ord", F.parse_json("j").alias("document"))


def walk(value, path=""):
    """(path, value) of every key, arrays through their first element."""
    if isinstance(value, dict):
        for key, inner in value.items():
            at = f"{path}.{key}" if path else key
            yield at, inner
            yield from walk(inner, at)
    elif isinstance(value, list) and value and isinstance(value[0], dict) and path:
        yield from walk(value[0], path + "[0]")


def nest(depth, leaf, wrap=lambda k, v: {f"k{k}": v, "side": k}):
    for k in reversed(range(depth)):
        leaf = wrap(k, leaf)
    return leaf


def test_paths_to_any_depth(spark):
    values = [nest(23, {"end": "x"}), {"a": 1}, nest(9, [{"b": [{"c": None}]}], lambda k, v: {"list": [{"in": v}]}), nest(6, 1), nest(7, {}), {}]
    for levels in (2, 6):
        got = S.discover_schema(docs(spark, values), levels=levels).collect()
        want = {}
        for value in values:
            for path, _ in walk(value):
                want[path] = want.get(path, 0) + 1
        assert {r.path: r.occurrences for r in got} == want
        flat = S.flatten_paths(docs(spark, values), "document", ["ord"], levels)
        assert sorted((r.ord, r.path) for r in flat.select("ord", "path").collect()) == sorted((k, p) for k, v in enumerate(values) for p, _ in walk(v))
        ends = {r.path: (r.type, r.default_json) for r in got}
        deepest = max(ends, key=lambda p: p.count("."))
        assert ends[deepest] == ("string", '"x"')


def test_objects_used_as_maps(spark):
    values = [{"by_id": {f"id{k}-{j}": {"n": j, "inner": {f"{k}/{j}": {"deep": True}}} for j in range(3)}, "plain": {"a": 1, "b": k}} for k in range(200)]
    fields = {r.path: r for r in S.discover_schema(docs(spark, values), map_keys=100).collect()}
    assert set(fields) == {"by_id", "by_id.*", "by_id.*.n", "by_id.*.inner", "by_id.*.inner.*", "by_id.*.inner.*.deep", "plain", "plain.a", "plain.b"}
    assert fields["by_id.*"].occurrences == 600 and fields["by_id.*.inner.*.deep"].type == "boolean" and fields["by_id.*.n"].default_json == "0"
    wide = [{f"f{j}": j for j in range(150)} for _ in range(30)]
    assert len(S.discover_schema(docs(spark, wide), map_keys=100).collect()) == 150
    root = [{f"r{k}": {"v": k}} for k in range(300)]
    assert {r.path: r.occurrences for r in S.discover_schema(docs(spark, root), map_keys=100).collect()} == {"*": 300, "*.v": 300}


def test_unknown_fields_to_any_depth(spark):
    odd = {"q\"": {"{": {"[x]": {"é.y": {"a": [{"no": {"no": 1}}], "b": {"c": {"d": {"e": {}}}}}}}}, "known": {"z": 1}}
    values = [nest(15, {"end": 1}), odd, {}]
    rows = docs(spark, values).withColumnRenamed("document", "raw_content")
    fields = spark.createDataFrame([("Item", "x", 0, "known", "object", False, None)], NO_FIELDS)

    def objects(value, path=""):
        for key, inner in value.items():
            at = f"{path}.{key}" if path else key
            yield at
            if isinstance(inner, dict):
                yield from objects(inner, at)

    for levels in (1, 3, 6):
        got = {r.ord: r.unknown_fields for r in S.schema_compat(rows, fields, levels=levels).collect()}
        for k, value in enumerate(values):
            # A key that holds a dot or a bracket is cut like a path, as the rule reads top keys.
            assert sorted(got[k]) == sorted(p for p in objects(value) if not p.startswith("known"))


def test_no_documents(spark):
    assert S.discover_schema(docs(spark, [])).count() == 0


def test_counts_equal_the_listed_paths(spark):
    values = [{"a": 1, "c.d": 2}, {"a.b": 1, "zz": {}}, {}, {"k1": 0, "c": 3, "q[0]": 1}]
    rows = docs(spark, values).withColumnRenamed("document", "raw_content")
    rows = rows.unionByName(rows.limit(1).withColumns({"subtype": F.lit("none"), "ord": F.lit(99)}))
    fields = spark.createDataFrame([("Item", "x", k, p, "string", r, None) for k, (p, r) in enumerate(
        [("a", True), ("a.b", False), ("c", True), ("c.e", True), ("d[0].x", False), ("k1", False)])], NO_FIELDS)
    listed = {r.ord: r for r in S.schema_compat(rows, fields).collect()}
    for r in S.compat_counts(rows, fields).collect():
        want = listed[r.ord]
        if want.compatible is None:
            assert r.missing_required is r.unknown_keys is r.compatible is None
            continue
        tops = {p.split(".")[0].split("[")[0] for p in want.unknown_fields}
        assert (r.missing_required, r.missing_optional, r.compatible) == (len(want.missing_required), len(want.missing_optional), want.compatible)
        assert r.unknown_keys == len([k for k in values[r.ord] if k.split(".")[0].split("[")[0] in tops])
    paths = {}
    for r in S.missing_paths(rows, fields).collect():
        paths.setdefault(r.ord, []).append(r.path)
    assert {k: sorted(v) for k, v in paths.items()} == {k: sorted(r.missing_required) for k, r in listed.items() if r.missing_required}


def test_a_schema_of_a_million_paths(spark):
    fields = spark.range(1_000_000).selectExpr("'Item' AS document_type", "'x' AS subtype", "int(id) AS ord", "concat('k', id div 4, '.p', id) AS path",
                                               "'string' AS type", "id % 8 = 0 AS required", "string(null) AS default_json")
    rows = docs(spark, [{"k0": 1, "k2": 2, "zz": 3}, {}]).withColumnRenamed("document", "raw_content")
    got = {r.ord: (r.missing_required, r.missing_optional, r.unknown_keys) for r in S.compat_counts(rows, fields).collect()}
    assert got == {0: (125_000 - 2, 875_000 - 6, 1), 1: (125_000, 875_000, 0)}
