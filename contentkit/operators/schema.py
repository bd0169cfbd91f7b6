"""Schema discovery, hashing, diff, compatibility and mapping coverage.

A schema is a long table: document_type, subtype, path, type, required, nullable, default_json, ord.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.functions.variants import MAP_TYPE, as_map, type_of
from contentkit.operators.conform import MapRule
from contentkit.operators.plan import compute_once, explode_rows
from contentkit.operators.skew import dim_join, hot_lookup, stage

#: Levels of a document that one step expands inside the row.
LEVELS = 6
#: An object path with more different keys than this, of which an object has a tenth at most on average, is a map.
MAP_KEYS = 1_000
KEY = ["document_type", "subtype"]
_NODES = "array<struct<path:string,parent:string,head:boolean,value:variant>>"


def top_key(path: Column) -> Column:
    """Text before the first dot or bracket."""
    return F.regexp_extract(path, r"^([^.\[]*)", 1)


def _children(prefix: Column, value: Column, joint: str = ".") -> Column:
    """The nodes (path, parent, head: whether it is the first, value) of the entries of an object, in key order."""
    entries = F.map_entries(F.try_variant_get(value, "$", MAP_TYPE))
    return F.transform(entries, lambda e, i: F.struct(
        F.when(prefix == "", e["key"]).otherwise(F.concat(prefix, F.lit(joint), e["key"])).alias("path"), prefix.alias("parent"),
        (i == 0).alias("head"), e["value"].alias("value")))


def _expand(node: Column) -> Column:
    """The nodes below one node: object entries, or the entries of an array's first element."""
    value, path = node["value"], node["path"]
    first = F.try_variant_get(value, "$[0]", "variant")
    return F.coalesce(
        F.when(type_of(value) == "object", _children(path, value))
        .when((type_of(value) == "array") & (type_of(first) == "object"), _children(F.concat(path, F.lit("[0]")), first)),
        F.array().cast(_NODES),
    )


def _level_nodes(frontier: DataFrame, keep: list[str], first: Column, levels: int) -> DataFrame:
    """The nodes of *levels* levels as rows (path, parent, head, value, deep); *first* are those of the uppermost one.

    Levels are expanded inside the row and exploded once, so the rows are read once and nothing shuffles.  Sub-values travel along, so keys
    with dots are safe.  *deep* marks a node of the last level that has something below it.
    """
    cols = frontier.select(*keep, F.coalesce(first, F.array().cast(_NODES)).alias("_l1"))
    for i in range(2, levels + 1):
        cols = compute_once(cols, **{f"_l{i}": F.flatten(F.transform(f"_l{i - 1}", _expand))})

    def marked(level: str, deep) -> Column:
        return F.transform(level, lambda n: F.struct(n["path"].alias("path"), n["parent"].alias("parent"), n["head"].alias("head"),
                                                     n["value"].alias("value"), deep(n).alias("deep")))

    upper = [marked(f"_l{i}", lambda n: F.lit(False)) for i in range(1, levels)]
    everything = F.concat(*upper, marked(f"_l{levels}", lambda n: F.size(_expand(n)) > 0))
    return explode_rows(cols, everything, "_n").select(*keep, *[F.col(f"_n.{c}").alias(c) for c in ("path", "parent", "head", "value", "deep")])


def _below(nodes: DataFrame, keep: list[str], levels: int) -> DataFrame:
    """The next levels, below the nodes that are marked as deep; those are written to the shared folder first."""
    frontier = stage(nodes.filter("deep").select(*keep, "path", "value"), "frontier")
    return _level_nodes(frontier, keep, _expand(F.struct("path", "value")), levels)


def flatten_paths(docs: DataFrame, payload: str, keep: list[str], levels: int = LEVELS) -> DataFrame:
    """Every (path, value) of a payload, to any depth; arrays are entered through element 0.

    What lies deeper than *levels* goes on as rows of its own until nothing is left below; documents that end before are read
    once for that and once for the result.
    """
    rounds = [_level_nodes(docs, keep, _children(F.lit(""), F.col(payload)), levels)]
    while not rounds[-1].filter("deep").isEmpty():
        rounds.append(_below(rounds[-1], keep, levels))
    return reduce(DataFrame.unionByName, rounds).select(*keep, "path", "value")


def _node_statistics(docs: DataFrame, payload: str, order: str, levels: int) -> DataFrame:
    """Per (KEY, parent, path, type): n, first (least order), heads (how often it was its object's first key); a written table.

    The counts of each round say themselves whether something lies below it, so flat documents are read once.
    """
    keep, rounds = [*KEY, order], []
    nodes = _level_nodes(docs, keep, _children(F.lit(""), F.col(payload)), levels)
    while True:
        typed = nodes.select(*keep, "parent", "path", type_of(F.col("value")).alias("type"), "head", "deep")
        rounds.append(stage(typed.groupBy(*KEY, "parent", "path", "type").agg(
            F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.count_if("head").alias("heads"), F.max("deep").alias("deep")), "paths"))
        if rounds[-1].filter("deep").isEmpty():
            break
        nodes = _below(nodes, keep, levels)
    if len(rounds) == 1:
        return rounds[0].drop("deep")
    return stage(reduce(DataFrame.unionByName, rounds).groupBy(*KEY, "parent", "path", "type").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("heads").alias("heads")), "paths")


#: What a path adds to its parent's.
_TAIL = "substring(path, length(parent) + 1)"


def _maps(stats: DataFrame, parent: str, map_keys: int) -> DataFrame:
    """(KEY, parent) of the objects that are used as maps, by a sketch of their different keys."""
    return stats.groupBy(*KEY, F.col(parent).alias("_of")).agg(
        F.approx_count_distinct(F.expr(_TAIL)).alias("_keys"), F.sum("n").alias("_entries"), F.sum("heads").alias("_objects")
    ).filter((F.col("_keys") > map_keys) & (F.col("_entries") * 10 <= F.col("_keys") * F.col("_objects"))).select(*KEY, "_of")


def _with_wildcards(stats: DataFrame, map_keys: int) -> DataFrame:
    """Add ``shown``: the path, with the keys of objects that are used as maps replaced by "*".

    Goes from the top down, one level of paths at a time: whether an object below a map is a map itself is decided on all of its
    occurrences together.
    """
    if _maps(stats, "parent", map_keys).isEmpty():
        return stats.withColumn("shown", F.col("path"))
    todo, above, done = stats, stats.select(*KEY).distinct().select(*KEY, F.lit("").alias("parent"), F.lit("").alias("_parent")), []
    while True:
        level = todo.join(above, [*KEY, "parent"])
        maps = _maps(level, "_parent", map_keys).withColumnRenamed("_of", "_parent").withColumn("_map", F.lit(True))
        shown = F.when(F.col("_map"), F.when(F.col("_parent") == "", "*").otherwise(F.concat("_parent", F.lit(".*")))).otherwise(F.concat("_parent", F.expr(_TAIL)))
        level = stage(level.join(maps, [*KEY, "_parent"], "left").withColumn("shown", shown).select(*stats.columns, "shown"), "level")
        done.append(level)
        named = level.select(*KEY, "path", "shown").distinct()
        above = named.select(*KEY, F.col("path").alias("parent"), F.col("shown").alias("_parent")).unionByName(
            named.select(*KEY, F.concat("path", F.lit("[0]")).alias("parent"), F.concat("shown", F.lit("[0]")).alias("_parent")))
        todo = todo.filter("parent <> ''") if len(done) == 1 else todo.join(level.select(*KEY, "path", "type").distinct(), [*KEY, "path", "type"], "left_anti")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done)


def discover_schema(
    docs: DataFrame, payload: str = "document", order: str = "ord", first_only: bool = False, levels: int = LEVELS, map_keys: int = MAP_KEYS,
) -> DataFrame:
    """The fields of each (document_type, subtype), with type, default and counts, to any depth.

    The default is the first value by *order*, of the type that occurs most (the earliest on a tie).
    With *first_only* just the first document of each subtype is looked at.  An object with more than *map_keys* different keys, of
    which its occurrences have few each, is a map: all its entries are reported as one path ``parent.*``.
    """
    if first_only:
        picked = docs.groupBy(*KEY).agg(F.min(order).alias(order))
        docs = docs.join(picked, [*KEY, order], "left_semi")
    # Counting needs numbers only, so it is a hash aggregation; the few documents that hold a first
    # value are then looked up by their order, and only those are flattened again for the defaults.
    stats = _with_wildcards(_node_statistics(docs, payload, order, levels), map_keys)
    stats = stats.groupBy(*KEY, "shown", "type").agg(
        F.sum("n").alias("n"), F.min_by("path", F.struct("first", "path")).alias("path"), F.min("first").alias("first"))
    stats = stage(stats, "fields")
    wanted = stats.select(*KEY, F.col("first").alias(order)).distinct()
    holders = dim_join(docs, wanted, [*KEY, order], spread=order, how="left_semi")
    defaults = flatten_paths(holders, payload, [*KEY, order], levels).select(
        *KEY, F.col(order).alias("first"), "path", type_of(F.col("value")).alias("type"), F.to_json("value").alias("default_json")
    ).groupBy(*KEY, "path", "type", "first").agg(F.min("default_json").alias("default_json"))
    per_type = stats.join(defaults, [*KEY, "path", "type", "first"], "left")
    best = F.struct(F.col("type") != "null", F.col("n"), -F.col("first"), "type", "default_json")
    return (
        per_type.groupBy(*KEY, F.col("shown").alias("path"))
        .agg(F.max(best).alias("_b"), F.sum("n").alias("occurrences"), F.max(F.col("type") == "null").alias("nullable"),
             F.count(F.lit(1)).alias("type_count"), F.min("first").alias("ord"))
        .select(*KEY, "path", F.col("_b.type").alias("type"), F.lit(False).alias("required"), "nullable",
                F.col("_b.default_json").alias("default_json"), "occurrences", "type_count", "ord")
    )


def schema_hash(fields: DataFrame) -> DataFrame:
    """Hash per schema over its sorted paths joined by "|" (duplicates count twice)."""
    joined = F.array_join(F.array_sort(F.collect_list("path")), "|")
    hashed = fields.groupBy(*KEY).agg(joined.alias("_p"))
    return hashed.select(*KEY, path_hash(F.col("_p")).alias("schema_hash"))


def path_hash(text: Column) -> Column:
    """h = h * 33 xor code unit, from 5381, unsigned 32 bit, as eight hex digits."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    value = F.aggregate(
        F.filter(F.split(text, ""), lambda ch: ch != ""),
        F.lit(5381).cast("bigint"),
        lambda h, ch: (h * 33).bitwiseAND(mask).bitwiseXOR(F.ascii(ch).cast("bigint")),
    )
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def schema_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """C4 (J7): one row per change: added, removed, changed_type or newly_required.

    Always compares types and required flags too, even where the path hash is equal.
    """
    p = previous.select(*KEY, "path", F.col("type").alias("from_type"), F.col("required").alias("_pr"), F.lit(True).alias("_p"))
    c = current.select(*KEY, "path", F.col("type").alias("to_type"), F.col("required").alias("_cr"), F.lit(True).alias("_c"))
    both = p.join(c, [*KEY, "path"], "full_outer")
    in_p, in_c = F.coalesce("_p", F.lit(False)), F.coalesce("_c", F.lit(False))
    changes = F.array_compact(F.array(
        F.when(in_c & ~in_p, "added"),
        F.when(in_p & ~in_c, "removed"),
        F.when(in_p & in_c & (F.col("from_type") != F.col("to_type")), "changed_type"),
        F.when(in_p & in_c & ~F.col("_pr") & F.col("_cr"), "newly_required"),
    ))
    return both.select(*KEY, "path", F.explode(changes).alias("change"), "from_type", "to_type")


def diff_report(previous: DataFrame, current: DataFrame) -> DataFrame:
    """C4 as one row per schema, with ``is_compatible``."""
    kinds = ("added", "removed", "changed_type", "newly_required")
    diff = schema_diff(previous, current).groupBy(*KEY).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("change") == k, F.col("path")))).alias(k) for k in kinds])
    keys = current.select(*KEY).distinct()
    none = F.array().cast("array<string>")
    full = keys.join(diff, KEY, "left").withColumns({k: F.coalesce(k, none) for k in kinds})
    clean = F.lit(True)
    for k in kinds:
        clean = clean & (F.size(k) == 0)
    return full.withColumn("is_compatible", clean)


def changed_schemas(cached: DataFrame, current: DataFrame) -> DataFrame:
    """Schemas that are new or whose hash differs from the cached one."""
    old = cached.select(*KEY, F.col("schema_hash").alias("previous_hash"))
    joined = current.join(old, KEY, "left")
    return joined.filter(F.col("previous_hash").isNull() | (F.col("previous_hash") != F.col("schema_hash")))


def _schema_arrays(fields: DataFrame) -> DataFrame:
    """One row per schema with its fields in order."""
    item = F.struct("ord", "path", top_key(F.col("path")).alias("top"), "type", "required", "default_json")
    return fields.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("_fields"))


def record_keys(payload: Column) -> Column:
    """Top-level keys of a payload."""
    return F.map_keys(as_map(payload))


_JSON_TOKEN = r'"(?:[^"\\]|\\.)*+"|[{}\[\],:]'


def _paths_of_text(path: Column, json: Column) -> Column:
    """The paths of all keys below an object, to any depth, from its JSON text: one fold over braces and keys.

    Arrays are passed over.  The stack holds the path of every open object, and null for an open array and all inside it.
    """
    tokens = F.regexp_extract_all(json, F.lit(_JSON_TOKEN), F.lit(0))
    # A key is a string with a colon behind it.
    pairs = F.arrays_zip(tokens.alias("t"), F.slice(tokens, 2, 1 << 30).alias("next"))
    events = F.transform(F.filter(pairs, lambda x: x["t"].isin("{", "}", "[", "]") | (F.coalesce(x["next"], F.lit("")) == ":")), lambda x: x["t"])
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("paths"), path.alias("now"))

    def step(acc: Column, t: Column) -> Column:
        key = F.concat(F.element_at(acc["stack"], -1), F.lit("."), F.parse_json(t).cast("string"))
        opened = F.when(t == "{", F.when(F.size(acc["stack"]) == 0, path).otherwise(F.when(F.element_at(acc["stack"], -1).isNotNull(), acc["now"])))
        return F.struct(
            F.when(t.isin("{", "["), F.concat(acc["stack"], F.array(opened))).when(
                t.isin("}", "]"), F.slice(acc["stack"], 1, F.size(acc["stack"]) - 1)).otherwise(acc["stack"]).alias("stack"),
            F.when(t.startswith('"') & key.isNotNull(), F.concat(acc["paths"], F.array(key))).otherwise(acc["paths"]).alias("paths"),
            F.when(t.startswith('"'), key).otherwise(acc["now"]).alias("now"))

    return F.aggregate(events, start, step, lambda acc: acc["paths"])


def _object_paths(payload: Column, levels: int) -> Column:
    """The paths of all keys of an object and of the objects inside it, level by level; what lies deeper than *levels* follows."""
    def inside(prefix: Column, value: Column) -> Column:
        return F.transform(_children(prefix, value), lambda n: F.struct(n["path"].alias("path"), n["value"].alias("value")))

    empty = F.array().cast("array<struct<path:string,value:variant>>")
    rows = [F.coalesce(inside(F.lit(""), payload), empty)]
    for _ in range(levels - 1):
        rows.append(F.flatten(F.transform(rows[-1], lambda n: F.coalesce(F.when(type_of(n["value"]) == "object", inside(n["path"], n["value"])), empty))))
    deeper = F.flatten(F.transform(
        F.filter(rows[-1], lambda n: type_of(n["value"]) == "object"), lambda n: _paths_of_text(n["path"], F.to_json(n["value"]))))
    return F.concat(F.transform(F.concat(*rows), lambda n: n["path"]), deeper)


def schema_compat(records: DataFrame, fields: DataFrame, payload: str = "raw_content", levels: int = LEVELS) -> DataFrame:
    """C3 (J5): missing required/optional paths, unknown keys and suggestions per record.

    A schema path is present when its top key is among the record's top-level keys, and a record
    path is known when its top key is one of the schema's, so the two anti joins become array
    tests against the record's own schema, which is a small derived dimension.  Record paths are listed to any depth.  ``compatible`` is
    null for a record whose type has no schema.
    """
    rows = dim_join(records, _schema_arrays(fields), KEY)
    have = record_keys(F.col(payload))
    missing = F.filter("_fields", lambda f: ~F.array_contains(F.col("_have"), f["top"]))
    tops = F.array_distinct(F.transform("_fields", lambda f: f["top"]))
    paths = _object_paths(F.col(payload), levels)

    def suggestion(f: Column) -> Column:
        example = F.try_element_at(F.create_map(*[F.lit(x) for x in (
            "string", '""', "number", "0", "boolean", "false", "array", "[]", "object", "{}")]), f["type"])
        known = F.coalesce(f["default_json"], F.lit("null")) != "null"
        return F.when(known, F.concat(F.lit('Add "'), f["path"], F.lit('" with value '), f["default_json"], F.lit(" (default)."))).otherwise(
            F.concat(F.lit('Add "'), f["path"], F.lit('" ('), f["type"], F.lit("), e.g. "), F.coalesce(example, F.lit("null")), F.lit(".")))

    out = compute_once(compute_once(rows, _have=have), _missing=missing, _tops=tops, _paths=paths)
    required = F.filter("_missing", lambda f: f["required"])
    out = out.withColumns({
        "missing_required": F.transform(required, lambda f: f["path"]),
        "missing_optional": F.transform(F.filter("_missing", lambda f: ~f["required"]), lambda f: f["path"]),
        "unknown_fields": F.when(F.col("_fields").isNotNull(), F.filter(
            "_paths", lambda p: ~F.array_contains(F.col("_tops"), top_key(p)))),
        "suggestions": F.transform(required, lambda f: F.struct(f["path"].alias("field"), suggestion(f).alias("suggestion"))),
        "compatible": F.size(required) == 0,
    })
    return out.withColumn("compatible", F.when(F.col("_fields").isNotNull(), F.col("compatible"))).select(
        *records.columns, "missing_required", "missing_optional", "unknown_fields", "suggestions", "compatible")


def _joint(key: Column) -> Column:
    return F.concat_ws("\u0001", "document_type", "subtype", key)


def compat_counts(records: DataFrame, fields: DataFrame, payload: str = "raw_content", order: str = "ord") -> DataFrame:
    """C3 for schemas of any width: per record missing_required, missing_optional, unknown_keys (numbers) and compatible.

    The same tests as ``schema_compat``, without a schema in any row: the record's keys are exploded and looked up among the top keys of
    all schemas, each with how many paths stand for it.  What is missing is what the schema has less what was found.  A key that most records of a
    frequent subtype have is resolved by the bounded broadcast of ``hot_lookup``.  *order* is unique; numbers and compatible are null
    where there is no schema.  The paths themselves are in ``missing_paths``.
    """
    tops = fields.groupBy(*KEY, top_key(F.col("path")).alias("top")).agg(
        F.count_if("required").alias("_req"), F.count_if(~F.col("required")).alias("_opt"))
    totals = tops.groupBy(*KEY).agg(F.sum("_req").alias("_all_req"), F.sum("_opt").alias("_all_opt"))
    keys = records.select(*KEY, order, F.explode(record_keys(F.col(payload))).alias("_key")).withColumn("_top", top_key(F.col("_key")))
    # A path is there by its whole top key, a key is known by its own top key: one lookup where they agree.
    same = F.col("_key") == F.col("_top")
    tests = F.when(same, F.array(F.struct(_joint(F.col("_key")).alias("j"), F.lit(True).alias("p"), F.lit(True).alias("k")))).otherwise(F.array(
        F.struct(_joint(F.col("_key")).alias("j"), F.lit(True).alias("p"), F.lit(False).alias("k")),
        F.struct(_joint(F.col("_top")).alias("j"), F.lit(False).alias("p"), F.lit(True).alias("k"))))
    asked = explode_rows(keys, tests, "_t").select(order, F.col("_t.j").alias("_j"), F.col("_t.p").alias("_p"), F.col("_t.k").alias("_k"))
    dim = asked.groupBy("_j").agg(F.count(F.lit(1)).alias("_n")).join(
        tops.select(_joint(F.col("top")).alias("_j"), "_req", "_opt", F.lit(True).alias("_known")), "_j")
    seen = hot_lookup(asked, dim, "_j", "_n", spread=order).groupBy(order).agg(
        F.sum(F.when(F.col("_p"), F.col("_req"))).alias("_has_req"), F.sum(F.when(F.col("_p"), F.col("_opt"))).alias("_has_opt"),
        F.count_if(F.col("_k") & F.col("_known").isNull()).alias("_unknown"))
    rows = dim_join(records, totals, KEY, spread=order).join(seen, order, "left")
    known = F.col("_all_req").isNotNull()
    missing = F.col("_all_req") - F.coalesce("_has_req", F.lit(0))
    return rows.select(
        *[F.col(c) for c in records.columns], F.when(known, missing).alias("missing_required"),
        F.when(known, F.col("_all_opt") - F.coalesce("_has_opt", F.lit(0))).alias("missing_optional"),
        F.when(known, F.coalesce("_unknown", F.lit(0))).alias("unknown_keys"), F.when(known, missing == 0).alias("compatible"))


def missing_paths(records: DataFrame, fields: DataFrame, payload: str = "raw_content", order: str = "ord", required_only: bool = True) -> DataFrame:
    """(order, path, required) of every schema path that a record lacks, as rows: for the records one looks at, since it lists them all.

    Records meet the top keys of their schema and lose those they have by an anti-join; paths are looked up for the rest.
    """
    wanted = fields.filter("required") if required_only else fields
    tops = wanted.select(*KEY, top_key(F.col("path")).alias("top")).distinct()
    have = records.select(*KEY, order, F.explode(record_keys(F.col(payload))).alias("top"))
    lacking = records.select(*KEY, order).join(tops, KEY).join(have, [*KEY, order, "top"], "left_anti")
    return lacking.join(wanted.select(*KEY, top_key(F.col("path")).alias("top"), "path", "required"), [*KEY, "top"]).select(order, "path", "required")


def rule_table(spark, rules: dict[str, list[MapRule]] | dict[str, tuple[MapRule, ...]]) -> DataFrame:
    """Mapping rules as rows (category, ord, kind, target_path, covered); nested rules also list their inner targets."""

    def targets(rule: MapRule) -> list[str]:
        return [rule.target] + [t for r in rule.rules for t in targets(r)]

    rows = [
        (category, i, rule.kind, rule.target, targets(rule))
        for category, group in rules.items() for i, rule in enumerate(group)
    ]
    return spark.createDataFrame(rows, "category string, ord int, kind string, target_path string, covered array<string>")


def _prefixes(path: Column) -> Column:
    """A path and all its ancestors; both "." and "[" separate."""
    steps = F.filter(F.split(path, r"(?=[.\[])"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ""))


def rule_coverage(rules: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C10 (J6): schema paths no rule covers, and rules whose target the schema does not know.

    *rules*: category, ord, kind, target_path, covered (array); *fields*: category, path, required.
    Two paths relate when one is a prefix of the other, so both sides are exploded to prefixes and
    the prefix join becomes two equi joins.
    """
    target = rules.select("category", F.explode("covered").alias("path")).distinct()
    schema_up = fields.select("category", "path", F.explode(_prefixes(F.col("path"))).alias("_p"))
    target_up = target.select("category", "path", F.explode(_prefixes(F.col("path"))).alias("_p"))
    by_ancestor = schema_up.join(target.select("category", F.col("path").alias("_p")), ["category", "_p"], "left_semi")
    by_descendant = fields.select("category", "path", F.col("path").alias("_p")).join(
        target_up.select("category", "_p"), ["category", "_p"], "left_semi")
    covered = by_ancestor.select("category", "path").union(by_descendant.select("category", "path")).distinct()
    last = F.regexp_extract(F.col("path"), r"([^.]*)$", 1)
    gaps = fields.join(covered, ["category", "path"], "left_anti").select(
        "category", F.col("path").alias("schema_path"), "required",
        F.regexp_replace(last, r"\[.*$", "").alias("suggested_source_key"))
    wanted = rules.filter(F.col("kind") != "default").select("category", "ord", F.col("target_path").alias("path"))
    up = wanted.select("category", "ord", "path", F.explode(_prefixes(F.col("path"))).alias("_p"))
    known_up = up.join(fields.select("category", F.col("path").alias("_p")), ["category", "_p"], "left_semi")
    known_down = wanted.select("category", "ord", "path", F.col("path").alias("_p")).join(
        schema_up.select("category", "_p"), ["category", "_p"], "left_semi")
    known = known_up.select("category", "ord").union(known_down.select("category", "ord")).distinct()
    stale = wanted.join(known, ["category", "ord"], "left_anti").select(
        "category", "ord", F.col("path").alias("target_path"),
        F.concat(F.lit('Target path "'), F.col("path"), F.lit('" not found in current schema.')).alias("reason"))
    return gaps, stale


def coverage_report(rules: DataFrame, fields: DataFrame) -> DataFrame:
    """C10 as one row per category, with ``is_valid``."""
    gaps, stale = rule_coverage(rules, fields)
    gap = gaps.groupBy("category").agg(
        F.count_if("required").alias("missing_required"), F.count_if(~F.col("required")).alias("missing_optional"))
    bad = stale.groupBy("category").agg(F.count(F.lit(1)).alias("stale_rules"))
    out = fields.select("category").distinct().join(gap, "category", "left").join(bad, "category", "left").fillna(
        0, ["missing_required", "missing_optional", "stale_rules"])
    return out.withColumn("is_valid", (F.col("missing_required") == 0) & (F.col("stale_rules") == 0))


def build_profile(rules: DataFrame, fields: DataFrame) -> DataFrame:
    """The base rules plus an exact rule for every schema path without one that has a default.

    *fields*: category, path, type, default_json, ord.
    """
    base = rules.select(
        "category", F.col("ord").cast("bigint").alias("ord"), "kind", "target_path",
        F.lit(None).cast("string").alias("source_key"), F.lit(None).cast("string").alias("coerce"),
        F.lit(None).cast("string").alias("default_json"))
    uncovered = fields.join(
        rules.select("category", F.col("target_path").alias("path")).distinct(), ["category", "path"], "left_anti"
    ).filter(F.coalesce("default_json", F.lit("null")) != "null")
    auto = uncovered.select(
        "category", (F.lit(1_000_000) + F.col("ord")).cast("bigint").alias("ord"), F.lit("exact").alias("kind"),
        F.col("path").alias("target_path"), F.regexp_extract("path", r"([^.]*)$", 1).alias("source_key"),
        F.when(F.col("type").isin("string", "number", "boolean", "array"), F.col("type")).alias("coerce"), "default_json")
    return base.unionByName(auto)


def profile_staleness(profiles: DataFrame, hashes: DataFrame) -> DataFrame:
    """A profile is stale when it is missing or its hash differs from the schema's."""
    p = profiles.select(*KEY, F.col("schema_hash").alias("profile_hash"))
    joined = hashes.join(p, KEY, "left")
    return joined.withColumn(
        "stale", F.col("profile_hash").isNull() | (F.col("profile_hash") != F.col("schema_hash")))
