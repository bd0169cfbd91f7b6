"""Conforming raw payloads to a nested target schema by rules.

Rules are compiled on the driver into one nested projection: paths, conflicts between paths and
types are resolved while compiling, so at run time every target path is a single expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.functions.rules import TRANSFORMS, flag
from contentkit.functions.scalars import compact, split_list, strip, to_number
from contentkit.functions.variants import get_as, get_text, get_value, literal, literal_variant, type_of

_UNSET = object()
SKIPPED_TYPE = "array<struct<target:string,reason:string>>"
TRANSFORM_KINDS = {"parseList": "array", "parseBulk": "number", "parseCR": "number", "parseMaxDex": "number",
                   "xpForCr": "number", "abilityMod": "number", "number": "number", "damageTypes": "array",
                   "levels": "list", "skills": "map", "flag": "boolean"}


@dataclass(frozen=True)
class MapRule:
    """One mapping rule; *kind* is exact, alias, transform, computed, default or nested."""

    kind: str
    target: str
    sources: tuple[str, ...] = ()
    transform: str = ""
    coerce: str = "none"
    expression: str = ""
    default: object = _UNSET
    rules: tuple["MapRule", ...] = ()

    @property
    def has_default(self) -> bool:
        return self.default is not _UNSET


def alias(target: str, *sources: str, coerce: str = "none", default: object = _UNSET) -> MapRule:
    return MapRule("alias", target, sources, coerce=coerce, default=default)


def exact(target: str, source: str, coerce: str = "none", default: object = _UNSET) -> MapRule:
    return MapRule("exact", target, (source,), coerce=coerce, default=default)


def transform(target: str, source: str, name: str, default: object = _UNSET) -> MapRule:
    return MapRule("transform", target, (source,), transform=name, default=default)


def computed(target: str, expression: str, coerce: str = "string") -> MapRule:
    """*expression* is Spark SQL over the record columns; null means no write."""
    return MapRule("computed", target, expression=expression, coerce=coerce)


def default(target: str, value: object) -> MapRule:
    return MapRule("default", target, default=value)


def nested(target: str, *rules: MapRule) -> MapRule:
    return MapRule("nested", target, rules=rules)


@dataclass
class Node:
    """A target path while compiling: an expression, children, or both (then a child write wins)."""

    expr: Column | None = None
    kind: str = "none"
    sure: bool = False
    written: Column | None = None
    children: dict[str, "Node"] = field(default_factory=dict)


def path_parts(path: str) -> list[str]:
    return [p for p in re.sub(r"\[(\d+)\]", r".\1", path).split(".") if p]


def kind_of_value(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list) and all(isinstance(v, str) for v in value):
        return "array"
    return "none"


def _typed_literal(value: object, kind: str) -> Column:
    if kind == "none":
        return literal_variant(value)
    if kind == "string" and not isinstance(value, str):
        return F.lit(str(value))
    return literal(value)


def _as_variant(c: Column, kind: str) -> Column:
    if kind == "none":
        return c
    if kind == "map":
        return F.to_variant_object(c)
    return F.when(c.isNotNull(), F.to_variant_object(c) if kind == "struct" else c.cast("variant"))


def _unify(a: Column, ka: str, b: Column, kb: str) -> tuple[Column, Column, str]:
    if ka == kb:
        return a, b, ka
    return _as_variant(a, ka), _as_variant(b, kb), "none"


class Tree:
    """Nested target under construction; later writes to a path win."""

    def __init__(self) -> None:
        self.root = Node()

    def write(self, path: str, expr: Column, kind: str, sure: bool) -> None:
        node = self.root
        for part in path_parts(path):
            node = node.children.setdefault(part, Node())
        hit = expr.isNotNull()
        if sure:
            node.children.clear()
            node.expr, node.kind, node.sure = expr, kind, True
        elif node.expr is None:
            node.expr, node.kind = expr, kind
        else:
            new, old, node.kind = _unify(expr, kind, node.expr, node.kind)
            node.expr = F.coalesce(new, old)
        node.written = hit if node.written is None else node.written | hit

    def written(self, node: Node) -> Column:
        out = F.lit(False) if node.written is None else node.written
        for child in node.children.values():
            out = out | self.written(child)
        return out

    def build(self, node: Node | None = None) -> tuple[Column, str]:
        node = node or self.root
        if not node.children:
            return node.expr, node.kind
        if all(k.isdigit() for k in node.children):
            cells = []
            for i in range(max(int(k) for k in node.children) + 1):
                child = node.children.get(str(i))
                cells.append(self.build(child) if child else (F.lit(None), "none"))
            kinds = {k for _, k in cells}
            if len(cells) > 1 and (len(kinds) > 1 or "struct" in kinds):
                out = F.array(*[_as_variant(c, k) for c, k in cells])
            else:
                out = F.array(*[c for c, _ in cells])
            kind = "structs"
        else:
            out = F.struct(*[self.build(c)[0].alias(k) for k, c in node.children.items()])
            kind = "struct"
        if node.expr is None:
            return out, kind
        inner = F.lit(False)
        for child in node.children.values():
            inner = inner | self.written(child)
        whole = F.to_variant_object(out)
        return F.when(inner, whole).otherwise(F.coalesce(_as_variant(node.expr, node.kind), whole)), "none"


def coerce(payload: Column, key: str, kind: str) -> Column:
    """Value of one key in the requested type; null when the key is absent or JSON null."""
    text = get_text(payload, key)
    if kind == "string":
        return text
    if kind == "number":
        as_flag = F.when(type_of(get_value(payload, key)) == "boolean", F.when(text == "true", 1.0).otherwise(0.0))
        return F.when(text.isNotNull(), F.coalesce(as_flag, to_number(text), F.lit(0.0)))
    if kind == "boolean":
        return F.when(text.isNotNull(), flag(text))
    if kind == "array":
        value = get_value(payload, key)
        return F.when(type_of(value) == "array", get_as(payload, key, "array<string>")).when(
            type_of(value) == "string", split_list(text)).when(value.isNotNull(), F.array(text))
    return get_value(payload, key)


def _apply(rule: MapRule, payload: Column, tree: Tree, skipped: list[Column],
           transforms: Mapping[str, Callable[[Column], Column]]) -> None:
    def skip(cond: Column, reason: str) -> None:
        skipped.append(F.when(cond, F.struct(F.lit(rule.target).alias("target"), F.lit(reason).alias("reason"))))

    if rule.kind == "default":
        kind = kind_of_value(rule.default)
        tree.write(rule.target, _typed_literal(rule.default, kind), kind, sure=True)
        return
    if rule.kind == "nested":
        inner = Tree()
        for sub in rule.rules:
            _apply(sub, payload, inner, [], transforms)
        if not inner.root.children:
            return
        expr, kind = inner.build()
        tree.write(rule.target, F.when(inner.written(inner.root), expr), kind, sure=False)
        return
    if rule.kind == "computed":
        tree.write(rule.target, F.expr(rule.expression), rule.coerce, sure=False)
        return
    if rule.kind == "transform":
        fn = transforms.get(rule.transform)
        if fn is None:
            skip(F.lit(True), f'Transform "{rule.transform}" not registered')
            return
        text = get_text(payload, rule.sources[0])
        kind = TRANSFORM_KINDS.get(rule.transform, "string")
        if kind == "array":
            listed = get_as(payload, rule.sources[0], "array<string>")
            value = F.when(listed.isNotNull(), listed).when(text.isNotNull(), fn(text))
        else:
            value = F.when(text.isNotNull(), fn(text))
    else:
        kind = rule.coerce
        value = F.coalesce(*[coerce(payload, s, kind) for s in rule.sources])
    if rule.has_default:
        fallback, fk = rule.default, kind_of_value(rule.default)
        new, old, kind = _unify(value, kind, _typed_literal(fallback, fk if kind != "none" else "none"),
                                fk if kind != "none" else "none")
        tree.write(rule.target, F.coalesce(new, old), kind, sure=True)
        return
    tree.write(rule.target, value, kind, sure=False)
    if len(rule.sources) > 1:
        skip(value.isNull(), f"None of [{', '.join(rule.sources)}] found in the payload")
    else:
        skip(value.isNull(), f'Source key "{rule.sources[0]}" absent')


def compile_rules(
    rules: Sequence[MapRule], payload: Column, seeds: Sequence[tuple[str, object]] = (),
    transforms: Mapping[str, Callable[[Column], Column]] | None = None,
) -> tuple[Column, Column]:
    """The system struct and the skipped-rules array for a rule list.

    *seeds* are (path, default) pairs of the target schema, written before the rules.
    """
    tree, skipped = Tree(), []
    for path, value in seeds:
        kind = kind_of_value(value)
        tree.write(path, _typed_literal(value, kind), kind, sure=True)
    for rule in rules:
        _apply(rule, payload, tree, skipped, transforms or TRANSFORMS)
    system = tree.build()[0] if tree.root.children else F.struct()
    return system, compact(*skipped).cast(SKIPPED_TYPE) if skipped else F.array().cast(SKIPPED_TYPE)


def conform(
    records: DataFrame, rules: Sequence[MapRule], category: str | None = None,
    seeds: Sequence[tuple[str, object]] = (), payload: str = "raw_content",
    transforms: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Adds ``system`` (nested struct) and ``skipped_rules`` for the records of one category."""
    rows = records if category is None else records.filter(F.col("category") == category)
    system, skipped = compile_rules(rules, F.col(payload), seeds, transforms)
    return rows.withColumns({"system": system, "skipped_rules": skipped})


def conform_all(
    records: DataFrame, profiles: Mapping[str, Sequence[MapRule]], payload: str = "raw_content"
) -> DataFrame:
    """P1 for many categories in one pass over the records; ``system`` is a VARIANT."""
    expr, skip = None, None
    for category, rules in profiles.items():
        system, skipped = compile_rules(rules, F.col(payload))
        cond = F.col("category") == category
        system = F.to_variant_object(system)
        expr = F.when(cond, system) if expr is None else expr.when(cond, system)
        skip = F.when(cond, skipped) if skip is None else skip.when(cond, skipped)
    return records.withColumns({"system": expr, "skipped_rules": F.coalesce(skip, F.array().cast(SKIPPED_TYPE))})


def apply_field_map(
    entries: DataFrame, field_maps: Mapping[str, Mapping[str, str]], skeletons: Mapping[str, Mapping],
    run_time: str, payload: str = "data",
) -> DataFrame:
    """Copy non-empty source fields over the category's default skeleton.

    Adds name (default ``Unnamed Entry``), ``system`` (VARIANT), ``missing_name`` and the metadata
    struct with ``Unknown`` defaults.  Only ``system.*`` targets are written, as real paths.
    """
    expr = None
    for category, mapping in field_maps.items():
        tree = Tree()
        targets = [t[len("system."):] for t in mapping.values() if t.startswith("system.")]
        _seed(tree, skeletons.get(category, {}), "", targets)
        for source, target in mapping.items():
            if source == "name" or not target.startswith("system."):
                continue
            value = get_value(F.col(payload), source)
            text = get_text(F.col(payload), source)
            tree.write(target[len("system."):], F.when(F.coalesce(text, F.lit("")) != "", value), "none", sure=False)
        if not tree.root.children:
            continue
        cond = F.col("content_type") == category
        system = F.to_variant_object(tree.build()[0])
        expr = F.when(cond, system) if expr is None else expr.when(cond, system)
    name = F.nullif(strip(get_text(F.col(payload), "name")), F.lit(""))

    def meta(column: str, fallback: Column) -> Column:
        return F.coalesce(F.col(f"metadata.{column}"), fallback)

    no_tags = F.array().cast("array<string>")
    return entries.withColumns({
        "missing_name": name.isNull(),
        "name": F.coalesce(name, F.lit("Unnamed Entry")),
        "system": expr,
        "document_metadata": F.struct(
            meta("source_book", F.lit("Unknown")).alias("sourceBook"),
            meta("publisher", F.lit("Unknown")).alias("publisher"),
            meta("author", F.lit("")).alias("author"),
            meta("page_number", F.lit(0).cast("bigint")).alias("pageNumber"),
            F.lit(run_time).alias("importDate"),
            meta("notes", F.lit("")).alias("notes"),
            meta("tags", no_tags).alias("tags"),
            F.col("content_type").alias("contentType"),
            F.lit("1.0.0").alias("schemaVersion"),
        ),
    })


def _seed(tree: Tree, value, path: str, targets: Sequence[str]) -> None:
    """Write the defaults below *path*; a subtree no target reaches into stays one literal."""
    entered = not path or any(t.startswith((path + ".", path + "[")) for t in targets)
    if isinstance(value, Mapping) and value and entered:
        for k, v in value.items():
            _seed(tree, v, f"{path}.{k}" if path else k, targets)
    elif isinstance(value, list) and value and entered:
        for i, v in enumerate(value):
            _seed(tree, v, f"{path}[{i}]", targets)
    elif path:
        tree.write(path, literal_variant(value), "none", sure=True)
        # A seeded default is not a write that outranks a value for the whole subtree.
        node = tree.root
        for part in path_parts(path):
            node = node.children[part]
        node.written = None
