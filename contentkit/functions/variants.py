"""Access to VARIANT payloads.

Keys are resolved as written and then in lower case, so that payloads read from CSV (whose
headers are lower-cased) still answer to camelCase rule keys.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentkit.functions.scalars import to_number

MAP_TYPE = "map<string,variant>"


def json_path(key: str) -> str:
    """JSON path of one top-level key, quoted so that dots and spaces in keys are safe."""
    escaped = key.replace("\\", "\\\\").replace('"', '\\"')
    return f'$["{escaped}"]'


def dotted_path(path: str) -> str:
    """JSON path of a dotted target such as ``damage[0].formula``."""
    return "$." + path


def _spellings(key: str) -> list[str]:
    low = key.lower()
    return [key] if low == key else [key, low]


def get_as(payload: Column, key: str, type_name: str) -> Column:
    hits = [F.try_variant_get(payload, json_path(k), type_name) for k in _spellings(key)]
    return hits[0] if len(hits) == 1 else F.coalesce(*hits)


def get_text(payload: Column, key: str) -> Column:
    """Value as text; absent keys and JSON null are null."""
    return get_as(payload, key, "string")


def get_value(payload: Column, key: str) -> Column:
    """Value as VARIANT; absent keys and JSON null are null."""
    hits = [F.try_variant_get(payload, json_path(k), "variant") for k in _spellings(key)]
    hits = [F.when(~F.is_variant_null(h), h) for h in hits]
    return hits[0] if len(hits) == 1 else F.coalesce(*hits)


def get_number(payload: Column, key: str) -> Column:
    """Value as number; absent, JSON null and non-numeric text are null, blank text is 0."""
    return to_number(get_text(payload, key))


def get_text_list(payload: Column, key: str) -> Column:
    return get_as(payload, key, "array<string>")


def type_of(v: Column) -> Column:
    """One of string, number, boolean, object, array, null for a VARIANT value."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), "null")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .otherwise("unknown")
    )


def as_map(v: Column) -> Column:
    """Top-level entries of an object; anything else gives an empty map."""
    return F.coalesce(F.try_variant_get(v, "$", MAP_TYPE), empty_map())


def empty_map() -> Column:
    return F.create_map().cast(MAP_TYPE)


def overlay(base: Column, top: Column) -> Column:
    """Shallow overlay of two objects; a key present in *top* wins, even with JSON null."""
    return F.to_variant_object(
        F.map_zip_with(as_map(base), as_map(top), lambda k, x, y: F.coalesce(y, x))
    )


def to_payload(struct: Column) -> Column:
    """Struct to VARIANT object."""
    return F.to_variant_object(struct)


def scalar_to_variant(text: Column) -> Column:
    """Type a text cell: blank is null, true/false is boolean, a number is a number, else text."""
    low = F.lower(text)
    return (
        F.when(text.isNull() | (text == ""), F.parse_json(F.lit("null")))
        .when(low == "true", F.lit(True).cast("variant"))
        .when(low == "false", F.lit(False).cast("variant"))
        .when(F.trim(text).rlike(r"^[+-]?\d{1,18}$"), F.trim(text).try_cast("bigint").cast("variant"))
        .when(to_number(text).isNotNull() & (F.trim(text) != ""), to_number(text).cast("variant"))
        .otherwise(text.cast("variant"))
    )


def literal(value) -> Column:
    """Python literal (scalar, list or dict) as a typed Spark column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return F.lit(value)
    if isinstance(value, (int, float)):
        return F.lit(float(value))
    if isinstance(value, list):
        if not value:
            return F.array().cast("array<string>")
        return F.array(*[literal(v) for v in value])
    if isinstance(value, dict):
        if not value:
            return empty_map()
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    raise TypeError(f"unsupported literal {value!r}")


def literal_variant(value) -> Column:
    """Python literal as VARIANT."""
    return F.parse_json(F.lit(json.dumps(value)))
