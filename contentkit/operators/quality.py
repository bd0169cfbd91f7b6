"""Validation of drafts, entries and documents."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.functions.scalars import bind, compact, float_prefix, strip
from contentkit.functions.variants import as_map, dotted_path, type_of
from contentkit.operators.plan import compute_once
from contentkit.operators.skew import hot_lookup
from contentkit.records import CATEGORY_NAMES, ISSUE_TYPE, error, is_category, issues_of, warning


@dataclass(frozen=True)
class FieldRule:
    """One content rule: the field's type and its optional limits."""

    category: str
    field: str
    type: str = "string"
    required: bool = False
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    enum: tuple[str, ...] = ()
    also: tuple[str, ...] = ()


RULE_TYPE = (
    "array<struct<field:string,sources:array<string>,type:string,required:boolean,min:double,max:double,"
    "min_length:int,enum:array<string>>>"
)


def _rule_table(rules: Iterable[FieldRule]) -> Column:
    """The rules as one literal map from category to its rule array."""
    by_category: dict[str, list[dict]] = {}
    for r in rules:
        by_category.setdefault(r.category, []).append({
            "field": r.field, "sources": list(dict.fromkeys(k for n in (r.field, *r.also) for k in (n, n.lower()))), "type": r.type, "required": r.required, "min": r.min,
            "max": r.max, "min_length": r.min_length, "enum": list(r.enum) or None})
    return F.from_json(F.lit(json.dumps(by_category)), f"map<string,{RULE_TYPE}>")


def _plain_number(c: Column) -> Column:
    """A limit without a trailing ".0"."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _checked(rule: Column, values: Column) -> Column:
    """The rule with the value it looks at: its type, its text, whether it is missing, its number."""
    first = F.get(F.filter(
        F.transform(rule["sources"], lambda k: F.try_element_at(values, k)), lambda v: v.isNotNull()), F.lit(0))

    def facts(v: Column) -> Column:
        kind = F.coalesce(v["kind"], F.lit("null"))
        return F.struct(
            rule.alias("rule"), kind.alias("kind"), v["text"].alias("text"),
            ((kind == "null") | ((kind == "string") & (v["text"] == ""))).alias("missing"),
            F.when((rule["type"] == "number") & kind.isin("number", "string"), float_prefix(v["text"])).alias("number"))

    return bind(first, facts)


def _rule_issues(seen: Column) -> Column:
    """Q1: every issue one rule raises (null where it holds).

    A missing or mistyped value stops the rule, so later checks only see values of the right type.
    """
    rule, kind, text, missing, number = (seen[c] for c in ("rule", "kind", "text", "missing", "number"))
    named = F.concat(F.lit("Field '"), rule["field"], F.lit("'"))
    wanted = rule["type"]
    number = F.when(~missing, number)
    is_text = ~missing & (wanted == "string") & (kind == "string")
    mismatch = ~missing & (
        F.when(wanted == "number", number.isNull())
        .when(wanted.isin("string", "array", "object"), kind != wanted)
        .otherwise(False)
    )
    expected = F.when(wanted == "string", F.concat(F.lit(" must be a string, got "), kind, F.lit("."))).when(
        wanted == "number", F.concat(F.lit(" must be a number, got '"), text, F.lit("'."))).otherwise(
        F.concat(F.lit(" must be an "), wanted, F.lit(".")))

    def raised(level: str, code: str, message: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), F.lit(code).alias("code"), rule["field"].alias("field"), message.alias("message"))

    return F.array(
        F.when(rule["required"] & missing, raised("error", "REQUIRED_FIELD_MISSING", F.concat(
            F.lit("Required field '"), rule["field"], F.lit("' is missing or empty.")))),
        F.when(mismatch, raised("error", "TYPE_MISMATCH", F.concat(named, expected))),
        F.when(is_text & (F.length(text) < rule["min_length"]), raised("error", "STRING_TOO_SHORT", F.concat(
            named, F.lit(" must be at least "), rule["min_length"].cast("string"), F.lit(" character(s).")))),
        F.when(is_text & ~F.array_contains(rule["enum"], text), raised("error", "INVALID_ENUM_VALUE", F.concat(
            named, F.lit(" has invalid value '"), text, F.lit("'. Allowed values: "), F.array_join(rule["enum"], ", "), F.lit(".")))),
        F.when(number < rule["min"], raised("error", "VALUE_TOO_LOW", F.concat(
            named, F.lit(" value "), text, F.lit(" is below minimum "), _plain_number(rule["min"]), F.lit(".")))),
        F.when(number > rule["max"], raised("error", "VALUE_TOO_HIGH", F.concat(
            named, F.lit(" value "), text, F.lit(" exceeds maximum "), _plain_number(rule["max"]), F.lit(".")))),
        F.when(~missing & (wanted == "boolean") & (kind != "boolean"), raised(
            "warning", "TYPE_COERCION", F.concat(named, F.lit(" is not a boolean; will be coerced.")))),
    )


def validate_content(
    entries: DataFrame, rules: Iterable[FieldRule], payload: str = "data", category: str = "content_type"
) -> DataFrame:
    """Q1: adds ``issues`` and ``valid``.

    The rules stay data: one expression runs over the rule array of the row's category, so the plan
    does not grow with the number of rules.  An unknown category is valid, with the warning ``NO_SCHEMA``.
    """
    table = _rule_table(rules)
    values = F.transform_values(as_map(F.col(payload)), lambda k, v: F.struct(
        type_of(v).alias("kind"), v.try_cast("string").alias("text")))
    rules_here = F.try_element_at(table, F.col(category))
    seen = bind(values, lambda m: F.transform(rules_here, lambda r: _checked(r, m)))
    found = F.array_compact(F.flatten(F.transform(seen, _rule_issues)))
    unknown = F.array(warning(
        "NO_SCHEMA", None,
        F.concat(F.lit("No validation schema defined for content type '"), F.coalesce(category, F.lit("")),
                 F.lit("'. Skipping field validation."))))
    issues = F.coalesce(found.cast(ISSUE_TYPE), unknown.cast(ISSUE_TYPE))
    return compute_once(entries, issues=issues).withColumn("valid", F.size(issues_of(F.col("issues"), "error")) == 0)


def validate_import(drafts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Q3 (J1): check drafts before saving; adds ``issues``, ``valid`` and ``display_name``.

    *drafts*: ord, name, category, source_book, publisher, page_number (double), raw_content.
    Duplicates are looked up against the catalog only, never inside the batch.
    """
    keyed = drafts.withColumn("_name", strip(F.coalesce("name", F.lit("")))).withColumn("_key", F.lower("_name"))
    stats = keyed.filter(F.col("_key") != "").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    have = catalog.select(F.lower("name").alias("_key")).distinct()
    rows = hot_lookup(keyed, stats.join(have, "_key").withColumn("_dup", F.lit(True)), "_key", "_n")
    name, category = F.col("_name"), F.col("category")
    allowed = ", ".join(CATEGORY_NAMES)
    no_category = category.isNull() | (category == "")

    def blank(c: str) -> Column:
        return strip(F.coalesce(c, F.lit(""))) == ""

    other_keys = F.filter(F.map_keys(as_map(F.col("raw_content"))), lambda k: ~k.isin("name", "category"))
    issues = compact(
        F.when(name == "", error("MISSING_NAME", "name", "Record has no name. A name is required.")),
        F.when(no_category, error("MISSING_CATEGORY", "category", f"Record has no category. Specify one of: {allowed}")),
        F.when(~no_category & ~is_category(category), error(
            "INVALID_CATEGORY", "category",
            F.concat(F.lit("'"), category, F.lit(f"' is not a valid category. Allowed: {allowed}")))),
        F.when((name != "") & F.coalesce("_dup", F.lit(False)), error(
            "DUPLICATE_NAME", "name",
            F.concat(F.lit("'"), name,
                     F.lit("' already exists in the database. Enable \"Overwrite Duplicates\" to replace it.")))),
        F.when(blank("source_book"), warning(
            "MISSING_SOURCE_BOOK", "sourceBook", "Source book is not specified. Add source information for traceability.")),
        F.when(blank("publisher"), warning("MISSING_PUBLISHER", "publisher", "Publisher is not specified.")),
        F.when(F.coalesce(F.col("page_number").cast("double"), F.lit(0.0)) == 0, warning(
            "MISSING_PAGE_NUMBER", "pageNumber", "Page number is 0 or absent. Add a page number for source traceability.")),
        F.when(F.size(other_keys) == 0, warning(
            "EMPTY_RAW_CONTENT", None, "Record contains no content fields beyond name and category. "
            "The record will save but its conversion may be incomplete.")),
    ).cast(ISSUE_TYPE)
    out = compute_once(rows, issues=issues).withColumn("display_name", F.when(name == "", "(no name)").otherwise(name))
    return out.withColumn("valid", F.size(issues_of(F.col("issues"), "error")) == 0).select(
        *drafts.columns, "display_name", "valid", "issues"
    )


def overwrite_policy(validated: DataFrame) -> DataFrame:
    """Q4: with overwriting allowed, a duplicate name is a warning instead of an error."""
    changed = F.transform("issues", lambda i: F.when(
        i["code"] == "DUPLICATE_NAME",
        F.struct(
            F.lit("warning").alias("level"), F.lit("WILL_OVERWRITE").alias("code"), F.lit("name").alias("field"),
            F.replace(i["message"], F.lit('Enable "Overwrite Duplicates" to replace it.'),
                      F.lit("This record will OVERWRITE the existing entry.")).alias("message"),
        )).otherwise(i))
    out = validated.withColumn("issues", changed.cast(ISSUE_TYPE))
    return out.withColumn("valid", F.size(issues_of(F.col("issues"), "error")) == 0)


def valid_records(validated: DataFrame) -> DataFrame:
    """Q5: the rows that passed, without the report columns."""
    return validated.filter("valid").drop("issues", "valid", "display_name")


def required_paths(documents: DataFrame, rules: dict[str, list[str]], payload: str = "document") -> DataFrame:
    """Q6: adds ``missing_paths``, the required target paths a document lacks."""
    expr = None
    for category, paths in rules.items():
        lacking = compact(*[
            F.when(F.try_variant_get(F.col(payload), dotted_path(p), "string").isNull(), F.lit(p))
            for p in paths
        ])
        cond = F.col("category") == category
        expr = F.when(cond, lacking) if expr is None else expr.when(cond, lacking)
    return documents.withColumn("missing_paths", F.coalesce(expr, F.array().cast("array<string>")))


def validation_rollup(validated: DataFrame) -> DataFrame:
    """Checked / valid / invalid / with warnings, and the distinct codes, in one pass."""
    errors = issues_of(F.col("issues"), "error")
    warnings = issues_of(F.col("issues"), "warning")

    def codes(issues: Column) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform(issues, lambda i: i["code"])))))

    return validated.agg(
        F.count(F.lit(1)).alias("total_checked"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(F.size(warnings) > 0).alias("with_warnings"),
        codes(errors).alias("error_codes"),
        codes(warnings).alias("warning_codes"),
    )


def content_rollup(validated: DataFrame) -> DataFrame:
    """Checked / passed / failed and the pass rate in whole percent."""
    counts = validated.agg(
        F.count(F.lit(1)).alias("total_checked"), F.count_if("valid").alias("passed"), F.count_if(~F.col("valid")).alias("failed")
    )
    rate = F.when(F.col("total_checked") > 0, F.floor(F.col("passed") * 100 / F.col("total_checked") + 0.5)).otherwise(0)
    return counts.withColumn("pass_rate", rate.cast("bigint"))
