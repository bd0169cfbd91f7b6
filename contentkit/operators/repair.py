"""Repairing payloads against a schema.

A field is normalised or filled only by the schema field whose path is the key itself.  Leaf
defaults below a key are seeded by conforming; putting them on the key would replace an object by
one of its leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.functions.scalars import split_list, strip, to_number
from contentkit.functions.variants import as_map, empty_map, type_of
from contentkit.operators.catalog import first_templates
from contentkit.operators.plan import compute_once
from contentkit.operators.schema import KEY, schema_compat
from contentkit.operators.skew import dim_join

ACTION_TYPE = "array<struct<field:string,action:string,old_value:string,new_value:string,reason:string>>"


def normalize_value(value: Column, kind: Column) -> Column:
    """A VARIANT value coerced to a declared type; what cannot be coerced is kept."""
    have = type_of(value)
    text = value.try_cast("string")
    low = F.lower(strip(text))
    number = to_number(text)
    as_number = F.when(number == F.floor(number), number.try_cast("bigint").cast("variant")).otherwise(number.cast("variant"))
    as_flag = F.when(low.isin("true", "1", "yes"), F.lit(True)).when(low.isin("false", "0", "no"), F.lit(False)).cast("variant")
    listed = F.when(
        (have == "string") & text.contains(","), F.to_variant_object(split_list(text, ","))
    ).otherwise(F.to_variant_object(F.array(value)))
    return (
        F.when(have == "null", value)
        .when((kind == "number") & (have == "boolean"), F.when(text == "true", 1).otherwise(0).cast("bigint").cast("variant"))
        .when((kind == "number") & (have == "string") & number.isNotNull(), as_number)
        .when((kind == "boolean") & (have == "string") & as_flag.isNotNull(), as_flag)
        .when((kind == "string") & (have != "string"), text.cast("variant"))
        .when((kind == "array") & (have != "array"), listed)
        .otherwise(value)
    )


def repair_records(
    records: DataFrame, fields: DataFrame, templates: DataFrame | None = None, payload: str = "raw_content"
) -> DataFrame:
    """Adds ``repaired`` (VARIANT), ``actions``, ``remaining_issues`` and ``was_modified``.

    *records* carry document_type and subtype (null when the category has no schema mapping).
    Per field, in schema order: a present value is normalised; an absent one is taken from the
    first template of the subtype, else from the schema default, else reported.
    """
    spark = records.sparkSession
    whole = fields.filter(~F.col("path").rlike(r"[.\[]"))
    ranked = whole.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("ord", "path", "type", "required", "default_json"))).alias("_f")
    ).select(*KEY, F.transform("_f", lambda f: F.struct(
        f["path"].alias("path"), f["type"].alias("type"), f["required"].alias("required"),
        F.try_parse_json(f["default_json"]).alias("default"))).alias("_fields"))
    if templates is None:
        template = spark.createDataFrame([], "subtype string, _snapshot string")
    else:
        template = first_templates(templates).select("subtype", F.to_json("snapshot").alias("_snapshot"))
    dim = ranked.join(template, "subtype", "left").select(
        *KEY, F.to_json(F.struct("_fields")).alias("_packed"), F.col("_snapshot").alias("_template_json"))
    rows = dim_join(records, dim, KEY)
    unpacked = F.from_json(
        "_packed", "struct<_fields:array<struct<path:string,type:string,required:boolean,default:variant>>>")["_fields"]
    rows = compute_once(
        rows, _schema=unpacked, _have=as_map(F.col(payload)),
        _template=F.coalesce(F.when(F.col("_template_json").isNotNull(), as_map(F.try_parse_json("_template_json"))), empty_map()))

    def outcome(f: Column) -> Column:
        key = f["path"]
        present = F.map_contains_key(F.col("_have"), key)
        old = F.try_element_at(F.col("_have"), key)
        normal = normalize_value(old, f["type"])
        from_template = F.try_element_at(F.col("_template"), key)
        fallback = f["default"]
        usable = fallback.isNotNull() & (type_of(fallback) != "null")
        changed = present & (F.to_json(old) != F.to_json(normal))
        missing = F.concat(
            F.when(f["required"], "Required").otherwise("Optional"), F.lit(' field "'), key,
            F.lit('" is absent and has no default — manual fix required.'))
        action = (
            F.when(present, F.when(changed, "normalized"))
            .when(from_template.isNotNull(), "filled_template")
            .when(usable, "filled_default")
            .otherwise("skipped")
        )
        value = F.when(present, normal).when(from_template.isNotNull(), from_template).when(usable, fallback)
        reason = (
            F.when(action == "normalized", F.concat(
                F.lit('Schema declares type "'), f["type"], F.lit('", found '), type_of(old), F.lit(". Coerced value.")))
            .when(action == "filled_template", F.concat(
                F.lit('Filled from registered "'), F.col("subtype"), F.lit('" template.')))
            .when(action == "filled_default", F.lit("Applied schema-declared default value."))
            .otherwise(missing)
        )
        return F.struct(key.alias("field"), action.alias("action"), old.alias("old"), value.alias("value"),
                        reason.alias("reason"), f["required"].alias("required"))

    rows = compute_once(rows, _out=F.transform("_schema", outcome))
    written = F.filter("_out", lambda o: o["action"].isin("normalized", "filled_template", "filled_default"))
    patch = F.map_from_entries(F.transform(written, lambda o: F.struct(o["field"], o["value"])))
    repaired = F.to_variant_object(F.map_zip_with(F.col("_have"), patch, lambda k, a, b: F.coalesce(b, a)))
    actions = F.transform(
        F.filter("_out", lambda o: o["action"].isNotNull()),
        lambda o: F.struct(
            o["field"].alias("field"), o["action"].alias("action"),
            F.when(o["action"] == "normalized", F.to_json(o["old"])).alias("old_value"),
            F.when(o["action"] != "skipped", F.to_json(o["value"])).alias("new_value"), o["reason"].alias("reason")))
    open_issues = F.transform(
        F.filter("_out", lambda o: (o["action"] == "skipped") & o["required"]), lambda o: o["reason"])
    no_schema = F.when(
        F.col("document_type").isNull() | F.col("subtype").isNull(),
        F.concat(F.lit('No schema mapping registered for category: "'), F.coalesce("category", F.lit("")), F.lit('". Cannot repair.')),
    ).otherwise(F.concat(F.lit("No discovered schema for "), F.col("document_type"), F.lit("."), F.col("subtype"), F.lit(".")))
    known = F.col("_schema").isNotNull()
    return rows.withColumns({
        "repaired": F.when(known, repaired).otherwise(F.col(payload)),
        "actions": F.when(known, actions.cast(ACTION_TYPE)).otherwise(F.array().cast(ACTION_TYPE)),
        "remaining_issues": F.when(known, open_issues).otherwise(F.array(no_schema)),
        "was_modified": F.when(known, F.size(written) > 0).otherwise(False),
    }).select(*records.columns, "repaired", "actions", "remaining_issues", "was_modified")


def before_after(records: DataFrame, fields: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Compatibility before the repair, next to the repair result."""
    compat = schema_compat(records, fields)
    return repair_records(compat, fields, templates)
