"""Control over how often an expression is evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row, whatever later steps do with them.

    A plain projection gives no such promise: a later filter on the column is pushed below the
    projection with the whole expression in it, and a lambda that refers to the column may get the
    expression inlined.  A one-element generator is a step the optimizer does not move expressions
    across.  Use it for costly columns (regex captures, rule checks, folds) only.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode_outer(packed).alias("_once")).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])


def explode_rows(df: DataFrame, items: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array element, without evaluating the array a second time.

    A plain explode makes the optimizer add a "not empty" filter that repeats the array expression;
    the outer form does not, so empty rows are dropped on the generated column instead.
    """
    if position:
        return df.select("*", F.posexplode_outer(items).alias(position, name)).filter(F.col(position).isNotNull())
    return df.select("*", F.explode_outer(F.transform(items, lambda x: F.struct(x.alias("v")))).alias("_item")).filter(
        F.col("_item").isNotNull()).withColumn(name, F.col("_item.v")).drop("_item")
