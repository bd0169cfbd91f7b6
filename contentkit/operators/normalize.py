"""V0: rewriting many columns from a spec, with a count of what happened to each."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.functions.rules import TRANSFORMS
from contentkit.functions.scalars import strip


def normalize_values(
    df: DataFrame, spec: Mapping[str, str], transforms: Mapping[str, Callable[[Column], Column]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Apply a named rule per column; returns the new rows and one row of counts per column.

    A value counts as ``blank`` when there was no text, ``fallback`` when the rule answered with what
    it gives for blank text, and ``parsed`` otherwise.  The counts are one aggregation pass.
    """
    rules = transforms or TRANSFORMS
    out = df.withColumns({c: rules[rule](F.col(c)) for c, rule in spec.items()})
    stats = []
    for c, rule in spec.items():
        text = F.col(c)
        value, fallback = rules[rule](text), rules[rule](F.lit("\u0000"))
        blank = text.isNull() | (strip(text) == "")
        same = value.eqNullSafe(fallback)
        stats += [
            F.count_if(blank).alias(f"{c}|blank"),
            F.count_if(~blank & same).alias(f"{c}|fallback"),
            F.count_if(~blank & ~same).alias(f"{c}|parsed"),
        ]
    wide = df.agg(*stats)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"),
                 *[F.col(f"`{c}|{k}`").alias(k) for k in ("blank", "fallback", "parsed")])
        for c, rule in spec.items()
    ])
    return out, wide.select(F.explode(rows).alias("r")).select("r.*")
