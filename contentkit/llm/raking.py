"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells, one per combination of the margin columns.  What is kept of the cells' tokens is raked: one margin
after the other is scaled to its targets, until all margins agree.  No cell can keep more than it has: a cell that is full stays so
while the others of its value take up the rest, and is scaled down with them when the value is above its target.  A document is
kept with the probability of its cell, decided by a hash of the document, so that the kept tokens follow the targets in expectation.

The topic, one of the margins, is a cluster of text statistics, fitted on all documents and given by a Spark expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.llm.storage import stage

#: Stands for a null in a margin column.
UNKNOWN = "(unknown)"


@dataclass(frozen=True)
class Mixture:
    """Targets per margin column.

    *targets* gives shares per value (they are scaled to sum to 1 over the values that occur; values without a share get 0).
    A margin without targets gets its own token shares raised to *temperature*.  *budget* is the share of all tokens
    to keep, less where the values with a share have not that many.  A value that has too few tokens for its target is kept whole, and the
    other values of the margin make up for it in proportion.
    """

    margins: tuple[str, ...] = ("source", "lang", "topic")
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    temperature: float = 0.7
    budget: float = 0.6
    sweeps: int = 60
    tolerance: float = 1e-4
    seed: int = 11


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner != "", F.size(F.split(inner, r"[\x20\x09-\x0D]+", -1))).otherwise(0).cast("long")


# Characters that are counted for the topic.
DIGITS, CAPITALS, MARKS = "[0-9]+", "[A-Z]+", r"[.,;:!?#*$%&|<>=()\[\]{}/+\-_@\"']+"
#: How many clusters there are, and the rounds of their fit.
TOPICS, ROUNDS = 6, 30
#: Statistics in whole steps, so that sums do not depend on their order.
STEPS = 1_000_000


def statistics(text: Column) -> list[Column]:
    """Roots of the shares of digits, capitals, marks, line ends and spaces, and the length of the text, all about 0 to 1."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(rest: Column) -> Column:
        return (F.length(text) - F.length(rest)) / n

    gaps = share(F.replace(text, F.lit(" "), F.lit("")))
    return [*[F.sqrt(share(F.regexp_replace(text, letters, ""))) for letters in (DIGITS, CAPITALS, MARKS)],
            F.sqrt(share(F.replace(text, F.lit("\n"), F.lit("")))), F.sqrt(gaps), F.log(n) / 12]


def _measured(text: Column) -> Column:
    """The statistics in steps, computed once; null for texts that are null or blank."""
    found = F.element_at(F.transform(F.array(F.array(*statistics(text))), lambda x: F.transform(x, lambda v: F.round(v * STEPS).cast("long"))), 1)
    return F.when(F.coalesce(F.trim(text) != "", F.lit(False)), found)


def _against(points: DataFrame, centres: np.ndarray) -> tuple[DataFrame, Column]:
    """*points* with the centres as columns, and the struct (away, k) of the nearest one.

    The centres come as a table of one row, so the plan, and with it the compiled code, stays the same from round to round.
    """
    names = [f"c{k}_{n}" for k in range(len(centres)) for n in range(6)]
    row = points.sparkSession.sql(f"SELECT * FROM VALUES ({', '.join(f'{float(c)!r}D' for c in centres.ravel())}) AS t({', '.join(names)})")
    away = [sum((F.col(f"s{n}") - F.col(f"c{k}_{n}")) * (F.col(f"s{n}") - F.col(f"c{k}_{n}")) for n in range(6)) for k in range(len(centres))]
    return points.crossJoin(F.broadcast(row)), F.least(*[F.struct(d.alias("away"), F.lit(k).alias("k")) for k, d in enumerate([*away, away[0]])])


def fit_topics(docs: DataFrame, text_col: str = "text", topics: int = TOPICS, measured: Column | None = None) -> np.ndarray:
    """Centres of at most *topics* clusters (rows, by size) of the statistics of all documents; equal statistics count once.

    Every round is one aggregate over all of them.  Texts that are null or blank are left out; without others there are no centres.
    *measured* names statistics that *docs* already has (see ``measure``).
    """
    names = [f"s{k}" for k in range(6)]
    found = docs.select((_measured(F.col(f"`{text_col}`")) if measured is None else measured).alias("s")).filter("s IS NOT NULL")
    points = stage(found.select(*[F.col("s")[k].alias(n) for k, n in enumerate(names)]).distinct(), "points")
    total = points.agg(F.count(F.lit(1)), *[F.sum(n) for n in names]).first()
    if not total[0]:
        return np.zeros((0, 6))
    mean = np.array([[s / total[0] for s in total[1:]]])

    def extreme(centres: np.ndarray, pick) -> tuple[float, np.ndarray]:
        placed, near = _against(points, centres)
        best = placed.select(near["away"].alias("away"), F.struct(*names).alias("at")).agg(pick(F.struct("away", "at")).alias("x")).first().x
        return best.away, np.array(best["at"], float)

    # The first centre is the mean's nearest point, each other one the farthest from those there are; then Lloyd's rounds.
    centres = extreme(mean, F.min)[1][None]
    while len(centres) < topics:
        away, at = extreme(centres, F.max)
        if not away:
            break
        centres = np.vstack([centres, at])
    sizes = np.zeros(len(centres), np.int64)
    for turn in range(ROUNDS + 1):
        placed, near = _against(points, centres)
        sums = placed.select(near["k"].alias("k"), *names).groupBy("k").agg(F.count(F.lit(1)), *[F.sum(n) for n in names]).collect()
        sizes[:] = 0
        last, centres = centres, centres.copy()
        for k, n, *total in sums:
            sizes[k] = n
            centres[k] = [t / n for t in total]
        # The last turn only counts.
        if turn == ROUNDS or np.array_equal(last, centres):
            centres = last
            break
    return centres[np.argsort(-sizes, kind="stable")] / STEPS


def measure(docs: DataFrame, tokens: Column, mix: Mixture, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """*docs* (its columns *keep*, all if None) written with what a mixture needs of the texts, so that they are read once.

    Adds _n_tokens, _chance (see ``sample_mixture``) and _statistics.
    """
    own = [F.col(f"`{c}`") for c in (keep if keep is not None else docs.columns)]
    return stage(docs.select(*own, tokens.alias("_n_tokens"), _chance(mix, id_col, text_col).alias("_chance"), _measured(F.col(f"`{text_col}`")).alias("_statistics")), "measured")


def _chance(mix: Mixture, id_col: str, text_col: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(mix.seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(1 << 40)) / F.lit(float(1 << 40))


def topic(text: Column, centres: np.ndarray, measured: Column | None = None) -> Column:
    """topic-0 (the largest cluster of the fit), topic-1, ... by the nearest centre; null for texts that are null or blank.

    *measured* names statistics that are already there (see ``measure``), instead of those of *text*.
    """
    if not len(centres):
        return F.lit(None).cast("string")

    def nearest(stats: Column) -> Column:
        away = [sum((stats[k] - float(c)) * (stats[k] - float(c)) for k, c in enumerate(centre)) for centre in centres * STEPS]
        return F.array_min(F.array(*[F.struct(d.alias("away"), F.lit(k).alias("k")) for k, d in enumerate(away)]))["k"]

    # One element: the statistics are computed once for all centres.
    stats = _measured(text) if measured is None else measured
    found = F.element_at(F.transform(F.array(stats), lambda s: F.when(s.isNotNull(), nearest(s))), 1)
    return F.concat(F.lit("topic-"), found.cast("string"))


def _filled(parts: DataFrame, goal: float) -> float:
    """The scale at which the *parts* (part, own), none above its own, add up to *goal*; scans over a grid of 64 values."""
    rate = F.when((F.col("own") > 0) & (F.col("part") > 0), F.col("part") / F.col("own"))
    low, high, whole = parts.agg(F.min(rate), F.max(rate), F.sum("part")).first()
    if not high or goal <= 0:
        return 0.0
    lo, hi = goal / whole / 1.001, max(1.001 / low, 1.001 * goal / whole)
    for _ in range(6):
        grid = [lo * (hi / lo) ** (k / 63) for k in range(64)]
        kept = parts.agg(*[F.sum(F.least(F.col("own"), F.col("part") * g)).alias(f"g{k}") for k, g in enumerate(grid)]).first()
        above = next((k for k in range(64) if kept[k] >= goal), 63)
        lo, hi = grid[max(0, above - 1)], grid[above]
    return hi


def _filled_here(part: np.ndarray, own: np.ndarray, goal: float) -> float:
    """The same scale for arrays, exactly: parts become full in the order of own / part."""
    use = (part > 0) & (own > 0)
    if not use.any() or goal <= 0:
        return 0.0
    order = np.argsort(own[use] / part[use], kind="stable")
    p, o = part[use][order], own[use][order]
    full = np.concatenate([[0.0], np.cumsum(o)[:-1]])
    left = np.cumsum(p[::-1])[::-1]
    scale = (goal - full) / left
    fits = np.flatnonzero(scale * p <= o)
    return float(scale[fits[0]]) if len(fits) else float((o / p)[-1])


@dataclass(frozen=True)
class _Cells:
    """The cells as arrays: per margin the values and each cell's one, and the tokens; at most CELLS of them."""

    values: dict[str, list[str]]
    codes: dict[str, np.ndarray]
    tokens: np.ndarray

    @classmethod
    def of(cls, rows: list, mix: Mixture) -> _Cells:
        values = {m: sorted({r[m] for r in rows}) for m in mix.margins}
        place = {m: {v: k for k, v in enumerate(v)} for m, v in values.items()}
        return cls(values, {m: np.array([place[m][r[m]] for r in rows], np.int64) for m in mix.margins}, np.array([r.tokens or 0 for r in rows], float))

    def goals(self, mix: Mixture) -> tuple[float, dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The budget, and per margin own, wished and goal of its values."""
        own = {m: np.bincount(self.codes[m], self.tokens, len(v)) for m, v in self.values.items()}
        part = {}
        for m, v in self.values.items():
            wanted = mix.targets.get(m)
            part[m] = own[m] ** mix.temperature if wanted is None else np.array([float(wanted.get(x, 0.0)) for x in v])
            part[m] = np.where(own[m] > 0, part[m], 0.0)
        budget = min([mix.budget * self.tokens.sum(), *[own[m][part[m] > 0].sum() for m in own]])
        out = {}
        for m in own:
            whole = part[m].sum()
            out[m] = (own[m], part[m] * (budget / whole if whole else 0.0), np.minimum(own[m], part[m] * _filled_here(part[m], own[m], budget)))
        return float(budget), out

    def rake(self, mix: Mixture) -> np.ndarray:
        """What is kept of every cell; the steps of ``rake``."""
        budget, wanted = self.goals(mix)
        kept = self.tokens * mix.budget
        if not budget:
            return np.zeros(len(kept))
        for _ in range(mix.sweeps):
            worst = 0.0
            for m, code in self.codes.items():
                full, goal = kept >= self.tokens * (1 - 1e-12), wanted[m][2]
                total, held = np.bincount(code, kept, len(goal)), np.bincount(code, np.where(full, kept, 0.0), len(goal))
                free = total - held
                down = np.divide(goal, total, out=np.zeros(len(goal)), where=total > 0)
                rest = np.divide(goal - held, free, out=np.ones(len(goal)), where=free > 0)
                scaled = np.where((total >= goal)[code], kept * down[code], np.where(full, kept, kept * rest[code]))
                kept = np.minimum(self.tokens, scaled)
                worst = max(worst, np.abs(goal - total).max(initial=0.0))
            if worst < mix.tolerance * budget:
                break
        return kept


#: Cells that are raked in the driver; more of them are raked as a table, by the same steps.
CELLS = 100_000


def _few(cells: DataFrame) -> list | None:
    """The cells where they are few."""
    return cells.collect() if cells.limit(CELLS + 1).count() <= CELLS else None


def goals(cells: DataFrame, mix: Mixture) -> tuple[float, dict[str, DataFrame]]:
    """Tokens to keep in all, and per margin a written table (value, own, wished, goal) of tokens.

    *wished* is the target's part; *goal* is what can be had of it, with the rest dealt to the other values.
    """
    rows = _few(cells)
    if rows is not None:
        here = _Cells.of(rows, mix)
        budget, found = here.goals(mix)
        return budget, {m: cells.sparkSession.createDataFrame(
            [(v, *map(float, x)) for v, *x in zip(here.values[m], *found[m])], "value string, own double, wished double, goal double") for m in mix.margins}
    parts = {}
    for margin in mix.margins:
        totals = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").cast("double").alias("own"))
        wanted = mix.targets.get(margin)
        part = F.pow(F.col("own"), F.lit(mix.temperature)) if wanted is None else F.coalesce(F.try_element_at(
            F.create_map(*[F.lit(x) for v, share in wanted.items() for x in (v, float(share))]), F.col("value")), F.lit(0.0)) if wanted else F.lit(0.0)
        parts[margin] = stage(totals.withColumn("part", F.when(F.col("own") > 0, part).otherwise(0.0)), "parts")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    had = [p.agg(F.sum(F.when(F.col("part") > 0, F.col("own")))).first()[0] or 0.0 for p in parts.values()]
    budget = min([mix.budget * float(total), *had])
    out = {}
    for margin, rows in parts.items():
        whole = rows.agg(F.sum("part")).first()[0] or 0.0
        scale = _filled(rows, budget)
        out[margin] = stage(rows.select("value", "own", (F.col("part") * (budget / whole if whole else 0.0)).alias("wished"),
                                        F.least(F.col("own"), F.col("part") * scale).alias("goal")), "goals")
    return budget, out


def rake(cells: DataFrame, mix: Mixture) -> DataFrame:
    """Add kept (tokens to keep, never more than a cell has) to *cells* (margins, tokens), so that every margin meets its goals.

    Goals that single margins allow but not all of them together are met as closely as the sweeps allow; ``margins`` lists what
    came out.  Up to CELLS cells are raked as arrays.  Of more, each step is one aggregate and one join, written, so neither plans nor
    lineage grow with the sweeps.
    """
    rows = _few(cells)
    if rows is not None:
        kept = _Cells.of(rows, mix).rake(mix)
        schema = cells.select(*mix.margins, "tokens").schema.add("kept", "double")
        return cells.sparkSession.createDataFrame([(*[r[m] for m in mix.margins], r.tokens, float(k)) for r, k in zip(rows, kept)], schema)
    budget, wanted = goals(cells, mix)
    now = cells.withColumn("kept", F.col("tokens") * F.lit(mix.budget))
    if not budget:
        return now.withColumn("kept", F.lit(0.0))
    for _ in range(mix.sweeps):
        worst = 0.0
        for margin in mix.margins:
            full = F.col("kept") >= F.col("tokens") * (1 - 1e-12)
            sums = now.groupBy(F.col(margin).alias("value")).agg(
                F.sum("kept").alias("sum"), F.sum(F.when(full, F.col("kept")).otherwise(0.0)).alias("full")).join(wanted[margin].select("value", "goal"), "value")
            free = F.col("sum") - F.col("full")
            sums = stage(sums.select(
                F.col("value").alias(margin), F.abs(F.col("goal") - F.col("sum")).alias("gap"),
                F.when(F.col("sum") >= F.col("goal"), F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0)).alias("all"),
                F.when(free > 0, (F.col("goal") - F.col("full")) / free).otherwise(1.0).alias("rest")), "factors")
            scaled = F.when(F.col("all").isNotNull(), F.col("kept") * F.col("all")).when(full, F.col("kept")).otherwise(F.col("kept") * F.col("rest"))
            now = stage(now.join(sums, margin).select(*mix.margins, "tokens", F.least(F.col("tokens").cast("double"), scaled).alias("kept")), "raked")
            worst = max(worst, sums.agg(F.max("gap")).first()[0] or 0.0)
        if worst < mix.tolerance * budget:
            break
    return now.select(*mix.margins, "tokens", "kept")


def probabilities(raked: DataFrame) -> DataFrame:
    """Add probability to raked cells: the part of their tokens that is kept."""
    return raked.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("kept") / F.col("tokens"))).otherwise(0.0))


def margins(raked: DataFrame, mix: Mixture) -> DataFrame:
    """(margin, value, wished, reachable, kept): shares of all kept tokens, as wished, as single margins allow, and as expected."""
    _, wanted = goals(raked.select(*mix.margins, "tokens"), mix)
    total = raked.agg(F.sum("kept")).first()[0] or 1.0
    out = None
    for margin, rows in wanted.items():
        got = raked.groupBy(F.col(margin).alias("value")).agg(F.sum("kept").alias("kept"))
        part = rows.join(got, "value").select(F.lit(margin).alias("margin"), "value", *[(F.col(a) / total).alias(b) for a, b in (
            ("wished", "wished"), ("goal", "reachable"), ("kept", "kept"))])
        out = part if out is None else out.unionByName(part)
    return out


def fit_cells(docs: DataFrame, mix: Mixture, tokens: Column) -> DataFrame:
    """Raked cells of *docs*: the margins (nulls as one value of their own), tokens, kept; sizes are summed before any shuffle."""
    named = [F.coalesce(F.col(f"`{m}`").cast("string"), F.lit(UNKNOWN)).alias(m) for m in mix.margins]
    return rake(stage(docs.select(*named, tokens.alias("_n_tokens")).groupBy(*mix.margins).agg(F.sum("_n_tokens").alias("tokens")), "cells"), mix)


def sample_mixture(docs: DataFrame, mix: Mixture, tokens: Column, id_col: str = "doc_id", text_col: str = "text", chance: Column | None = None) -> DataFrame:
    """The sampled rows of *docs* with their cell's probability as keep_probability (an own column of that name is replaced).

    *docs* has the margin columns (nulls count as one value).  A row is kept if the hash of its id and text falls below the
    probability: rows that repeat exactly are kept or dropped together.  Rows without tokens fall into a cell as well; a cell
    without any is not kept.  An empty table gives none.  A source with most of the rows costs no more than another.  *chance* names
    the hash where it is already there (see ``measure``).
    """
    rates = stage(probabilities(fit_cells(docs, mix, tokens)), "rates").select(*[F.col(m).alias(f"m{k}") for k, m in enumerate(mix.margins)], "probability")
    chance = _chance(mix, id_col, text_col) if chance is None else chance
    own = [c for c in docs.columns if c != "keep_probability"]
    # The row travels as one value, so its names cannot clash; an element of an array, so that costly columns (the topic) are
    # computed once.  Spark broadcasts the cells by their written size or joins by shuffle.
    packed = docs.select(F.explode(F.array(F.struct(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), chance.alias("chance")))).alias("x")).select(
        "x.row", "x.chance", *[F.coalesce(F.col(f"x.row.`{m}`").cast("string"), F.lit(UNKNOWN)).alias(f"m{k}") for k, m in enumerate(mix.margins)])
    placed = packed.join(rates, [f"m{k}" for k in range(len(mix.margins))])
    return placed.filter("chance < probability").select(*[F.col(f"row.`{c}`") for c in own], F.col("probability").alias("keep_probability"))
