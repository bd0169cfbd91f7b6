"""Quality rules: a learned decision list, with Spark SQL functions only.

Statistics of whole texts are cut into bins at quantiles of the labelled rows.  Sequential covering learns one rule at a
time for documents labelled 0: conditions (a statistic above or below a bin edge) are added while they raise the
information gain on the growing part of the labels, then dropped from the end while that helps on the pruning part.  The labels a rule covers are removed and the
next rule is learned.  The list is emitted as one ordered ``CASE`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.llm.storage import stage

WORD_GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = ["word_length", "symbol_share", "line_repeat", "word_repeat", "distinct_share", "shout_share", "mark_share", "letter_share", "end_share"]


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    edge: float

    def holds(self) -> Column:
        column = F.col(self.measure)
        return column > self.edge if self.above else column <= self.edge


@dataclass(frozen=True)
class Rule:
    """A conjunction that marks a document as poor; *good* and *bad* are the labels it covered when learned."""

    conditions: tuple[Condition, ...]
    good: int
    bad: int

    def holds(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.holds()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.measure} {'>' if c.above else '<='} {c.edge:g}" for c in self.conditions)


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column) -> Column:
    """Words inside a window of three that occurs twice or more: sort windows by hash, keep repeated starts, merge them."""
    def use(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - 2)
        grams = F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(
            F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i"))))

        def merged(g: Column) -> Column:
            again = F.filter(g, lambda x, k: F.get(g, k - 1)["h"].eqNullSafe(x["h"]) | F.get(g, k + 1)["h"].eqNullSafe(x["h"]))
            return _let(F.array_sort(F.transform(again, lambda x: x["i"])), lambda at: F.aggregate(
                at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("last")),
                lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")))["n"])

        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_let(grams, merged))

    return _let(words, use)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _free(name: str, docs: DataFrame) -> str:
    """*name*, or one like it that *docs* does not have."""
    while name in docs.columns:
        name += "_"
    return name


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of the base rule and the measures of the learned rules, from the whole text; null texts have no words.

    Measures are 0 where their denominator is.  Rows are measured one by one, so repeated rows and ids do not matter; own columns
    of *docs* with one of the added names are replaced, the text's excepted.
    """
    added = {*COUNTS, *MEASURES} - {text_col}
    at, found = (_free(name, docs) for name in ("_text", "_stats"))
    text = F.col(at)
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(_without(line, SPACES)) > 0)
    words = F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")
    made = _let(words, lambda w: _let(lines, lambda rows: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
        F.size(rows).cast("long").alias("_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("_distinct"),
        (F.length(text) - F.length(_without(text, "!?|"))).cast("long").alias("_marks"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("_upper"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("_letters"),
        F.size(F.filter(w, lambda x: x.rlike(r"[^\p{L}\p{N}]$"))).cast("long").alias("_ended"))))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    packed = docs.select(*kept, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(at)).select(*kept, F.explode(F.array(made)).alias(found))

    def share(a: str, b: str) -> Column:
        below = F.col(f"{found}.{b}")
        return F.when(below > 0, F.col(f"{found}.{a}") / below).otherwise(0.0)

    return packed.select(
        *kept, *[F.col(f"{found}.{c}").alias(c) for c in COUNTS],
        share("word_chars", "n_words").alias("word_length"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "_lines").alias("line_repeat"), share("n_repeat_words", "n_words").alias("word_repeat"),
        share("_distinct", "n_words").alias("distinct_share"), share("_upper", "word_chars").alias("shout_share"),
        share("_marks", "word_chars").alias("mark_share"), share("_letters", "word_chars").alias("letter_share"),
        share("_ended", "n_words").alias("end_share"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _gain(bad: float, good: float, bad0: float, good0: float) -> float:
    """FOIL information gain of a rule over its predecessor."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def _below(measure: str):
    return lambda edge: edge < F.col(measure)


def learn(labelled: DataFrame, label_col: str = "label", spread_col: str = "doc_id", bins: int = 48, max_rules: int = 8,
          max_conditions: int = 3, least_precision: float = 0.8, least_covered: int = 3) -> list[Rule]:
    """Learn the decision list from rows with the measures and a label (0 poor, 1 good).

    Every step is one Spark aggregate over (measure, bin); the driver sees those sums only, a few hundred rows.  Rows with other labels
    are ignored.  A third of the rows, by hash of *spread_col*, prunes.  Without both labels the list is empty.
    """
    data = stage(labelled.filter(F.col(label_col).isin(0, 1)).select(
        F.col(label_col).cast("int").alias("y"), (F.pmod(F.xxhash64(spread_col), F.lit(3)) == 0).alias("prune"), *MEASURES), "labelled")
    edges_row = data.agg(*[F.percentile_approx(m, [k / bins for k in range(1, bins)], 2000).alias(m) for m in MEASURES],
                         *[F.max(F.when(F.col("y") == 1, F.col(m))).alias(f"{m}_top") for m in MEASURES],
                         *[F.min(F.when(F.col("y") == 1, F.col(m))).alias(f"{m}_low") for m in MEASURES]).first()
    edges = {m: sorted({float(x) for x in [*(edges_row[m] or []), edges_row[f"{m}_top"], edges_row[f"{m}_low"]] if x is not None}) for m in MEASURES}
    if not any(edges.values()):
        return []
    binned = stage(data.select("y", "prune", *MEASURES, *[
        F.size(F.filter(F.array(*[F.lit(e) for e in edges[m]]).cast("array<double>"), _below(m))).alias(f"{m}_bin") for m in MEASURES]), "binned")
    rules: list[Rule] = []
    left = F.lit(True)
    long = F.stack(F.lit(len(MEASURES)), *[x for m in MEASURES for x in (F.lit(m), F.col(f"{m}_bin"))]).alias("measure", "bin")

    def totals(where: Column, prune: bool) -> tuple[int, int]:
        row = binned.filter(left & where & (F.col("prune") == prune)).agg(
            F.coalesce(F.sum((F.col("y") == 0).cast("int")), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
        return row[0], row[1]

    while len(rules) < max_rules:
        conditions: list[Condition] = []
        where = F.lit(True)
        bad0, good0 = totals(where, False)
        if bad0 < least_covered:
            break
        while len(conditions) < max_conditions and good0:
            cells = binned.filter(left & where & ~F.col("prune")).select("y", long).groupBy("measure", "bin").agg(
                F.sum((F.col("y") == 0).cast("int")).alias("bad"), F.sum("y").alias("good")).collect()
            best = None
            for m in MEASURES:
                own = {r.bin: (r.bad, r.good) for r in cells if r.measure == m}
                bad, good = 0, 0
                for k, edge in enumerate(edges[m]):
                    bad, good = bad + own.get(k, (0, 0))[0], good + own.get(k, (0, 0))[1]
                    for above, b, g in ((False, bad, good), (True, bad0 - bad, good0 - good)):
                        gain = _gain(b, g, bad0, good0)
                        if b >= least_covered and gain > 0 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, Condition(m, above, edge), b, g)
            if best is None:
                break
            conditions.append(best[1])
            where = where & best[1].holds()
            bad0, good0 = best[2], best[3]
        if not conditions:
            break
        # Prune: the shortest beginning of the conjunction with the best value on the other rows.
        prefixes = [Rule(tuple(conditions[:size]), 0, 0).holds() for size in range(1, len(conditions) + 1)]
        sums = binned.filter(left).agg(*[
            F.coalesce(F.sum((p & F.col("prune") & (F.col("y") == y)).cast("int")), F.lit(0)) for p in prefixes for y in (0, 1)], *[
            F.coalesce(F.sum((p & ~F.col("prune") & (F.col("y") == y)).cast("int")), F.lit(0)) for p in prefixes for y in (0, 1)]).first()
        n = len(conditions)
        values = [((sums[2 * k] - sums[2 * k + 1]) / max(1, sums[2 * k] + sums[2 * k + 1]), sums[2 * k], sums[2 * k + 1]) for k in range(n)]
        at = max(range(len(values)), key=lambda k: (values[k][0], values[k][1], -k))
        kept = tuple(conditions[:at + 1])
        bad, good = (sums[2 * (n + at) + y] + values[at][1 + y] for y in (0, 1))
        if bad + good == 0 or bad / (bad + good) < least_precision:
            break
        rule = Rule(kept, good, bad)
        rules.append(rule)
        left = left & ~rule.holds()
    return _with_margin(rules, data)


def _with_margin(rules: list[Rule], data: DataFrame) -> list[Rule]:
    """Edges moved to the middle between the neighbouring labelled values, which changes no decision on the labels."""
    conditions = list(dict.fromkeys(c for rule in rules for c in rule.conditions))
    if not conditions:
        return rules
    row = data.agg(*[F.max(F.when(F.col(c.measure) <= c.edge, F.col(c.measure))) for c in conditions],
                   *[F.min(F.when(F.col(c.measure) > c.edge, F.col(c.measure))) for c in conditions]).first()
    moved = {c: Condition(c.measure, c.above, (row[k] + row[len(conditions) + k]) / 2 if None not in (row[k], row[len(conditions) + k]) else c.edge)
             for k, c in enumerate(conditions)}
    return [Rule(tuple(moved[c] for c in rule.conditions), rule.good, rule.bad) for rule in rules]


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 for none."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.holds(), k).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Add statistics, base_failed, rule and kept to every row; own columns with these names are replaced."""
    return statistics(docs, text_col).withColumn("base_failed", base_failed()).withColumn("rule", decision(rules)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))
