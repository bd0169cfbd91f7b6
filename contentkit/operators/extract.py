"""Rule-driven extraction of typed records from text blocks.

Rules are data.  A block never leaves its row: scoring, capturing and assembling are projections,
with one explode per passed detector in between, so no step shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentkit.functions.scalars import all_of, any_of, compact, float_prefix, strip
from contentkit.functions.variants import as_map, overlay
from contentkit.operators.plan import compute_once, explode_rows
from contentkit.operators.skew import one_per_key

MIN_CONFIDENCE = 0.3
REFINE_BELOW = 0.7
REFINED_CONFIDENCE = 0.9


# ------------------------------------------------------------------------------------------------
# Field templates
# ------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class FieldPattern:
    """First match of *pattern* (group 1) becomes *field*, after the transform."""

    field: str
    pattern: str
    flags: str = "im"
    transform: str | None = None


@dataclass(frozen=True)
class TextTemplate:
    id: str
    category: str
    rules: tuple[FieldPattern, ...]


def pick_template(
    templates: Sequence[TextTemplate], template_id: str | None, category: str
) -> tuple[TextTemplate | None, list[tuple[str, str, str]]]:
    """Template by id, else the first one of the category; issues are (level, code, message)."""
    notes = []
    chosen = next((t for t in templates if template_id and t.id == template_id), None)
    if template_id and chosen is None:
        notes.append(("warning", "TEMPLATE_NOT_FOUND",
                      f"Template '{template_id}' not found; falling back to the content type."))
    chosen = chosen or next((t for t in templates if t.category == category), None)
    if chosen is None:
        notes.append(("error", "NO_TEMPLATE", f"No template found for content type '{category}'."))
    return chosen, notes


def extract_fields(blocks: DataFrame, rules: Sequence[FieldPattern], text: str = "text", out: str = "data") -> DataFrame:
    """Adds *out* (VARIANT) with one key per rule that matched; blocks without any match stay, as {}."""
    hits = []
    for rule in rules:
        flags = f"(?{rule.flags})" if rule.flags else ""
        pattern = flags + rule.pattern
        raw = strip(F.regexp_extract(text, pattern, 1))
        if rule.transform == "number":
            plain = F.replace(raw, F.lit(","), F.lit(""))
            number = float_prefix(plain)
            value = F.when(number == F.floor(number), number.cast("bigint").cast("variant")).when(
                number.isNotNull(), number.cast("variant")).otherwise(raw.cast("variant"))
        elif rule.transform in ("lowercase", "uppercase"):
            value = (F.lower(raw) if rule.transform == "lowercase" else F.upper(raw)).cast("variant")
        else:
            value = raw.cast("variant")
        hits.append(F.when(F.col(text).rlike(pattern), F.struct(F.lit(rule.field).alias("key"), value.alias("value"))))
    return compute_once(blocks, **{out: F.to_variant_object(F.map_from_entries(compact(*hits)))})


# ------------------------------------------------------------------------------------------------
# detectors
# ------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Signal:
    """Weighted evidence on the lower-cased text; every given part must hold.

    *any* and *all* are substring tests; next to a *pattern* they are cheap guards for it.
    """

    weight: int
    any: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    pattern: str = ""

    def holds(self, low: Column) -> Column:
        tests = []
        if self.any:
            tests.append(any_of(*[low.contains(w) for w in self.any]))
        if self.all:
            tests.append(all_of(*[low.contains(w) for w in self.all]))
        if self.pattern:
            tests.append(low.rlike(self.pattern))
        return all_of(*tests)


@dataclass(frozen=True)
class Capture:
    """One field: group of the first match, as text or integer, with a default for no match."""

    field: str
    pattern: str
    kind: str = "text"
    default: object = ""
    flags: str = "i"
    group: int = 1


@dataclass(frozen=True)
class Found:
    """What a detector's expressions may look at."""

    text: Column
    low: Column
    lines: Column
    caps: Column

    def cap(self, name: str) -> Column:
        return self.caps[name]


@dataclass(frozen=True)
class Detector:
    """A rule pack: when it fires, what it captures, and how sure it is."""

    category: str
    threshold: int
    signals: tuple[Signal, ...]
    vetoes: tuple[Signal, ...]
    name: Callable[[Found], Column]
    captures: tuple[Capture, ...]
    skip_line: Callable[[Column, Found], Column]
    confidence: tuple[float, float, float]
    counted: tuple[tuple[str, str, int], ...]
    tags: Callable[[Found], list[Column]]
    computed: dict[str, Callable[[Found], Column]] = field(default_factory=dict)
    describe: Callable[[Found, Column], Column] = lambda f, d: d


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), strip), lambda ln: ln != "")


def _capture_map(d: Detector, f: Found) -> Column:
    parts = [F.lit("name"), strip(d.name(f))]
    for c in d.captures:
        parts += [F.lit(c.field), strip(F.regexp_extract(f.text, f"(?{c.flags}){c.pattern}", c.group))]
    return F.create_map(*parts)


def _typed(c: Capture, f: Found) -> Column:
    raw = f.cap(c.field)
    if c.kind == "int":
        return F.coalesce(F.nullif(raw, F.lit("")).try_cast("bigint"), F.lit(c.default).cast("bigint"))
    return F.when(raw == "", F.lit(c.default)).otherwise(raw) if c.default else raw


def _assemble(d: Detector, f: Found) -> Column:
    by_field = {c.field: c for c in d.captures}
    name = f.cap("name")
    rest = F.filter(f.lines, lambda ln: (ln != name) & ~d.skip_line(ln, f))
    description = d.describe(f, strip(F.array_join(rest, " ")))
    values = {c.field: _typed(c, f) for c in d.captures if not c.field.startswith("_")}
    values.update({k: fn(f) for k, fn in d.computed.items()})
    n = F.lit(0)
    for name_, how, weight in d.counted:
        if how == "matched":
            hit = f.cap(name_) != ""
        elif how == "positive":
            hit = _typed(by_field[name_], f) > 0
        elif how == "always":
            hit = F.lit(True)
        elif how == "list":
            hit = F.size(values[name_]) > 0
        else:
            hit = values[name_] != ""
        n = n + F.when(hit, weight).otherwise(0)
    base, step, cap = d.confidence
    return F.struct(
        name.alias("name"),
        F.to_variant_object(F.struct(*[v.alias(k) for k, v in values.items()], description.alias("description"))).alias("data"),
        F.least(F.lit(base) + n * F.lit(step), F.lit(cap)).alias("confidence"),
        compact(*d.tags(f)).alias("auto_tags"),
    )


@dataclass(frozen=True)
class Compiled:
    """The columns of a detector list: scores, captured fields, assembled record."""

    detectors: tuple[Detector, ...]
    scores: Column
    captures: Column
    record: Column


_COMPILED: dict[tuple, Compiled] = {}


def _compiled(detectors: Sequence[Detector], text: str) -> Compiled:
    """Compile a detector list once per Spark context: the packs hold a few thousand expressions."""
    key = (tuple(id(d) for d in detectors), text, id(SparkContext._active_spark_context))
    if key not in _COMPILED:
        f = Found(F.col(text), F.col("_low"), F.col("_lines"), F.col("_caps"))

        def by_category(build: Callable[[Detector, Found], Column]) -> Column:
            expr = None
            for i, d in enumerate(detectors):
                cond = F.col("match_no") == i
                expr = F.when(cond, build(d, f)) if expr is None else expr.when(cond, build(d, f))
            return expr

        captures = F.coalesce(by_category(_capture_map), F.create_map().cast("map<string,string>"))
        _COMPILED[key] = Compiled(tuple(detectors), _scores(detectors), captures, by_category(_assemble))
    return _COMPILED[key]


def _scores(detectors: Sequence[Detector]) -> Column:
    """One struct per detector, in pack order, with its score; a veto scores -1."""
    low = F.col("_low")
    scores = []
    for order, d in enumerate(detectors):
        total = F.lit(0)
        for s in d.signals:
            total = total + F.when(s.holds(low), s.weight).otherwise(0)
        if d.vetoes:
            total = F.when(total < d.threshold, total).when(any_of(*[v.holds(low) for v in d.vetoes]), -1).otherwise(total)
        scores.append(F.struct(
            F.lit(order).alias("match_no"), F.lit(d.category).alias("category"), total.alias("score"),
            F.lit(d.threshold).alias("threshold")))
    return F.array(*scores)


def _scored(blocks: DataFrame, detectors: Sequence[Detector], text: str) -> DataFrame:
    lowered = compute_once(blocks, _low=F.lower(text))
    hits = lowered.select("*", F.explode_outer(_compiled(detectors, text).scores).alias("_hit"))
    return hits.filter(F.col("_hit.score") >= F.col("_hit.threshold")).select(
        *blocks.columns, "_low", "_hit.match_no", "_hit.category", "_hit.score")


def score_categories(blocks: DataFrame, detectors: Sequence[Detector], text: str = "text") -> DataFrame:
    """One row per (block, detector that passes), with its score; output order is pack order."""
    return _scored(blocks, detectors, text).drop("_low")


def detect_records(
    blocks: DataFrame, detectors: Sequence[Detector], min_confidence: float = MIN_CONFIDENCE, text: str = "text"
) -> DataFrame:
    """One extracted record per (block, passed detector).

    Adds match_no, category, name, structured_data (VARIANT), confidence, auto_tags.  Scores are
    filtered before anything is captured, and a row evaluates only its own category's captures.
    """
    scored = _scored(blocks.filter(strip(F.col(text)) != ""), detectors, text)
    prepared = compute_once(scored, _lines=lines_of(F.col(text)))
    rules = _compiled(detectors, text)
    captured = compute_once(prepared, _caps=rules.captures)
    out = compute_once(captured, _rec=rules.record)
    return out.select(
        *blocks.columns, "match_no", "category", F.col("_rec.name").alias("name"),
        F.col("_rec.data").alias("structured_data"), F.col("_rec.confidence").alias("confidence"),
        F.col("_rec.auto_tags").alias("auto_tags"),
    ).filter(F.col("confidence") >= min_confidence)


# ------------------------------------------------------------------------------------------------
# Model refinement (the model call itself happens outside)
# ------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class PromptPack:
    category: str
    system_prompt: str
    user_template: str


def prompt_dim(spark: SparkSession, packs: Sequence[PromptPack]) -> DataFrame:
    return spark.createDataFrame(
        [(p.category, p.system_prompt, p.user_template) for p in packs],
        "category string, system_prompt string, user_template string",
    )


def build_prompts(
    extracted: DataFrame, packs: Sequence[PromptPack], below: float = REFINE_BELOW, text: str = "text"
) -> DataFrame:
    """A prompt for every unsure record of a category with a prompt pack."""
    dim = prompt_dim(extracted.sparkSession, packs)
    joined = extracted.filter(F.col("confidence") < below).join(F.broadcast(dim), "category")
    user = F.replace(F.col("user_template"), F.lit("{{rawText}}"), F.col(text))
    user = F.replace(user, F.lit("{{sourceBook}}"), F.col("source_book"))
    return joined.select("record_id", "category", "system_prompt", user.alias("user_prompt"))


def apply_responses(extracted: DataFrame, responses: DataFrame) -> DataFrame:
    """X6 (J9): overlay a JSON object response on the structured data; anything else changes nothing.

    *responses*: record_id, body.  Of several objects for a record the one with the greatest text counts.
    """
    parsed = responses.select("record_id", "body", F.try_parse_json("body").alias("_body")).filter(
        F.schema_of_variant("_body").startswith("OBJECT")
    )
    parsed = one_per_key(parsed.select("record_id", "body"), ["record_id"], ["body"]).select(
        "record_id", F.try_parse_json("body").alias("_body"))
    joined = extracted.join(parsed, "record_id", "left")
    hit = F.col("_body").isNotNull()
    changed = {
        "structured_data": F.when(hit, overlay(F.col("structured_data"), F.col("_body"))).otherwise(F.col("structured_data")),
        "detection_method": F.when(hit, "ai").otherwise(F.col("detection_method")),
        "confidence": F.when(hit, F.greatest(F.col("confidence"), F.lit(REFINED_CONFIDENCE))).otherwise(F.col("confidence")),
    }
    return joined.withColumns(changed).select(*extracted.columns)


def has_no_keys(payload: Column) -> Column:
    return F.size(as_map(payload)) == 0
