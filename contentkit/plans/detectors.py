"""The fourteen detector packs, in output order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentkit.functions.rules import ABILITIES
from contentkit.functions.scalars import collapse_space, lookup, strip
from contentkit.operators.extract import Capture, Detector, Found, Signal, lines_of

# ---------------------------------------------------------------------------------------------
# Patterns and word lists that decide results.
# ---------------------------------------------------------------------------------------------
NPC_VETO = Signal(0, any=("cr", "fort"), pattern=r"\bcr\s+\d|\bfort\s+[+-]\d")
SPELL_VETO = Signal(0, any=("casting", "school"), pattern=r"\bcasting\s*time\b|\bschool\s*:")
WEAPON_VETO = Signal(0, any=("damage",), pattern=r"\bdamage\s+\d+d\d+")
FULL_NPC_VETO = Signal(0, any=("kac", "ref"), pattern=r"\beac\s*\d+.*\bkac\s*\d+|\bfort\s+[+-]\d+.*\bref\s+[+-]\d+")
EQUIPMENT_VETOES = (
    Signal(0, any=("damage", "arm", "weapon"), pattern=r"\bdamage\s+\d+d\d+|small\s+arm|long\s+arm|heavy\s+weapon"),
    Signal(0, any=("bonus", "max"), pattern=r"\beac\s+bonus\b|\bkac\s+bonus\b|\bmax\s*dex\b"),
    Signal(0, any=("cr", "str", "fort"), pattern=r"\bcr\s+\d|\bstr\s+\d|\bfort\s+[+-]\d"),
    SPELL_VETO,
)
CAPS_NAME = r"^[A-Z0-9\s,\-–']{3,}$"
TITLE_NAME = r"^[A-Z][A-Za-z0-9\s'\-–]+$"
TITLE_NAME_COMMA = r"^[A-Z][A-Za-z0-9\s'\-–,]+$"
SPECIES_NAME = r"^[A-Z][A-Za-z\s'\-–]{2,}$"
SPECIES_CAPS_NAME = r"^[A-Z][A-Z\s'\-–]{2,}$"
SIZES = "fine|diminutive|tiny|small|medium|large|huge|gargantuan|colossal"
VEHICLE_SIZES = "tiny|small|medium|large|huge|gargantuan|colossal"
WEAPON_CLASSES = (
    "small arm|long arm|heavy weapon|sniper weapon|melee weapon|grenade|basic melee|advanced melee|small arms|long arms"
)
ARMOR_CLASSES = "light armor|heavy armor|powered armor"
AUGMENTATION_TYPES = ("cybernetic", "biotech", "magitech", "neuro-hack", "neurohack")
BODY_SLOTS = (
    "arm", "hand", "foot", "leg", "eye", "ear", "brain", "heart", "lungs", "spinal column", "throat", "skin", "all", "none",
)
FEAT_TYPES = ("combat", "general", "skill", "teamwork", "gunnery", "psionics")
HAZARD_TYPES = ("environmental", "haunt", "trap", "disease", "radiation", "void", "gravity")
VEHICLE_LINE = rf"\b({VEHICLE_SIZES})\s+(?:land|sea|air|hover|water|space)?\s*vehicle"
STARSHIP_SIZE = rf"\b({VEHICLE_SIZES})\s+starship"
SHIELDS = (
    r"shields\s*(?:forward\s*(\d+),\s*port\s*(\d+),\s*starboard\s*(\d+),\s*aft\s*(\d+)|([^\n]+))"
)
ABILITY_MOD = r"([+\-–−]?\s*\d+)\s+([A-Za-z]+)"
TRAIT_HEADER = r"([A-Z][A-Za-z\s'\-–]{1,50}?)\s+\((Ex|Su|Sp)\)\s*:"
ALT_FEATURE = r"(?i)(?:(\d+)(?:st|nd|rd|th)\s+level|level\s+(\d+))[^:\n]*[:—–]\s*([^\n]{3,80})"
KNOWLEDGE_BLOCK = r"theme\s+knowledge[^:]*\n([\s\S]{0,400}?)(?:\n\n|\n(?:[A-Z0-9 ]{4,}|\d+th\s+level))"
KNOWLEDGE_LINE = r"theme\s+knowledge[^\n]*\n([^\n]{0,300})"
CASTER_LEVELS = r"(?i)((?:mystic|technomancer|witchwarper|precog|caster)\s+\d+)"


# ---------------------------------------------------------------------------------------------
# Building blocks
# ---------------------------------------------------------------------------------------------
def _has(c: Column, pattern: str) -> Column:
    return c.rlike("(?i)" + pattern)


def _first(lines: Column, test) -> Column:
    return F.get(F.filter(lines, test), F.lit(0))


def _line0(f: Found) -> Column:
    return F.get(f.lines, F.lit(0))


def _caps_name(skip: str):
    """First line, unless the first line that is not *skip* is an all-caps heading."""

    def name(f: Found) -> Column:
        head = _first(f.lines, lambda ln: ~_has(ln, skip))
        return F.when(head.rlike(CAPS_NAME), head).otherwise(_line0(f))

    return name


def _title_name(pattern: str, limit: int, no: tuple[str, ...] = (":",), unlike: str = ""):
    """First line that looks like a title, else the first line."""

    def ok(ln: Column) -> Column:
        cond = ln.rlike(pattern) & (F.length(ln) < limit)
        for ch in no:
            cond = cond & ~ln.contains(ch)
        return cond & ~_has(ln, unlike) if unlike else cond

    return lambda f: F.coalesce(_first(f.lines, ok), _line0(f))


def _leading_name(label: str, value: str):
    """Text before "<label> <value>" at the start of the block, else of the first such line."""
    pattern = rf"(?i)^([^\n]+?)\s+\b{label}\s+({value})"

    def name(f: Found) -> Column:
        head = F.nullif(F.regexp_extract(f.text, pattern, 1), F.lit(""))
        line = _first(f.lines, lambda ln: ln.rlike(pattern))
        return F.coalesce(head, F.regexp_extract(line, pattern, 1), _line0(f))

    return name


def _skip(pattern: str):
    return lambda ln, f: _has(ln, pattern)


def _until(rest: Column, stop: str) -> Column:
    """Non-blank lines of *rest* up to the first later line that starts a stop label, joined by spaces."""
    lines = lines_of(rest)
    at = F.array_position(F.transform(lines, lambda ln, i: (i >= 1) & _has(ln, stop)), True)
    kept = F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)
    return F.array_join(kept, " ")



def _first_word(low: Column, words: tuple[str, ...], default: str, whole: bool = False) -> Column:
    expr = None
    for w in words:
        cond = low.rlike(rf"\b{w}\b") if whole else low.contains(w)
        label = F.lit(w[:1].upper() + w[1:])
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default)


def _dashed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "-")


def _tag(c: Column) -> Column:
    return F.when(c != "", F.lower(c))


def text(name: str, pattern: str, default: str = "", flags: str = "i", group: int = 1) -> Capture:
    return Capture(name, pattern, "text", default, flags, group)


def integer(name: str, pattern: str, default: int = 0) -> Capture:
    return Capture(name, pattern, "int", default)


def matched(*names: str) -> tuple[tuple[str, str, int], ...]:
    return tuple((n, "matched", 1) for n in names)


def filled(*names: str) -> tuple[tuple[str, str, int], ...]:
    return tuple((n, "text", 1) for n in names)


def positive(*names: str) -> tuple[tuple[str, str, int], ...]:
    return tuple((n, "positive", 1) for n in names)


# ---------------------------------------------------------------------------------------------
# Species
# ---------------------------------------------------------------------------------------------
def _species_name(f: Found) -> Column:
    titled = lambda ln: (ln.rlike(SPECIES_NAME) & ~ln.contains(":") | ln.rlike(SPECIES_CAPS_NAME)) & (F.length(ln) < 60)
    return F.coalesce(_first(f.lines, titled), _line0(f))


def _ability_mods(f: Found) -> Column:
    parts = F.filter(F.split(f.cap("_mods"), r",\s*"), lambda p: p.rlike(ABILITY_MOD))

    def entry(p: Column) -> Column:
        raw = F.regexp_replace(F.regexp_extract(p, ABILITY_MOD, 1), r"[–−]", "-")
        mod = F.regexp_replace(raw, r"\s+", "")
        signed = F.when(mod.startswith("-"), mod).otherwise(F.concat(F.lit("+"), F.replace(mod, F.lit("+"), F.lit(""))))
        return F.struct(
            signed.alias("mod"), lookup(F.lower(F.regexp_extract(p, ABILITY_MOD, 2)), ABILITIES, None).alias("ability")
        )

    return F.filter(F.transform(parts, entry), lambda e: e["ability"].isNotNull())


def _traits(f: Found) -> Column:
    names = F.regexp_extract_all(f.text, F.lit(TRAIT_HEADER), F.lit(1))
    kinds = F.regexp_extract_all(f.text, F.lit(TRAIT_HEADER), F.lit(2))
    bodies = F.split(f.text, TRAIT_HEADER)
    return F.transform(names, lambda n, i: F.struct(
        strip(n).alias("name"),
        F.get(kinds, i).alias("type"),
        strip(F.when(i < F.size(names) - 1, F.get(bodies, i + 1))
              .otherwise(F.get(F.split(F.get(bodies, i + 1), "\n\n"), F.lit(0)))).alias("description"),
    ))


def _subtype(f: Found) -> Column:
    return F.lower(F.coalesce(
        F.nullif(f.cap("_sub1"), F.lit("")), F.nullif(f.cap("_sub2"), F.lit("")), F.lit("humanoid")))


SPECIES = Detector(
    category="race",
    threshold=4,
    signals=(
        Signal(3, any=("ability",), pattern=r"ability\s+(adjustments?|modifiers?)\s*:"),
        Signal(3, any=("size",), pattern=r"size\s+and\s+type\s*:"),
        Signal(2, any=("hit",), pattern=r"hit\s+points?\s*:\s*\d+(?:\s|$)"),
        Signal(1, any=("(ex)", "(su)", "(sp)")),
        Signal(1, any=("subtype",)),
        Signal(1, any=("racial",), pattern=r"racial\s+trait"),
    ),
    vetoes=(),
    name=_species_name,
    captures=(
        integer("hp", r"hit\s+points?\s*:\s*(\d+)"),
        text("_mods", r"ability\s+(?:adjustments?|modifiers?)\s*:\s*([^\n]+)"),
        text("_size1", rf"size\s+and\s+type\s*:[^.]*?\b({SIZES})\b"),
        text("_size2", rf"\b({SIZES})\b"),
        text("_sub1", r"with\s+the\s+(\w+)\s+subtype"),
        text("_sub2", r"(?:are|is)\s+\w+\s+(\w+)\s+with"),
    ),
    computed={
        "abilityMods": _ability_mods,
        "size": lambda f: F.lower(F.coalesce(
            F.nullif(f.cap("_size1"), F.lit("")), F.nullif(f.cap("_size2"), F.lit("")), F.lit("medium"))),
        "subtype": _subtype,
        "racialAbilities": _traits,
    },
    skip_line=_skip(r"ability\s+(?:adjustments?|modifiers?)\s*:|hit\s+points?\s*:|size\s+and\s+type\s*:"),
    confidence=(0.5, 0.08, 0.97),
    counted=(("abilityMods", "list", 2), *positive("hp"), ("size", "always", 1), ("subtype", "always", 1),
             ("racialAbilities", "list", 1)),
    tags=lambda f: [F.lit("species"), _subtype(f)],
)


# ---------------------------------------------------------------------------------------------
# Theme, class, archetype
# ---------------------------------------------------------------------------------------------
def _knowledge(f: Found) -> Column:
    return collapse_space(F.when(_has(f.text, KNOWLEDGE_BLOCK), f.cap("_k1")).otherwise(f.cap("_k2")))


THEME = Detector(
    category="theme",
    threshold=4,
    signals=(
        Signal(5, any=("theme",), pattern=r"theme\s+knowledge"),
        *[Signal(1, any=(f"{n}th",), pattern=rf"\b{n}th\s+level\b") for n in (6, 12, 18)],
    ),
    vetoes=(NPC_VETO, SPELL_VETO, WEAPON_VETO),
    name=_title_name(TITLE_NAME, 60, unlike=r"theme\s+knowledge"),
    captures=(
        text("_k1", KNOWLEDGE_BLOCK), text("_k2", KNOWLEDGE_LINE),
        *[text(f"_at{n}", rf"{n}th\s+level[^\n]*\n([^\n]{{0,200}})") for n in (6, 12, 18)],
    ),
    computed={
        "themeKnowledge": _knowledge,
        **{f"abilityAt{n}": (lambda f, n=n: collapse_space(f.cap(f"_at{n}"))) for n in (6, 12, 18)},
    },
    skip_line=_skip(r"^(theme\s+knowledge|\d+th\s+level)"),
    describe=lambda f, d: F.when(_knowledge(f) != "", _knowledge(f)).otherwise(d),
    confidence=(0.55, 0.1, 0.96),
    counted=(("themeKnowledge", "text", 2), ("abilityAt6", "always", 1)),
    tags=lambda f: [F.lit("theme")],
)

CLASS = Detector(
    category="class",
    threshold=4,
    signals=(
        Signal(5, any=("ability",), pattern=r"key\s+ability\s+score"), Signal(3, any=("stamina",), pattern=r"stamina\s+points"),
        Signal(2, any=("feature",), pattern=r"class\s+feature"), Signal(1, any=("proficiencies",), pattern=r"\bproficiencies\b"),
    ),
    vetoes=(NPC_VETO, SPELL_VETO, WEAPON_VETO),
    name=_title_name(TITLE_NAME, 60),
    captures=(
        text("keyAbility", r"key\s+ability\s+score\s*[:;]?\s*([^\n;]+)"),
        integer("hp", r"hit\s+points\s*[:;]?\s*(\d+)"),
        integer("stamina", r"stamina\s+points\s*[:;]?\s*(\d+)"),
        text("_skills1", r"class\s+skills?\s*[:;]?\s*([^\n]+)"),
        text("_skills2", r"key\s+skills?\s*[:;]?\s*([^\n]+)"),
        text("proficiencies", r"proficiencies\s*[:;]?\s*([^\n]+)"),
    ),
    computed={"keySkills": lambda f: F.coalesce(F.nullif(f.cap("_skills1"), F.lit("")), f.cap("_skills2"))},
    skip_line=_skip(
        r"^(key\s+ability|hit\s+points|stamina\s+points|class\s+skills?|key\s+skills?|proficiencies|bab|base\s+attack)\b"),
    confidence=(0.55, 0.12, 0.96),
    counted=(*filled("keyAbility"), *positive("hp", "stamina")),
    tags=lambda f: [F.lit("class")],
)


def _alt_features(f: Found) -> Column:
    ordinal = F.regexp_extract_all(f.text, F.lit(ALT_FEATURE), F.lit(1))
    plain = F.regexp_extract_all(f.text, F.lit(ALT_FEATURE), F.lit(2))
    names = F.regexp_extract_all(f.text, F.lit(ALT_FEATURE), F.lit(3))
    return F.transform(names, lambda n, i: F.concat(
        F.lit("Level "),
        F.coalesce(F.nullif(F.get(ordinal, i), F.lit("")), F.nullif(F.get(plain, i), F.lit("")), F.lit("?")),
        F.lit(": "), strip(n)))


ARCHETYPE = Detector(
    category="archetypeFeature",
    threshold=4,
    signals=(
        Signal(5, any=("alternate",), pattern=r"alternate\s+class\s+features?"), Signal(3, any=("associated",), pattern=r"associated\s+classes?\s*:"),
        Signal(1, any=("replace",), pattern=r"\breplaces?\b"),
    ),
    vetoes=(NPC_VETO, SPELL_VETO, WEAPON_VETO),
    name=_title_name(TITLE_NAME, 60, unlike=r"alternate\s+class"),
    captures=(text("associatedClasses", r"associated\s+classes?\s*:\s*([^\n]+)"),),
    computed={
        "altFeatureCount": lambda f: F.size(_alt_features(f)).cast("bigint"),
        "altFeatures": lambda f: F.slice(_alt_features(f), 1, 8),
    },
    skip_line=_skip(r"^(associated\s+classes?|alternate\s+class\s+features?)"),
    confidence=(0.55, 0.15, 0.96),
    counted=(*filled("associatedClasses"), ("altFeatures", "list", 1)),
    tags=lambda f: [F.lit("archetype")],
)


# ---------------------------------------------------------------------------------------------
# Augmentation, feat, hazard
# ---------------------------------------------------------------------------------------------
def _augmentation_name(f: Found) -> Column:
    ok = lambda ln: (
        ln.rlike(TITLE_NAME_COMMA) & (F.length(ln) < 70) & ~ln.contains(":") & ~F.lower(ln).isin(list(AUGMENTATION_TYPES))
    )
    return F.coalesce(_first(f.lines, ok), _line0(f))


AUGMENTATION = Detector(
    category="augmentation",
    threshold=4,
    signals=(
        Signal(4, any=("system",), pattern=r"\bsystem\s*:"), Signal(3, any=AUGMENTATION_TYPES), Signal(1, any=BODY_SLOTS),
        Signal(1, any=("level",), pattern=r"\blevel\s+\d{1,2}\b"), Signal(1, any=("price",), pattern=r"\bprice\b"),
    ),
    vetoes=(NPC_VETO, WEAPON_VETO),
    name=_augmentation_name,
    captures=(
        text("system", r"system\s*:\s*([^\n;]+)"),
        integer("level", r"\blevel\s+(\d{1,2})\b"),
        text("price", r"price\s*[:;]?\s*([\d,]+(?:\s*credits?)?)"),
    ),
    computed={"augType": lambda f: _first_word(f.low, AUGMENTATION_TYPES, "Augmentation")},
    skip_line=_skip(r"^(system|level|price|cybernetic|biotech|magitech|neuro-?hack)\b"),
    confidence=(0.5, 0.13, 0.96),
    counted=(*filled("system"), ("augType", "always", 1), *positive("level")),
    tags=lambda f: [F.lit("augmentation"), F.lower(_first_word(f.low, AUGMENTATION_TYPES, "Augmentation"))],
)

FEAT_SUFFIX = r"\(([A-Za-z]+)\)\s*$"


def _feat_line(f: Found) -> Column:
    return _first(f.lines, lambda ln: ~ln.contains(":") & (
        ln.rlike(FEAT_SUFFIX) | (ln.rlike(TITLE_NAME) & (F.length(ln) < 70))))


def _feat_name(f: Found) -> Column:
    return F.coalesce(F.regexp_replace(_feat_line(f), r"\s*" + FEAT_SUFFIX, ""), _line0(f))


def _feat_type(f: Found) -> Column:
    line = F.coalesce(_feat_line(f), F.lit(""))
    word = F.lit("")
    for t in reversed(FEAT_TYPES):
        word = F.when(F.lower(line).contains(t), t).otherwise(word)
    return F.when(line.rlike(FEAT_SUFFIX), F.regexp_extract(line, FEAT_SUFFIX, 1)).otherwise(word)


def _benefit(f: Found) -> Column:
    return _until(f.cap("_benefit"), r"^(?:special|normal|prerequisite)")


FEAT = Detector(
    category="feat",
    threshold=4,
    signals=(Signal(4, any=("benefit",), pattern=r"\bbenefit\s*:"), Signal(2, any=("prerequisite",), pattern=r"\bprerequisites?\s*:")),
    vetoes=(NPC_VETO, SPELL_VETO, WEAPON_VETO),
    name=_feat_name,
    captures=(
        text("prerequisites", r"prerequisites?\s*:\s*([^\n]+)"),
        text("_benefit", r"benefit\s*:\s*([\s\S]*)$"),
        text("special", r"special\s*:\s*([^\n]+)"),
        text("normal", r"normal\s*:\s*([^\n]+)"),
    ),
    computed={"featType": _feat_type, "benefit": _benefit},
    skip_line=_skip(r"^(prerequisites?|benefit|special|normal)\s*:"),
    describe=lambda f, d: F.when(_benefit(f) != "", _benefit(f)).otherwise(d),
    confidence=(0.5, 0.13, 0.95),
    counted=filled("prerequisites", "benefit", "featType"),
    tags=lambda f: [F.lit("feat"), _tag(_feat_type(f))],
)


def _hazard_name(f: Found) -> Column:
    titled = _title_name(TITLE_NAME, 60)
    before_cr = strip(F.regexp_extract(f.text, r"(?im)^([^\n]+?)\s+\bcr\s+([0-9/]+)", 1))
    return F.when(before_cr != "", before_cr).otherwise(titled(f))


HAZARD = Detector(
    category="hazard",
    threshold=4,
    signals=(
        Signal(3, any=("perception",), pattern=r"perception\s+dc\s*\d+"), Signal(2, any=("disable",), pattern=r"\bdisable\b"), Signal(2, any=("trigger",), pattern=r"\btrigger\b"),
        Signal(1, any=("effect",), pattern=r"\beffect\b"), Signal(2, any=HAZARD_TYPES, pattern=rf"\b(?:{'|'.join(HAZARD_TYPES)})\b"),
    ),
    vetoes=(FULL_NPC_VETO, WEAPON_VETO, SPELL_VETO),
    name=_hazard_name,
    captures=(
        text("cr", r"\bcr\s+([0-9/]+)"),
        text("xp", r"\bxp\s+([\d,]+)"),
        integer("perceptionDc", r"perception\s+dc\s*(\d+)"),
        integer("disableDc", r"disable\b[^:]*\bdc\s*(\d+)"),
        text("_trigger", r"trigger\s*[:;]?\s*([\s\S]*)$"),
        text("_effect", r"effect\s*[:;]?\s*([\s\S]*)$"),
    ),
    computed={
        "hazardType": lambda f: _first_word(f.low, HAZARD_TYPES, "Hazard", whole=True),
        "trigger": lambda f: _until(f.cap("_trigger"), r"^(?:effect|reset|onset)"),
        "effect": lambda f: _until(f.cap("_effect"), r"^(?:trigger|reset|onset|countermeasures)"),
    },
    skip_line=_skip(r"^(cr|xp|type|perception\s+dc|disable|trigger|effect|reset|onset)\b"),
    confidence=(0.5, 0.13, 0.96),
    counted=(*filled("cr"), *positive("perceptionDc", "disableDc")),
    tags=lambda f: [
        F.lit("hazard"), F.lower(_first_word(f.low, HAZARD_TYPES, "Hazard", whole=True)),
        F.when(f.cap("cr") != "", F.concat(F.lit("cr-"), f.cap("cr"))),
    ],
)


# ---------------------------------------------------------------------------------------------
# Starship, vehicle, npc
# ---------------------------------------------------------------------------------------------
def _shields(f: Found) -> Column:
    general = F.regexp_extract(f.cap("_shields"), r"\d+", 0)
    listed = f.cap("_sh1") != ""

    def arc(i: int) -> Column:
        raw = F.when(listed, f.cap(f"_sh{i}")).otherwise(general)
        return F.coalesce(F.nullif(raw, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))

    return F.struct(arc(1).alias("forward"), arc(2).alias("port"), arc(3).alias("starboard"), arc(4).alias("aft"))


def _crew(f: Found) -> Column:
    low = F.lower(f.cap("_crew"))
    seats = {
        "captain": ("captain", "Captain"), "pilot": ("pilot", "Pilot"), "gunner": ("gunner", "Gunner"),
        "engineer": ("engineer", "Engineer"), "scienceOfficer": ("science", "Science Officer"),
    }
    return F.struct(*[F.when(low.contains(w), label).otherwise("").alias(k) for k, (w, label) in seats.items()])


def _size_label(f: Found) -> Column:
    return F.when(f.cap("size") == "", "Medium").otherwise(F.initcap(f.cap("size")))


STARSHIP = Detector(
    category="starship",
    threshold=3,
    signals=(
        Signal(2, any=("starship",)), Signal(2, any=("tier",), pattern=r"\btier\s+\d+"), Signal(2, all=("hp",), any=("dt", "ct")),
        Signal(1, any=("shields",)),
    ),
    vetoes=(),
    name=_leading_name("tier", r"\d+"),
    captures=(
        text("tier", r"\btier\s*(\d+)", "1"),
        text("size", STARSHIP_SIZE),
        integer("hp", r"\bhp\s*(\d+)"), integer("dt", r"\bdt\s*(\d+)"), integer("ct", r"\bct\s*(\d+)"),
        integer("speed", r"\bspeed\s*(\d+)"),
        text("maneuverability", r"\bmaneuverability\s*([a-zA-Z0-9()\-–\s]+)", "average"),
        *[text(f"_sh{i}", SHIELDS, group=i) for i in (1, 2, 3, 4)],
        text("_shields", SHIELDS, group=5),
        text("_shields_all", SHIELDS, group=0),
        text("powerCore", r"power\s*core\s*:?\s*([^\n;]+)"),
        text("driftEngine", r"drift\s*engine\s*:?\s*([^\n;]+)"),
        text("sensors", r"sensors\s*:?\s*([^\n;]+)"),
        text("_crew", r"crew\s*:?\s*([^\n]+)"),
    ),
    computed={
        "size": _size_label,
        "shields": _shields,
        "attacks": lambda f: F.filter(f.lines, lambda ln: _has(ln, r"^attack\s*\(")),
        "crew": _crew,
    },
    skip_line=_skip(
        rf"{STARSHIP_SIZE}|^(tier|speed|maneuverability|hp|dt|ct|shields|power\s*core|drift\s*engine|sensors|attack|attacks|crew):?"),
    confidence=(0.4, 0.1, 1.0),
    counted=matched("tier", "size", "hp", "_shields_all", "powerCore", "sensors"),
    tags=lambda f: [F.lit("starship"), F.lower(_size_label(f))],
)


def _vehicle_name(f: Found) -> Column:
    at = F.array_position(F.transform(f.lines, lambda ln: _has(ln, VEHICLE_LINE)), True)
    return F.when(at > 1, F.get(f.lines, (at - 2).cast("int"))).otherwise(_line0(f))


VEHICLE = Detector(
    category="vehicle",
    threshold=3,
    signals=(
        Signal(2, any=("vehicle",)), Signal(2, any=("hardness",)), Signal(1, any=("autopilot",)), Signal(1, any=("cover",)),
    ),
    vetoes=(),
    name=_vehicle_name,
    captures=(
        text("size", VEHICLE_LINE),
        text("speed", r"speed\s*([^\n;]+)"),
        integer("eac", r"eac\s*(\d+)", 10), integer("kac", r"kac\s*(\d+)", 10), integer("hp", r"hp\s*(\d+)"),
        integer("hardness", r"hardness\s*(\d+)"),
        text("attacks", r"(?:attack|attacks|attack\s*\(ram\))\s*:?\s*([^\n]+)"),
        text("crew", r"crew\s*:?\s*([^\n;]+)"),
        text("passengers", r"passengers\s*:?\s*([^\n;]+)"),
        text("cargo", r"cargo\s*:?\s*([^\n;]+)"),
        text("modifiers", r"modifiers\s*:?\s*([^\n]+)"),
    ),
    computed={"size": _size_label},
    skip_line=_skip(
        rf"{VEHICLE_LINE}|^(speed|eac|kac|hp|hardness|attacks|attack|crew|passengers|cargo|modifiers|autopilot):?"),
    confidence=(0.4, 0.1, 1.0),
    counted=matched("size", "speed", "eac", "kac", "hardness", "crew"),
    tags=lambda f: [F.lit("vehicle"), F.lower(_size_label(f))],
)


def _npc_cr(f: Found) -> Column:
    return F.when(f.cap("cr") == "", "1").otherwise(f.cap("cr"))


NPC = Detector(
    category="npc",
    threshold=3,
    signals=(
        Signal(2, any=("cr",), pattern=r"\bcr\s+\d+"), Signal(2, all=("eac", "kac")), Signal(1, all=("fort", "ref", "will")),
        Signal(1, all=("str", "dex", "con")),
    ),
    vetoes=(),
    name=_leading_name("cr", "[0-9/]+"),
    captures=(
        text("cr", r"\bcr\s+([0-9/]+)", "1"),
        text("xp", r"\bxp\s+([0-9,]+)"),
        integer("hp", r"\bhp\s+(\d+)"),
        integer("eac", r"\beac\s*(\d+)", 10), integer("kac", r"\bkac\s*(\d+)", 10),
        *[integer(n, rf"\b{n}\s*([+-]\d+)") for n in ("fort", "ref", "will")],
        *[integer(n, rf"\b{n}\s*([+-]?\d+)", 10) for n in ("str", "dex", "con", "int", "wis", "cha")],
        text("speed", r"\bspeed\s*([^\n;]+)"),
        integer("initiative", r"\b(?:init|initiative)\s*([+-]?\d+)"),
        text("skills", r"\bskills\s*([^\n]+)"),
        text("languages", r"\blanguages\s*([^\n]+)"),
    ),
    computed={"attacks": lambda f: F.filter(f.lines, lambda ln: _has(ln, r"^(?:melee|ranged)\s+"))},
    skip_line=lambda ln, f: ln.contains(F.concat(F.lit("CR "), _npc_cr(f))) | _has(
        ln, r"^(xp|init|senses|perception|eac|kac|fort|ref|will|hp|speed|melee|ranged|str|dex|con|int|wis|cha|skills"
            r"|languages|other gear|tactics|defense|offense|statistics):?"),
    confidence=(0.4, 0.1, 1.0),
    counted=matched("cr", "xp", "hp", "eac", "kac", "str", "skills"),
    tags=lambda f: [F.lit("npc"), F.concat(F.lit("cr-"), _npc_cr(f))],
)


# ---------------------------------------------------------------------------------------------
# Spell, weapon, armor, equipment
# ---------------------------------------------------------------------------------------------
def _spell_classes(f: Found) -> Column:
    listed = F.when(f.cap("_classes") != "", f.cap("_classes")).otherwise(
        F.array_join(F.regexp_extract_all(f.text, F.lit(CASTER_LEVELS), F.lit(1)), ", "))
    return F.filter(F.transform(F.split(listed, ","), strip), lambda c: c != "")


def _spell_level(f: Found) -> Column:
    numbers = F.transform(
        _spell_classes(f), lambda c: F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("bigint"))
    return F.greatest(F.lit(1).cast("bigint"), F.coalesce(F.array_max(numbers), F.lit(1).cast("bigint")))


SPELL = Detector(
    category="spell",
    threshold=3,
    signals=(
        Signal(2, any=("school:", "school ")), Signal(2, any=("casting time:", "casting time ")),
        Signal(1, any=("classes:", "classes ", "mystic ", "technomancer ")), Signal(1, any=("range:", "range ")),
        Signal(1, any=("duration:", "duration ")),
    ),
    vetoes=(),
    name=_caps_name(r"^(?:school:|classes:)"),
    captures=(
        text("school", r"school:?\s*([a-z]+)"),
        text("_classes", r"classes:?\s*([^\n]+)"),
        text("castingTime", r"casting\s*time:?\s*([^\n;]+)"),
        text("range", r"range:?\s*([^\n;]+)"),
        text("targets", r"(?:targets|target|area|effect):?\s*([^\n;]+)"),
        text("duration", r"duration:?\s*([^\n;]+)"),
        text("savingThrow", r"saving\s*throw:?\s*([^;\n]+)"),
        text("spellResistance", r"spell\s*resistance:?\s*([^\n]+)"),
    ),
    computed={"classes": _spell_classes, "level": _spell_level},
    skip_line=_skip(
        r"^(school|classes|casting\s*time|range|targets|duration|saving\s*throw|spell\s*resistance|target|area|effect):"),
    confidence=(0.4, 0.1, 1.0),
    counted=filled("school", "castingTime", "range", "duration", "savingThrow", "spellResistance"),
    tags=lambda f: [F.lit("spell"), _tag(f.cap("school"))],
)


def _weapon_type(f: Found) -> Column:
    return F.when(f.cap("weaponType") == "", "Small arm").otherwise(f.cap("weaponType"))


WEAPON = Detector(
    category="weapon",
    threshold=3,
    signals=(
        Signal(2, any=("damage",)), Signal(1, any=("range",)), Signal(1, any=("capacity",)), Signal(1, any=("usage",)),
        Signal(1, any=("level",), pattern=r"level\s+\d+"), Signal(2, any=tuple(WEAPON_CLASSES.split("|")), pattern=rf"\b({WEAPON_CLASSES})\b"),
    ),
    vetoes=(),
    name=_caps_name(r"^level\s+(\d+)"),
    captures=(
        integer("level", r"\blevel\s+(\d+)", 1),
        *[text(n, rf"{n}\s+([^;\n]+)") for n in ("damage", "range", "capacity", "usage", "bulk", "special")],
        text("weaponType", rf"\b({WEAPON_CLASSES}|heavy)\b", "Small arm"),
    ),
    computed={"damageType": lambda f: strip(
        F.regexp_extract(f.cap("damage"), r"(?i)(\d+d\d+(?:\+\d+)?)\s*([A-Za-z& ]*)", 2))},
    skip_line=lambda ln, f: _has(ln, "damage|capacity|^level") | (
        _has(ln, rf"\b({WEAPON_CLASSES}|heavy)\b") & (F.length(ln) < 30)),
    confidence=(0.4, 0.1, 1.0),
    counted=filled("damage", "range", "capacity", "usage", "bulk", "special"),
    tags=lambda f: [F.lit("weapon"), _dashed(_weapon_type(f))],
)


def _armor_type(f: Found) -> Column:
    return F.when(f.cap("armorType") == "", "Light Armor").otherwise(f.cap("armorType"))


ARMOR = Detector(
    category="armor",
    threshold=3,
    signals=(
        Signal(2, any=("eac bonus", "eac +", "eac ")), Signal(2, any=("kac bonus", "kac +", "kac ")),
        Signal(1, any=("max dex", "max. dex")), Signal(1, any=("armor check", "acp")), Signal(2, any=tuple(ARMOR_CLASSES.split("|")), pattern=rf"\b({ARMOR_CLASSES})\b"),
    ),
    vetoes=(),
    name=_caps_name(r"^level\s+(\d+)"),
    captures=(
        integer("level", r"\blevel\s+(\d+)", 1),
        integer("eac", r"(?:eac\s+bonus:?\s*|eac\s*\+?\s*)([+-]?\d+)"),
        integer("kac", r"(?:kac\s+bonus:?\s*|kac\s*\+?\s*)([+-]?\d+)"),
        integer("maxDex", r"(?:max\s*dex\s*(?:bonus)?:?\s*|max\.\s*dex:?\s*)([+-]?\d+)"),
        integer("acp", r"(?:armor\s*check\s*(?:penalty)?:?\s*|acp:?\s*)([+-]?\d+)"),
        text("speedAdj", r"(?:speed\s*adjustment:?\s*|speed:?\s*)([^\n;]+)"),
        integer("upgradeSlots", r"(?:upgrade\s*slots:?\s*|slots:?\s*)(\d+)"),
        text("bulk", r"(?:bulk:?\s*)([^\n;]+)"),
        text("armorType", rf"\b({ARMOR_CLASSES})\b", "Light Armor"),
        text("price", r"(?:price|cost):?\s*([^\n;]+)"),
    ),
    skip_line=lambda ln, f: _has(ln, "^level|^price|eac bonus|kac bonus") | (
        _has(ln, rf"\b({ARMOR_CLASSES}|eac|kac|max\s*dex|armor\s*check|acp|upgrade\s*slots|slots)\b") & (F.length(ln) < 30)),
    confidence=(0.4, 0.1, 1.0),
    counted=(*matched("eac", "kac", "maxDex", "acp", "upgradeSlots"), *filled("bulk")),
    tags=lambda f: [F.lit("armor"), _dashed(_armor_type(f))],
)

EQUIPMENT = Detector(
    category="equipment",
    threshold=4,
    signals=(
        Signal(3, any=("price",), pattern=r"price\s*[\d,]+|\bprice\s+\d"), Signal(2, any=("level",), pattern=r"\blevel\s+\d{1,2}\b"),
        Signal(2, any=("bulk",), pattern=r"\bbulk\b"), Signal(1, any=("capacity", "usage"), pattern=r"\bcapacity\b|\busage\b"),
    ),
    vetoes=EQUIPMENT_VETOES,
    name=_title_name(TITLE_NAME_COMMA, 70, no=(":", ";")),
    captures=(
        integer("level", r"\blevel\s+(\d{1,2})\b"),
        text("price", r"price\s*[:;]?\s*([\d,]+(?:\s*credits?)?)"),
        text("_bulk", r"bulk\s*[:;]?\s*([^\n;,]+)"),
        text("hands", r"\bhands?\s*[:;]?\s*([^\n;,]+)"),
        text("capacity", r"capacity\s*[:;]?\s*([^\n;]+)"),
        text("usage", r"usage\s*[:;]?\s*([^\n;]+)"),
        text("upgradeSlots", r"upgrade\s*slots?\s*[:;]?\s*(\d+)"),
    ),
    computed={"bulk": lambda f: F.get(F.split(f.cap("_bulk"), r"\s"), F.lit(0))},
    skip_line=_skip(r"^(level|price|bulk|capacity|usage|upgrade\s*slot|hands?)\b"),
    confidence=(0.45, 0.12, 0.95),
    counted=(*positive("level"), *filled("price", "bulk")),
    tags=lambda f: [F.lit("equipment")],
)

DETECTORS: tuple[Detector, ...] = (
    SPECIES, THEME, CLASS, ARCHETYPE, AUGMENTATION, FEAT, HAZARD, STARSHIP, VEHICLE, NPC, SPELL, WEAPON, ARMOR, EQUIPMENT,
)
