"""Named value rules (V1-V15): Column-to-Column, addressable by name from mapping specs.

``TRANSFORMS`` is the extension point: pass ``{**TRANSFORMS, "mine": fn}`` to the operators that
accept named transforms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentkit.functions.scalars import (
    blank_to_null,
    classify,
    int_prefix,
    lookup,
    number_or,
    split_list,
    strip,
    to_number,
)

# ---------------------------------------------------------------------------------------------
# Lookup tables that decide results.
# ---------------------------------------------------------------------------------------------
ABILITIES = {
    "strength": "str", "str": "str",
    "dexterity": "dex", "dex": "dex",
    "constitution": "con", "con": "con",
    "intelligence": "int", "int": "int",
    "wisdom": "wis", "wis": "wis",
    "charisma": "cha", "cha": "cha",
}
ALIGNMENTS = {
    "lawful good": "lg", "lg": "lg",
    "neutral good": "ng", "ng": "ng",
    "chaotic good": "cg", "cg": "cg",
    "lawful neutral": "ln", "ln": "ln",
    "neutral": "n", "n": "n", "true": "n",
    "chaotic neutral": "cn", "cn": "cn",
    "lawful evil": "le", "le": "le",
    "neutral evil": "ne", "ne": "ne",
    "chaotic evil": "ce", "ce": "ce",
}
DAMAGE_TYPES = {
    "bludgeoning": "B", "b": "B",
    "piercing": "P", "p": "P",
    "slashing": "S", "s": "S",
    "fire": "F", "f": "F",
    "cold": "C", "c": "C",
    "electricity": "E", "e": "E",
    "acid": "A", "a": "A",
    "sonic": "So",
    "force": "force",
}
SPELL_SCHOOLS = {
    "abjuration": "abj", "conjuration": "con", "divination": "div", "enchantment": "enc",
    "evocation": "evo", "illusion": "ill", "necromancy": "nec", "transmutation": "trs",
    "universal": "uni",
}
XP_BY_CR = {
    "1/6": 65, "1/4": 100, "1/3": 135, "1/2": 200,
    "1": 400, "2": 600, "3": 800, "4": 1200, "5": 1600,
    "6": 2400, "7": 3200, "8": 4800, "9": 6400, "10": 9600,
    "11": 12800, "12": 19200, "13": 25600, "14": 38400, "15": 51200,
    "16": 76800, "17": 102400, "18": 153600, "19": 204800, "20": 307200,
    "21": 409600, "22": 614400, "23": 819200, "24": 1228800, "25": 1638400,
}
# Ordered substring tables: (needle, label), first hit wins; second item is the default.
SUBSTRING_RULES: dict[str, tuple[list[tuple[str, str]], str]] = {
    "size": ([("fine", "fine"), ("dim", "diminutive"), ("tiny", "tiny"), ("small", "small"), ("large", "large"),
              ("huge", "huge"), ("garg", "gargantuan"), ("col", "colossal")], "medium"),
    "vehicle_size": ([("small", "small"), ("medium", "medium"), ("large", "large"), ("huge", "huge"),
                      ("garg", "gargantuan"), ("col", "colossal")], "large"),
    "starship_size": ([("tiny", "tiny"), ("small", "small"), ("medium", "medium"), ("large", "large"),
                       ("huge", "huge"), ("garg", "gargantuan"), ("col", "colossal")], "medium"),
    "armor_type": ([("powered", "powered"), ("heavy", "heavy")], "light"),
    "equipment_type": ([("tech", "technological"), ("magic", "magic"), ("hybrid", "hybrid"),
                        ("augment", "augmentation"), ("consum", "consumable")], "technological"),
    "augmentation_type": ([("bio", "biotech"), ("cyber", "cybernetic"), ("magi", "magitech"), ("necro", "necrograft"),
                           ("personal", "personal-upgrade")], "cybernetic"),
    "feat_type": ([("combat", "combat"), ("racial", "racial"), ("species", "racial"), ("skill", "skill"),
                   ("general", "general"), ("story", "story")], "general"),
    "hazard_type": ([("trap", "trap"), ("haunt", "haunt"), ("environ", "environmental")], "trap"),
    "vehicle_type": ([("air", "air"), ("fly", "air"), ("water", "water"), ("sea", "water"), ("aqua", "water")], "land"),
    "maneuver": ([("perfect", "perfect"), ("good", "good"), ("average", "average"), ("poor", "poor"),
                  ("clumsy", "clumsy")], "average"),
    "activation": ([("swift", "swift"), ("bonus", "swift"), ("full", "full"), ("reaction", "reaction"),
                    ("minute", "minute")], "standard"),
    "range_units": ([("close", "close"), ("medium", "medium"), ("long", "long"), ("touch", "touch"),
                     ("personal", "personal"), ("ft", "ft"), ("feet", "ft")], "ft"),
}


def bulk(c: Column, fallback: float = 1.0) -> Column:
    """V1: "L" is 0.1, "-" and blank are 0, otherwise the number (*fallback* if not one, or zero)."""
    s = F.lower(F.coalesce(c, F.lit("")))
    return F.when(s == "l", F.lit(0.1)).when(s.isin("-", ""), F.lit(0.0)).otherwise(number_or(s, fallback))


def fraction(c: Column) -> Column:
    """V2: "a/b" is the quotient, otherwise the number (1 if not one, or zero)."""
    s = F.coalesce(c, F.lit("1"))
    part = F.split(s, "/")
    ratio = F.try_divide(to_number(part[0]), to_number(F.get(part, F.lit(1))))
    return F.when(s.contains("/"), ratio).otherwise(number_or(s, 1))


def max_dex(c: Column) -> Column:
    """V3: blank or a dash means no limit (99), otherwise the number (5 if not one, or zero)."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(s.isin("", "-", "—"), F.lit(99.0)).otherwise(number_or(s, 5))


def ability(c: Column, default: str = "str") -> Column:
    """V4: ability name to its three-letter code."""
    table = {**ABILITIES, "any": "any"} if default == "any" else ABILITIES
    return lookup(F.lower(F.coalesce(c, F.lit(""))), table, default)


def items(c: Column) -> Column:
    """V5: comma or semicolon list."""
    return split_list(c)


def substring_rule(name: str) -> Callable[[Column], Column]:
    """One of the ordered substring tables as a function."""
    table, default = SUBSTRING_RULES[name]
    return lambda c: classify(F.coalesce(c, F.lit("")), table, default)


def alignment(c: Column) -> Column:
    """V7."""
    return lookup(F.lower(F.coalesce(c, F.lit(""))), ALIGNMENTS, "n")


def flag(c: Column) -> Column:
    """V8: true, yes and 1 (any case) are true, everything else is false."""
    return F.coalesce(F.lower(c).isin("true", "yes", "1"), F.lit(False))


def flag_or(c: Column, default: bool = False) -> Column:
    """V8, second dialect: also knows false/no/0 and falls back to *default* otherwise."""
    low = F.lower(c)
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False).otherwise(default)


def damage_types(c: Column) -> Column:
    """V9: list of damage type codes; unknown words are kept in upper case."""
    words = F.split(F.coalesce(c, F.lit("")), r"[\s,&]+")
    return F.filter(
        F.transform(words, lambda w: lookup(F.lower(w), DAMAGE_TYPES, F.upper(w))), lambda w: w != ""
    )


def xp_for_cr(c: Column) -> Column:
    """Experience for a challenge rating text, 400 when unknown."""
    pairs = [x for k, v in XP_BY_CR.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(400.0))


def ability_mod(c: Column) -> Column:
    """V11."""
    return F.floor((c - 10) / 2).cast("double")


def skills(c: Column) -> Column:
    """V12: "Name +N, ..." to a map of compact lower-case name to bonus; last duplicate wins."""
    pattern = r"^(\w[\w\s]*?)\s*([+-]\d+)$"
    entry = F.transform(
        F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda e: e.rlike(pattern)),
        lambda e: F.struct(
            F.regexp_replace(F.lower(strip(F.regexp_extract(e, pattern, 1))), r"\s+", "").alias("name"),
            F.regexp_extract(e, pattern, 2).try_cast("int").alias("bonus"),
        ),
    )
    names = F.array_distinct(F.transform(entry, lambda e: e["name"]))
    return F.map_from_arrays(
        names,
        F.transform(names, lambda n: F.element_at(F.filter(entry, lambda e: e["name"] == n), -1)["bonus"]),
    )


def progression(c: Column) -> Column:
    """Save and attack progressions."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(low.contains("full") | low.isin("1", "good"), "full")
        .when(low.contains("3") | (low == "medium"), "3/4")
        .when(low.contains("1/2") | low.contains("half") | (low == "poor"), "1/2")
        .otherwise("poor")
    )


def spell_school(c: Column) -> Column:
    """School name to code; unknown names are kept in lower case."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return lookup(low, SPELL_SCHOOLS, low)


def levels(c: Column) -> Column:
    """List of integers between 1 and 20."""
    parsed = F.transform(split_list(c), int_prefix)
    return F.filter(parsed, lambda n: n.isNotNull() & n.between(1, 20))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters to one dash, one dash trimmed at each end, 40 characters."""
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 40)


def speed_adjustment(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    return F.when(s.isin("", "-", "—"), F.lit(0.0)).otherwise(
        F.coalesce(int_prefix(s).cast("double"), F.lit(0.0))
    )


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "parseBulk": bulk,
    "parseCR": fraction,
    "parseMaxDex": max_dex,
    "parseAbility": ability,
    "parseList": items,
    "parseSize": substring_rule("size"),
    "parseAlignment": alignment,
    "damageTypes": damage_types,
    "xpForCr": xp_for_cr,
    "abilityMod": lambda c: ability_mod(to_number(c)),
    "skills": skills,
    "progression": progression,
    "spellSchool": spell_school,
    "levels": levels,
    "slug": slug,
    "number": to_number,
    "flag": flag,
    "blankToNull": blank_to_null,
    **{name: substring_rule(name) for name in SUBSTRING_RULES},
}
