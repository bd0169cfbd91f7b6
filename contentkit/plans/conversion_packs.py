"""Conversion packs (P11): the target document of each category as a nested spec.

A pack is a function from a :class:`Source` (the record seen through typed accessors) to nested
dicts and lists of columns; :func:`contentkit.operators.convert.nest` turns it into one struct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentkit.functions import rules as R
from contentkit.functions.scalars import first_nonzero, first_text, float_prefix, lookup, split_list, to_number
from contentkit.functions.variants import get_as, get_value, type_of

# ---------------------------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------------------------
MELEE_WORDS = ("battleglove", "club", "dagger", "longsword", "sword", "melee")
SPECIES_SIZES = ("fine", "diminutive", "tiny", "small", "medium", "large", "huge", "gargantuan", "colossal")
ABILITY_KEYS = ("str", "dex", "con", "int", "wis", "cha")
JOURNAL_PAGE_NAMES = {"pdf": "PDF Reference", "rules": "Rules Reference", "lore": "Lore", "sourcebook": "Entry"}


class Source:
    """Typed access to a record's payload and columns.

    The payload is unpacked once per row into two maps (see :func:`unpack`), so a field access is
    a map lookup and the compiled plan stays small.
    """

    def __init__(self, payload: str = "raw_content") -> None:
        self.payload = F.col(payload)

    @staticmethod
    def unpack(payload: Column) -> dict[str, Column]:
        """The helper columns every pack reads: texts by key, then numbers by key."""
        texts = F.coalesce(F.try_variant_get(payload, "$", "map<string,string>"), F.create_map().cast("map<string,string>"))
        return {"_texts": texts}

    @staticmethod
    def numbers() -> dict[str, Column]:
        return {"_numbers": F.transform_values("_texts", lambda k, v: to_number(v))}

    @staticmethod
    def _lookup(table: str, key: str) -> str:
        spellings = dict.fromkeys((key, key.lower()))
        return ", ".join(f"try_element_at({table}, '{k}')" for k in spellings)

    def raw(self, key: str) -> Column:
        """Text of a key, null when absent or JSON null."""
        return F.expr(f"coalesce({self._lookup('_texts', key)})")

    def text(self, *keys: str, default: str | Column = "") -> Column:
        """First non-empty text among *keys*; the default stands in for an absent last key."""
        *head, tail = keys
        firsts = [f"nullif(coalesce({self._lookup('_texts', k)}), '')" for k in head]
        last = self._lookup("_texts", tail)
        if isinstance(default, Column):
            return F.coalesce(*[F.expr(e) for e in firsts], F.expr(f"coalesce({last})"), default)
        return F.expr(f"coalesce({', '.join([*firsts, last])}, '{default}')")

    def num(self, *keys: str, default: float | Column = 0) -> Column:
        """First non-zero number among *keys*; the default stands in for an absent or odd last key."""
        *head, tail = keys
        firsts = [f"nullif(coalesce({self._lookup('_numbers', k)}), 0D)" for k in head]
        last = self._lookup("_numbers", tail)
        if isinstance(default, Column):
            return F.coalesce(*[F.expr(e) for e in firsts], F.expr(f"coalesce({last})"), default)
        return F.expr(f"coalesce({', '.join([*firsts, last])}, {float(default)}D)")

    def flag(self, key: str) -> Column:
        return R.flag(self.raw(key))

    def kind(self, rule: str, *keys: str, default: str = "") -> Column:
        return R.substring_rule(rule)(self.text(*keys, default=default))

    def list(self, key: str, separators: str = "[,;]") -> Column:
        return split_list(self.text(key), separators)

    @property
    def description(self) -> dict:
        return {"value": self.text("description"), "chat": "", "unidentified": ""}

    @property
    def source(self) -> Column:
        return F.concat(F.coalesce("source_book", F.lit("")), F.lit(" pg. "), F.coalesce("page_number", F.lit(0)).cast("string"))

    @property
    def rarity(self) -> Column:
        return self.text("rarity", default="common")

    def header(self) -> dict:
        return {"description": self.description, "source": self.source}

    def goods(self, bulk_default: str, bulk_fallback: float) -> dict:
        return {
            "quantity": self.num("quantity", default=1),
            "bulk": R.bulk(self.text("bulk", default=bulk_default), bulk_fallback),
            "level": self.num("level", default=1),
            "price": self.num("price"),
            **self.header(),
        }


def pair(value: Column, *names: str) -> dict:
    return {n: value for n in names}


def weapon(s: Source) -> dict:
    melee = F.lit(False)
    kind = F.lower(s.text("type"))
    for word in MELEE_WORDS:
        melee = melee | kind.contains(word)
    critical = s.text("critical", "critEffect")
    return {
        **s.goods("1", 1),
        "type": first_text(s.text("weaponType", "type"), F.lit("smallArm")),
        "weaponType": F.when(melee, "melee").otherwise("ranged"),
        "damage": [{
            "formula": first_text(s.text("damageFormula", "damage"), F.lit("1d6")),
            "type": {"values": R.damage_types(first_text(s.text("damageType", "damageTypes"), F.lit("B"))), "custom": ""},
        }],
        "critical": {"parts": F.filter(F.array(critical), lambda c: c != "")},
        "range": {
            "value": s.num("range", default=F.when(melee, 5.0).otherwise(30.0)), "units": "ft", "additional": "",
            "increment": s.num("rangeIncrement", default=F.when(melee, 0.0).otherwise(5.0)),
        },
        "capacity": pair(s.num("capacity", default=20), "value", "max"),
        "usage": {"value": s.num("usage", default=1), "per": "shot"},
        "special": s.text("special"),
        "equipped": False,
        "proficient": False,
        "rarity": s.rarity,
    }


def armor(s: Source) -> dict:
    return {
        **s.goods("1", 1),
        "type": s.kind("armor_type", "type", "armorType"),
        "armor": {"eac": s.num("eac"), "kac": s.num("kac")},
        "maxDexBonus": R.max_dex(s.text("maxDex", "maxDexBonus")),
        "armorCheckPenalty": s.num("acp", "armorCheckPenalty"),
        "speedAdjustment": R.speed_adjustment(s.text("speedAdjust", "speedAdjustment")),
        "upgradeSlots": s.num("upgradeSlots"),
        "equipped": False,
        "rarity": s.rarity,
    }


def equipment(s: Source) -> dict:
    return {
        **s.goods("L", 0.1),
        "type": s.kind("equipment_type", "type", "equipType"),
        "capacity": pair(s.num("capacity"), "value", "max"),
        "usage": {"value": s.num("usage"), "per": s.text("usagePer", default="charge")},
        "equipped": False,
        "rarity": s.rarity,
    }


def augmentation(s: Source) -> dict:
    return {
        **s.goods("0", 0),
        "type": s.kind("augmentation_type", "type", "augType"),
        "system": s.text("system", "bodySlot"),
        "equipped": False,
        "rarity": s.rarity,
    }


def feat(s: Source) -> dict:
    return {
        **s.header(),
        "type": s.kind("feat_type", "featType", "type"),
        "prerequisites": {"parts": split_list(s.text("prerequisites", "prereqs"), ";")},
        "activation": {
            "type": first_text(s.text("activation"), F.lit("passive")),
            "cost": s.num("activationCost"), "condition": s.text("activationCondition"),
        },
        "abilityMods": {"parts": []},
        "modifiers": [],
        "rarity": s.rarity,
    }


def spell(s: Source) -> dict:
    damage = s.text("damage", "damageFormula")
    part = F.struct(
        damage.alias("formula"),
        F.struct(F.array().cast("array<string>").alias("values"), F.lit("").alias("custom")).alias("type"))
    return {
        **s.header(),
        "level": s.num("level", default=1),
        "school": R.spell_school(s.text("school")),
        "subschool": s.text("subschool"),
        "descriptors": {"value": F.transform(s.list("descriptors"), F.lower), "custom": ""},
        "activation": {"type": s.kind("activation", "castingTime", "activation"), "cost": 1, "condition": ""},
        "range": {"value": s.text("range"), "units": s.kind("range_units", "range"), "additional": ""},
        "area": {"value": s.text("area"), "units": "ft", "shape": s.text("areaShape")},
        "effect": {"value": s.text("effect"), "units": "", "shape": ""},
        "targets": {"value": s.text("targets")},
        "duration": {"value": s.text("duration"), "units": s.text("durationUnits"), "dismissible": s.flag("dismissible")},
        "save": {"type": s.text("save", "savingThrow"), "dc": s.text("saveDC"), "harmless": s.flag("harmless")},
        "sr": s.flag("sr"),
        "damage": {"parts": F.filter(F.array(part), lambda p: p["formula"] != "")},
        "rarity": s.rarity,
    }


def species(s: Source) -> dict:
    def typed(key: str, kind: str) -> Column:
        return F.when(type_of(get_value(s.payload, key)) == kind, s.raw(key))

    size = F.lower(typed("size", "string"))
    mods = F.coalesce(get_as(s.payload, "abilityMods", "array<struct<mod:string,ability:string>>"),
                      F.array().cast("array<struct<mod:string,ability:string>>"))
    traits = get_as(s.payload, "racialAbilities", "array<struct<name:string,type:string,description:string>>")
    listed = F.transform(traits, lambda t: F.concat(
        F.lit("<li><strong>"), F.coalesce(t["name"], F.lit("Racial Ability")),
        F.when(F.coalesce(t["type"], F.lit("")) != "", F.concat(F.lit(" ("), t["type"], F.lit(")"))).otherwise(""),
        F.lit(":</strong> "), F.coalesce(t["description"], F.lit("")), F.lit("</li>")))
    html = F.when(F.size(traits) > 0, F.concat(F.lit("<ul>"), F.array_join(listed, ""), F.lit("</ul>")))
    text = s.text("description")
    full = F.when(html.isNotNull(), F.btrim(F.concat(text, F.lit("\n\n"), html), F.lit(" \t\r\n"))).otherwise(text)
    return {
        "description": {"value": full, "chat": "", "unidentified": ""},
        "source": s.source,
        "hp": F.coalesce(typed("hp", "number").try_cast("double"), F.lit(4.0)),
        "size": F.when(size.isin(list(SPECIES_SIZES)), size).otherwise("medium"),
        "subtype": F.coalesce(typed("subtype", "string"), F.lit("humanoid")),
        "abilityMods": {"parts": F.transform(
            F.filter(mods, lambda m: (F.coalesce(m["mod"], F.lit("")) != "") & (F.coalesce(m["ability"], F.lit("")) != "")),
            lambda m: F.array(m["mod"], m["ability"]))},
        "damage": {"parts": []},
        "modifiers": [],
        "rarity": s.rarity,
    }


def theme(s: Source) -> dict:
    return {
        **s.header(),
        "abilityMod": {"ability": R.ability(s.text("abilityMod", "keyAbility"), "any"), "value": s.num("abilityModValue", default=1)},
        "skill": s.text("classSkill", "themeSkill"),
        "themeKnowledge": {"subtype": s.text("knowledgeSubtype"), "skill": s.text("knowledgeSkill")},
        "rarity": s.rarity,
    }


def character_class(s: Source) -> dict:
    return {
        **s.header(),
        "keyAbility": R.ability(s.text("keyAbility", "abilityScore")),
        "hp": s.num("hp", default=6),
        "sp": s.num("sp", default=6),
        "skillRanks": s.num("skillRanks", default=4),
        "levels": 20,
        "bab": R.progression(s.text("bab", "babProgression")),
        "saves": {k: R.progression(s.text(f"{k}Save", k, default="poor")) for k in ("fort", "ref", "will")},
        "proficiencies": {"weapon": s.list("weaponProficiencies"), "armor": s.list("armorProficiencies")},
        "rarity": s.rarity,
    }


def archetype(s: Source) -> dict:
    return {
        **s.header(),
        "levels": R.levels(s.text("levels", "level")),
        "replaces": split_list(s.text("replaces", "replacedFeatures")),
        "archetype": {"name": s.text("archetype", "archetypeName")},
        "rarity": s.rarity,
    }


def _pool(value: Column | float) -> dict:
    return {"value": value, "max": value, "min": 0}


def _save(value: Column) -> dict:
    return {"bonus": value, "misc": 0, "value": value}


def npc(s: Source) -> dict:
    init = s.num("initiative", "init")
    skills = R.skills(s.text("skills"))
    scores = {a: s.num(a, default=10) for a in ABILITY_KEYS}
    return {
        "details": {
            "alignment": s.text("alignment", default="N"),
            "cr": R.fraction(s.text("cr", "challengeRating", default="1")),
            "xp": {"value": s.num("xp", default=R.xp_for_cr(s.text("cr", default="1")))},
            "source": s.source,
            "type": s.text("creatureType", "type"),
            "subtype": s.text("creatureSubtype", "subtype"),
            "size": s.kind("size", "size", default="medium"),
            "biography": {"value": s.text("description")},
        },
        "attributes": {
            "eac": {"value": s.num("eac", default=10), "min": 0},
            "kac": {"value": s.num("kac", default=10), "min": 0},
            "hp": _pool(s.num("hp", default=6)),
            "sp": _pool(0),
            "init": {"value": init, "bonus": 0, "total": init},
            "fort": _save(s.num("fort")), "reflex": _save(s.num("ref")), "will": _save(s.num("will")),
            "bab": s.num("bab"),
            "cmd": {"value": s.num("cmd", default=10)},
        },
        "abilities": {a: {"value": v, "min": 3, "misc": 0, "mod": R.ability_mod(v), "base": v} for a, v in scores.items()},
        "skills": F.transform_values(skills, lambda k, v: F.struct(
            F.lit(0.0).alias("value"), v.alias("misc"), F.lit(0.0).alias("ranks"), v.alias("mod"))),
        "traits": {
            "dr": s.text("dr", "damageReduction"),
            "immunities": {"value": s.list("immunities")},
            "weaknesses": {"value": s.list("weaknesses")},
            "resistances": s.text("resistances", "sr"),
            "senses": s.text("senses"),
            "languages": {"value": s.list("languages"), "custom": ""},
        },
        # "40 ft., climb 20 ft." counts as 40: the leading number is taken from text with units.
        "speed": {"value": s.num("speed", default=F.coalesce(float_prefix(s.raw("speed")), F.lit(30.0))),
                  "special": s.text("otherSpeed")},
    }


def vehicle(s: Source) -> dict:
    speed = s.num("speed", default=30)
    return {
        "details": {"source": s.source, "type": s.kind("vehicle_type", "type", "vehicleType"),
                    "biography": {"value": s.text("description")}},
        "attributes": {
            "eac": {"value": s.num("eac", default=10), "min": 0},
            "kac": {"value": s.num("kac", default=10), "min": 0},
            "hp": _pool(s.num("hp", default=20)),
            "hardness": s.num("hardness"),
            "cover": s.text("cover", default="total"),
        },
        "frame": {"size": s.kind("vehicle_size", "size", default="large"), "bulk": s.num("bulk", default=50),
                  "price": s.num("price"), "level": s.num("level", default=1)},
        "movement": {
            "speed": speed, "speedType": s.text("speedType", default="land"),
            "fullSpeed": first_nonzero(s.num("fullSpeed"), speed * 3),
            "pilotingBonus": s.num("pilotingBonus"), "driveDC": s.num("driveDC", default=15),
            "maneuver": s.kind("maneuver", "maneuver"),
        },
        "crew": {"minimumCrew": s.num("minCrew", "crew", default=1),
                 "maximumPassengers": s.num("maxPassengers", "passengers")},
    }


def starship(s: Source) -> dict:
    hp = s.num("hp", default=30)
    arcs = {"forward": "Forward", "starboard": "Starboard", "port": "Port", "aft": "Aft"}
    return {
        "details": {
            "source": s.source, "biography": {"value": s.text("description")}, "frame": s.text("frame"),
            "manufacturer": s.text("manufacturer"), "model": s.text("model"), "tier": R.fraction(s.text("tier", default="1")),
            "size": s.kind("starship_size", "size", default="medium"), "price": s.num("price"),
        },
        "attributes": {
            "hp": _pool(hp), "dt": s.num("dt"), "ct": F.floor(hp / 5).cast("double"),
            "shields": {k: s.num(f"shields{v}", "shields") for k, v in arcs.items()},
            "ac": {"value": s.num("ac", default=10), "misc": 0},
            "tl": {"value": s.num("tl", default=10), "misc": 0},
            **pair(s.num("pcu", default=30), "pcu", "powerCoreUnits"),
            "bsp": s.num("bsp"),
        },
        "movement": {"speed": s.num("speed", default=6), "maneuverability": s.kind("maneuver", "maneuver", "maneuverability")},
        "crew": {
            "captain": {"limit": 1}, "pilot": {"limit": 1}, "gunners": {"limit": s.num("gunners", default=1)},
            "engineers": {"limit": s.num("engineers", default=1)}, "science": {"limit": s.num("scienceOfficers", default=1)},
        },
    }


def hazard(s: Source) -> dict:
    return {
        "details": {
            "source": s.source, "type": s.kind("hazard_type", "type", "hazardType"),
            "cr": R.fraction(s.text("cr", "challengeRating", default="1")), "xp": {"value": s.num("xp", default=400)},
            "biography": {"value": s.text("description")},
            **{k: s.text(k) for k in ("reset", "disarm", "trigger", "effect")},
        },
        "attributes": {
            "hp": _pool(s.num("hp")), "hardness": s.num("hardness"),
            "noticePerception": s.num("noticePerception", "noticedc", default=20),
            "disableEngineering": s.num("disableEngineering", "disabledc", default=20),
            "senses": s.text("senses"),
        },
        "saves": {t: {"value": s.num(k)} for t, k in (("fort", "fort"), ("reflex", "ref"), ("will", "will"))},
    }


def journal_page(s: Source) -> dict:
    """The single page of a journal entry; its layout depends on ``journalType``."""
    kind = s.text("journalType", default="sourcebook")
    text = s.text("description")
    name, tags = F.col("name"), F.coalesce("tags", F.array().cast("array<string>"))

    def tag(before: str, value: Column, after: str, needed: bool = True) -> Column:
        whole = F.concat(F.lit(before), value, F.lit(after))
        return F.when(value != "", whole) if needed else whole

    def text_or(key: str) -> Column:
        return F.coalesce(s.raw(key), text)

    head = [tag("<h2>", name, "</h2>", False), tag("<p><em>Source: ", s.source, "</em></p>", False)]
    url = s.text("pdfUrl")
    bodies = {
        "pdf": [*head, tag('<p><a href="', url, '" target="_blank">Open PDF</a></p>'), tag("<p>", text, "</p>")],
        "rules": [*head, tag('<div class="rule-text">', text_or("ruleText"), "</div>", False)],
        "lore": [*head, tag("<p>", text_or("loreText"), "</p>", False),
                 tag("<p><strong>Tags:</strong> ", F.when(F.size(tags) > 0, F.array_join(tags, ", ")), "</p>")],
    }
    other = [
        *head, tag("<p><strong>Publisher:</strong> ", F.coalesce("publisher", F.lit("")), "</p>", False),
        tag("<p><strong>Author:</strong> ", F.col("author"), "</p>"), tag("<hr/><p>", text, "</p>"),
        tag("<hr/><p><strong>GM Notes:</strong> ", F.col("notes"), "</p>"),
    ]
    content = F.lit(None).cast("string")
    for key, parts in bodies.items():
        content = F.when(kind == key, F.concat_ws("\n", *parts)).otherwise(content)
    content = F.coalesce(content, F.concat_ws("\n", *other))
    return {"name": lookup(kind, JOURNAL_PAGE_NAMES, "Entry"), "type": "text", "text": {"content": content, "format": 1}}


PACKS = {
    "weapon": weapon, "armor": armor, "equipment": equipment, "augmentation": augmentation, "feat": feat, "spell": spell,
    "race": species, "theme": theme, "class": character_class, "archetypeFeature": archetype, "npc": npc,
    "vehicle": vehicle, "starship": starship, "hazard": hazard,
}
