"""Mapping rules per category (P1), declarative field files, field maps and skeletons."""

from __future__ import annotations

from contentkit.operators.conform import MapRule, alias, default, exact, transform

# ---------------------------------------------------------------------------------------------
# Base rules, in application order.
# ---------------------------------------------------------------------------------------------
ABILITY_KEYS = ("str", "dex", "con", "int", "wis", "cha")


def num(target: str, *sources: str, default: float = 0) -> MapRule:
    return alias(target, *sources, coerce="number", default=default)


def txt(target: str, *sources: str, default: str = "") -> MapRule:
    return alias(target, *sources, coerce="string", default=default)


GOODS = (num("level", "level", default=1), num("price", "price"), num("quantity", "quantity", default=1),
         transform("bulk", "bulk", "parseBulk", default=1))
DESCRIPTION = txt("description.value", "description")

BASE_RULES: dict[str, tuple[MapRule, ...]] = {
    "weapon": (
        *GOODS,
        txt("damage[0].formula", "damage", "damageFormula", default="1d6"),
        num("range.value", "range", default=30), num("capacity.max", "capacity", default=20),
        num("usage.value", "usage", default=1), txt("special", "special"), txt("rarity", "rarity", default="common"),
        DESCRIPTION, default("equipped", False), default("proficient", False),
    ),
    "armor": (
        *GOODS,
        num("armor.eac", "eac"), num("armor.kac", "kac"), transform("maxDexBonus", "maxDex", "parseMaxDex", default=99),
        num("armorCheckPenalty", "acp", "armorCheckPenalty"), num("upgradeSlots", "upgradeSlots"),
        DESCRIPTION, default("equipped", False),
    ),
    "feat": (
        DESCRIPTION, transform("prerequisites.parts", "prerequisites", "parseList", default=[]),
        txt("activation.type", "activation", default="passive"), txt("rarity", "rarity", default="common"),
    ),
    "spell": (
        num("level", "level", default=1), txt("school", "school", default="uni"), txt("range.value", "range"),
        txt("duration.value", "duration"), txt("save.type", "save", "savingThrow"),
        alias("sr", "sr", coerce="boolean", default=False), DESCRIPTION,
    ),
    "npc": (
        transform("details.cr", "cr", "parseCR", default=1), txt("details.alignment", "alignment", default="n"),
        transform("details.size", "size", "parseSize", default="medium"),
        num("attributes.eac.value", "eac", default=10), num("attributes.kac.value", "kac", default=10),
        num("attributes.hp.max", "hp", default=6), num("attributes.fort.bonus", "fort"),
        num("attributes.reflex.bonus", "ref"), num("attributes.will.bonus", "will"),
        *[num(f"abilities.{a}.value", a, default=10) for a in ABILITY_KEYS],
        num("speed.value", "speed", default=30), txt("details.biography.value", "description"),
    ),
}

# Declarative field files: (source, target, type, default), applied one after the other.
FIELD_FILES: dict[str, tuple[tuple[str, str, str, object], ...]] = {
    "weapon": (
        ("level", "level", "number", 1), ("price", "price", "number", 0), ("quantity", "quantity", "number", 1),
        ("bulk", "bulk", "string", "1"), ("damage", "damage[0].formula", "string", "1d6"),
        ("damageFormula", "damage[0].formula", "string", "1d6"), ("damageType", "damage[0].type", "string", "B"),
        ("critical", "critical.parts[0]", "string", ""), ("critEffect", "critical.parts[0]", "string", ""),
        ("range", "range.value", "number", 30), ("rangeIncrement", "range.increment", "number", 5),
        ("capacity", "capacity.max", "number", 20), ("usage", "usage.value", "number", 1),
        ("special", "special", "string", ""), ("rarity", "rarity", "string", "common"),
        ("description", "description.value", "string", ""),
    ),
    "armor": (
        ("level", "level", "number", 1), ("price", "price", "number", 0), ("quantity", "quantity", "number", 1),
        ("bulk", "bulk", "string", "1"), ("eac", "armor.eac", "number", 0), ("kac", "armor.kac", "number", 0),
        ("maxDex", "maxDexBonus", "number", 99), ("maxDexBonus", "maxDexBonus", "number", 99),
        ("acp", "armorCheckPenalty", "number", 0), ("armorCheckPenalty", "armorCheckPenalty", "number", 0),
        ("speedAdjust", "speedAdjustment", "number", 0), ("upgradeSlots", "upgradeSlots", "number", 0),
        ("rarity", "rarity", "string", "common"), ("description", "description.value", "string", ""),
    ),
    "spell": (
        ("level", "level", "number", 1), ("school", "school", "string", "uni"), ("subschool", "subschool", "string", ""),
        ("descriptors", "descriptors.value", "array", []), ("castingTime", "activation.type", "string", "standard"),
        ("activation", "activation.type", "string", "standard"), ("range", "range.value", "string", ""),
        ("area", "area.value", "string", ""), ("targets", "targets.value", "string", ""),
        ("duration", "duration.value", "string", ""), ("save", "save.type", "string", ""),
        ("savingThrow", "save.type", "string", ""), ("saveDC", "save.dc", "string", ""), ("sr", "sr", "boolean", False),
        ("damage", "damage.parts[0][0]", "string", ""), ("damageFormula", "damage.parts[0][0]", "string", ""),
        ("rarity", "rarity", "string", "common"), ("description", "description.value", "string", ""),
    ),
    "feat": (
        ("featType", "type", "string", "general"), ("type", "type", "string", "general"),
        ("prerequisites", "prerequisites.parts", "array", []), ("prereqs", "prerequisites.parts", "array", []),
        ("activation", "activation.type", "string", "passive"), ("activationCost", "activation.cost", "number", 0),
        ("activationCondition", "activation.condition", "string", ""), ("rarity", "rarity", "string", "common"),
        ("description", "description.value", "string", ""),
    ),
    "npc": (
        ("cr", "details.cr", "string", "1"), ("challengeRating", "details.cr", "string", "1"),
        ("xp", "details.xp.value", "number", 400), ("alignment", "details.alignment", "string", "N"),
        ("size", "details.size", "string", "medium"), ("creatureType", "details.type", "string", ""),
        ("type", "details.type", "string", ""), ("creatureSubtype", "details.subtype", "string", ""),
        ("subtype", "details.subtype", "string", ""), ("eac", "attributes.eac.value", "number", 10),
        ("kac", "attributes.kac.value", "number", 10), ("hp", "attributes.hp.max", "number", 6),
        ("fort", "attributes.fort.bonus", "number", 0), ("ref", "attributes.reflex.bonus", "number", 0),
        ("will", "attributes.will.bonus", "number", 0), ("init", "attributes.init.value", "number", 0),
        ("initiative", "attributes.init.value", "number", 0), ("bab", "attributes.bab", "number", 0),
        *[(a, f"abilities.{a}.value", "number", 10) for a in ABILITY_KEYS],
        ("speed", "speed.value", "number", 30), ("senses", "traits.senses", "string", ""),
        ("immunities", "traits.immunities.value", "array", []), ("languages", "traits.languages.value", "array", []),
        ("dr", "traits.dr", "string", ""), ("description", "details.biography.value", "string", ""),
    ),
}


def merged_file_rules(category: str) -> tuple[MapRule, ...]:
    """A declarative file as alias rules.

    Several entries may share a target; the later entry wins where its source is present, and the
    default applies only where none is.
    """
    by_target: dict[str, tuple[list[str], str, object]] = {}
    for source, target, kind, fallback in FIELD_FILES[category]:
        sources, _, _ = by_target.setdefault(target, ([], kind, fallback))
        sources.insert(0, source)
    return tuple(alias(t, *s, coerce=k, default=d) for t, (s, k, d) in by_target.items())


def flat_file_rules(category: str) -> tuple[MapRule, ...]:
    """A declarative file applied literally: entry by entry, each with its own default."""
    return tuple(exact(t, s, coerce=k, default=d) for s, t, k, d in FIELD_FILES[category])


# ---------------------------------------------------------------------------------------------
# Source field to target path, per category.
# ---------------------------------------------------------------------------------------------
FIELD_MAPS: dict[str, dict[str, str]] = {
    "weapon": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
        "level": "system.level",
        "price": "system.price",
        "bulk": "system.bulk",
        "type": "system.type",
        "rarity": "system.rarity",
        "equipped": "system.equipped",
        "weaponType": "system.weaponType",
        "damage": "system.damage",
        "damageFormula": "system.damage[0].formula",
        "damageType": "system.damage[0].type",
        "critical": "system.critical.parts",
        "range": "system.range.value",
        "capacity": "system.capacity.max",
        "usage": "system.usage.value",
        "special": "system.special",
    },
    "armor": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
        "level": "system.level",
        "price": "system.price",
        "bulk": "system.bulk",
        "type": "system.type",
        "rarity": "system.rarity",
        "equipped": "system.equipped",
        "eac": "system.armor.eac",
        "kac": "system.armor.kac",
        "maxDex": "system.maxDexBonus",
        "acp": "system.armorCheckPenalty",
        "speedAdjust": "system.speedAdjustment",
        "upgradeSlots": "system.upgradeSlots",
    },
    "equipment": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
        "level": "system.level",
        "price": "system.price",
        "bulk": "system.bulk",
        "type": "system.type",
        "rarity": "system.rarity",
        "equipped": "system.equipped",
        "capacity": "system.capacity.max",
        "usage": "system.usage.value",
    },
    "augmentation": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
        "level": "system.level",
        "price": "system.price",
        "type": "system.type",
        "system": "system.system",
        "capacity": "system.capacity.max",
    },
    "feat": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
        "type": "system.type",
        "prerequisites": "system.prerequisites.value",
    },
    "spell": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
        "level": "system.level",
        "school": "system.school",
        "castingTime": "system.activation.type",
        "duration": "system.duration.value",
        "range": "system.range.value",
        "target": "system.target.value",
        "save": "system.save.type",
        "saveDC": "system.save.dc",
        "sr": "system.sr",
        "mysticLevel": "system.lists.mystic",
        "technomancerLevel": "system.lists.technomancer",
        "witchwarperLevel": "system.lists.witchwarper",
        "precogLevel": "system.lists.precog",
    },
    "race": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
        "type": "system.type",
        "subtype": "system.subtype",
        "hp": "system.hit_points",
        "size": "system.size",
        "speed": "system.speed.base",
        "strMod": "system.abilityMods.str",
        "dexMod": "system.abilityMods.dex",
        "conMod": "system.abilityMods.con",
        "intMod": "system.abilityMods.int",
        "wisMod": "system.abilityMods.wis",
        "chaMod": "system.abilityMods.cha",
    },
    "theme": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
        "abilityModAbility": "system.abilityMod.ability",
        "abilityModValue": "system.abilityMod.value",
    },
    "class": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
        "hpPerLevel": "system.hpPerLevel",
        "sp": "system.sp",
        "bab": "system.bab",
        "skillRanksPerLevel": "system.skillRanksPerLevel",
        "keyAbility": "system.keyAbility",
    },
    "archetypeFeature": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
    },
    "npc": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
        "hp": "system.attributes.hp.value",
        "hpMax": "system.attributes.hp.max",
        "eac": "system.attributes.eac.value",
        "kac": "system.attributes.kac.value",
        "cr": "system.details.cr",
        "xp": "system.details.xp.value",
        "alignment": "system.details.alignment",
        "type": "system.details.type",
        "subtype": "system.details.subtype",
        "sp": "system.attributes.sp.value",
        "fort": "system.attributes.fort.value",
        "ref": "system.attributes.ref.value",
        "will": "system.attributes.will.value",
        "speed": "system.attributes.speed.value",
        "str": "system.abilities.str.value",
        "dex": "system.abilities.dex.value",
        "con": "system.abilities.con.value",
        "int": "system.abilities.int.value",
        "wis": "system.abilities.wis.value",
        "cha": "system.abilities.cha.value",
    },
    "starship": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
        "hp": "system.attributes.hp.value",
        "hpMax": "system.attributes.hp.max",
        "tier": "system.details.tier",
        "frame": "system.details.frame",
        "size": "system.details.size",
        "speed": "system.attributes.speed",
        "maneuverability": "system.attributes.maneuverability",
    },
    "vehicle": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
        "hp": "system.attributes.hp.value",
        "hpMax": "system.attributes.hp.max",
        "eac": "system.attributes.eac.value",
        "kac": "system.attributes.kac.value",
        "level": "system.details.level",
        "price": "system.details.price",
        "type": "system.details.type",
        "landSpeed": "system.attributes.speed.land",
    },
    "hazard": {
        "name": "name",
        "description": "system.description.value",
        "source": "system.source",
        "cr": "system.details.cr",
        "xp": "system.details.xp.value",
        "type": "system.details.type",
    },
    "journal": {
        "name": "name",
    },
}


# ---------------------------------------------------------------------------------------------
# Default target data per category.
# ---------------------------------------------------------------------------------------------
def _pool(value: int) -> dict:
    return {"value": value, "min": 0, "max": value}


_TEXTS = {"description": {"value": "", "chat": "", "unidentified": ""}, "source": ""}
_ITEM = {"level": 1, "price": 0, "equipped": False, "identified": True, "quantity": 1}
_EMPTY_USE = {"capacity": {"value": 0, "max": 0}, "usage": {"value": 0, "per": ""}}

SKELETONS: dict[str, dict] = {
    "weapon": {**_TEXTS, **_ITEM, "type": "small arm", "weaponType": "ranged", "bulk": "L",
               "damage": [{"formula": "1d6", "type": "B"}], "critical": {"parts": []},
               "range": {"value": 30, "units": "ft"}, "capacity": {"value": 20, "max": 20},
               "usage": {"value": 1, "per": "shot"}, "special": "", "properties": {}, "rarity": "common"},
    "armor": {**_TEXTS, **_ITEM, "type": "light", "bulk": "1", "armor": {"eac": 1, "kac": 2}, "maxDexBonus": 5,
              "armorCheckPenalty": 0, "speedAdjustment": 0, "upgradeSlots": 0, "rarity": "common", "properties": {},
              "container": {"contents": []}},
    "equipment": {**_TEXTS, **_ITEM, **_EMPTY_USE, "type": "technological", "bulk": "L", "rarity": "common",
                  "container": {"contents": []}},
    "augmentation": {**_TEXTS, **_ITEM, **_EMPTY_USE, "type": "cybernetic", "system": "universal"},
    "feat": {**_TEXTS, "type": "general", "prerequisites": {"value": []},
             "activation": {"type": "none", "cost": 0, "condition": ""}, "uses": {"value": 0, "max": 0, "per": ""},
             "recharge": {"value": ""}, "requirements": "", "level": 0},
    "spell": {**_TEXTS, "level": 1, "school": "evo",
              "components": {"value": "V, S", "verbal": True, "somatic": True,
                             "material": False, "focus": False, "divineFocus": False},
              "lists": {"mystic": None, "technomancer": None, "witchwarper": None, "precog": None},
              "activation": {"type": "action", "cost": 1, "condition": ""},
              "duration": {"value": "instantaneous", "units": "inst",
                           "concentration": False, "dismissal": False, "discharge": False},
              "target": {"value": "one creature"}, "range": {"value": "medium", "units": "medium", "additional": ""},
              "area": {"value": "", "units": "", "type": "", "effect": "", "shapable": False},
              "save": {"type": "", "dc": "", "descriptor": ""}, "sr": False, "damage": [], "actionType": "save"},
    "race": {**_TEXTS, "type": "humanoid", "subtype": "", "hit_points": 4, "size": "medium",
             "speed": {"base": 30, "special": ""}, "abilityMods": {}, "traits": [],
             "languages": {"value": ["common"], "custom": ""}},
    "theme": {**_TEXTS, "abilityMod": {"ability": "", "value": 0}},
    "class": {**_TEXTS, "levels": 20, "bab": "medium", "hpPerLevel": 6, "sp": 6, "skillRanksPerLevel": 4,
              "isMaster": False, "keyAbility": "dex",
              "proficiencies": {"armor": ["light"], "weapon": ["basic melee", "small arm"],
                                "saves": {"fort": "slow", "ref": "slow", "will": "slow"}}},
    "archetypeFeature": dict(_TEXTS),
    "npc": {**_TEXTS,
            "details": {"alignment": "N", "race": "", "class": "", "environment": "", "organization": "", "cr": 1,
                        "xp": {"value": 400}, "type": "humanoid", "subtype": "", "rarity": ""},
            "attributes": {"hp": _pool(15), "sp": _pool(0), "rp": _pool(0), "eac": {"value": 11}, "kac": {"value": 13},
                           "cmd": {"value": 21}, "init": {"value": 0, "total": 0},
                           "bab": {"value": 1}, "fort": {"value": 1}, "ref": {"value": 1}, "will": {"value": 1},
                           "speed": {"value": "30 ft.", "special": "", "land": {"base": 30},
                                     "fly": {"base": 0, "maneuverability": ""},
                                     "swim": {"base": 0}, "burrow": {"base": 0}, "climb": {"base": 0}},
                           "senses": {"darkvision": 0, "lowlightVision": False, "blindsense": 0, "blindsight": 0, "senseText": ""}},
            "abilities": {"str": {"value": 10, "mod": 0}, "dex": {"value": 10, "mod": 0}, "con": {"value": 10, "mod": 0},
                          "int": {"value": 10, "mod": 0}, "wis": {"value": 10, "mod": 0}, "cha": {"value": 10, "mod": 0}},
            "skills": {}},
    "starship": {**_TEXTS, "details": {"tier": 1, "frame": "", "size": "medium", "shields": "", "cost": 0, "buildPoints": 55},
                 "attributes": {"hp": _pool(40), "shields": {"forward": 0, "starboard": 0, "aft": 0, "port": 0, "total": 0},
                                "powerCoreUnits": 100, "speed": 8, "maneuverability": "average", "acPiloting": 0,
                                "acTargeting": 0, "driftEngine": "", "expansionBays": 2},
                 "crew": {"captain": {"actors": []}, "pilot": {"actors": []}, "gunner": {"actors": []}, "engineer": {"actors": []},
                          "chiefMate": {"actors": []}, "magicOfficer": {"actors": []}, "scienceOfficer": {"actors": []}}},
    "vehicle": {**_TEXTS, "details": {"type": "land", "level": 1, "price": 0, "bulk": "—", "passengers": 1, "cargo": 0,
                                      "hardness": 5},
                "attributes": {"hp": _pool(20), "speed": {"land": 30, "water": 0, "air": 0, "ftl": False},
                               "eac": {"value": 14}, "kac": {"value": 15}}},
    "hazard": {**_TEXTS, "details": {"type": "trap", "subtype": "", "cr": 1, "xp": {"value": 400}, "rarity": "", "reset": ""},
               "attributes": {"perception": {"dc": 15}, "disable": {"dc": 15, "skill": "Engineering"},
                              "trigger": "", "effect": "", "save": {"type": "Reflex", "dc": 15}}},
    "journal": {},
}
