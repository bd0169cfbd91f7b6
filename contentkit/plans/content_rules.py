"""Field rules per category (Q2) and required target paths (Q6).

File readers take ``type`` out of the payload (it names the category), so rules on ``type`` also
look at ``subtype``.
"""

from __future__ import annotations

from contentkit.operators.quality import FieldRule

# ---------------------------------------------------------------------------------------------
# Limits and vocabularies.
# ---------------------------------------------------------------------------------------------
RARITIES = ("common", "uncommon", "rare", "legendary", "")
ALIGNMENT_CODES = ("LG", "LN", "LE", "NG", "N", "NE", "CG", "CN", "CE", "")
ALL_SIZES = ("fine", "diminutive", "tiny", "small", "medium", "large", "huge", "gargantuan", "colossal")
WEAPON_KINDS = ("basic melee", "advanced melee", "small arm", "longarm", "heavy", "sniper", "special")
AUGMENTATION_KINDS = ("biotech", "cybernetic", "magitech", "necrografts", "personal upgrade", "racial")
EQUIPMENT_KINDS = ("equipment", "consumable", "technological", "magic", "hybrid", "other")
FEAT_KINDS = ("feat", "combat", "general", "skill", "racial", "creature", "companion")
SCHOOL_CODES = ("abj", "con", "div", "enc", "evo", "ill", "nec", "trs", "uni")

NUM = {"type": "number"}
NON_NEGATIVE = {"type": "number", "min": 0}
AT_LEAST_ONE = {"type": "number", "min": 1}
AT_LEAST_TEN = {"type": "number", "min": 10}
LEVEL = {"type": "number", "required": True, "min": 1, "max": 20}
CHALLENGE = {"type": "number", "required": True, "min": 0.125, "max": 30}
TEXT = {"type": "string"}


def one_of(values: tuple[str, ...], required: bool = False, also: tuple[str, ...] = ()) -> dict:
    return {"type": "string", "enum": values, "required": required, "also": also}


def kind(values: tuple[str, ...], required: bool = False) -> dict:
    return one_of(values, required, ("subtype",))


NAME = {"name": {"type": "string", "required": True, "min_length": 1}}
FIELD_SPECS: dict[str, dict[str, dict]] = {
    "weapon": {**NAME, "level": LEVEL, "price": NON_NEGATIVE, "bulk": TEXT, "type": kind(WEAPON_KINDS, True),
               "weaponType": one_of(("ranged", "melee", "thrown"), True), "damage": TEXT, "range": NON_NEGATIVE,
               "capacity": NON_NEGATIVE, "usage": AT_LEAST_ONE, "rarity": one_of(RARITIES)},
    "armor": {**NAME, "level": LEVEL, "price": NON_NEGATIVE, "bulk": TEXT,
              "type": kind(("light", "heavy", "powered", "shield"), True), "eac": {**NUM, "required": True},
              "kac": {**NUM, "required": True}, "maxDex": NUM, "acp": NUM, "speedAdjust": NUM,
              "upgradeSlots": NON_NEGATIVE, "rarity": one_of(RARITIES)},
    "equipment": {**NAME, "level": LEVEL, "price": NON_NEGATIVE, "bulk": TEXT, "type": kind(EQUIPMENT_KINDS),
                  "rarity": one_of(RARITIES)},
    "augmentation": {**NAME, "level": LEVEL, "price": NON_NEGATIVE, "type": kind(AUGMENTATION_KINDS, True),
                     "system": {**TEXT, "required": True}},
    "feat": {**NAME, "type": kind(FEAT_KINDS)},
    "spell": {**NAME, "level": {"type": "number", "required": True, "min": 0, "max": 6},
              "school": one_of(SCHOOL_CODES, True)},
    "race": {**NAME, "hp": NON_NEGATIVE, "size": one_of(ALL_SIZES), "speed": NON_NEGATIVE},
    "theme": NAME,
    "class": {**NAME, "hpPerLevel": {**AT_LEAST_ONE, "required": True}, "bab": one_of(("slow", "medium", "fast"), True),
              "skillRanksPerLevel": AT_LEAST_ONE, "keyAbility": one_of(("str", "dex", "con", "int", "wis", "cha"))},
    "archetypeFeature": NAME,
    "npc": {**NAME, "cr": CHALLENGE, "xp": NON_NEGATIVE, "hp": AT_LEAST_ONE, "eac": AT_LEAST_TEN, "kac": AT_LEAST_TEN,
            "fort": NUM, "ref": NUM, "will": NUM, "alignment": one_of(ALIGNMENT_CODES), "type": {**TEXT, "also": ("subtype",)},
            **{a: AT_LEAST_ONE for a in ("str", "dex", "con", "int", "wis", "cha")}},
    "starship": {**NAME, "tier": {"type": "number", "required": True, "min": 0.25, "max": 20},
                 "size": one_of(("tiny", "small", "medium", "large", "huge", "gargantuan", "colossal")), "hp": AT_LEAST_ONE, "speed": AT_LEAST_ONE,
                 "maneuverability": one_of(("clumsy", "poor", "average", "good", "perfect"))},
    "vehicle": {**NAME, "level": LEVEL, "price": NON_NEGATIVE, "hp": AT_LEAST_ONE, "eac": AT_LEAST_TEN,
                "kac": AT_LEAST_TEN, "landSpeed": NON_NEGATIVE},
    "hazard": {**NAME, "cr": CHALLENGE, "type": kind(("environmental", "haunt", "trap", "affliction", "")), "xp": NON_NEGATIVE},
    "journal": NAME,
}
FIELD_RULES: list[FieldRule] = [
    FieldRule(category, field, **spec) for category, fields in FIELD_SPECS.items() for field, spec in fields.items()
]

REQUIRED_PATHS: dict[str, list[str]] = {
    "weapon": ["name", "system.type", "system.level", "system.weaponType"],
    "armor": ["name", "system.type", "system.level", "system.armor.eac", "system.armor.kac"],
    "equipment": ["name", "system.type", "system.level"],
    "augmentation": ["name", "system.type", "system.level", "system.system"],
    "feat": ["name"],
    "spell": ["name", "system.level", "system.school"],
    "race": ["name"],
    "theme": ["name"],
    "class": ["name", "system.hpPerLevel", "system.bab"],
    "archetypeFeature": ["name"],
    "npc": ["name", "system.details.cr"],
    "vehicle": ["name", "system.details.level"],
    "starship": ["name", "system.details.tier"],
    "hazard": ["name", "system.details.cr"],
    "journal": ["name"],
}
