"""Prompt packs for model refinement (X5), generated from the expected response fields."""

from __future__ import annotations

from contentkit.operators.extract import PromptPack

TEXT, NUMBER, EITHER = "string or null", "number or null", "string or number or null"
# Response keys per category; "name" comes first and "description" last.
RESPONSE_FIELDS: dict[str, dict[str, str]] = {
    "weapon": {"level": NUMBER, "price": NUMBER, **dict.fromkeys(
        ("bulk", "damage", "damageType", "range", "capacity", "usage", "weaponType", "special"), TEXT)},
    "armor": {"level": NUMBER, "price": NUMBER, "bulk": TEXT, **dict.fromkeys(
        ("eac", "kac", "maxDex", "acp", "upgradeSlots"), NUMBER), "armorType": TEXT},
    "feat": {"prerequisites": TEXT, "benefit": "string", "special": TEXT},
    "spell": dict.fromkeys(("level", "school", "castingTime", "range", "targets", "duration", "savingThrow",
                            "spellResistance", "classes"), TEXT),
    "npc": {"cr": EITHER, "xp": NUMBER, "alignment": TEXT, "size": TEXT, "type": TEXT, **dict.fromkeys(
        ("hp", "eac", "kac", "fort", "ref", "will", "str", "dex", "con", "int", "wis", "cha"), NUMBER),
        **dict.fromkeys(("speed", "attacks", "skills", "languages"), TEXT)},
    "vehicle": {"size": TEXT, "speed": TEXT, **dict.fromkeys(("eac", "kac", "hp", "hardness"), NUMBER),
                **dict.fromkeys(("crew", "passengers", "cargo"), TEXT)},
    "starship": {"tier": EITHER, "size": TEXT, **dict.fromkeys(("hp", "dt", "ct"), NUMBER), "speed": EITHER,
                 **dict.fromkeys(("maneuverability", "shields", "powerCore", "driftEngine", "attacks"), TEXT)},
    "race": {"hp": NUMBER, "size": TEXT, "subtype": TEXT, "abilityMods": "array of {mod, ability}",
             "racialAbilities": "array of {name, type, description}"},
}


def prompt_pack(category: str, fields: dict[str, str]) -> PromptPack:
    keys = {"name": "string", **fields, "description": "string"}
    listing = "\n".join(f"- {k}: {t}" for k, t in keys.items())
    return PromptPack(
        category,
        "Extract the record described by the text and answer with one JSON object and nothing else.\n"
        f"Use exactly these keys and types:\n{listing}",
        f"Extract {category} data from this text from {{{{sourceBook}}}}:\n\n{{{{rawText}}}}",
    )


PROMPT_PACKS = tuple(prompt_pack(c, f) for c, f in RESPONSE_FIELDS.items())
