"""Text templates for field extraction."""

from __future__ import annotations

from contentkit.operators.extract import FieldPattern, TextTemplate

# ---------------------------------------------------------------------------------------------
# Field patterns.
# ---------------------------------------------------------------------------------------------
HEADING = r"^([A-Z][A-Z ,\-']+)$"
ALIGNMENT_CODES = "LG|LN|LE|NG|N|NE|CG|CN|CE"
CREATURE_KINDS = "aberration|construct|dragon|fey|magical beast|outsider|plant|undead|vermin"
TO_LINE_END = r"(.+?)(?=\n|$)"


def _text(name: str, pattern: str, flags: str = "i") -> FieldPattern:
    return FieldPattern(name, pattern, flags)


def _numbers(**patterns: str) -> tuple[FieldPattern, ...]:
    return tuple(FieldPattern(name, pattern, "im", "number") for name, pattern in patterns.items())


WEAPON_TEMPLATE = TextTemplate("weapon-block", "weapon", (
    _text("name", HEADING, "m"),
    *_numbers(level=r"Level\s+(\d+)", price=r"Price\s+([\d,]+)"),
    _text("damage", r"Damage\s+([\ddDa-zA-Z ]+(?:[A-Z]))"),
    *_numbers(range=r"Range\s+(\d+)\s*ft", capacity=r"Capacity\s+(\d+)", usage=r"Usage\s+(\d+)"),
    _text("bulk", r"Bulk\s+([\dL—]+)"),
    _text("special", r"Special\s+" + TO_LINE_END, "im"),
    _text("critical", r"Critical\s+" + TO_LINE_END, "im"),
))
ARMOR_TEMPLATE = TextTemplate("armor-block", "armor", (
    _text("name", HEADING, "m"),
    *_numbers(
        level=r"Level\s+(\d+)", price=r"Price\s+([\d,]+)", eac=r"EAC\s+([+\-]?\d+)", kac=r"KAC\s+([+\-]?\d+)",
        maxDex=r"Max Dex\s+([+\-]?\d+)", acp=r"ACP\s+([+\-]?\d+)", speedAdjust=r"Speed Adj\.?\s+(-?\d+)",
        upgradeSlots=r"Upgrade Slots\s+(\d+)",
    ),
    _text("bulk", r"Bulk\s+([\dL—]+)"),
))
NPC_TEMPLATE = TextTemplate("npc-block", "npc", (
    _text("name", HEADING, "m"),
    *_numbers(cr=r"CR\s+([\d/]+)", xp=r"XP\s+([\d,]+)"),
    _text("alignment", rf"({ALIGNMENT_CODES})\s+(?:humanoid|monstrous|{CREATURE_KINDS})"),
    _text("type", rf"(?:{ALIGNMENT_CODES})\s+(humanoid|monstrous humanoid|{CREATURE_KINDS})"),
    *_numbers(hp=r"HP\s+(\d+)", eac=r"EAC\s+(\d+)", kac=r"KAC\s+(\d+)",
              fort=r"Fort\s+([+\-]?\d+)", ref=r"Ref\s+([+\-]?\d+)", will=r"Will\s+([+\-]?\d+)"),
    _text("speed", r"Speed\s+([\d]+ ft\.?(?:,.*)?)"),
    *_numbers(**{a.lower(): rf"{a}\s+(\d+)" for a in ("Str", "Dex", "Con", "Int", "Wis", "Cha")}),
))
TEMPLATES = (WEAPON_TEMPLATE, ARMOR_TEMPLATE, NPC_TEMPLATE)
