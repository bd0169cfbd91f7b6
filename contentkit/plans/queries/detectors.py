"""X4 per detector pack: render a stat block per part, detect it, and compare with the source columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentkit.operators import extract as X
from contentkit.plans.detectors import DETECTORS
from contentkit.plans.queries.base import query
from contentkit.plans.queries.extraction import ARMOR_PIECES, NPC_PIECES, WEAPON_PIECES, render

PACK = {d.category: d for d in DETECTORS}
BASE = ("name", "confidence", "tags", "description")


def _found(spark, sf, category, pieces, texts=(), ints=(), others=()):
    out = X.detect_records(render(spark, sf, *pieces), [PACK[category]])
    data = F.col("structured_data")
    return out.select(
        "block_id", "name", F.round("confidence", 6).alias("confidence"), F.array_join("auto_tags", "|").alias("tags"),
        F.try_variant_get(data, "$.description", "string").alias("description"),
        *[F.try_variant_get(data, f"$.{t}", "string").alias(t) for t in texts],
        *[F.try_variant_get(data, f"$.{i}", "bigint").alias(i) for i in ints],
        *[F.try_variant_get(data, path, kind).alias(name) for name, path, kind in others])


def _sql(name, confidence, tags, description, texts=(), ints=(), where="true"):
    cols = [f'{e} AS "{n}"' for n, e in texts] + [f'CAST({e} AS BIGINT) AS "{n}"' for n, e in ints]
    return (f"SELECT p_partkey AS block_id, {name} AS name, CAST({confidence} AS DOUBLE) AS confidence, {tags} AS tags, {description} AS description"
            + "".join(", " + c for c in cols) + f" FROM part WHERE {where}")


TITLE = "(upper(left(p_name, 1)) || substr(p_name, 2))"
SIZE = "p_size"
PRICE = "CAST(floor(p_retailprice) AS BIGINT)"
TITLE_PIECE = "{concat(upper(left(p_name, 1)), substr(p_name, 2))}"


@query("x4_weapon", _sql(
    "upper(p_name)", "1.0", "'weapon|small-arm'", f"'Bulk ' || ({SIZE} % 3 + 1) || '; Special ' || lower(p_type) || ' edge A trusted tool.'",
    texts=[("damage", f"'1d' || {SIZE} || ' F'"), ("damageType", "'F'"), ("range", f"({SIZE} * 10) || ' ft.'"),
           ("capacity", f"({SIZE} + 20) || ' charges'"), ("usage", f"CAST({SIZE} % 4 + 1 AS VARCHAR)"),
           ("bulk", f"CAST({SIZE} % 3 + 1 AS VARCHAR)"), ("special", "lower(p_type) || ' edge'"), ("weaponType", "'Small arm'")],
    ints=[("level", SIZE)]))
def weapon(spark, sf):
    return _found(spark, sf, "weapon", WEAPON_PIECES,
                  ("damage", "damageType", "range", "capacity", "usage", "bulk", "special", "weaponType"), ("level",))


@query("x4_armor", _sql(
    "upper(p_name)", "1.0", "'armor|heavy-armor'", f"'Max Dex Bonus ' || ({SIZE} % 6 + 1) || '; Armor Check Penalty -' || ({SIZE} % 4) || ' Speed Adjustment -5 ft.; Upgrade Slots ' || ({SIZE} % 5) || '; Bulk 2 Plates for hard days.'",
    texts=[("armorType", "'Heavy Armor'"), ("price", f"CAST({PRICE} AS VARCHAR)"), ("speedAdj", "'-5 ft.'"), ("bulk", "'2'")],
    ints=[("level", SIZE), ("eac", f"{SIZE} + 1"), ("kac", f"{SIZE} + 3"), ("maxDex", f"{SIZE} % 6 + 1"), ("acp", f"-({SIZE} % 4)"),
          ("upgradeSlots", f"{SIZE} % 5")]))
def armor(spark, sf):
    return _found(spark, sf, "armor", ARMOR_PIECES, ("armorType", "price", "speedAdj", "bulk"),
                  ("level", "eac", "kac", "maxDex", "acp", "upgradeSlots"))


INIT_NAME = "list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', ' ')"


@query("x4_npc", _sql(
    INIT_NAME, "1.0", f"'npc|cr-' || {SIZE}", "'CE humanoid Lurks in docks.'",
    texts=[("cr", f"CAST({SIZE} AS VARCHAR)"), ("xp", f"CAST({SIZE} * 400 AS VARCHAR)"), ("speed", "'30 ft.'"),
           ("skills", f"'Stealth +' || {SIZE}"), ("languages", "'Common'"), ("attacks", f"'[\"Melee fist +' || {SIZE} || '\",\"Ranged bow +2\"]'")],
    ints=[("hp", f"{SIZE} * 10"), ("eac", f"{SIZE} + 10"), ("kac", f"{SIZE} + 12"), ("fort", "3"), ("ref", "-1"), ("will", f"{SIZE} % 7"),
          ("str", "4"), ("dex", f"{SIZE} % 5"), ("con", "1"), ("int", "0"), ("wis", "2"), ("cha", "-1"), ("initiative", "2")]))
def npc(spark, sf):
    return _found(spark, sf, "npc", NPC_PIECES, ("cr", "xp", "speed", "skills", "languages", "attacks"),
                  ("hp", "eac", "kac", "fort", "ref", "will", "str", "dex", "con", "int", "wis", "cha", "initiative"))


@query("x4_spell", _sql(
    "upper(p_name)", "1.0", "'spell|' || lower(p_type)", "'It glows brightly.'",
    texts=[("school", "lower(p_type)"), ("castingTime", "'1 standard action'"), ("range", f"'close (' || {SIZE} || ' ft.)'"),
           ("targets", "'one creature'"), ("duration", f"{SIZE} || ' rounds'"), ("savingThrow", "'Will negates'"), ("spellResistance", "'yes'"),
           ("classes", f"'[\"Mystic ' || ({SIZE} % 6 + 1) || '\",\"Technomancer 2\"]'")],
    ints=[("level", f"greatest({SIZE} % 6 + 1, 2)")]))
def spell(spark, sf):
    pieces = ("{upper(p_name)}", "\nSchool: ", "{lower(p_type)}", "\nClasses: Mystic ", "{p_size % 6 + 1}", ", Technomancer 2\nCasting Time: 1 standard action\nRange: close (",
              "{p_size}", " ft.)\nTargets: one creature\nDuration: ", "{p_size}", " rounds\nSaving Throw: Will negates; Spell Resistance: yes\nIt glows brightly.")
    return _found(spark, sf, "spell", pieces,
                  ("school", "castingTime", "range", "targets", "duration", "savingThrow", "spellResistance", "classes"), ("level",))


@query("x4_vehicle", _sql(
    TITLE, "1.0", "'vehicle|large'", "'It runs well with good cover.'",
    texts=[("size", "'Large'"), ("speed", f"{SIZE} || ' ft.'"), ("crew", "'2'"), ("passengers", f"CAST({SIZE} AS VARCHAR)"), ("cargo", "'3 tons'"),
           ("attacks", "'(Ram) 4d4 B'"), ("modifiers", "'-1 piloting'")],
    ints=[("eac", f"{SIZE} + 11"), ("kac", f"{SIZE} + 12"), ("hp", f"{SIZE} * 5"), ("hardness", f"{SIZE} % 9")]))
def vehicle(spark, sf):
    pieces = ("Heading\n", TITLE_PIECE, "\nLarge land vehicle\nSpeed ", "{p_size}", " ft.; full speed\nEAC ", "{p_size + 11}", "; KAC ", "{p_size + 12}",
              "\nHP ", "{p_size * 5}", "; Hardness ", "{p_size % 9}", "\nAttack (Ram) 4d4 B\nCrew 2; Passengers ", "{p_size}",
              "; Cargo 3 tons\nModifiers -1 piloting\nAutopilot +3\nIt runs well with good cover.")
    out = _found(spark, sf, "vehicle", pieces, ("size", "speed", "crew", "passengers", "cargo", "attacks", "modifiers"),
                 ("eac", "kac", "hp", "hardness"))
    return out.withColumn("description", F.regexp_replace("description", "^Heading ", ""))


@query("x4_starship", _sql(
    TITLE, "1.0", "'starship|huge'", f"{TITLE} || ' Tier ' || {SIZE} || ' Seen at the edge of the rim.'",
    texts=[("tier", f"CAST({SIZE} AS VARCHAR)"), ("size", "'Huge'"), ("maneuverability", "'average (turn 2)'"), ("powerCore", "'Pulse Blue'"),
           ("driftEngine", "'Basic'"), ("sensors", "'cheap'"), ("attacks", "'[\"Attack (Forward) laser\"]'"),
           ("crew", "'{\"captain\":\"Captain\",\"engineer\":\"\",\"gunner\":\"Gunner\",\"pilot\":\"\",\"scienceOfficer\":\"\"}'")],
    ints=[("hp", f"{SIZE} * 5"), ("dt", "0"), ("ct", f"{SIZE}"), ("speed", "8"), ("forward", f"{SIZE} + 1"), ("port", f"{SIZE} + 2"),
          ("starboard", f"{SIZE} + 3"), ("aft", f"{SIZE} + 4")]))
def starship(spark, sf):
    pieces = (TITLE_PIECE, " Tier ", "{p_size}", "\nHuge starship\nSpeed 8\nManeuverability average (turn 2)\nDrift Engine Basic\nHP ", "{p_size * 5}", "; DT 0; CT ", "{p_size}",
              "\nShields forward ", "{p_size + 1}", ", port ", "{p_size + 2}", ", starboard ", "{p_size + 3}", ", aft ", "{p_size + 4}",
              "\nAttack (Forward) laser\nPower Core Pulse Blue; Sensors cheap\nCrew Captain, Gunner\nSeen at the edge of the rim.")
    out = _found(spark, sf, "starship", pieces, ("tier", "size", "maneuverability", "powerCore", "driftEngine", "sensors", "attacks", "crew"),
                 ("hp", "dt", "ct", "speed"), [(a, f"$.shields.{a}", "bigint") for a in ("forward", "port", "starboard", "aft")])
    return out.withColumn("maneuverability", F.regexp_extract("maneuverability", r"^([^\n]+)", 1))


@query("x4_species", _sql(
    TITLE, "0.97", "'species|goblinoid'", "'They are quick. They use the racial trait well. Keen Eye (Ex): They see far. Night Skin (Su): They hide at night.'",
    texts=[("size", "'small'"), ("subtype", "'goblinoid'"), ("abilityMods", "'[{\"ability\":\"dex\",\"mod\":\"+2\"},{\"ability\":\"str\",\"mod\":\"-2\"}]'"),
           ("racialAbilities", "'[{\"description\":\"They see far.\",\"name\":\"Keen Eye\",\"type\":\"Ex\"},{\"description\":\"They hide at night.\",\"name\":\"Night Skin\",\"type\":\"Su\"}]'")],
    ints=[("hp", SIZE)]))
def species(spark, sf):
    pieces = (TITLE_PIECE, "\nThey are quick. They use the racial trait well.\nAbility Adjustments: +2 Dex, –2 Strength\nHit Points: ", "{p_size}",
              "\nSize and Type: They are Small humanoids with the goblinoid subtype.\nKeen Eye (Ex): They see far.\nNight Skin (Su): They hide at night.")
    return _found(spark, sf, "race", pieces, ("size", "subtype", "abilityMods", "racialAbilities"), ("hp",))


@query("x4_theme", _sql(
    TITLE, "0.85", "'theme'", "'18th Level'",
    texts=[("themeKnowledge", "'18th Level'"), ("abilityAt6", "'You move fast.'"), ("abilityAt12", "'You hide well.'"), ("abilityAt18", "'You rest less.'")]))
def theme(spark, sf):
    pieces = (TITLE_PIECE, "\nTheme Knowledge (1st Level)\nYou know ", "{p_size}", " ports.\n6th Level\nYou move fast.\n12th Level\nYou hide well.\n18th Level\nYou rest less.")
    return _found(spark, sf, "theme", pieces, ("themeKnowledge", "abilityAt6", "abilityAt12", "abilityAt18"))


@query("x4_class", _sql(
    TITLE, "0.91", "'class'", "'Each class feature is new.'",
    texts=[("keyAbility", "'Wisdom'"), ("keySkills", "'Diplomacy, Sense'"), ("proficiencies", "'light armor'")],
    ints=[("hp", f"{SIZE} % 4 + 5"), ("stamina", f"{SIZE} % 3 + 6")]))
def character_class(spark, sf):
    pieces = (TITLE_PIECE, "\nKey Ability Score: Wisdom\nHit Points: ", "{p_size % 4 + 5}", "\nStamina Points: ", "{p_size % 3 + 6}",
              "\nKey Skills: Diplomacy, Sense\nProficiencies: light armor\nEach class feature is new.")
    return _found(spark, sf, "class", pieces, ("keyAbility", "keySkills", "proficiencies"), ("hp", "stamina"))


@query("x4_archetype", _sql(
    TITLE, "0.85", "'archetype'", f"'They trade. Level 2: Fast Hands Level ' || ({SIZE} % 9 + 3) || ': Sharp Mind'",
    texts=[("associatedClasses", "'Envoy, Mechanic'"), ("altFeatures", f"'[\"Level 2: Fast Hands\",\"Level ' || ({SIZE} % 9 + 3) || ': Sharp Mind\"]'")],
    ints=[("altFeatureCount", "2")]))
def archetype(spark, sf):
    pieces = (TITLE_PIECE, "\nThey trade.\nAssociated Classes: Envoy, Mechanic\nAlternate Class Features\nLevel 2: Fast Hands\nLevel ", "{p_size % 9 + 3}", ": Sharp Mind")
    return _found(spark, sf, "archetypeFeature", pieces, ("associatedClasses", "altFeatures"), ("altFeatureCount",))


@query("x4_augmentation", _sql(
    "upper(p_name)", "0.89", "'augmentation|cybernetic'", "'It hums.'",
    texts=[("augType", "'Cybernetic'"), ("system", "'Arm and hand'"), ("price", f"{PRICE} || ' credits'")], ints=[("level", f"{SIZE}")]))
def augmentation(spark, sf):
    pieces = ("{upper(p_name)}", "\nCybernetic\nSystem: Arm and hand\nLevel ", "{p_size}", "; Price ", "{cast(p_retailprice as bigint)}", " credits\nIt hums.")
    return _found(spark, sf, "augmentation", pieces, ("augType", "system", "price"), ("level",))


@query("x4_feat", _sql(
    TITLE, "0.89", "'feat|combat'", f"'You gain +' || {SIZE} || ' once. It lasts a day.'",
    texts=[("featType", "'Combat'"), ("prerequisites", "'Dex 13'"), ("benefit", f"'You gain +' || {SIZE} || ' once. It lasts a day.'"),
           ("special", "'Take it twice.'"), ("normal", "'You gain none.'")]))
def feat(spark, sf):
    pieces = (TITLE_PIECE, " (Combat)\nPrerequisites: Dex 13\nBenefit: You gain +", "{p_size}", " once.\nIt lasts a day.\nSpecial: Take it twice.\nNormal: You gain none.")
    return _found(spark, sf, "feat", pieces, ("featType", "prerequisites", "benefit", "special", "normal"))


@query("x4_hazard", _sql(
    TITLE, "0.89", f"'hazard|trap|cr-' || {SIZE}", f"{TITLE} || ' CR ' || {SIZE} || ' Watch it.'",
    texts=[("cr", f"CAST({SIZE} AS VARCHAR)"), ("xp", f"CAST({SIZE} * 400 AS VARCHAR)"), ("hazardType", "'Trap'"), ("trigger", "'touch the door'"), ("effect", "'acid spray hits all Watch it.'")],
    ints=[("perceptionDc", f"{SIZE} + 10"), ("disableDc", f"{SIZE} + 12")]))
def hazard(spark, sf):
    pieces = (TITLE_PIECE, " CR ", "{p_size}", "\nXP ", "{p_size * 400}", "\nType trap\nPerception DC ", "{p_size + 10}", "\nDisable Engineering DC ", "{p_size + 12}",
              "\nTrigger touch the door\nEffect acid spray hits all\nWatch it.")
    return _found(spark, sf, "hazard", pieces, ("cr", "xp", "hazardType", "trigger", "effect"), ("perceptionDc", "disableDc"))


@query("x4_equipment", _sql(
    TITLE, "0.81", "'equipment'", f"'Upgrade Slots ' || ({SIZE} % 5) || ' A handy thing.'",
    texts=[("price", f"{PRICE} || ' credits'"), ("bulk", "'L'"), ("hands", "'1'"), ("capacity", "'20'"), ("usage", "'1/hour'"), ("upgradeSlots", f"CAST({SIZE} % 5 AS VARCHAR)")],
    ints=[("level", SIZE)]))
def equipment(spark, sf):
    pieces = (TITLE_PIECE, "\nLevel ", "{p_size}", "; Price ", "{cast(p_retailprice as bigint)}", " credits; Bulk L\nHands 1; Capacity 20; Usage 1/hour\nUpgrade Slots ",
              "{p_size % 5}", "\nA handy thing.")
    return _found(spark, sf, "equipment", pieces, ("price", "bulk", "hands", "capacity", "usage", "upgradeSlots"), ("level",))
