"""P11 queries: one per conversion pack, plus all packs in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentkit.operators.convert import convert_category, convert_records
from contentkit.plans.queries.base import RUN_TIME, busy_table, query

N = "CAST(p_size AS DOUBLE)"
BASE = "p_brand AS source_book, p_size AS page, p_name AS name"
SOURCE = "p_brand || ' pg. ' || p_size"


def _records(spark, sf, category, **payload):
    """``part`` as records of one category; payload values are SQL over its columns."""
    data = F.to_variant_object(F.struct(*[F.expr(e).alias(k) for k, e in payload.items()]))
    return busy_table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
        F.lit(category).alias("category"), F.col("p_brand").alias("source_book"), F.lit("").alias("publisher"),
        F.when(F.col("p_size") > 25, "ann").otherwise("").alias("author"), F.col("p_size").cast("bigint").alias("page_number"),
        F.split("p_name", " ").alias("tags"), F.lit("").alias("notes"), data.alias("raw_content"), F.lit("json").alias("import_method"))


def _pack(name, category, payload, shown, sql):
    """Register a query that shows chosen paths of a pack's system data."""
    cols = ", ".join(f'{e} AS "{k}"' for k, e in sql.items())

    @query(name, f"SELECT CAST(p_partkey AS VARCHAR) AS id, {SOURCE} AS source, {cols} FROM part")
    def run(spark, sf):
        out = convert_category(_records(spark, sf, category, **payload), category)
        source = "system.details.source" if category in ("npc", "vehicle", "starship", "hazard") else "system.source"
        return out.select("id", F.col(source).alias("source"), *[F.expr(e).alias(k) for k, e in shown.items()])


_pack("p11_weapon", "weapon",
      dict(level="p_size", price="p_retailprice", bulk="if(p_size % 2 = 0, 'L', '3')", type="if(p_size > 25, 'Long Sword', 'small arm')",
           damage="concat('1d', p_size)", damageType="'fire & cold'", capacity="p_size", critical="if(p_size > 10, 'burn', '')"),
      dict(level="system.level", bulk="system.bulk", weapon_type="system.weaponType", kind="system.type", formula="system.damage[0].formula",
           types="array_join(system.damage[0].type.values, '|')", range="system.range.value", increment="system.range.increment",
           capacity="system.capacity.max", crit="array_join(system.critical.parts, '|')", rarity="system.rarity"),
      dict(level=N, bulk="CASE WHEN p_size % 2 = 0 THEN 0.1 ELSE 3 END::DOUBLE", weapon_type="CASE WHEN p_size > 25 THEN 'melee' ELSE 'ranged' END",
           kind="CASE WHEN p_size > 25 THEN 'Long Sword' ELSE 'small arm' END", formula="'1d' || p_size", types="'F|C'",
           range="CASE WHEN p_size > 25 THEN 5 ELSE 30 END::DOUBLE", increment="CASE WHEN p_size > 25 THEN 0 ELSE 5 END::DOUBLE", capacity=N,
           crit="CASE WHEN p_size > 10 THEN 'burn' ELSE '' END", rarity="'common'"))
_pack("p11_armor", "armor",
      dict(type="if(p_size > 25, 'Heavy plate', 'suit')", eac="p_size", acp="0", armorCheckPenalty="-2", maxDex="if(p_size > 25, '-', '4')", speedAdjust="'-5 ft.'", bulk="'-'"),
      dict(kind="system.type", eac="system.armor.eac", kac="system.armor.kac", acp="system.armorCheckPenalty", max_dex="system.maxDexBonus",
           speed="system.speedAdjustment", bulk="system.bulk", level="system.level"),
      dict(kind="CASE WHEN p_size > 25 THEN 'heavy' ELSE 'light' END", eac=N, kac="0::DOUBLE", acp="-2::DOUBLE", max_dex="CASE WHEN p_size > 25 THEN 99 ELSE 4 END::DOUBLE",
           speed="-5::DOUBLE", bulk="0::DOUBLE", level="1::DOUBLE"))
_pack("p11_equipment", "equipment", dict(type="lower(p_type)", capacity="p_size", usage="'x'", equipType="'hybrid item'"),
      dict(kind="system.type", capacity="system.capacity.value", usage="system.usage.value", per="system.usage.per", bulk="system.bulk"),
      dict(kind="'technological'", capacity=N, usage="0::DOUBLE", per="'charge'", bulk="0.1::DOUBLE"))
_pack("p11_augmentation", "augmentation", dict(type="if(p_size > 25, 'Magitech core', 'odd')", bodySlot="p_type", bulk="'x'"),
      dict(kind="system.type", slot="system.system", bulk="system.bulk"),
      dict(kind="CASE WHEN p_size > 25 THEN 'magitech' ELSE 'cybernetic' END", slot="p_type", bulk="0::DOUBLE"))
_pack("p11_feat", "feat", dict(featType="if(p_size > 25, 'Combat feat', '')", type="'Species feat'", prereqs="concat('Dex ', p_size, '; ; Str 2, x')"),
      dict(kind="system.type", parts="array_join(system.prerequisites.parts, '|')", activation="system.activation.type", mods="size(system.modifiers)"),
      dict(kind="CASE WHEN p_size > 25 THEN 'combat' ELSE 'racial' END", parts="'Dex ' || p_size || '|Str 2, x'", activation="'passive'", mods="0"))
_pack("p11_spell", "spell", dict(level="p_size % 7", school="if(p_size > 25, 'Evocation', 'Odd')", castingTime="'1 full action'", range="'long (400 ft.)'",
                                 descriptors="'Fire, ;COLD'", sr="'Yes'", damage="concat(p_size, 'd6')"),
      dict(level="system.level", school="system.school", act="system.activation.type", units="system.range.units",
           desc="array_join(system.descriptors.value, '|')", sr="system.sr", formula="system.damage.parts[0].formula", harmless="system.save.harmless"),
      dict(level="CAST(p_size % 7 AS DOUBLE)", school="CASE WHEN p_size > 25 THEN 'evo' ELSE 'odd' END", act="'full'", units="'long'", desc="'fire|cold'",
           sr="true", formula="p_size || 'd6'", harmless="false"))
_pack("p11_species", "race", dict(hp="if(p_size > 25, null, p_size)", size="'LARGE'", description="'base'",
                                  abilityMods="array(named_struct('mod', '+2', 'ability', 'dex'), named_struct('mod', '', 'ability', 'str'))",
                                  racialAbilities="array(named_struct('name', p_name, 'type', 'Ex', 'description', 'sees'))"),
      dict(hp="system.hp", size="system.size", subtype="system.subtype", mods="array_join(system.abilityMods.parts[0], '|')", n="size(system.abilityMods.parts)",
           text="system.description.value"),
      dict(hp="CASE WHEN p_size > 25 THEN 4 ELSE p_size END::DOUBLE", size="'large'", subtype="'humanoid'", mods="'+2|dex'", n="1",
           text="'base' || chr(10) || chr(10) || '<ul><li><strong>' || p_name || ' (Ex):</strong> sees</li></ul>'"))
_pack("p11_theme", "theme", dict(keyAbility="'Wisdom'", abilityModValue="p_size", themeSkill="p_type"),
      dict(ability="system.abilityMod.ability", value="system.abilityMod.value", skill="system.skill"),
      dict(ability="'wis'", value=N, skill="p_type"))
_pack("p11_class", "class", dict(keyAbility="'dex'", hp="p_size", bab="if(p_size > 25, 'full', '3/4')", fort="'Good'", willSave="'half'", weaponProficiencies="'a, b;c'"),
      dict(ability="system.keyAbility", hp="system.hp", bab="system.bab", fort="system.saves.fort", ref="system.saves.ref", will="system.saves.will",
           weapons="array_join(system.proficiencies.weapon, '|')", levels="system.levels"),
      dict(ability="'dex'", hp=N, bab="CASE WHEN p_size > 25 THEN 'full' ELSE '3/4' END", fort="'full'", ref="'1/2'", will="'1/2'", weapons="'a|b|c'", levels="20::DOUBLE"))
_pack("p11_archetype", "archetypeFeature", dict(level="concat('2, ', p_size, '; 40')", replacedFeatures="'a; b'", archetypeName="p_type"),
      dict(levels="array_join(transform(system.levels, x -> cast(x as string)), '|')", replaces="array_join(system.replaces, '|')", archetype="system.archetype.name"),
      dict(levels="CASE WHEN p_size <= 20 THEN '2|' || p_size ELSE '2' END", replaces="'a|b'", archetype="p_type"))
_pack("p11_npc", "npc", dict(cr="if(p_size > 25, '1/2', cast(p_size as string))", hp="p_size", str="p_size", skills="'Stealth +4'", speed="'40 ft., climb 20 ft.'",
                             init="3", languages="'Common; Elder'", size="'Huge'", fort="-1"),
      dict(cr="system.details.cr", xp="system.details.xp.value", hp="system.attributes.hp.max", str_mod="system.abilities.str.mod", dex="system.abilities.dex.value",
           stealth="system.skills['stealth'].misc", speed="system.speed.value", init="system.attributes.init.total", languages="array_join(system.traits.languages.value, '|')",
           size="system.details.size", fort="system.attributes.fort.bonus", alignment="system.details.alignment"),
      dict(cr="CASE WHEN p_size > 25 THEN 0.5 ELSE p_size END::DOUBLE",
           xp="CASE WHEN p_size > 25 THEN 200 WHEN p_size = 1 THEN 400 WHEN p_size % 2 = 0 THEN 600 * 2 ** (p_size // 2 - 1) ELSE 800 * 2 ** ((p_size - 3) // 2) END::DOUBLE",
           hp=N, str_mod="floor((p_size - 10) / 2.0)::DOUBLE", dex="10::DOUBLE", stealth="4", speed="40::DOUBLE", init="3::DOUBLE", languages="'Common|Elder'", size="'huge'",
           fort="-1::DOUBLE", alignment="'N'"))
_pack("p11_vehicle", "vehicle", dict(type="'Hover sea craft'", speed="p_size", hp="p_size", crew="2", maneuver="'Good'"),
      dict(kind="system.details.type", full_speed="system.movement.fullSpeed", hp="system.attributes.hp.value", crew="system.crew.minimumCrew",
           maneuver="system.movement.maneuver", size="system.frame.size", bulk="system.frame.bulk"),
      dict(kind="'water'", full_speed="p_size * 3::DOUBLE", hp=N, crew="2::DOUBLE", maneuver="'good'", size="'large'", bulk="50::DOUBLE"))
_pack("p11_starship", "starship", dict(tier="if(p_size > 25, '1/4', cast(p_size as string))", hp="p_size", shields="p_size", shieldsAft="1", maneuverability="'Clumsy'", size="'Colossal'"),
      dict(tier="system.details.tier", ct="system.attributes.ct", fwd="system.attributes.shields.forward", aft="system.attributes.shields.aft",
           maneuver="system.movement.maneuverability", size="system.details.size", pcu="system.attributes.powerCoreUnits"),
      dict(tier="CASE WHEN p_size > 25 THEN 0.25 ELSE p_size END::DOUBLE", ct="floor(p_size / 5.0)::DOUBLE", fwd=N, aft="1::DOUBLE", maneuver="'clumsy'", size="'colossal'", pcu="30::DOUBLE"))
_pack("p11_hazard", "hazard", dict(type="'Environment'", challengeRating="cast(p_size as string)", xp="'6,280'", noticedc="p_size", ref="-2"),
      dict(kind="system.details.type", cr="system.details.cr", xp="system.details.xp.value", notice="system.attributes.noticePerception",
           disable="system.attributes.disableEngineering", reflex="system.saves.reflex.value"),
      dict(kind="'environmental'", cr=N, xp="400::DOUBLE", notice=N, disable="20::DOUBLE", reflex="-2::DOUBLE"))


@query("p11_journal", """SELECT CAST(p_partkey AS VARCHAR) AS id,
  CASE p_size % 4 WHEN 0 THEN 'PDF Reference' WHEN 1 THEN 'Rules Reference' WHEN 2 THEN 'Lore' ELSE 'Entry' END AS page,
  '<h2>' || p_name || '</h2>' || chr(10) || '<p><em>Source: ' || p_brand || ' pg. ' || p_size || '</em></p>' || chr(10) ||
  CASE p_size % 4 WHEN 0 THEN '<p><a href="u" target="_blank">Open PDF</a></p>' || chr(10) || '<p>text</p>'
       WHEN 1 THEN '<div class="rule-text">text</div>'
       WHEN 2 THEN '<p>old tale</p>' || chr(10) || '<p><strong>Tags:</strong> ' || replace(p_name, ' ', ', ') || '</p>'
       ELSE '<p><strong>Publisher:</strong> </p>' || CASE WHEN p_size > 25 THEN chr(10) || '<p><strong>Author:</strong> ann</p>' ELSE '' END || chr(10) || '<hr/><p>text</p>' END AS content,
  'Missing publisher.' AS warnings FROM part""")
def journal(spark, sf):
    records = _records(spark, sf, "journal", description="'text'", pdfUrl="'u'", loreText="'old tale'",
                       journalType="element_at(array('pdf', 'rules', 'lore', 'notes'), p_size % 4 + 1)")
    return convert_records(records, RUN_TIME).select(
        "id", F.col("pages")[0]["name"].alias("page"), F.col("pages")[0]["text"]["content"].alias("content"), F.array_join("warnings", "|").alias("warnings"))


@query("p11_convert_records", """SELECT CASE p_partkey % 3 WHEN 0 THEN 'weapons' WHEN 1 THEN 'npcs' ELSE '' END AS pack_id, count(*) AS documents,
  CAST(sum(CASE p_partkey % 3 WHEN 2 THEN 0 ELSE 1 END) AS BIGINT) AS warned, count_if(p_partkey % 3 = 2) AS failed,
  CAST(sum(CASE p_partkey % 3 WHEN 0 THEN p_size END) AS DOUBLE) AS levels FROM part GROUP BY 1""")
def mixed(spark, sf):
    kind = F.element_at(F.array(F.lit("weapon"), F.lit("npc"), F.lit("gadget")), (F.col("ord") % 3 + 1).cast("int"))
    records = _records(spark, sf, "weapon", level="p_size", cr="p_size").withColumn("category", kind)
    out = convert_records(records, RUN_TIME)
    return out.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.when(F.size("warnings") > 0, 1).otherwise(0)).alias("warned"),
        F.count_if(F.size("errors") > 0).alias("failed"), F.sum(F.try_variant_get("system", "$.level", "double")).alias("levels"))
