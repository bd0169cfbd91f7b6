import math

from pyspark.sql import functions as F

from contentkit.functions import rules as R
from contentkit.functions import scalars as S
from contentkit.functions import variants as V


def apply(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_to_number(spark):
    values = ["", "  ", "12", " 1.5 ", "1d", "1f", "6,280", "inf", "1e3", "-.5", "0x10", None]
    assert apply(spark, S.to_number, values) == [0, 0, 12, 1.5, None, None, None, None, 1000, -0.5, None, None]


def test_prefixes(spark):
    assert apply(spark, S.int_prefix, ["12 ft", "-3", "x1", "", None, "99999999999999999999"]) == [12, -3, None, None, None, None]
    assert apply(spark, S.float_prefix, ["1.5m", "2e1x", ".5", "abc"]) == [1.5, 20, 0.5, None]


def test_strip_handles_all_whitespace(spark):
    assert apply(spark, S.strip, ["\n\t a b  　\r"]) == ["a b"]


def test_bulk(spark):
    assert apply(spark, R.bulk, ["L", "l", "-", "", "2", "0", "x", None]) == [0.1, 0.1, 0, 0, 2, 1, 1, 0]
    assert apply(spark, lambda c: R.bulk(c, 0.1), ["x"]) == [0.1]


def test_fraction(spark):
    assert apply(spark, R.fraction, ["1/2", "7", "x", "0", None, "1/0"]) == [0.5, 7, 1, 1, 1, None]


def test_max_dex_and_ability(spark):
    assert apply(spark, R.max_dex, ["", "-", "—", " 3 ", "0", "x"]) == [99, 99, 99, 3, 5, 5]
    assert apply(spark, R.ability, ["Strength", "WIS", "luck", None]) == ["str", "wis", "str", "str"]
    assert apply(spark, lambda c: R.ability(c, "any"), ["luck", "any"]) == ["any", "any"]


def test_lists_sizes_alignment(spark):
    assert apply(spark, R.items, ["a, b;c,,", "", None]) == [["a", "b", "c"], [], []]
    assert apply(spark, R.substring_rule("size"), ["Diminutive", "very LARGE", "colossal", "?"]) == ["diminutive", "large", "colossal", "medium"]
    assert apply(spark, R.alignment, ["Lawful Good", "true", "x"]) == ["lg", "n", "n"]


def test_flags(spark):
    assert apply(spark, R.flag, ["TRUE", "y", "1", None]) == [True, False, True, False]
    assert apply(spark, lambda c: R.flag_or(c, True), ["no", "maybe", None]) == [False, True, True]


def test_damage_skills_levels_slug(spark):
    assert apply(spark, R.damage_types, ["fire & cold", "B,p", "odd"]) == [["F", "C"], ["B", "P"], ["ODD"]]
    assert apply(spark, R.skills, ["Sense Motive +5, a +1, A +2, bad", ""]) == [{"sensemotive": 5, "a": 2}, {}]
    assert apply(spark, R.levels, ["1, 3 ; 25;x", ""]) == [[1, 3], []]
    assert apply(spark, R.slug, ["--Ärger! 42 " + "x" * 60])[0].startswith("rger-42-x")
    assert len(apply(spark, R.slug, ["x" * 60])[0]) == 40


def test_xp_and_modifier(spark):
    assert apply(spark, R.xp_for_cr, ["1/2", "25", "99", None]) == [200, 1638400, 400, 400]
    assert apply(spark, R.ability_mod, [9.0, 10.0, 13.0], "double") == [-1, 0, 1]


def test_scalar_to_variant_types(spark):
    out = apply(spark, lambda c: F.to_json(V.scalar_to_variant(c)), ["", "True", "12", "1.5", "x", "1d"])
    assert out == ["null", "true", "12", "1.5", '"x"', '"1d"']


def test_overlay(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": {"x": 1, "y": 2}}', '{"a": null, "b": {"y": 3}}')], "l string, r string")
    l, r = F.parse_json("l"), F.parse_json("r")
    assert rows.select(F.to_json(V.overlay(l, r))).first()[0] == '{"a":null,"b":{"y":3}}'


def test_lookup_of_camel_case_keys_in_lower_case_payloads(spark):
    rows = spark.createDataFrame([('{"maxdex": "3"}',)], "j string").select(F.parse_json("j").alias("p"))
    assert rows.select(V.get_text(F.col("p"), "maxDex")).first()[0] == "3"


def test_title_case_and_rounding(spark):
    assert apply(spark, S.title_case, ["my_book-TITLE  x"]) == ["My Book Title X"]
    assert apply(spark, S.round_half_up, [0.5, 1.49, -0.5], "double") == [1, 1, 0]
    assert math.isclose(apply(spark, R.progression, ["x"])[0] == "poor", 1)
