"""Text, number, card and report expressions on worked cases."""

import pytest
from pyspark.sql import functions as F

from hoardbook.functions import cards as c, numbers as n, reports as r, text as x


def value(spark, column, **inputs):
    schema = ", ".join(f"{k} {t}" for k, (_, t) in inputs.items()) or "one int"
    row = tuple(v for v, _ in inputs.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column).first()[0]


@pytest.mark.parametrize("text,number,whole,copies", [
    ("2.9", 2.9, 2, 2), ("0", 0.0, 0, 1), ("x", None, None, 1), ("", None, None, 1),
    (None, None, None, 1), (" 7 ", 7.0, 7, 7), ("1_0", 10.0, 10, 10), ("1e2", 100.0, 100, 100),
    ("-3.7", -3.7, -3, 1), ("1d", None, None, 1), ("$4", None, None, 1), (".5", 0.5, 0, 1),
    ("5.", 5.0, 5, 5), (" 8 ", 8.0, 8, 8), ("1__0", None, None, 1),
    ("99999999999", 99999999999.0, None, 1),
])
def test_numbers(spark, text, number, whole, copies):
    got = spark.createDataFrame([(text,)], "t string").select(
        n.clean_number(F.col("t")), n.whole_number(F.col("t")), n.quantity(F.col("t"))
    ).first()
    assert tuple(got) == (number, whole, copies)


def test_special_numbers(spark):
    got = spark.createDataFrame([("inf",), ("-Infinity",), ("nan",)], "t string").select(
        n.clean_number(F.col("t")), n.whole_number(F.col("t")), n.money(F.col("t"))
    ).collect()
    assert got[0][0] == float("inf") and got[1][0] == float("-inf") and got[2][0] != got[2][0]
    assert all(g[1] is None and g[2] is None for g in got)


@pytest.mark.parametrize("text,default,amount", [
    ("2.675", None, "2.68"), ("", 0, "0.00"), ("n/a", 0, "0.00"), ("n/a", None, "None"),
    (" 12 ", None, "12.00"), ("-0.005", None, "-0.01"),
])
def test_money(spark, text, default, amount):
    column = n.money(F.col("t"), None if default is None else F.lit(default))
    assert str(value(spark, column, t=(text, "string"))) == amount


@pytest.mark.parametrize("number,rarity,game,code,set_code", [
    ("SFN/S108-E006 R", "R", "weiss", "SFN/S108-E006", "SFN/S108"),
    ("064/113", "Common", "pokemon", "064/113", "Set Name"),
    ("SFN/S108-E006 r", "R", "weiss", "SFN/S108-E006", "SFN/S108"),
    ("A-1 SR", "R", "mtg", "A-1 SR", "Set Name"), ("", "R", "mtg", None, "Set Name"),
    ("12 13 R", "R", "mtg", "12 13", "Set Name"), ("R", "R", "mtg", "R", "Set Name"),
    ("-9", "", "weiss", "-9", ""), ("A 1", "", "weiss", "A 1", "Set Name"),
])
def test_numbers_of_cards(spark, number, rarity, game, code, set_code):
    df = spark.createDataFrame([(number, rarity, game, "Set Name")], "n string, r string, g string, s string")
    got = c.collector_number(F.col("n"), F.col("r"))
    assert tuple(df.select(got, c.set_code(F.col("g"), got, F.col("s"))).first()) == (code, set_code)


@pytest.mark.parametrize("number,code,set_code", [
    ("SFN/S108-E031S SR", "SFN/S108-E031S", "SFN/S108"), ("064/113", "064/113", None),
    ("1 2 3", "1 2", None), ("", None, None), (None, None, None),
])
def test_legacy_numbers(spark, number, code, set_code):
    got = c.legacy_collector_number(F.col("n"))
    df = spark.createDataFrame([(number,)], "n string")
    assert tuple(df.select(got, c.legacy_set_code(got)).first()) == (code, set_code)


@pytest.mark.parametrize("rarity,printing,variant", [
    ("SR", "Foil", "SR Foil"), ("SR", "Normal", "SR"), ("", "Foil", "Foil"), ("", "", None),
    ("C", "", "C"), ("", "NORMAL", None),
])
def test_variants(spark, rarity, printing, variant):
    column = c.variant(F.col("r"), F.col("p"))
    assert value(spark, column, r=(rarity, "string"), p=(printing, "string")) == variant


def test_codes(spark):
    df = spark.createDataFrame(
        [("Near Mint", "MAGIC"), ("odd", ""), ("damaged", "Weiss Schwarz"), ("", "x")],
        "c string, l string",
    )
    got = df.select(c.condition_code(F.col("c")), c.game_code(F.col("l"))).collect()
    assert [tuple(g) for g in got] == [
        ("NM", "mtg"), (None, "other"), ("DMG", "weiss"), (None, "other")
    ]


def test_strip_and_first_filled(spark):
    assert value(spark, x.strip(F.col("t")), t=("　\t a b \n", "string")) == "a b"
    column = x.first_filled(F.col("a"), F.col("b"))
    assert value(spark, column, a=(" ", "string"), b=(" v ", "string")) == "v"
    assert value(spark, column, a=(None, "string"), b=("", "string")) == ""


@pytest.mark.parametrize("text,query,found", [
    ("50% off", r"50\%", True), ("500 off", r"50\%", False), ("a_b", r"a\_b", True),
    ("axb", "a_b", True), ("axb", r"a\xb", True), (r"a\b", r"a\\b", True), ("AB", "b", True),
    ("end%", "end\\", True),
])
def test_contains(spark, text, query, found):
    assert value(spark, x.contains_any([F.col("t")], query), t=(text, "string")) is found


def test_pattern_column_equals_pattern_text(spark):
    texts = ["a%", r"a\%", r"a\b", "a\\", r"\\", r"\\\_", "", "\\\n"]
    got = spark.createDataFrame([(t,) for t in texts], "p string").select(
        "p", x.like_pattern_column(F.col("p"))
    ).collect()
    assert all(g[1] == x.like_pattern(g[0]) for g in got)


@pytest.mark.parametrize("tier,condition,amount,flag,median,reason", [
    ("grade", "NM", "30", False, None, "NM condition · $30 raw value · ungraded"),
    ("grade", "LP", "5", True, 1.0, "flagged by you · ungraded"),
    ("grade", "NM", "26.50", False, None, "NM condition · $26 raw value · ungraded"),
    ("grade", "NM", "1234.50", True, None, "NM condition · $1,234 raw value · flagged by you · ungraded"),
    ("review", "LP", "4", False, 1.0, "$4.00 raw — 4.0× the box median ($1.00)"),
    ("review", "LP", "4321.10", False, 2.0, "$4,321.10 raw — 2160.6× the box median ($2.00)"),
    ("review", None, None, False, None, "$0.00 raw — 0.0× the box median ($0.00)"),
])
def test_reasons(spark, tier, condition, amount, flag, median, reason):
    column = r.grade_reason(
        F.col("t"), F.col("c"), F.col("v").cast("decimal(12,2)"), F.col("f"), F.col("m")
    )
    assert value(
        spark, column, t=(tier, "string"), c=(condition, "string"), v=(amount, "string"),
        f=(flag, "boolean"), m=(median, "double"),
    ) == reason


def test_strip_reads_its_text_once(spark):
    """Fields of a row are read together: long expressions make methods that the JVM does not compile."""
    assert str(x.strip(F.col("typed"))).count("typed") == 1
