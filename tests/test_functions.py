import re
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from opalyx.functions import dates, geo, money, rules, semi, text


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(make(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize("raw,key", [("Offenes Verfahren", "offenes_verfahren"), ("Procédure  Ouverte", "procedure_ouverte"), (" -- ", None), (None, None), ("中文", None)])
def test_lookup_key(spark, raw, key):
    assert one(spark, text.lookup_key, raw) == key


@pytest.mark.parametrize("raw,key", [("New School, Phase 2", "new-school-phase-2"), ("  ", "unknown"), ("建筑 设计", "建筑-设计"), ("_a_", "a")])
def test_key_fragment(spark, raw, key):
    assert one(spark, text.key_fragment, raw) == key


@pytest.mark.parametrize("raw,label", [("urban_design-now", "Urban Design Now"), (None, "Unknown"), ("McKay hall", "McKay Hall")])
def test_title_case(spark, raw, label):
    assert one(spark, text.title_case, raw) == label


def test_strip_html_and_titles(spark):
    assert one(spark, text.strip_html, "<p>A &amp; B<br>c</p>") == "A & B c"
    assert one(spark, text.html_title, "<TITLE>x\n y</TITLE>") == "x y"


@pytest.mark.parametrize("base,link,whole", [("https://a.org/x/y.html", "z.html", "https://a.org/x/z.html"), ("https://a.org/x/", "/q", "https://a.org/q"), ("https://a.org/x", "//b.org/c", "https://b.org/c"), ("https://a.org/x", "http://c.org", "http://c.org")])
def test_resolve_url(spark, base, link, whole):
    assert one(spark, text.resolve_url, base, link) == whole


@pytest.mark.parametrize("title,authority,place", [("Construction d'une école, 31000 Toulouse", None, "Toulouse"), ("Notice", "City of Porto, works", "Porto"), ("New hall in Bergen.", None, "Bergen"), ("x", "Office", None)])
def test_place_of(spark, title, authority, place):
    assert one(spark, text.place_of, title, authority) == place


@pytest.mark.parametrize("raw,day", [("2026-03-04", "2026-03-04"), ("2026/03/04", "2026-03-04"), ("2026-03-04T10:00:00Z", "2026-03-04"), ("Closes 04/03/2026 noon", "2026-03-04"), ("bis 04.03.2026", "2026-03-04"), ("March 4, 2026", "2026-03-04"), ("Wed, 04 Mar 2026 08:00:00 +0000", "2026-03-04"), ("4 March 2026", "2026-03-04"), ("31.02.2026", None), ("soon", None), (None, None)])
def test_parse_date(spark, raw, day):
    got = one(spark, dates.parse_date, raw)
    assert (got and got.isoformat()) == day


def test_cjk_dates_and_windows(spark):
    assert one(spark, dates.parse_cjk_date, "截止 2026 年 3 月 4 日").isoformat() == "2026-03-04"
    assert dates.publication_from(date(2026, 3, 10), 7) == date(2026, 3, 3)
    assert dates.iso_or_none("2026-3-4") is None


@pytest.mark.parametrize("raw,amount", [("EUR 1.250.000,50", 1250000.5), ("1,250,000.50", 1250000.5), ("CHF 1'250'000", 1250000.0), ("1 250,5", 1250.5), ("1.250", 1250.0), ("1.25", 1.25), ("2.5E6", 2500000.0), ("no", None), (None, None)])
def test_parse_amount(spark, raw, amount):
    assert one(spark, money.parse_amount, raw) == amount


def test_numbers_are_rounded_as_printf_does(spark):
    """Shortest spellings that end in a five: 0.435 is less than it says, 0.005 more, 0.125 exactly that."""
    values = [0.435, 0.285, 0.845, 2.675, 0.005, 0.125, 0.375, 0.29, 1.0, 0.0, 0.995, -0.435, -0.125, 2.5e11 + 0.125, 3e15, None] + [(10_000 * i + 5_000) / 1_000_000 for i in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", money.fixed(F.col("v"), 2).alias("two"), money.fixed(F.col("v"), 0).alias("none"), money.value_label(F.col("v") * 1_000_000, F.lit(None).cast("string"), F.lit(None).cast("string")).alias("label")).collect()
    for r in rows:
        assert (r.two, r.none) == (None if r.v is None else f"{r.v:.2f}", None if r.v is None else f"{r.v:.0f}")
    assert rows[0].label == "Estimated service value EUR 0.43M"


def test_fee_and_value_labels(spark):
    row = spark.sql("select cast(null as double) a, 0.0d b, 50.0d c, 2500000.0d v").select(money.fee_label(F.col("a"), F.col("b")).alias("free"), money.fee_label(F.col("c"), F.col("a")).alias("paid"), money.value_label(F.col("v"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("v")).first()
    assert tuple(row) == ("No participation fee", "EUR 50 registration", "Estimated service value EUR 2.50M")


def test_tolerant_json(spark):
    rows = spark.createDataFrame([('["a", 1, null, "b"]',), ('{"a": 1}',), ("[x",), (None,)], "p string").select(semi.string_items(F.col("p")).alias("x")).collect()
    assert [r["x"] for r in rows] == [["a", "b"], [], [], []]
    assert one(spark, lambda c: semi.first_value(semi.record(c), ["a", "b.c"]), '{"a": "  ", "b": {"c": 7}}') == "7"
    assert one(spark, lambda c: semi.list_value(semi.record(c), ["x", "y"]), '{"x": [], "y": "z"}') == ["z"]
    assert tuple(one(spark, semi.first_money, '{"x": [{"y": {"amount": "12.5", "currency": "eur"}}]}')) == (12.5, "EUR")
    assert one(spark, semi.linked_addresses, '<script type="application/ld+json">{"address": {"@type": "PostalAddress", "streetAddress": "A 1"}}</script>')[0]["street"] == "A 1"


def test_rules(spark):
    assert one(spark, lambda c: rules.cut_at_markers(c, ["stop", "x"]), "go on stop x") == "go on "
    assert one(spark, lambda c: rules.weighted_score(c, {"a": 2, "b": 3, "z": 9}), "ab") == 5
    assert one(spark, lambda c: rules.any_true_or_unknown(c, ["q"]), "none") is None


def test_datum_is_identity_outside(spark):
    got = spark.sql("select 48.0d lat, 2.0d lng").select(geo.gcj02_to_wgs84(F.col("lat"), F.col("lng")).alias("g")).first()["g"]
    assert (got["lat"], got["lng"]) == (48.0, 2.0)


def test_query_variants(spark):
    got = spark.sql("select array('a 1', 'b') x, array('Porto', cast(null as string), 'b') y").select(geo.query_variants(F.col("x"), F.col("y")).alias("v")).first()["v"]
    assert got == ["a 1, Porto", "a 1", "a 1, b", "b, Porto", "b"]


def test_folding_asks_few_ranges(spark):
    """the class holds the characters with several letters and no others; long texts without them are folded in a moment."""
    df = spark.range(0x80, 0xFFFE).filter("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert {r.c for r in df.filter(F.col("c").rlike(text.SEVERAL_CLASS)).collect()} == set(text.FOLD_SEVERAL)
    assert text.SEVERAL_CLASS.count("-") < 60
    several = "é" + "".join(text.FOLD_SEVERAL) + "… ﬁn"
    assert one(spark, text.fold, several) == "e" + "".join(text.FOLD_SEVERAL.values()).lower() + "... fin"
    start = time.monotonic()
    assert spark.range(1).select(F.length(text.fold(F.repeat(F.lit("straße über "), 400_000))).alias("n")).first().n == 4_800_000
    assert time.monotonic() - start < 10


def test_located_in_one_scan_or_several(spark):
    """texts that hold the mark itself give the same places."""
    rows = spark.createDataFrame([("xa1 b22c",), ("x\x01a1 b2\x01b22c",), ("",), ("none",), (None,)], "t string").select(text.located(F.col("t"), r"([a-z])(\d+)", 2).alias("m"), text.located(F.col("t"), r"[a-z]\d+").alias("w")).collect()
    assert [r.m and [tuple(x) for x in r.m] for r in rows] == [[(1, 3, "1"), (4, 7, "22")], [(2, 4, "1"), (5, 7, "2"), (8, 11, "22")], [], [], None]
    assert [r.w and [x.value for x in r.w] for r in rows[:2]] == [["a1", "b22"], ["a1", "b2", "b22"]]


def test_even_white_space(spark):
    for raw in ("a b", "a  b", "\ta　 b\n", "  ", "a b   c ", ""):
        assert one(spark, text.even, raw) == re.sub(r"\s+", " ", raw)
