"""Markers in one scan, deadlines in texts, notice rules."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from opalyx.functions import dates, rules, text
from opalyx.plans import notices


def test_markers_find_what_contains_finds(spark):
    rng = random.Random(3)
    names = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {"a.c", "(b)", "[c", "c|a", "a\\b", "院", "病房", "病房改造", "改造", "😀b"})
    texts = ["".join(rng.choice("abc.()[]|\\ 病房改造院😀") for _ in range(rng.randrange(40))) for _ in range(200)] + ["", None, "a" * 5_000]
    m = rules.Markers(names[:30], names[20:])
    weights, labels = {n: k - 20 for k, n in enumerate(names)}, {"x": names[:9], "y": names[9:12], "z": ["nowhere"]}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", m.hits(F.col("t")).alias("h"))
    for r in df.select("t", "h", rules.weight_of(F.col("h"), weights).alias("w"), rules.labels_of(F.col("h"), labels).alias("l"), rules.any_hit(F.col("h"), names[:3]).alias("a")).collect():
        held = {n for n in names if n in (r.t or "")}
        assert set(r.h) == held and len(r.h) == len(held)
        assert r.w == sum(weights[n] for n in held)
        assert r.l == [k for k, v in labels.items() if held & set(v)] and r.a == bool(held & set(names[:3]))
    assert spark.range(1).select(rules.Markers([]).hits(F.lit("x")).alias("h")).first().h == []
    with pytest.raises(ValueError):
        rules.Markers(["a", ""])


def test_located_matches_and_windows(spark):
    t = "ab1 😀 ab22, xab333"
    got = spark.range(1).select(text.located(F.lit(t), r"ab(\d+)", 1).alias("m"), text.located(F.lit("none"), r"ab(\d+)").alias("n"), text.located(F.lit(None).cast("string"), "a").alias("z")).first()
    assert [(m.start, m.end, m.value) for m in got.m] == [(0, 3, "1"), (6, 10, "22"), (13, 18, "333")] and got.n == [] and got.z is None
    assert all(t[m.start : m.end].endswith(m.value) for m in got.m)
    around = spark.range(1).select(*(text.window(F.lit(t), F.lit(s), F.lit(e), 4, 2).alias(f"w{s}") for s, e in ((0, 3), (6, 10), (13, 18)))).first()
    assert list(around) == [t[0:5], t[2:12], t[9:20]]


# The forms that the register's notices take, written anew: an ISO time, spaced digits, a bracket after the label, a word export, an opening time before the deadline.
NOTICES = [
    ("六、投标文件的递交\n递交截止时间：2026-05-28 10:30:00\n递交方式：现场递交文件", date(2026, 5, 7), date(2026, 5, 28)),
    ("项目概况：潜在供应商应于 202 6 年 5 月 19 日 13 时 30分（北京时间）前提交响应文件。\n截止时间：202 6 年 5 月 19 日 13 时 30分（北京时间）", date(2026, 5, 8), date(2026, 5, 19)),
    ("招标范围：建筑方案设计。\n5.1 投标文件递交的截止时间（投标截止时间，下同）为 2026-05-28 09:00。\n3.1.1资质要求", date(2026, 5, 7), date(2026, 5, 28)),
    ("项目名称：酒店设计服务\n投标截止时间：2026年05月29日 09时30分\n开标时间：2026年05月29日 09时30分", date(2026, 5, 8), date(2026, 5, 29)),
    ("开标时间：2026年05月18日 09时30分\n投标文件递交截止时间：2026年05月19日 09时30分\n资质要求", date(2026, 5, 8), date(2026, 5, 19)),
    ("截止时间：2028-01-01", date(2026, 5, 8), None),
    ("截止时间：2028-01-01", None, date(2028, 1, 1)),
    ("投标截止时间：２０２６年６月１日\n2026-07-01", date(2026, 5, 8), date(2026, 6, 1)),
    ("截止时间：2026年13月1日 或 2026-02-30", None, None),
    ("2026-06-01", None, None),
    (None, None, None),
]


def test_deadlines_of_notices(spark):
    df = spark.createDataFrame([(k, t, p) for k, (t, p, _) in enumerate(NOTICES)], "k int, t string, p date")
    got = {r.k: r.d for r in df.select("k", notices.deadline(F.col("t"), F.col("p")).alias("d")).collect()}
    assert got == {k: d for k, (_, _, d) in enumerate(NOTICES)}


def test_day_a_page_was_made_comes_last(spark):
    html = '<META name="others" content="x 页面生成时间 2026-05-20">'
    got = spark.range(1).select(notices.deadline(F.lit("nothing"), F.lit(None).cast("date"), F.lit(html)).alias("a"), notices.deadline(F.lit("开标时间：2026-05-01"), F.lit(None).cast("date"), F.lit(html)).alias("b")).first()
    assert (got.a, got.b) == (date(2026, 5, 20), date(2026, 5, 1))


def test_window_scores_what_stands_around_a_phrase(spark):
    t = "递交投标文件\n" + "很" * 60 + "\n于 2026年 5 月 9 日（北京时间）前\n" + "远" * 30 + "\n提交响应文件"
    c = spark.range(1).select(dates.deadline_candidates(F.lit(t), **notices.DEADLINES).alias("c")).first().c
    assert [(x.score, x.day) for x in c] == [(1, date(2026, 5, 9))] * 2  # its line, and the characters around it
    near = spark.range(1).select(dates.deadline_candidates(F.lit("递交投标文件\n于 2026年 5 月 9 日（北京时间）前"), **notices.DEADLINES).alias("c")).first().c
    assert [(x.score, x.day) for x in near] == [(1, date(2026, 5, 9)), (3, date(2026, 5, 9))]


def test_few_markers_are_searched_without_a_pattern(spark):
    """up to SEARCHED markers cost a search each, and give what the scan gives."""
    names = ["hall", "shall", "all", "design build", "design builder"]
    hits = rules.Markers(names).hits(F.col("t"))
    df = spark.createDataFrame([("the shallow hall",), ("design builders",), ("",), (None,)], "t string").select(hits.alias("h"))
    assert "regexp" not in df._jdf.queryExecution().analyzed().toString()
    many = rules.Markers(names, [f"zz{i}" for i in range(rules.SEARCHED)])
    scanned = spark.createDataFrame([("the shallow hall",), ("design builders",), ("",), (None,)], "t string").select(many.hits(F.col("t")).alias("h"))
    assert [sorted(r.h) for r in df.collect()] == [sorted(r.h) for r in scanned.collect()] == [["all", "hall", "shall"], ["design build", "design builder"], [], []]
