"""Register definitions, notice rules and links beyond what the registered queries hold against SQL."""

import json

from pyspark.sql import functions as F

from opalyx.functions import links, semi, text
from opalyx.operators import store
from opalyx.plans import notices
from opalyx.plans.query import Query
from opalyx.sources import definitions
from opalyx.sources.catalog import Source

S = Source("r", "R", "official", "europe", "https://r")


def test_pages_are_read_up_to_a_short_one(spark):
    full, short = json.dumps({"hits": [1, 2, 3]}), json.dumps({"hits": [4]})
    pages = spark.createDataFrame([(0, full), (1, full), (2, short), (3, full)], "page int, payload string")
    assert sorted(r["page"] for r in definitions.until_short(pages, "hits", 3).collect()) == [0, 1, 2]
    assert definitions.until_short(pages.filter("page < 2"), "hits", 3).count() == 2
    work = definitions.page_list(spark, S, 5, definitions.page_size(3, 10, 50), first=1).collect()
    assert [(r["source_id"], r["page"], r["size"]) for r in work] == [("r", p, 50) for p in range(1, 6)]


def test_a_broken_answer_gives_no_documents(spark):
    pages = spark.createDataFrame([(0, "<html>"), (1, '{"notices": {}}'), (2, None)], "page int, payload string")
    assert definitions.ted(pages, S).count() == 0 and definitions.boamp(pages, S).count() == 0


def test_features_read_only_what_is_before_the_bidders(spark):
    rows = [("医院病房改造", "设计服务 资格审查 学校", "")]
    f = spark.createDataFrame(rows, "t string, b string, c string").select(notices.features(F.col("t"), F.col("b"), F.col("c")).alias("f")).first()["f"]
    assert f["assets"] == ["healthcare"] and f["modes"] == ["renovation"] and f["scopes"] == ["design_service"]


def test_query_parameters_come_back():
    q = Query(search="a", min_value=0.5, project_types=["urban_planning", "urban_planning"], include_expired=True, sort="latest", limit=7, offset=24)
    back = Query.from_params(q.to_params())
    assert back == Query(search="a", min_value=0.5, project_types=["urban_planning"], include_expired=True, sort="latest", limit=7, offset=24)
    assert "offset" not in Query().to_params() and "sort" not in Query().to_params()


def test_urls_and_codes_keep_their_digits(spark):
    from opalyx.sources import connectors

    fetched = spark.createDataFrame([("i", "i", "<urlset><loc> https://a.org/page0 </loc><loc>https://a.org/page1</loc><loc>https://a.org/p22</loc></urlset>")], "root string, url string, xml string")
    assert sorted(r["url"] for r in connectors.sitemap_pages(fetched).collect()) == ["https://a.org/p22", "https://a.org/page0", "https://a.org/page1"]


def test_streams_read_a_folder_of_parts(spark, tmp_path):
    from opalyx import queries

    rows = [(k, k % 3, "view") for k in range(30)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr("event_id", "CAST(TIMESTAMP '1998-01-01' AS timestamp_ntz) AS ts", "user_id", "event_type", "CAST(1 AS double) AS value", "'{}' AS props")
    events.repartition(3).write.parquet(f"{tmp_path}/folder/events.parquet")
    assert queries.QUERIES["stream_seen_dedup"](spark, f"{tmp_path}/folder").count() == 3
    assert sorted((r["user_id"], r["event_id"]) for r in queries.QUERIES["stream_latest_state"](spark, f"{tmp_path}/folder").collect()) == [(0, 27), (1, 28), (2, 29)]


def test_folding_and_character_references(spark):
    rows = [("Ａｒｃｈｉｔｅｃｔ ﬁn été №5",), ("&#233;&#x20AC;&amp;#65; &#0; &#99999999; x",), ("漢字",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(text.fold(F.col("t")).alias("f"), text.unescape(F.col("t")).alias("u")).collect()
    assert got[0]["f"] == "architect fin ete no5" and got[1]["u"] == "é€&#65; &#0; &#99999999; x" and got[2]["f"] == "漢字" and got[3]["f"] is None and got[3]["u"] is None


def test_page_text_of_odd_pages(spark):
    rows = [(None,), ("",), ("<p>none</p>",), ('<div class="detail_content">a<br>b<img src=x>c</div>d',), ('<div class="detail_content">open <div>x',)]
    got = spark.createDataFrame(rows, "h string").select(semi.class_text(F.col("h")).alias("t"), semi.balanced_div(F.col("h")).alias("b")).collect()
    assert [r["t"] for r in got] == [None, None, None, "a\nb c", "open\nx"]
    assert [r["b"] for r in got] == [None, None, None, "a<br>b<img src=x>c", "open <div>"]


def test_refused_images_and_removed_rows(spark):
    df = spark.createDataFrame([("https://x.org/logo.png", 500), ("https://x.org/hero.jpg", 1300)], "u string, w int")
    got = df.select(links.image_score(F.col("u"), F.lit(""), F.lit("img"), F.col("w"), F.lit(None).cast("int"), F.col("u")).alias("s")).collect()
    assert got[0]["s"] is None and got[1]["s"] == 58 + 8 + 8 + 12
    kept, changed = store.removed(df, F.col("w") > 5000)
    assert kept.count() == 2 and not changed.first()["changed"]


def test_shared_folder_needs_a_setting_on_a_cluster(spark, monkeypatch):
    import pytest

    from opalyx import runtime

    class Context:
        applicationId, master = "none-such", "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: None)

    with pytest.raises(ValueError):
        runtime.shared_dir(Session(), "x")
