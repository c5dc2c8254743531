import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from opalyx.sources import catalog, connectors, ingest, live, parsers, sinks
from opalyx.sources.catalog import Batch, Source

S = Source("s", "Source", "official", "france", "https://s.org", source_tier="primary", regions=["europe"], languages=["fr"])


def payloads(df):
    return [json.loads(r["payload"]) for r in df.collect()]


def sources(spark):
    return catalog.catalog_frame(spark, [S])


def test_contract_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id_avviso,descrizione_avviso,denominazione_stazione_appaltante,tipo_avviso,data_pubblicazione_scp,scadenza_avviso,url_avviso\n1,Progettazione nuova scuola,Comune di Roma,Avviso,01/02/2026,01/03/2026,https://x/1\n2,Progettazione museo,Comune di Roma,Avviso,05/02/2026,,\n3,Fornitura cancelleria scuola,Comune di Roma,Avviso,06/02/2026,,\n4,Progettazione biblioteca,Altro,Avviso,07/02/2026,,\n")
    src = Source("scp", "SCP", "official", "italy", "https://scp", buyer_allowlist=["Comune di Roma"])
    got = payloads(connectors.contract_notices_csv(connectors.csv_rows(spark, str(tmp_path / "a.csv")), src, 5, date(2026, 1, 1)))
    assert [g["officialNoticeId"] for g in got] == ["2", "1"] and got[1]["deadline"] == "2026-03-01"


def test_bilingual_csv(spark):
    df = spark.createDataFrame([(" ", "Services d'architecture pour un hôpital", "*CNST", "2026-01-05")], "`title-titre-eng` string, `title-titre-fra` string, `procurementCategory-categorieApprovisionnement` string, `publicationDate-datePublication` string")
    assert payloads(connectors.bilingual_csv(df, S))[0]["title"].startswith("Services")


def test_ocds(spark):
    release = {"ocid": "o1", "parties": [{"name": "Buyer A", "roles": ["buyer"]}], "tender": {"title": "Architect for a school building", "description": "design services", "classification": {"id": "71200000"}, "value": {"amount": 1000, "currency": "GBP"}, "tenderPeriod": {"endDate": "2026-02-01"}, "documents": [{"url": "https://d"}]}}
    other = {"ocid": "o2", "tender": {"title": "Paper supply", "classification": {"id": "30000000"}}}
    df = spark.createDataFrame([(json.dumps({"releases": [other, release]}),)], "payload string")
    got = payloads(connectors.ocds_releases(df, S))
    assert [(g["noticeId"], g["buyer"], g["estimatedValueText"], g.get("estimatedValueEur")) for g in got] == [("o1", "Buyer A", "GBP 1,000", None)]


def test_rss_scores_and_order(spark):
    item = lambda t, d, p: f"<item><title>{t}</title><link>https://x/{p}</link><description>{d}</description><pubDate>Wed, {p:02d} Mar 2026 08:00:00 +0000</pubDate></item>"
    feed = "<rss><channel>" + item("Design services for a museum", "x", 3) + item("Architect for a library building", "&lt;table&gt;&lt;tr&gt;&lt;th&gt;Reference&lt;/th&gt;&lt;td&gt;R7&lt;/td&gt;&lt;/tr&gt;&lt;/table&gt;", 1) + item("Logo contest", "student", 5) + "</channel></rss>"
    got = payloads(connectors.rss_notices(spark.createDataFrame([(feed,)], "payload string"), S))
    assert [g["title"] for g in got] == ["Architect for a library building", "Design services for a museum"]
    assert got[0]["noticeId"] == "R7" and got[0]["publishedAt"] == "2026-03-01"


def test_atom_with_details(spark):
    entry = lambda i, state: f'<entry><title>Proyecto museo arquitectura {i}</title><link href="https://d/{i}"/><summary>Estado: {state}; Importe: 1.000,00</summary><updated>2026-03-01T00:00:00Z</updated></entry>'
    feed = "<feed>" + entry(1, "PUB") + entry(1, "PUB") + entry(2, "RES") + "</feed>"
    details = spark.createDataFrame([("https://d/1", "<p>Expediente: E-1</p><p>architecture for a museum 71200000</p>")], "source_url string, html string")
    got = payloads(connectors.atom_notices(spark.createDataFrame([(feed,)], "payload string"), details, S))
    assert [(g["noticeId"], g["estimatedValueEur"], g["cpv"]) for g in got] == [("E-1", 1000.0, ["71200000"])]


def test_buyer_pages_route(spark):
    html = '<table><tr><td><a href="/n/1">Architecture school project</a></td></tr><tr><td><a href="/n/2">Printing</a></td></tr></table>'
    got = connectors.buyer_pages(spark.createDataFrame([("https://b.org/list", html), ("https://b.org/one", "<h1>Notice</h1>")], "source_url string, payload string"), S).collect()
    assert sorted(r["source_url"] for r in got) == ["https://b.org/n/1", "https://b.org/one"]


def test_scaffold_and_sitemaps(spark):
    with pytest.raises(ValueError):
        connectors.scaffold(spark, S)
    fetched = spark.createDataFrame([("i", "i", "<sitemapindex><loc>p</loc></sitemapindex>"), (None, "p", "<urlset><loc> a </loc><loc>b</loc></urlset>")], "root string, url string, xml string")
    assert sorted(r["url"] for r in connectors.sitemap_pages(fetched).collect()) == ["a", "b"]


def test_page_parser_and_currency(spark):
    html = "<h1> Neubau Schule </h1><p>Vergabestelle: Stadt X</p><p>Abgabetermin: 04.03.2026</p><p>Geschätzter Auftragswert: CHF 1'000'000</p><p>CPV: 71200000, 71220000</p>"
    row = parsers.parse(spark.createDataFrame([("s", "u", html)], "source_id string, source_url string, payload string"), sources(spark), parsers.PARSERS["simap"]).first()
    assert (row["title"], row["authority_name"], row["estimated_contract_value_eur"], row["cpv_codes"], str(row["deadline_at"]), row["error"]) == ("Neubau Schule", "Stadt X", None, ["71200000", "71220000"], "2026-03-04", None)


def test_ingest_splits_and_drops_stale(spark):
    docs = spark.createDataFrame([("s", "u1", json.dumps({"title": "Architect for hospital", "deadline": "2026-05-01"})), ("s", "u2", "nothing"), ("s", "u3", json.dumps({"title": "Old", "deadline": "2020-01-01"}))], "source_id string, source_url string, payload string")
    out = ingest.ingest(docs, sources(spark), "generic", date(2026, 3, 1))
    assert [r["title"] for r in out.records.collect()] == ["Architect for hospital"]
    assert [r["error"] for r in out.failures.collect()] == ["payload is no JSON object"]
    assert out.run.first()["status"] == "completed_with_failures"


def test_catalog_includes_and_cycles(tmp_path):
    (tmp_path / "list.txt").write_text("a\n# c\nb\na\n")
    (tmp_path / "one.json").write_text(json.dumps({"sources": [{"source_id": "x", "name": "X", "kind": "media", "jurisdiction": "f", "base_url": "u", "url_list_path": "list.txt"}]}))
    (tmp_path / "top.json").write_text(json.dumps({"include": ["one.json"]}))
    got = catalog.load_catalog(str(tmp_path / "top.json"))
    assert got[0].url_list == ["a", "b"] and got[0].pack == "one"
    with pytest.raises(ValueError):
        catalog.select_sources(got, Batch("b", include_source_ids=["nope"]))
    (tmp_path / "one.json").write_text(json.dumps({"include": ["top.json"]}))
    with pytest.raises(ValueError):
        catalog.load_catalog(str(tmp_path / "top.json"))


def test_fetch_retries():
    import io

    calls = []

    class Answer(io.BytesIO):
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    def opener(request, timeout):
        calls.append(timeout)
        if len(calls) < 3:
            raise OSError("down")
        return Answer(b"\xef\xbb\xbfok")

    assert live.fetch({"url": "http://x", "pause": 0}, 3, opener) == "ok" and calls == [30, 30, 30]
    assert live.fetch({"url": "http://x", "pause": 0, "required": False}, 1, lambda *a, **k: (_ for _ in ()).throw(OSError())) is None


def test_sql_dump_and_versions(spark, tmp_path):
    df = spark.createDataFrame([("a'b", None, True)], "x string, y int, z boolean")
    assert sinks.sql_inserts(df, "t").first()[0] == "INSERT INTO t (x, y, z) VALUES ('a''b', NULL, 1);"
    first = sinks.write_version(df, str(tmp_path / "v"))
    second = sinks.write_version(df, str(tmp_path / "v"))
    assert first != second and sinks.latest_version(spark, str(tmp_path / "v")).endswith(second.rsplit("/", 1)[1])
    assert sinks.latest_version(spark, str(tmp_path / "w")) is None


def test_geocode_cache_keeps_misses(spark):
    rec = spark.createDataFrame([("a", "Porto", "portugal"), ("b", "Nowhere", "portugal"), ("c", "New", "portugal")], "id string, location_label string, jurisdiction string")
    cache = spark.createDataFrame([("portugal:porto", 41.1, -8.6, 0.9), ("portugal:nowhere", None, None, None)], "location_key string, lat double, lng double, confidence double")
    assert {r["id"]: r["geo_lat"] for r in ingest.geocoded(rec, cache).collect()} == {"a": 41.1, "b": None, "c": None}
    assert [r["location_key"] for r in ingest.geocode_misses(rec, cache).collect()] == ["portugal:new"]


def test_official_pages(spark):
    rec = spark.createDataFrame([("a", "Extension municipal library quarter", None, None)], "id string, title string, official_url string, evidence_note string")
    pages = spark.createDataFrame([("a", "https://x/extension-municipal-library.html", "<p>Extension of the municipal library quarter</p>"), ("a", "https://x/other", "<p>none</p>")], "id string, url string, html string")
    assert parsers.official_pages(rec, pages).first()["official_url"].endswith("library.html")


def test_scored_search_keeps_4000_characters(spark):
    hits = spark.createDataFrame([("n1", "Museum", "https://s.org/n1", "2026-01-02")], "id string, title string, url string, published string")
    details = spark.createDataFrame([("n1", "<p>" + "museum " * 400 + "deadline</p>" + "x" * 2000)], "id string, html string")
    got = payloads(connectors.scored_search(hits, details, S, 5, title_weights={"museum": 9}, body_weights={}, negative={}))
    assert len(got[0]["summary"]) == 4000 and "deadline" in got[0]["summary"]


def test_feed_takes_designs_of_built_things_and_no_announcements(spark):
    cells = lambda **kv: "<table>" + "".join(f"<tr><td><b>{k}: </b></td><td>{v}</td></tr>" for k, v in kv.items()) + "</table>"
    item = lambda t, d: f"<item><title>{t}</title><link>https://x/{len(t)}</link><description><![CDATA[{d}]]></description></item>"
    items = [
        item("Shared path along the shore", cells(Organisation="Agency", Categories="81100000 - Professional services<br>71200000 - Architectural services", Overview="Detailed design of a boardwalk")),
        item("Concept design of a pavilion", cells(Overview="This is an Advance Notice. No information from suppliers is requested.")),
        item("Architectural models", cells(Overview="Toys")),
        item("Supply of pipes to a facility", cells(Overview="Stormwater")),
    ]
    got = payloads(connectors.rss_notices(spark.createDataFrame([("<rss><channel>" + "".join(items) + "</channel></rss>",)], "payload string"), S))
    assert [(g["title"], g["buyer"], g["summary"]) for g in got] == [("Shared path along the shore", "Agency", "Detailed design of a boardwalk")]


def test_municipal_rows_by_service_and_by_steering(spark):
    rows = ["Objektplanung Gebäude und Innenräume", "Projektsteuerung für den Neubau einer Schule", "Projektsteuerung für Software", "Lieferung von Papier", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(connectors.municipal_relevant(F.col("t")).alias("r"), connectors.municipal_candidate(F.col("t")).alias("c"))
    assert [tuple(map(bool, r)) for r in df.collect()] == [(True, True), (True, True), (False, True), (False, False), (False, False)]


def test_notice_search_uses_the_notice_rules(spark):
    hits = spark.createDataFrame([(i, t, f"https://s.org/{i}", "2026-05-08", "山东省", "工程建设", "招标公告") for i, t in (("a", "市民文化中心建筑设计招标公告"), ("a", "市民文化中心建筑设计招标公告"), ("b", "油气钻井工程设计"), ("c", "医院病房改造施工图设计服务"), ("d", "水利工程方案设计"), ("e", "办公用品"))], "id string, title string, url string, published string, province string, business string, information string")
    details = spark.createDataFrame([("a", "<p>建筑方案设计</p>\n<p>投标文件递交截止时间：2026年05月19日 09时30分</p>", None), ("d", "<p>方案设计 医院</p>", "水利工程")], "id string, html string, category string")
    got = {g["noticeId"]: g for g in payloads(connectors.notice_search(hits, details, S, 10))}
    assert set(got) == {"a", "c"}
    assert (got["a"]["deadline"], got["a"]["evidenceLevel"], got["a"]["procedureType"], got["a"]["location"]) == ("2026-05-19", "official_notice", "open", "山东省")
    assert "civic_culture" in got["a"]["builtAssetTypes"] and got["c"]["projectModes"] == ["renovation"] and got["c"]["evidenceLevel"] == "official_listing" and "title-only" in got["c"]["evidenceNote"]


def test_pages_by_tiers(spark):
    rec = spark.createDataFrame([(k, "Extension municipal library quarter", "Library authority", None, None) for k in "abc"], "id string, title string, authority_name string, official_url string, evidence_note string")
    fits = "<title>Municipal library</title><p>Extension of the quarter</p>"
    pages = spark.createDataFrame([("a", "https://x/library/1", "nothing"), ("a", "https://x/library/2", fits + '<link rel="canonical" href="https://x/own">'), ("b", "https://x/library/1", ""), ("c", "https://x/none", fits)], "id string, url string, html string")
    rendered = spark.createDataFrame([("a", "https://x/library/3", fits), ("b", "https://x/library/1", fits)], "id string, url string, html string")
    assert {r.id: r.official_url for r in parsers.official_pages(rec, pages, rendered).collect()} == {"a": "https://x/own", "b": "https://x/library/1", "c": None}


def test_tiers_leave_out_candidates_that_were_tried(spark):
    from opalyx.operators import aggregates

    rec = spark.createDataFrame([("a",), ("b",)], "id string")
    first = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], "id string, c string, score int")
    second = spark.createDataFrame([("a", "x", 9), ("a", "y", 9), ("b", "x", 9)], "id string, c string, score int")
    choose = lambda df: aggregates.first_passing(df, "id", [F.asc("c")], 5, F.col("score") > 5)
    assert sorted(map(tuple, aggregates.by_tiers(rec, [first, second], "id", choose, "c").collect())) == [("a", "y", 9)]
    assert sorted(map(tuple, aggregates.by_tiers(rec, [first, second], "id", choose).collect())) == [("a", "x", 9), ("b", "x", 9)]


def test_page_scores_of_a_city_page(spark):
    """A project's page under the paths that publish tenders: 34 for its address (24 letters of words, path words), and its words in title or text."""
    url = "https://www.city.example/de/projekte-und-ausschreibungen/hochbauvorhaben/wohnsiedlung-herbstweg.html"
    title = "Lotissement Herbstweg, rénovation partielle et densification ; concours ouvert"
    got = spark.range(1).select(parsers.url_score(F.lit(url), F.array(F.lit("herbstweg"))).alias("u"), parsers.page_score(F.lit(url), F.lit("<title>Wohnsiedlung Herbstweg</title><p>Amt fuer Hochbauten</p>"), F.lit(title), F.lit("HBD - Amt für Hochbauten (AHB)")).alias("p")).first()
    assert got.u == 9 + 15 + 10 and got.p == got.u + 4 * 9 + len("hochbauten")


def test_allow_list_of_many_buyers(spark):
    from opalyx.functions import text

    names = [f"Comune n. {k}" for k in range(1_500)] + ["Città di Forlì", "Straße & Söhne", "ﬁnance Ⅻ"]
    assert {r.t: r.p for r in spark.createDataFrame([(n,) for n in names[-5:]], "t string").select("t", text.plain_text(F.col("t")).alias("p")).collect()} == {n: text.driver_plain(n) for n in names[-5:]}
    buyers = ["COMUNE N 1499 - ufficio", "comune n x", "La CITTA DI FORLI'", "Strasse", "stra e sohne", None, ""]
    df = spark.createDataFrame([(b,) for b in buyers], "b string").select("b", connectors.buyer_allowed(F.col("b"), names).alias("ok"))
    plain = {b: any(text.driver_plain(n) in text.driver_plain(b or "") for n in names) for b in buyers}
    assert {r.b: r.ok for r in df.collect()} == plain and plain["COMUNE N 1499 - ufficio"] and not plain["comune n x"]
    assert df.sparkSession.range(1).select(connectors.buyer_allowed(F.lit("x"), ["--"]).alias("a"), connectors.buyer_allowed(F.lit("x"), []).alias("b")).first() == (True, True)


def test_pages_are_read_once(spark):
    """the text of a page is made before it meets its records."""
    from opalyx import queries

    plan = queries.QUERIES["page_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if " AS page#" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    below = [line for n, line in enumerate(plan[at + 1 :]) if all(depth(x) > depth(plan[at]) for x in plan[at + 1 : at + 2 + n])]
    assert below and not any("Generate" in line for line in below)


def test_only_tried_pages_are_read(spark, monkeypatch):
    """pages are judged after the choice of those that are tried."""
    from opalyx.operators import aggregates

    seen, first_passing = [], aggregates.first_passing
    monkeypatch.setattr(aggregates, "first_passing", lambda df, *rest: (seen.append(df.columns), first_passing(df, *rest))[1])
    rec = spark.createDataFrame([("a", "Municipal library extension", "https://library.org", None)], "id string, title string, official_url string, evidence_note string")
    pages = spark.createDataFrame([("a", f"https://x/library-extension/{i}.html", f"<title>library extension municipal {i}</title>") for i in range(9)], "id string, url string, html string")
    assert parsers.official_pages(rec, pages).first()["official_url"] == "https://x/library-extension/0.html"
    assert seen and all("fit" not in names for names in seen)
