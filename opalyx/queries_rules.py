"""Further registered queries: registers, notice rules, links, page text, keyed writes and small labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from opalyx.functions import dates, geo, linked, links, money, places, rules, semi, text
from opalyx.operators import review, store, versions
from opalyx.plans import classify, labels, notices, saved
from opalyx.plans import query as Q
from opalyx.plans.view import TODAY, opportunities, table
from opalyx.queries import V, query
from opalyx.runtime import shared_dir, ship
from opalyx.sources import connectors, definitions
from opalyx.sources.catalog import Source
from opalyx.streaming import jobs

S = Source("reg", "Register", "register", "europe", "https://base.org")


def _landed(df, key: str, path: str, size: int, **fields):
    """Landed pages: rows of df in order of key, so many to a page, as a JSON answer."""
    rows = df.select((F.col(key) / size).cast("int").alias("page"), F.col(key).alias("_k"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("r"))
    packed = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("_k", "r"))).alias("x")).withColumn("x", F.transform("x", lambda y: y["r"]))
    return packed.select("page", F.to_json(F.struct(F.col("x").alias(path))).alias("payload"))


def _got(docs, *names: str):
    v = F.parse_json("payload")
    return docs.select("source_url", *(F.trim(semi.at(v, n)).alias(n) for n in names))


_ALL, _PAGE = 1_000_000_000, 100


# --- registers -----------------------------------------------------------------------------------
@query("csv_notices", "SELECT 'https://n.org/' || c_custkey AS source_url, CAST(c_custkey AS VARCHAR) AS \"officialNoticeId\", 'Progettazione museo ' || c_name AS title FROM customer WHERE c_custkey % 3 = 0")
def csv_notices(spark, sf):
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "customer").select(k.cast("string").alias("id_avviso"), F.concat(F.when(k % 3 == 0, "Progettazione museo ").otherwise("Stampa museo "), "c_name").alias("descrizione_avviso"), F.lit("1998-05-01").alias("data_pubblicazione_scp"), F.lit("Avviso").alias("tipo_avviso"), F.lit("Comune").alias("denominazione_stazione_appaltante"), F.concat(F.lit(" https://n.org/"), k.cast("string")).alias("url_avviso"), F.lit("1998-07-01").alias("scadenza_avviso"))
    rows = rows.withColumns({c: none for c in ("importo_lotto", "cpv", "descrizione_cpv", "scadenza") if c not in rows.columns})
    return _got(connectors.contract_notices_csv(rows, S, limit=None), "officialNoticeId", "title")


@query("sitemap_urls", "SELECT 'https://s' || p_size || '.org/map.xml' AS root, 'https://s' || p_size || '.org/page' || p_partkey AS url FROM part")
def sitemap_urls(spark, sf):
    p = table(spark, sf, "part")
    root = F.concat(F.lit("https://s"), F.col("p_size").cast("string"), F.lit(".org/map.xml"))
    inner = F.concat(F.lit("https://s"), F.col("p_size").cast("string"), F.lit(".org/m"), F.floor(F.col("p_partkey") / 1000).cast("string"), F.lit(".xml"))
    loc = lambda c: F.concat(F.lit("<loc> "), c, F.lit(" </loc>"))
    page = F.regexp_replace(F.concat(root, F.lit("|page"), F.col("p_partkey").cast("string")), r"map\.xml\|", "")
    maps = p.groupBy(inner.alias("url")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc(page)), ""), F.lit("</urlset>")).alias("xml")).withColumn("root", F.lit(None).cast("string"))
    top = p.select(root.alias("url"), inner.alias("i")).distinct().groupBy("url").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(loc(F.col("i"))), ""), F.lit("</sitemapindex>")).alias("xml")).withColumn("root", F.col("url"))
    return connectors.sitemap_pages(maps.unionByName(top).select("root", "url", "xml"), nested=_ALL)


@query("parser_codes", "SELECT page_id, '71200000,' || CAST(71220000 + page_id % 10 AS VARCHAR) AS codes, 'Bau ' || page_id AS title FROM pages")
def parser_codes(spark, sf):
    from opalyx.sources import parsers

    k = F.col("page_id")
    html = F.concat(F.lit("<h1>Bau "), k.cast("string"), F.lit("</h1><p>CPV: 71200000, "), (71220000 + k % 10).cast("string"), F.lit("</p>"))
    docs = table(spark, sf, "pages").select(F.lit("s").alias("source_id"), k.cast("string").alias("source_url"), html.alias("payload"))
    sources = spark.createDataFrame([("s", "Source", "switzerland", "primary", ["europe"], ["de"])], "source_id string, name string, jurisdiction string, source_tier string, regions array<string>, languages array<string>")
    got = parsers.parse(docs, sources, parsers.PARSERS["simap"])
    return got.select(F.col("source_url").cast("long").alias("page_id"), F.array_join("cpv_codes", ",").alias("codes"), "title")


@query("ted_notices", "SELECT 'https://t.org/' || c_custkey AS source_url, 'T-' || c_custkey AS \"noticeId\", CASE c_custkey % 4 WHEN 0 THEN 'Architectural services ' WHEN 3 THEN 'Works ' END || c_custkey AS title, c_mktsegment AS buyer FROM customer WHERE c_custkey % 4 IN (0, 3)")
def ted_notices(spark, sf):
    k = F.col("c_custkey")
    title = F.concat(F.when(k % 4 == 0, "Architectural services ").when(k % 4 == 1, "Architecture construction work ").when(k % 4 == 2, "Cleaning ").otherwise("Works "), k.cast("string"))
    pages = _landed(table(spark, sf, "customer"), "c_custkey", "notices", 500, **{"notice-title": F.struct(title.alias("eng")), "classification-cpv": F.array(F.when(k % 4 == 3, "71200000").otherwise("45000000")), "publication-number": F.concat(F.lit("T-"), k.cast("string")), "organisation-name-buyer": F.struct(F.array("c_mktsegment").alias("eng")), "links": F.struct(F.struct(F.concat(F.lit("https://t.org/"), k.cast("string")).alias("ENG")).alias("html"))})
    return _got(definitions.ted(pages, S, limit=None), "noticeId", "title", "buyer")


@query("boamp_notices", "SELECT 'https://b.org/' || c_custkey AS source_url, 'Architecte ' || c_custkey AS title, '71200000' AS codes, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS DOUBLE) END AS amount FROM customer WHERE c_custkey % 3 <> 0")
def boamp_notices(spark, sf):
    ship(spark)
    k = F.col("c_custkey")
    nested = F.to_json(F.struct(F.struct(F.when(k % 2 == 0, "EUR").otherwise("CHF").alias("@currencyID"), k.cast("double").cast("string").alias("#text")).alias("montant"), F.lit("71200000-1").alias("cpv")))
    pages = _landed(table(spark, sf, "customer"), "c_custkey", "results", 500, objet=F.concat(F.lit("Architecte "), k.cast("string")), nomacheteur=F.col("c_name"), nature_libelle=F.when(k % 3 == 0, "Résultat de marché").otherwise("Avis"), dateparution=F.lit("1998-05-01"), donnees=nested, url=F.concat(F.lit("https://b.org/"), k.cast("string")), descripteur_libelle=F.array(F.lit("Building")))
    got = definitions.boamp(pages, S, limit=None)
    v = F.parse_json("payload")
    return got.select("source_url", semi.at(v, "title").alias("title"), semi.at(v, "cpv[0]").alias("codes"), semi.at(v, "estimatedValueEur", "double").alias("amount"))


@query("simap_notices", "SELECT 'https://www.simap.ch/de/project-detail/' || c_custkey AS source_url, 'Architettura ' || c_custkey AS title, CASE WHEN c_custkey % 4 = 0 THEN 'P-' || c_custkey ELSE 'L-' || c_custkey END AS \"officialNoticeId\", CASE WHEN c_custkey % 4 = 0 THEN 'City' END AS location FROM customer WHERE c_custkey % 2 = 0")
def simap_notices(spark, sf):
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    pages = _landed(c, "c_custkey", "projects", 500, id=k.cast("string"), pubType=F.when(k % 2 == 0, "competition").otherwise("tender"), title=F.struct(F.concat(F.lit("Architettura "), k.cast("string")).alias("it")), publicationNumber=F.concat(F.lit("L-"), k.cast("string")), publicationDate=F.lit("1998-05-01"))
    detail = F.to_json(F.struct(F.struct(F.struct(F.struct(F.lit("City").alias("de")).alias("city")).alias("procOfficeAddress")).alias("project-info"), F.struct(F.concat(F.lit("P-"), k.cast("string")).alias("publicationNumber")).alias("base")))
    details = c.filter(k % 4 == 0).select(k.cast("string").alias("id"), detail.alias("payload"))
    return _got(definitions.simap(pages, details, S, limit=None), "title", "officialNoticeId", "location")


@query("anac_notices", f"SELECT 'https://pubblicitalegale.anticorruzione.it/' || CASE WHEN c_custkey % 2 = 0 THEN 'esiti/' ELSE 'bandi/' END || c_custkey || '?ricercaArchivio=true' AS source_url, CAST(c_custkey AS VARCHAR) AS \"officialNoticeId\", 'Restauro architettonico ' || c_custkey AS title, c_name AS buyer, CAST(c_custkey AS VARCHAR) AS \"estimatedValueEur\" FROM customer WHERE c_custkey % 5 <> 0")
def anac_notices(spark, sf):
    k = F.col("c_custkey")
    item = F.struct(k.cast("string").alias("valore_affidamento"))
    sections = F.array(F.struct(F.lit(None).cast("struct<soggetti_sa:array<struct<denominazione_amministrazione:string>>>").alias("fields"), F.array(item).alias("items")), F.struct(F.struct(F.array(F.struct(F.col("c_name").alias("denominazione_amministrazione"))).alias("soggetti_sa")).alias("fields"), F.lit(None).cast("array<struct<valore_affidamento:string>>").alias("items")))
    title = F.when(k % 5 == 0, "Stampa").otherwise(F.concat(F.lit("Restauro architettonico "), k.cast("string")))
    template = F.array(F.struct(F.struct(F.struct(title.alias("titolo")).alias("metadata"), sections.alias("sections")).alias("template")))
    pages = _landed(table(spark, sf, "customer"), "c_custkey", "content", _PAGE, idAvviso=k.cast("string"), codiceScheda=F.when(k % 2 == 0, "AD5").otherwise("P1"), dataPubblicazione=F.lit("1998-05-01"), template=template)
    return _got(definitions.anac(pages, S, limit=None, most=_ALL), "officialNoticeId", "title", "buyer", "estimatedValueEur")


@query("doffin_notices", "SELECT 'https://www.doffin.no/notices/' || c_custkey AS source_url, CASE WHEN c_custkey % 2 = 0 THEN 'Arkitekt school ' ELSE 'Landskap architect ' END || c_custkey AS title, c_name AS buyer FROM customer WHERE c_custkey % 3 <> 0")
def doffin_notices(spark, sf):
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    heading = F.concat(F.when(k % 3 == 0, "Poster of a ").when(k % 2 == 0, "Arkitekt school ").otherwise("Landskap architect "), k.cast("string"))
    pages = _landed(c, "c_custkey", "hits", _PAGE, id=k.cast("string"), heading=F.lit("listed"), buyer=F.array(F.struct(F.col("c_name").alias("name"))))
    pages = pages.withColumn("page", F.col("page") + 1)
    details = c.select(k.cast("string").alias("id"), F.to_json(F.struct(heading.alias("heading"), F.when(k % 3 == 0, "logo").otherwise("architect building").alias("description"))).alias("payload"))
    got = definitions.doffin(pages, details, S, limit=None, most=_ALL, size=_PAGE)
    return _got(got, "title", "buyer")


@query("tenderned_notices", "SELECT 'https://base.org/' || c_custkey AS source_url, CAST(c_custkey AS VARCHAR) AS \"noticeId\", 'Architect museum ' || c_custkey AS title, 'https://www.tenderned.nl/p' || c_custkey AS \"briefPdfUrl\" FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def tenderned_notices(spark, sf):
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    kind = lambda x: F.struct(F.lit(x).alias("code"))
    pages = _landed(c, "c_custkey", "content", _PAGE, publicatieId=k.cast("string"), typePublicatie=F.struct(F.when(k % 2 == 0, "AAO").otherwise("VOR").alias("code")), typeOpdracht=kind("D"), publicatiestatus=kind("PUB"), sluitingsDatum=F.lit("1998-07-01"), aanbestedingNaam=F.when(k % 3 == 0, "Architect uitzendkrachten").otherwise("Architect"))
    details = c.select(k.cast("string").alias("id"), F.to_json(F.struct(F.concat(F.lit("Architect museum "), k.cast("string")).alias("aanbestedingNaam"), F.struct(F.struct(F.concat(F.lit("/p"), k.cast("string")).alias("href")).alias("pdf")).alias("links"))).alias("payload"))
    return _got(definitions.tenderned(pages, details, S, limit=None, most=_ALL), "noticeId", "title", "briefPdfUrl")


# --- notice rules --------------------------------------------------------------------------------
_TITLES = ["医院病房改造初步设计", "学校室内设计", "水利工程生态修复方案设计", "老旧小区改造方案设计", "托幼用地修建性详细规划", "油气钻探设计服务", "办公楼新建建筑设计"]
_BODIES = ["注册建筑师 建筑装饰工程设计专项", "污水 管网 投标人资格要求 医院", "", "建筑行业（建筑工程） 联系人：学校"]
_CATEGORIES = ["房屋建筑", "水利工程", ""]


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _weights(c: str, table_: dict[str, int]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({c}, '{w}') THEN {n} ELSE 0 END" for w, n in table_.items()) + ")"


def _labels(c: str, table_: dict[str, list[str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_any(c, w)} THEN '{k}' END" for k, w in table_.items()) + "], lambda x: x IS NOT NULL)"


_NOTICE_SQL = f"""WITH n AS (SELECT p_partkey, {_case('p_partkey % 7', _TITLES)} AS title, {_case('p_partkey % 4', _BODIES)} AS body, {_case('p_partkey % 3', _CATEGORIES)} AS cat, p_partkey % 5 > 0 AS detailed FROM part),
  w AS (SELECT *, trim(title || ' ' || body) AS whole, trim(title || ' ' || substr(body, 1, CASE WHEN len(list_filter([{', '.join(f"strpos(body, '{m}')" for m in notices.STOPS)}], lambda i: i > 1)) > 0 THEN list_min(list_filter([{', '.join(f"strpos(body, '{m}')" for m in notices.STOPS)}], lambda i: i > 1)) - 1 ELSE 1000 END)) AS head FROM n),
  l AS (SELECT *, {_labels('cat', notices.SECTORS)} AS sectors, {_labels('head', notices.ASSETS)} AS found, {_labels('head', notices.SCOPES)} AS scopes, {_labels('head', notices.MODES)} AS m0, {_labels("trim(cat || ' ' || whole)", notices.DOMAINS)} AS domains, {_any('whole', notices.DISCIPLINE)} AS discipline FROM w),
  f AS (SELECT *, CASE WHEN list_contains(scopes, 'interior_design') THEN list_concat(['interior'], list_filter(found, lambda x: x <> 'interior')) ELSE found END AS assets,
    CASE WHEN list_contains(m0, 'new_build') AND list_contains(m0, 'renovation') AND NOT {_any('head', notices.NEW_BUILD)} THEN list_filter(m0, lambda x: x <> 'new_build') ELSE m0 END AS modes FROM l),
  t AS (SELECT *, len(list_filter(assets, lambda x: x <> 'urban_renewal')) > 0 AS strong, len(sectors) > 0 OR discipline AS support FROM f),
  b AS (SELECT *, NOT (len(domains) > 0 AND NOT strong AND NOT support) AND len(scopes) > 0 AND (strong OR (list_contains(scopes, 'planning') AND list_contains(assets, 'land_use_planning')) OR (list_contains(scopes, 'architectural_design') AND discipline) OR (len(sectors) > 0 AND discipline) OR (support AND len(assets) > 0)) AS target,
    {_weights('whole', notices.OBJECT_WEIGHTS)} AS things, {_weights('whole', notices.CONTEXTUAL_PENALTIES)} AS contextual, {_weights('whole', notices.SITE_PENALTIES)} AS site FROM t),
  s AS (SELECT *, {_weights('title', notices.TITLE_WEIGHTS)} + {_weights('whole', notices.BODY_WEIGHTS)} + things - {_weights('whole', notices.PENALTIES)} - CASE WHEN contextual > 0 THEN site ELSE 0 END + CASE WHEN {_any('whole', notices.DESIGN_WORDS)} THEN 2 ELSE 0 END + CASE WHEN {_any('whole', notices.CONTEXT_WORDS)} THEN 3 ELSE -3 END
    + CASE WHEN len(sectors) > 0 THEN 3 ELSE 0 END + CASE WHEN discipline THEN 2 ELSE 0 END + CASE WHEN strong THEN 2 ELSE 0 END - 3 * len(domains) AS score FROM b)"""


def _notices(spark, sf):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % n).cast("int"))
    return table(spark, sf, "part").select("p_partkey", pick(_TITLES, 7).alias("title"), pick(_BODIES, 4).alias("body"), pick(_CATEGORIES, 3).alias("cat"), (F.col("p_partkey") % 5 > 0).alias("detailed"))


@query("notice_features", f"{_NOTICE_SQL} SELECT p_partkey, array_to_string(sectors, '|') AS sectors, array_to_string(assets, '|') AS assets, array_to_string(scopes, '|') AS scopes, array_to_string(modes, '|') AS modes, array_to_string(domains, '|') AS domains, discipline FROM f")
def notice_features(spark, sf):
    n = _notices(spark, sf).withColumn("f", notices.features(F.col("title"), F.col("body"), F.col("cat")))
    return n.select("p_partkey", *(F.array_join(f"f.{c}", "|").alias(c) for c in ("sectors", "assets", "scopes", "modes", "domains")), "f.discipline")


@query("notice_relevance", f"{_NOTICE_SQL} SELECT p_partkey, CAST(CASE WHEN {_any('cat', notices.REFUSED_CATEGORIES)} THEN -120 WHEN {_any('whole', notices.REFUSED_WORDS)} THEN -100 ELSE score END AS INTEGER) AS score, NOT {_any('cat', notices.REFUSED_CATEGORIES)} AND NOT {_any('whole', notices.REFUSED_WORDS)} AND NOT (contextual >= 5 AND things = 0) AND NOT (contextual >= 3 AND site >= things + 3) AND target AND score >= CASE WHEN detailed THEN 7 ELSE 10 END AS relevant FROM s")
def notice_relevance(spark, sf):
    n = _notices(spark, sf).withColumn("r", notices.relevance(F.col("title"), F.col("body"), F.col("cat"), F.col("detailed")))
    return n.select("p_partkey", "r.score", "r.relevant")


@query("notice_types", f"""{_NOTICE_SQL} SELECT p_partkey,
  concat_ws('|', CASE WHEN list_contains(assets, 'urban_renewal') THEN 'urban_regeneration' END, CASE WHEN list_contains(scopes, 'planning') THEN 'urban_planning' END, CASE WHEN list_contains(scopes, 'interior_design') OR list_contains(assets, 'interior') THEN 'interior_project' END, CASE WHEN strong OR support THEN 'building_project' END) AS project_types,
  concat_ws('|', CASE WHEN list_contains(assets, 'healthcare') THEN 'healthcare' END, CASE WHEN list_contains(assets, 'education') THEN 'education' END, CASE WHEN list_contains(assets, 'housing') THEN 'housing' END, CASE WHEN list_has_any(assets, ['civic_culture', 'welfare', 'office_research']) THEN 'civic_public' END, CASE WHEN list_contains(assets, 'hospitality_commercial') THEN 'sport_leisure' END) AS building_categories,
  concat_ws('|', 'architecture', CASE WHEN list_contains(scopes, 'interior_design') OR list_contains(assets, 'interior') THEN 'interior' END, CASE WHEN list_contains(assets, 'healthcare') THEN 'healthcare' END, CASE WHEN list_contains(assets, 'education') THEN 'education' END, CASE WHEN list_contains(assets, 'housing') THEN 'housing' END, CASE WHEN list_has_any(assets, ['civic_culture', 'welfare', 'office_research']) THEN 'public_building' END, CASE WHEN list_contains(assets, 'urban_renewal') OR list_contains(modes, 'renovation') THEN 'adaptive_reuse' END, CASE WHEN list_contains(scopes, 'planning') THEN 'masterplan' END) AS competition_types FROM t""")
def notice_types(spark, sf):
    n = _notices(spark, sf).withColumn("f", notices.features(F.col("title"), F.col("body"), F.col("cat")))
    f = F.col("f")
    return n.select("p_partkey", F.array_join(notices.project_types(f), "|").alias("project_types"), F.array_join(notices.building_categories(f), "|").alias("building_categories"), F.array_join(notices.competition_types(f), "|").alias("competition_types"))


# --- candidates and backfills --------------------------------------------------------------------
_REG = """r AS (SELECT id, title, official_notice_id, CASE WHEN id % 2 = 0 THEN 'ANAC BDNCP' ELSE organizer END AS organizer, status,
  CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://pubblicitalegale.anticorruzione.it/bandi/x' WHEN 2 THEN 'https://a.it/esiti/y' ELSE 'https://a.it/' || id END AS source_url,
  CASE WHEN id % 7 = 0 THEN 'AD3' WHEN id % 7 = 1 THEN NULL ELSE 'P1' END AS code, CASE WHEN id % 9 = 0 THEN 'Esito' ELSE 'Bando' END AS kind, CASE WHEN id % 10 = 0 THEN 'completed' ELSE '' END AS source_kind FROM v)"""
_RESULT = "(starts_with(lower(coalesce(code, '')), 'ad') OR lower(coalesce(kind, '')) = 'esito' OR contains(lower(coalesce(source_url, '')), '/esiti/') OR contains(lower(title), 'affidamento diretto'))"


def _register(spark, sf):
    k, c = F.col("id"), F.col
    url = F.when(k % 5 == 1, "https://pubblicitalegale.anticorruzione.it/bandi/x").when(k % 5 == 2, "https://a.it/esiti/y").when(k % 5 > 2, F.concat(F.lit("https://a.it/"), k.cast("string")))
    own = {"organizer": F.when(k % 2 == 0, "ANAC BDNCP").otherwise(c("organizer")), "source_url": url, "code": F.when(k % 7 == 0, "AD3").when(k % 7 > 1, "P1"), "kind": F.when(k % 9 == 0, "Esito").otherwise("Bando"), "source_kind": F.when(k % 10 == 0, "completed").otherwise("")}
    return opportunities(spark, sf).withColumns(own)


@query("trace_candidates", f"{V}, {_REG} SELECT id FROM r WHERE organizer = 'ANAC BDNCP' AND official_notice_id IS NOT NULL AND (source_url IS NULL OR (source_url NOT LIKE 'https://pubblicitalegale.anticorruzione.it/bandi/%' AND source_url NOT LIKE 'https://pubblicitalegale.anticorruzione.it/esiti/%'))")
def trace_candidates(spark, sf):
    return store.trace_candidates(_register(spark, sf)).select("id")


@query("status_candidates", f"{V}, {_REG} SELECT id FROM r WHERE organizer = 'ANAC BDNCP' AND status NOT IN ('archived', 'discarded')")
def status_candidates(spark, sf):
    return store.status_candidates(_register(spark, sf), "ANAC BDNCP").select("id")


@query("trace_backfill", f"{V}, {_REG}, n AS (SELECT *, 'https://pubblicitalegale.anticorruzione.it/' || CASE WHEN {_RESULT} THEN 'esiti/' ELSE 'bandi/' END || official_notice_id || '?ricercaArchivio=true' AS new FROM r WHERE official_notice_id IS NOT NULL) SELECT id, new AS source_url FROM n WHERE new IS DISTINCT FROM source_url")
def trace_backfill(spark, sf):
    c = F.col
    rows = _register(spark, sf).filter("official_notice_id IS NOT NULL")
    return store.backfill(rows, "source_url", store.trace_url(c("official_notice_id"), c("source_url"), c("title"), c("code"), c("kind")), [F.asc("id")])


@query("status_backfill", f"{V}, {_REG}, n AS (SELECT *, CASE WHEN {_RESULT} OR source_kind IN ('aggiudicazione', 'esito', 'archived', 'completed') OR contains(lower(title), 'aggiudicazione') THEN 'archived' ELSE status END AS new FROM r) SELECT id, new AS status FROM n WHERE new <> status")
def status_backfill(spark, sf):
    c = F.col
    made = store.record_status(c("source_url"), c("title"), c("code"), c("kind"), c("source_kind"))
    return store.backfill(_register(spark, sf), "status", F.when(made == "archived", made).otherwise(c("status")), [F.asc("id")])


@query("geocode_backfill", "WITH a AS (SELECT o_orderkey AS id, CAST(o_orderkey % 90 AS DOUBLE) AS geo_lat FROM orders ORDER BY o_orderkey LIMIT 120) SELECT id, geo_lat + 1 AS geo_lat FROM a WHERE id % 4 = 0 ORDER BY id LIMIT 20")
def geocode_backfill(spark, sf):
    k = F.col("id")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).withColumn("geo_lat", (k % 90).cast("double"))
    answers = rows.withColumn("geo_lat", F.when(k % 4 == 0, F.col("geo_lat") + 1).otherwise(F.col("geo_lat")))
    return store.geocode_changes(rows, answers, "id", ["geo_lat"], [F.asc("id")], 20)


@query("batch_totals", "SELECT event_type AS batch_id, count(DISTINCT user_id) AS total_sources, coalesce(sum(CASE WHEN event_id % 4 > 0 THEN event_id % 7 END), 0) AS total_ingested, count(*) FILTER (event_id % 4 = 0) AS failed FROM events GROUP BY event_type")
def batch_totals(spark, sf):
    k = F.col("event_id")
    runs = table(spark, sf, "events").select(F.col("event_type").alias("batch_id"), F.col("user_id").alias("source_id"), F.when(k % 4 == 0, "failed").otherwise("success").alias("status"), (k % 7).alias("ingested"))
    return store.batch_totals(runs)


# --- watch-lists, sessions -----------------------------------------------------------------------
def _saved(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string")).alias("workspace_key"), F.col("event_type").alias("name"), F.col("ts").alias("updated_at"))


@query("saved_listing", "SELECT event_id AS id, event_type AS name FROM events WHERE user_id % 5 = 2 ORDER BY ts DESC, event_id DESC LIMIT 50")
def saved_listing(spark, sf):
    return store.listing(_saved(spark, sf), "w2").select("id", "name")


@query("saved_delete", "SELECT 'kept' AS what, count(*) AS n FROM events WHERE NOT (user_id % 5 = 2 AND event_type = 'click') UNION ALL SELECT 'changed', max(CASE WHEN user_id % 5 = 2 AND event_type = 'click' THEN 1 ELSE 0 END) FROM events")
def saved_delete(spark, sf):
    kept, changed = store.removed(_saved(spark, sf), (F.col("workspace_key") == "w2") & (F.col("name") == "click"))
    return kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("what"), "n").unionByName(changed.select(F.lit("changed").alias("what"), F.col("changed").cast("long").alias("n")))


@query("watch_additions", "SELECT 'w' || (o_custkey % 3) AS workspace_key, o_orderkey AS opportunity_id, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 9 END AS created, CASE WHEN o_orderkey % 3 = 0 THEN 9 WHEN o_orderkey % 2 = 0 THEN 1 END AS updated FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def watch_additions(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("w"), (F.col("o_custkey") % 3).cast("string")).alias("workspace_key"), F.col("o_orderkey").alias("opportunity_id"))
    k = F.col("opportunity_id")
    held = o.filter(k % 2 == 0).withColumns({"created_at": F.lit(1), "updated_at": F.lit(1)})
    wanted = o.filter(k % 3 == 0).unionByName(o.limit(1).select("workspace_key", F.lit(-5).cast("long").alias("opportunity_id")))
    got = store.watch(held, o.select(k.alias("id")), wanted, F.lit(9))
    return got.select("workspace_key", "opportunity_id", F.col("created_at").alias("created"), F.col("updated_at").alias("updated"))


@query("live_sessions", "SELECT event_id, sha256(event_type) AS token_hash FROM events WHERE ts + INTERVAL 30 DAY > (SELECT max(ts) FROM events)")
def live_sessions(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("now"))
    rows = e.crossJoin(F.broadcast(last)).withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
    return store.live_sessions(rows, F.col("now")).select("event_id", store.token_hash(F.col("event_type")).alias("token_hash"))


@query("queue_decisions", "WITH q AS (SELECT conv_id AS queue_id, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT queue_id, CASE WHEN last % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS status FROM q")
def queue_decisions(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("queue_id"), F.col("turn").alias("id"), F.when(F.col("turn") % 2 == 0, "accepted").otherwise("rejected").alias("decision"), F.lit("t").alias("created_at"))
    queue = c.select("queue_id").distinct().withColumns({"status": F.lit("pending"), "updated_at": F.lit("")})
    return store.decide(queue, c).select("queue_id", "status")


@query("queue_filtered", "SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id % 3 = 1 AND event_type = 'view'")
def queue_filtered(spark, sf):
    k = F.col("event_id")
    rows = table(spark, sf, "events").select("event_id", (k % 2 == 0).alias("is_active"), F.when(k % 3 == 1, "pending").otherwise("accepted").alias("status"), F.col("event_type").alias("reason_code"))
    return review.filtered(rows, status="pending", reason="view").select("event_id")


@query("candidate_order", "SELECT event_id FROM events ORDER BY event_id % 10 DESC, CASE WHEN event_id % 4 > 0 THEN ts END ASC NULLS FIRST, event_id LIMIT 200")
def candidate_order(spark, sf):
    k = F.col("event_id")
    rows = table(spark, sf, "events").select("event_id", (k % 10).alias("priority"), F.when(k % 4 > 0, F.col("ts")).alias("last_detected_at"), k.alias("queue_id"))
    return rows.orderBy(*review.candidate_order()).limit(200).select("event_id")


@query("expired_records", f"{V} SELECT id FROM v WHERE deadline_at < DATE '1998-05-25'")
def expired_records(spark, sf):
    v = opportunities(spark, sf)
    return v.filter(store.expired(v, TODAY, 7)).select("id")


@query("published_since", f"{V} SELECT id FROM v WHERE deadline_at IS NULL OR deadline_at >= DATE '1998-06-01'")
def published_since(spark, sf):
    return opportunities(spark, sf).filter(connectors.since(F.col("deadline_at"), TODAY)).select("id")


@query("saved_query_roundtrip", f"{V} SELECT id FROM v WHERE status NOT IN ('archived', 'discarded') AND (deadline_at IS NULL OR deadline_at >= DATE '1998-06-01') AND jurisdiction = 'NATION_3' AND coalesce(estimated_contract_value_eur, 0) >= 1000.5")
def saved_query_roundtrip(spark, sf):
    q = Q.Query.from_params({"jurisdiction": " NATION_3 ", "min_value": "1000.5", "sort": "bogus", "limit": "-3", "max_value": "inf"})
    q = Q.Query.from_params(Q.Query.from_json(q.to_json()).to_params()).clamped(100)
    return Q.visible(opportunities(spark, sf), q, TODAY).select("id")


# --- links and page text -------------------------------------------------------------------------
_IMG = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'https://x.org/media/hero-' || p_partkey || '.jpg' WHEN 1 THEN 'https://x.org/logo.png' WHEN 2 THEN 'https://www.konkurado.ch/thumbs/300x200/competitions/' || p_partkey || '.jpg' WHEN 3 THEN 'https://x.org/a.svg' WHEN 4 THEN 'https://x.org/p' || p_partkey || '.gif' ELSE 'https://x.org/photo/' || p_partkey END AS url, p_size * 40 AS width, p_brand FROM part"


def _images(spark, sf):
    k = F.col("p_partkey")
    s = k.cast("string")
    x = F.lit("https://x.org/")
    url = F.when(k % 6 == 0, F.concat(x, F.lit("media/hero-"), s, F.lit(".jpg"))).when(k % 6 == 1, "https://x.org/logo.png").when(k % 6 == 2, F.concat(F.lit("https://www.konkurado.ch/thumbs/300x200/competitions/"), s, F.lit(".jpg"))).when(k % 6 == 3, "https://x.org/a.svg").when(k % 6 == 4, F.concat(x, F.lit("p"), s, F.lit(".gif"))).otherwise(F.concat(x, F.lit("photo/"), s))
    p = table(spark, sf, "part").select("p_partkey", "p_brand", url.alias("url"), (F.col("p_size") * 40).alias("width"))
    score = links.image_score(F.col("url"), F.lit(""), F.when(k % 2 == 0, "meta").otherwise("img"), F.col("width"), F.lit(None).cast("int"), F.col("url"))
    return p.withColumn("score", score)


_IMG_SCORE = """CASE p_partkey % 6 WHEN 1 THEN NULL ELSE CASE WHEN p_partkey % 2 = 0 THEN 92 ELSE 58 END + CASE p_partkey % 6 WHEN 0 THEN 28 WHEN 2 THEN 38 WHEN 3 THEN -20 WHEN 4 THEN -28 WHEN 5 THEN 8 END
  + CASE WHEN width >= 1200 THEN 12 WHEN width >= 800 THEN 10 WHEN width >= 400 THEN 6 WHEN width <= 160 THEN -30 WHEN width <= 240 THEN -14 ELSE 0 END END"""


@query("image_scores", f"SELECT p_partkey, CAST({_IMG_SCORE} AS INTEGER) AS score FROM ({_IMG})")
def image_scores(spark, sf):
    return _images(spark, sf).select("p_partkey", "score")


@query("image_best", f"SELECT p_brand, url, score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS n FROM (SELECT *, CAST({_IMG_SCORE} AS INTEGER) AS score FROM ({_IMG})) WHERE score >= 58) WHERE n = 1")
def image_best(spark, sf):
    return links.best_image(_images(spark, sf).withColumn("place", F.col("p_partkey")), "p_brand").select("p_brand", "url", "score")


@query("pdf_best", "WITH u AS (SELECT p_brand, CASE p_partkey % 4 WHEN 0 THEN 'https://x.org/lageplan-' || p_partkey || '.pdf' WHEN 1 THEN 'https://x.org/terms.pdf' WHEN 2 THEN 'https://x.org/project_' || p_partkey || '.pdf' ELSE 'https://x.org/page' END AS url, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 2 THEN 1 END AS score FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, url) AS rank FROM (SELECT p_brand, url, max(score) AS score FROM u WHERE score IS NOT NULL GROUP BY 1, 2)) SELECT p_brand, url, score, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 3")
def pdf_best(spark, sf):
    k = F.col("p_partkey")
    s = k.cast("string")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://x.org/lageplan-"), s, F.lit(".pdf"))).when(k % 4 == 1, "https://x.org/terms.pdf").when(k % 4 == 2, F.concat(F.lit("https://x.org/project_"), s, F.lit(".pdf"))).otherwise("https://x.org/page")
    rows = table(spark, sf, "part").select("p_brand", url.alias("url")).withColumn("score", links.pdf_score(F.col("url"), F.lit("")))
    return links.best_pdfs(rows, "p_brand").select("p_brand", "url", "score", "rank")


@query("shown_links", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'https://p/' || o_orderkey END AS portal, CASE WHEN o_orderkey % 4 <> 0 THEN 'https://o/' || o_orderkey END AS page, CASE WHEN o_orderkey % 5 <> 0 OR o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'https://o/api/' || o_orderkey ELSE 'https://s/' || o_orderkey END END AS trace FROM orders")
def shown_links(spark, sf):
    k = F.col("o_orderkey")
    s = k.cast("string")
    url = lambda head: F.concat(F.lit(head), s)
    official = F.when(k % 4 == 0, url("https://o/api/")).otherwise(url("https://o/"))
    documents = F.when(k % 3 == 0, official).otherwise(url("https://p/"))
    source = F.when(k % 5 == 0, official).otherwise(url("https://s/"))
    got = links.shown_links(official, documents, url("https://b/"), source)
    return table(spark, sf, "orders").select("o_orderkey", got["documents_portal"].alias("portal"), got["official_page"].alias("page"), got["source_trace"].alias("trace"))


@query("display_labels", "SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE n_name || ' · City ' || n_nationkey END AS place, CASE n_nationkey % 3 WHEN 0 THEN 'A · B' WHEN 1 THEN 'A' ELSE 'F' END AS category FROM nation")
def display_labels(spark, sf):
    k = F.col("n_nationkey")
    place = F.when(k % 3 == 0, F.lower("n_name")).otherwise(F.concat(F.lit("City "), k.cast("string")))
    category = links.category_label(F.when(k % 3 < 2, "A"), F.when(k % 3 == 0, "B"), F.lit("F"))
    return table(spark, sf, "nation").select("n_name", links.location_label(F.col("n_name"), place).alias("place"), category.alias("category"))


@query("html_dom_text", "SELECT page_id, 'Title ' || page_id || chr(10) || 'one two' || chr(10) || 'row' AS body FROM pages")
def html_dom_text(spark, sf):
    ship(spark)
    html = F.concat(F.lit('<body>out<div class="a detail_content"><h2>Title '), F.col("page_id").cast("string"), F.lit("</h2><script>no</script><p>one <b>two</b></p><o:p>no</o:p><table><tr><td>row</td></tr></table></div><p>out</p></body>"))
    return table(spark, sf, "pages").select("page_id", semi.class_text(html).alias("body"))


@query("html_balanced_div", "SELECT page_id, '<div>in ' || page_id || '<div>deep</div></div>rest' AS body FROM pages")
def html_balanced_div(spark, sf):
    ship(spark)
    html = F.concat(F.lit('<div id="mycontent"><DIV class="x detail_content"><div>in '), F.col("page_id").cast("string"), F.lit("<div>deep</div></div>rest</div><div>after</div></div>"))
    return table(spark, sf, "pages").select("page_id", semi.balanced_div(html).alias("body"))


@query("title_cleaning", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '12/' || o_orderkey ELSE 'New school' END AS title FROM orders")
def title_cleaning(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" 12/"), k.cast("string"))).otherwise(F.concat(F.lit("12_"), k.cast("string"), F.lit("-7 New school ")))
    return table(spark, sf, "orders").select("o_orderkey", text.clean_title(raw).alias("title"))


# --- small values --------------------------------------------------------------------------------
@query("loose_key", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_stra_e' AS k FROM part")
def loose_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.loose_key(F.concat("p_name", F.lit(" Straße"))).alias("k"))


@query("label_field", "SELECT o_orderkey, o_orderpriority AS value FROM orders")
def label_field(spark, sf):
    raw = F.concat(F.lit("<p>x</p>Estado : "), F.col("o_orderpriority"), F.lit("; other: y"))
    return table(spark, sf, "orders").select("o_orderkey", text.field(raw, "estado").alias("value"))


@query("note_append", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'has new in' ELSE 'old new' END AS note FROM orders")
def note_append(spark, sf):
    k = F.col("o_orderkey") % 3
    return table(spark, sf, "orders").select("o_orderkey", text.append_note(F.when(k == 1, "has new in").when(k == 2, "old"), F.lit("new")).alias("note"))


@query("compatible_labels", "SELECT n_nationkey, n_nationkey % 2 = 0 AS same FROM nation")
def compatible_labels(spark, sf):
    other = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Great "), F.col("n_name"))).otherwise("elsewhere")
    return table(spark, sf, "nation").select("n_nationkey", text.compatible_labels(F.col("n_name"), other).alias("same"))


@query("localized_text", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'english' WHEN 2 THEN 'deutsch' ELSE 'first' END AS t FROM events")
def localized_text(spark, sf):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, '{"t": " plain "}').when(k == 1, '{"t": {"de": "x", "en": "english"}}').when(k == 2, '{"t": {"de": "deutsch"}}').otherwise('{"t": ["first", "second"]}')
    return table(spark, sf, "events").select("event_id", semi.localized(F.parse_json(raw), "t").alias("t"))


@query("json_list_value", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '|b' WHEN 1 THEN event_type ELSE '' END AS items FROM events")
def json_list_value(spark, sf):
    k, e = F.col("event_id") % 3, F.col("event_type")
    raw = F.when(k == 0, F.to_json(F.struct(F.array(e, F.lit(" "), F.lit("b")).alias("x")))).when(k == 1, F.to_json(F.struct(e.alias("y")))).otherwise("{}")
    return table(spark, sf, "events").select("event_id", F.array_join(semi.list_value(F.parse_json(raw), ["x", "y"]), "|").alias("items"))


@query("json_money_deep", "SELECT event_id, CAST(event_id % 100 AS DOUBLE) + 0.5 AS amount, 'EUR' AS currency FROM events")
def json_money_deep(spark, sf):
    ship(spark)
    raw = F.concat(F.lit('{"a": [{"b": {"amount": "n/a", "currency": "chf"}}, {"c": [[{"@currencyID": "eur", "#text": "'), ((F.col("event_id") % 100).cast("double") + 0.5).cast("string"), F.lit('"}]]}]}'))
    return table(spark, sf, "events").select("event_id", semi.first_money(raw).alias("m")).select("event_id", "m.amount", "m.currency")


@query("json_addresses", "SELECT page_id, 'Street ' || page_id AS street, 'Town' AS locality, 2 AS n FROM pages")
def json_addresses(spark, sf):
    ship(spark)
    raw = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"location": {"@type": "PostalAddress", "streetAddress": "Street '), F.col("page_id").cast("string"), F.lit('", "addressLocality": "Town"}}, {"streetAddress": "Other"}]}</script><script type="application/ld+json">{broken</script>'))
    return table(spark, sf, "pages").select("page_id", semi.linked_addresses(raw).alias("a")).select("page_id", F.col("a")[0]["street"].alias("street"), F.col("a")[0]["locality"].alias("locality"), F.size("a").alias("n"))


@query("canonical_filters", """SELECT event_id, '{"kind":"' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"user":' || user_id ELSE '' END || '}' AS filters FROM events""")
def canonical_filters(spark, sf):
    made = semi.canonical_json(user=F.when(F.col("event_id") % 2 == 0, F.col("user_id")), kind=F.col("event_type"))
    return table(spark, sf, "events").select("event_id", made.alias("filters"))


@query("joined_labels", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || ', b' ELSE 'none' END AS shown, event_type = 'view' AS prefixed FROM events")
def joined_labels(spark, sf):
    values = F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "events").select("event_id", semi.joined_or(values, "none").alias("shown"), semi.any_prefix(F.array("event_type"), ("vie", "zzz")).alias("prefixed"))


@query("cut_markers", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'head ' ELSE 'STOP none' END AS head FROM orders")
def cut_markers(spark, sf):
    raw = F.when(F.col("o_orderkey") % 2 == 0, "head END more STOP").otherwise("STOP none")
    return table(spark, sf, "orders").select("o_orderkey", rules.cut_at_markers(raw, ["STOP", "END"]).alias("head"))


@query("requirement_flags", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN TRUE END AS architect, CASE WHEN o_orderkey % 3 = 0 THEN TRUE END AS partner FROM orders")
def requirement_flags(spark, sf):
    k = F.col("o_orderkey")
    words = F.concat_ws(" ", F.when(k % 2 == 0, "A Licensed Architect"), F.when(k % 3 == 0, "with a Local Partner"), F.lit("x"))
    return table(spark, sf, "orders").select("o_orderkey", classify.architect_required(words).alias("architect"), classify.partner_required(words).alias("partner"))


@query("type_inference", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'public_design_contest' WHEN 1 THEN 'framework_design_services' ELSE NULL END AS kind FROM orders WHERE o_orderkey % 4 <> 2")
def type_inference(spark, sf):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, "Open idea CONTEST").when(k == 1, "A framework").otherwise("nothing of that")
    return table(spark, sf, "orders").filter(k != 2).select("o_orderkey", classify.opportunity_type(raw).alias("kind"))


@query("competition_kinds", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'architecture' ELSE 'landscape' END AS has FROM orders")
def competition_kinds(spark, sf):
    words = F.when(F.col("o_orderkey") % 2 == 0, "zzz").otherwise("a LANDSCAPE plan")
    found = classify.competition_types(words)
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.array_contains(found, "landscape"), "landscape").otherwise(F.array_join(found, "|")).alias("has"))


_ASKED = """SELECT o_orderkey AS k, ['locality', 'site', 'street_address', 'street'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 43) / 2.0 END AS km,
  [NULL, 'building', 'amenity', 'boundary', 'shop', 'place', 'Highway'][o_orderkey % 7 + 1] AS category, ['', 'city', 'town', 'municipality', 'house', 'Road', 'quarter', 'place', 'retail'][o_orderkey % 9 + 1] AS address, [NULL, 'yes', 'county', 'village', 'town'][o_orderkey % 5 + 1] AS type, o_orderkey % 2 = 0 AS numbered FROM orders"""


@query("geocode_accept", f"""SELECT k, coalesce((kind = 'locality' OR NOT (address IN ('city', 'town', 'municipality') OR coalesce(type, '') IN ('county', 'town')))
  AND (category IS NULL OR category IN ('building', 'place', 'Highway') OR (kind = 'locality' AND category = 'boundary') OR (kind = 'site' AND category = 'amenity'))
  AND (address IN ('', 'house', 'Road', 'retail') OR (address = 'place' AND numbered) OR kind = 'locality' OR (kind = 'street' AND (address IN ('city', 'town', 'municipality', 'Road', 'quarter', 'place') OR type IN ('village', 'town'))))
  AND (km IS NULL OR km <= CASE kind WHEN 'locality' THEN CASE WHEN address IN ('city', 'town') OR type = 'town' THEN 14 WHEN address = 'municipality' THEN 10 ELSE 18 END WHEN 'site' THEN 8 WHEN 'street_address' THEN 4 ELSE 18 END), false) AS ok,
  CASE WHEN kind = 'locality' THEN 'locality' WHEN kind = 'site' THEN 'site' WHEN coalesce(nullif(address, ''), type, '') IN ('city', 'town', 'municipality') THEN 'city' WHEN kind = 'street_address' THEN 'address' ELSE 'street' END AS precision,
  k % 200 <= 90 AS valid, CASE WHEN k % 2 = 0 THEN 'A 1, Town|A 1, Land|B, Town|B, Land' ELSE 'A 1|B' END AS asked FROM ({_ASKED})""")
def geocode_accept(spark, sf):
    k, pick = F.col("k"), lambda values: F.get(F.array(*map(F.lit, values)), (F.col("k") % len(values)).cast("int"))
    kind, address, place = pick(["locality", "site", "street_address", "street"]), pick(["", "city", "town", "municipality", "house", "Road", "quarter", "place", "retail"]), pick([None, "yes", "county", "village", "town"])
    ok = geo.acceptable_geocode(kind, F.when(k % 11 > 0, (k % 43) / 2), pick([None, "building", "amenity", "boundary", "shop", "place", "Highway"]), address, place, F.when(k % 2 == 0, "7"))
    places = F.when(k % 2 == 0, F.array(F.lit("Town"), F.lit("Land"), F.lit("Town"))).otherwise(F.array(F.lit("")))
    asked = geo.query_variants(F.array(F.lit("A 1"), F.lit("B")), places)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return o.select("k", ok.alias("ok"), geo.geocode_precision(kind, address, place).alias("precision"), geo.valid_coordinates((k % 200).cast("double"), F.lit(0.0)).alias("valid"), F.array_join(asked, "|").alias("asked"))


@query("money_euro_only", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN l_extendedprice END AS eur FROM lineitem")
def money_euro_only(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", money.euro_only(F.col("l_extendedprice"), F.when(F.col("l_orderkey") % 2 == 0, " eur ").otherwise("CHF")).alias("eur"))


@query("date_parse_cjk", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders")
def date_parse_cjk(spark, sf):
    d = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "'于 'yyyy' 年 'M' 月 'd' 日'")).otherwise(F.date_format(d, "yyyy-M-d HH:mm"))
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_cjk_date(raw).alias("parsed"))


@query("place_names", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Bellinzona' END AS place FROM nation")
def place_names(spark, sf):
    title = F.when(F.col("n_nationkey") % 2 == 0, "New school, 6500 Bellinzona").otherwise("new school")
    return table(spark, sf, "nation").select("n_nationkey", text.place_of(title, F.lit("the council")).alias("place"))


# --- narrow reads --------------------------------------------------------------------------------
@query("narrow_list", f"{V} SELECT id, title, organizer, authority_name, status, deadline_at, qualification_score FROM v ORDER BY deadline_at ASC NULLS LAST, updated_at DESC, id LIMIT 20")
def narrow_list(spark, sf):
    return Q.narrow_list(opportunities(spark, sf)).select("id", "title", "organizer", "authority_name", "status", "deadline_at", "qualification_score")


@query("professional_items", f"{V} SELECT id, title, CASE WHEN deadline_at IS NULL THEN 'Deadline pending' ELSE 'Closes ' || strftime(deadline_at, '%d %b %Y') END AS deadline_label, FALSE AS has_internal FROM v WHERE status NOT IN ('archived', 'discarded') AND (deadline_at IS NULL OR deadline_at >= DATE '1998-06-01')")
def professional_items(spark, sf):
    shown = Q.professional(Q.feed_item(Q.visible(opportunities(spark, sf), Q.Query(), TODAY)))
    return shown.select("id", "title", "deadline_label", F.lit(bool(set(shown.columns) & set(Q.INTERNAL))).alias("has_internal"))


def _where_any(values):
    """Rows whose array isn't empty, with the array; a filter on it would compute it twice."""
    return F.explode(text.bind(values, lambda x: F.when(F.size(x) > 0, F.array(x))))


# --- many markers in one scan --------------------------------------------------------------------
_SYLLABLES = ["er", "or", "th", "in", "an", "he", "re", "on", "it", "ti"]


@query("allow_list_names", f"""WITH s AS (SELECT unnest({_SYLLABLES}) AS x), names AS (SELECT a.x || b.x || c.x AS name FROM s a, s b, s c)
  SELECT doc_id, string_agg(name, ' ' ORDER BY name) AS names, CAST(count(*) AS INTEGER) AS n FROM documents JOIN names ON contains(lower(text), name) GROUP BY doc_id""")
def allow_list_names(spark, sf):
    """Which of 1,000 names each document's whole text holds."""
    names = rules.Markers(a + b + c for a in _SYLLABLES for b in _SYLLABLES for c in _SYLLABLES)
    d = table(spark, sf, "documents").select("doc_id", _where_any(F.array_sort(names.hits(F.lower("text")))).alias("h"))
    return d.select("doc_id", F.array_join("h", " ").alias("names"), F.size("h").alias("n"))


# --- deadlines in whole texts --------------------------------------------------------------------
_D, _M = "CAST(1 + doc_id % 28 AS VARCHAR)", "CAST(3 + doc_id % 7 AS VARCHAR)"
_DATED = f"""CASE doc_id % 6
  WHEN 0 THEN '开标时间：2026年0' || {_M} || '月 ' || {_D} || ' 日 09时30分' || chr(10) || '投标文件递交截止时间：2026年 0' || {_M} || ' 月 29 日'
  WHEN 1 THEN '项目概况：供应商应于 202 6 年 ' || {_M} || ' 月 ' || {_D} || ' 日 13 时 30分（北京时间）前提交响应文件。'
  WHEN 2 THEN '递交截止时间：2026-' || {_M} || '-' || {_D} || ' 10:30:00'
  WHEN 3 THEN '5.1 投标文件递交的截止时间（下同）' || chr(10) || '截止时间' || chr(10) || '为 2026-' || {_M} || '-' || {_D} || ' 09:00。'
  WHEN 4 THEN '截止时间：2031年1月1日，开启时间 2026-0' || {_M} || '-' || {_D} || ' 9:00'
  ELSE '2026-' || {_M} || '-' || {_D} END"""
_W = r"[\s\x{3000}]"
_SQL_DAY = rf"(?:\d{_W}*){{4}}年{_W}*\d{{1,2}}{_W}*月{_W}*\d{{1,2}}{_W}*日(?:{_W}*\d{{1,2}}{_W}*[时点:：]{_W}*\d{{1,2}}(?:{_W}*分)?)?"
_SQL_STARTS = f"(?:{'|'.join(notices.DEADLINE_STARTS)})[^0-9]{{0,16}}"
_SQL_PHRASES = [f"{_SQL_STARTS}({_SQL_DAY})", rf"于{_W}*({_SQL_DAY}){_W}*[（(]北京时间[)）]?{_W}*前", rf"{_SQL_STARTS}(\d{{4}}-\d{{1,2}}-\d{{1,2}}{_W}+\d{{1,2}}:\d{{2}}(?::\d{{2}})?)"]


def _sql_score(c: str) -> str:
    first = "CASE " + " ".join(f"WHEN contains({c}, '{m}') THEN {n}" for m, n in (("投标文件递交的截止时间为", 12), ("投标文件递交截止时间为", 12), ("投标文件递交截止时间", 12), ("投标文件截止时间", 11), ("投标截止时间", 11), ("响应文件提交截止时间", 12), ("提交响应文件截止时间", 12), ("响应文件截止时间", 11), ("递交投标文件截止时间", 11), ("提交投标文件截止时间", 11), ("递交截止时间", 10), ("截止时间", 8), ("开启时间", 3), ("开标时间", 2))) + " ELSE 0 END"
    return f"({first} + CASE WHEN contains({c}, '北京时间') THEN 1 ELSE 0 END + CASE WHEN contains({c}, '前提交') OR contains({c}, '提交响应文件') THEN 2 ELSE 0 END + CASE WHEN contains({c}, '前递交') OR contains({c}, '递交投标文件') THEN 2 ELSE 0 END)"


def _sql_phrase(p: str) -> str:
    return f"""SELECT doc_id, CASE WHEN {_sql_score('ctx')} > 0 THEN {_sql_score('ctx')} ELSE 1 END AS score, value FROM (
    SELECT doc_id, value, substr(t, CAST(greatest(0, s - 48) + 1 AS BIGINT), CAST(s + length(m) + 24 - greatest(0, s - 48) AS BIGINT)) AS ctx FROM (
      SELECT doc_id, t, ms[i] AS m, vs[i] AS value, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s FROM (
        SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', 1) AS vs, string_split_regex(t, '{p}') AS parts FROM d WHERE regexp_matches(t, '{p}')))))"""


@query("deadline_candidates", f"""WITH d AS (SELECT doc_id, substr(text, 1, length(text) // 2) || chr(10) || {_DATED} || chr(10) || substr(text, length(text) // 2 + 1) AS t FROM documents),
  lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
  raw AS (SELECT doc_id, {_sql_score('line')} AS score, unnest(list_concat(regexp_extract_all(line, '{_SQL_DAY}'), regexp_extract_all(line, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}'))) AS value FROM lines WHERE {_sql_score('line')} > 0
    UNION ALL {' UNION ALL '.join(map(_sql_phrase, _SQL_PHRASES))}),
  p AS (SELECT doc_id, score, regexp_extract(regexp_replace(value, '{_W}', '', 'g'), '(\\d{{4}})年(\\d{{1,2}})月(\\d{{1,2}})日', ['y', 'm', 'd']) AS a, regexp_extract(value, '(\\d{{4}})-(\\d{{1,2}})-(\\d{{1,2}})', ['y', 'm', 'd']) AS b FROM raw),
  c AS (SELECT doc_id, score, coalesce(try_cast(a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0') AS DATE), try_cast(b.y || '-' || lpad(b.m, 2, '0') || '-' || lpad(b.d, 2, '0') AS DATE)) AS day FROM p)
  SELECT d.doc_id, CAST(count(c.day) AS INTEGER) AS n, CAST(coalesce(sum(c.score) FILTER (c.day IS NOT NULL), 0) AS INTEGER) AS scores,
    max_by(c.day, (c.score, c.day)) FILTER (date_diff('day', DATE '2026-05-01' + CAST(d.doc_id % 90 AS INTEGER), c.day) BETWEEN -7 AND 365) AS best
  FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def deadline_candidates(spark, sf):
    """Labelled days in the middle of each document's whole text: candidates, their scores, the best one."""
    k, half = F.col("doc_id"), F.floor(F.length("text") / 2).cast("int")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.substring(F.col("text"), F.lit(1), half), F.lit("\n"), F.expr(_DATED.replace("AS VARCHAR", "AS STRING")), F.lit("\n"), F.substring(F.col("text"), half + 1, F.length("text"))).alias("t"))
    published = F.date_add(F.lit("2026-05-01").cast("date"), (k % 90).cast("int"))
    c = d.withColumn("c", dates.deadline_candidates(F.col("t"), **notices.DEADLINES))
    return c.select("doc_id", F.size("c").alias("n"), F.aggregate("c", F.lit(0), lambda s, x: s + x["score"]).alias("scores"), dates.best_deadline(F.col("c"), published).alias("best"))


# --- values of the rules -------------------------------------------------------------------------
_KIND_WORDS = [("stadium", 1), ("school", 2), ("museum", 4), ("hospital", 8), ("housing", 16), ("tunnel", 32), ("library", 64)]


@query("category_order", f"""{V} SELECT id, array_to_string(list_filter([CASE WHEN id & 2 > 0 THEN 'education' END, CASE WHEN id & 8 > 0 THEN 'healthcare' END, CASE WHEN id & 16 > 0 THEN 'housing' END, CASE WHEN id & 64 > 0 THEN 'civic_public' END,
  CASE WHEN id & 1 > 0 THEN 'sport_leisure' END, CASE WHEN id & 4 > 0 THEN 'culture_heritage' END, CASE WHEN id & 32 > 0 THEN 'transport_infrastructure' END], lambda x: x IS NOT NULL), '|') AS building_categories FROM v""")
def category_order(spark, sf):
    """Several categories of one title, in the fixed order."""
    titles = F.concat_ws(" ", *(F.when(F.col("id").bitwiseAND(bit) > 0, word) for word, bit in _KIND_WORDS))
    none = {c: F.lit(None).cast("string") for c in ("eligibility_summary", "authority_name", "organizer", "implementation_path")}
    return classify.with_classes(opportunities(spark, sf).withColumns({"title": titles, "procedure_type": F.lit("open"), **none})).select("id", F.array_join("building_categories", "|").alias("building_categories"))


def _plain_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


_PHRASES = ["Advance Notice:", "a notice of information", "advance notification to the market", "early indication only", "is not the commencement of a tender process", "will not form part of any future tender.", "intention to release a tender", "Future procurement opportunities", "no information from suppliers is requested", "future opportunity", "prior information", "early market"]
_SUBJECTS = ["Architectural services for a boardwalk", "Design-builder for the town hall", "Landscape design, concept design", "Paper supply to a facility", "Urban design of a museum"]


@query("preannouncement", f"""WITH d AS (SELECT doc_id, {_plain_sql(f"{_SUBJECTS}[doc_id % 5 + 1] || ' ' || substr(text, 1, length(text) // 2) || ' ' || {_PHRASES}[doc_id % 12 + 1] || ' ' || substr(text, length(text) // 2 + 1)")} AS t FROM documents),
  b AS (SELECT *, {_any('t', ['design build', 'design builder', 'design-builder', 'infrastructure', 'stormwater', 'watermain', 'shared path', 'boardwalk', 'hall', 'pavilion', 'facility', 'facilities', 'public realm', 'street', 'camp'])} AS built FROM d)
  SELECT doc_id, {_any('t', ['advance notice', 'notice of information', 'advance notification to the market', 'early indication only', 'not the commencement of a tender process', 'will not form part of any future tender', 'intention to release a tender', 'future procurement opportunities', 'no information from suppliers is requested'])} AS announces,
    {_any('t', ['design build', 'design builder', 'design services', 'architectural services', 'concept design', 'detailed design', 'preliminary design', 'architectural', 'architecture', 'architect', 'landscape architecture', 'landscape design', 'urban design', 'planning competition', 'project competition'])} AND (built OR {_any('t', labels.BUILT_WORDS)}) AS relevant,
    CASE WHEN {_any('t', ['architect', 'architecture', 'architectural'])} THEN 5 ELSE 0 END + CASE WHEN {_any('t', ['urban design', 'landscape architecture', 'landscape design'])} THEN 4 ELSE 0 END + CASE WHEN {_any('t', ['design build', 'design and build', 'design builder'])} THEN 4 ELSE 0 END
      + CASE WHEN {_any('t', ['concept design', 'detailed design', 'preliminary design'])} THEN 3 ELSE 0 END + CASE WHEN {_any('t', ['design services', 'architectural services'])} THEN 3 ELSE 0 END + CASE WHEN built THEN 1 ELSE 0 END AS score FROM b""")
def preannouncement(spark, sf):
    """The feed's rules over whole texts: announcements, relevance, score."""
    k, half = F.col("doc_id"), F.floor(F.length("text") / 2).cast("int")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    t = F.concat_ws(" ", pick(_SUBJECTS), F.substring(F.col("text"), F.lit(1), half), pick(_PHRASES), F.substring(F.col("text"), half + 1, F.length("text")))
    w = F.col("w")
    d = table(spark, sf, "documents").select("doc_id", connectors.feed_judged(text.plain_text(t)).alias("w"))
    return d.select("doc_id", w["announces"].alias("announces"), w["relevant"].alias("relevant"), w["score"].alias("score"))


def _pages_sql(url: str = "url") -> str:
    return f"""p AS (SELECT page_id, {url} AS url, url AS own, html, nullif(trim(regexp_replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title,
    {_plain_sql("regexp_extract(html, '(?i)<title>([^<]+)</title>', 1)")} AS named, {_plain_sql("regexp_replace(replace(replace(replace(html, '&quot;', chr(34)), '&lt;', '<'), '&amp;', '&'), '<[^>]+>', ' ', 'g')")} AS body, {_plain_sql(url)} AS plain_url FROM pages),
  w AS (SELECT *, string_split({_plain_sql("coalesce(title, '')")}, ' ') AS t0, string_split({_plain_sql('own')}, ' ') AS u0 FROM p),
  r AS (SELECT page_id AS id, list_filter(t0, lambda x: length(x) >= 6 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ('concours', 'ouvert', 'selection', 'project', 'competition', 'planung', 'projets')) AS t1, list_filter(u0, lambda x: length(x) >= 6 AND NOT regexp_matches(x, '^[0-9]+$')) AS u1 FROM w),
  k AS (SELECT id, list_filter(t1, lambda x, i: list_position(t1, x) = i)[1:12] AS tokens, list_filter(u1, lambda x, i: list_position(u1, x) = i)[1:12] AS buyer FROM r),
  c AS (SELECT id, page_id, url, list_sum(list_prepend(0, list_transform(tokens, lambda x: CASE WHEN contains(plain_url, x) THEN length(x) ELSE 0 END))) + CASE WHEN ends_with(lower(url), '.html') THEN 15 ELSE 0 END
      + CASE WHEN {_any('lower(url)', ['ausschreibung', 'ausschreibungen', 'wettbewerb', 'projekte-und-ausschreibungen', 'planung-ausfuehrung', 'hochbauvorhaben'])} THEN 10 ELSE 0 END - CASE WHEN contains(lower(url), '/content/dam/') THEN 20 ELSE 0 END AS by_url,
    list_sum(list_prepend(0, list_transform(tokens, lambda x: CASE WHEN contains(named, x) THEN 4 * length(x) WHEN contains(body, x) THEN 2 * length(x) ELSE 0 END))) + list_sum(list_prepend(0, list_transform(buyer, lambda x: CASE WHEN contains(body, x) THEN length(x) ELSE 0 END))) AS by_page
    FROM k JOIN w ON page_id BETWEEN id AND id + 2)"""


def _candidates(spark, sf):
    pages = table(spark, sf, "pages")
    records = pages.select(F.col("page_id").alias("id"), text.html_title(F.col("html")).alias("title"), F.col("url").alias("authority_name"), F.lit(None).cast("string").alias("official_url"), F.lit(None).cast("string").alias("evidence_note"))
    near = pages.withColumn("id", F.explode(F.sequence(F.col("page_id") - 2, F.col("page_id")))).filter("id >= 0")
    return records, near


@query("page_match", f"WITH {_pages_sql()} SELECT id, page_id, CAST(by_url + by_page AS INTEGER) AS score FROM c")
def page_match(spark, sf):
    """How well each of three pages fits the title of the first."""
    from opalyx.sources import parsers

    # A page is read once and then meets the words of up to three records.
    records, _ = _candidates(spark, sf)
    asked = records.select("id", parsers.sought(F.col("title"), F.col("authority_name")).alias("words"))
    near = asked.withColumn("page_id", F.explode(F.sequence(F.col("id"), F.col("id") + 2)))
    read = table(spark, sf, "pages").select("page_id", "url", parsers.page_texts(F.col("html")).alias("page"))
    return near.join(read, "page_id").select("id", "page_id", parsers.texts_score(F.col("url"), F.col("page"), F.col("words")).alias("score"))


_BEST = "SELECT id, arg_min(url, (-by_url, url)) AS official_url FROM c WHERE by_url > 0 AND by_url + by_page >= 30"
_MARKED = "url || '/wettbewerb'"


@query("official_pages", f"""WITH {_pages_sql(_MARKED)} SELECT k.id, coalesce(a.official_url, b.official_url) AS official_url FROM k
  LEFT JOIN ({_BEST} AND id % 3 = 0 AND page_id > id GROUP BY id) a USING (id) LEFT JOIN ({_BEST} AND page_id = id GROUP BY id) b USING (id)""")
def official_pages(spark, sf):
    """Verification by tiers: for every third record the pages after its own; for all that is left open its own, as rendered."""
    from opalyx.sources import parsers

    records, near = _candidates(spark, sf)
    marked = near.withColumn("url", F.concat(F.col("url"), F.lit("/wettbewerb")))
    first, second = marked.filter("id % 3 = 0 AND page_id > id"), marked.filter("page_id = id")
    return parsers.official_pages(records, first, second).select("id", "official_url")


# --- places --------------------------------------------------------------------------------------
_SNIPPETS = ["; inmueble sito en C/ Mayántigo, Barrio Acorán, Distrito Suroeste; ", ". Lavori in via Vitulanese 104. ", ", parcheggi nel Campus Bizzozero di Varese, e poi Via Roma 1 e ancora via Roma 1, Frazione Alta. ", ": edifício sito na Rua das Flores 12, em Porto. ", " (pand aan Kerkstraat 12, Amsterdam). ", " fastighet på Storgatan 5; przy ul. Noniewicza 31 w Suwałkach. ", ". Nuova sede in Via Progetto Alfa 9, lotto 3. "]


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_group(n: int, kind: str, pattern: str) -> str:
    p = _sql_text(places.plain_pattern(pattern))
    tails = ", ".join(f"nullif(regexp_extract(tail, {_sql_text(x)}, 1), '')" for x in places.ADDRESS_TAILS)
    return f"""SELECT doc_id, {n} AS g, i, '{kind}' AS kind, regexp_replace(v, '[\\s,;:.]+$', '') AS address, coalesce({tails}) AS hint FROM (
    SELECT doc_id, i, vs[i] AS v, substr(t, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) + 1 AS BIGINT), 120) AS tail FROM (
      SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, 1) AS vs, string_split_regex(t, {p}) AS parts FROM d WHERE regexp_matches(t, {p}))))"""


@query("address_candidates", f"""WITH d AS (SELECT doc_id, regexp_replace(translate(substr(text, 1, length(text) // 2) || list_extract([{', '.join(map(_sql_text, _SNIPPETS))}], CAST(doc_id % 7 + 1 AS BIGINT)) || substr(text, length(text) // 2 + 1), '–—', '--'), '\\s+', ' ', 'g') AS t FROM documents),
  c AS ({' UNION ALL '.join(_sql_group(n, k, p) for n, (k, p) in enumerate(places.ADDRESS_GROUPS))}),
  f AS (SELECT *, lower(strip_accents(address)) AS key FROM c WHERE NOT regexp_matches(address, '(?i)(?:^|\\W)(?:cup|cig|codice|missione|lotto|pnrr|investimento|procedura|intervento|progetto|servizio|lavori|adeguamento|bando|pratica)(?:\\W|$)') AND NOT regexp_matches(address, {_sql_text('(?i)^(?:' + places.REFUSED_WHOLE + ')$')})),
  m AS (SELECT doc_id, kind, key, arg_min(address, (g, i)) AS address, arg_max(hint, (length(hint), -g, -i)) FILTER (hint IS NOT NULL) AS hint, min((g, i)) AS place FROM f GROUP BY doc_id, kind, key)
  SELECT doc_id, string_agg(kind || ':' || address || coalesce(' @ ' || hint, ''), '|' ORDER BY place) AS found, CAST(count(*) AS INTEGER) AS n FROM m GROUP BY doc_id""")
def address_candidates(spark, sf):
    """Addresses in each document's whole text, with one of several written into its middle."""
    half = F.floor(F.length("text") / 2).cast("int")
    snippet = F.get(F.array(*map(F.lit, _SNIPPETS)), (F.col("doc_id") % 7).cast("int"))
    t = F.concat(F.substring(F.col("text"), F.lit(1), half), snippet, F.substring(F.col("text"), half + 1, F.length("text")))
    d = table(spark, sf, "documents").select("doc_id", _where_any(places.address_candidates(t)).alias("c"))
    shown = F.transform("c", lambda x: F.concat(x["kind"], F.lit(":"), x["address"], F.coalesce(F.concat(F.lit(" @ "), x["hint"]), F.lit(""))))
    return d.select("doc_id", F.array_join(shown, "|").alias("found"), F.size("c").alias("n"))


_BUYERS = ["Comune di {}", "Gemeente {} (Centrum)", "{} kommune v/ Eiendom", "Gmina Miasto {}", "{} kaupunki", "Provincia di {} - Ufficio", "Ayuntamiento de {}", "Ministry of works"]


@query("explicit_city", """SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 7 THEN n_name WHEN o_orderkey % 3 = 0 THEN 'Radovljica' WHEN o_orderkey % 3 = 1 THEN '黄山市徽州区' END AS city
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def explicit_city(spark, sf):
    """The place in an authority's name, or else in the title, by the first pattern that gives a useful one."""
    k = F.col("o_orderkey")
    names = F.array(*(F.replace(F.lit(b), F.lit("{}"), F.col("n_name")) for b in _BUYERS))
    title = F.when(k % 8 < 7, "Works on a roof").when(k % 3 == 0, "Objekt na naslovu Prešernova cesta 11, Radovljica, z upoštevanjem").when(k % 3 == 1, "黄山市徽州区2026年老旧小区改造").otherwise("三江新区大学城片区")
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select("o_orderkey", places.explicit_city(title, F.get(names, (k % 8).cast("int"))).alias("city"))


# --- linked data ---------------------------------------------------------------------------------
def _script(k, url) -> str:
    return (
        """'<script type="application/ld+json">{"@graph": [{"name": "Hall", "address": {"@type": "PostalAddress", "streetAddress": "Street ' || """ + k + """ || '", "addressLocality": "Town", "postalCode": 7}}], "url": [[{"contentUrl": "' || """ + url + """ || '/a.png", "width": 640, "caption": "The hall"}, "/b.png"]],"""
        """ "meta": {"url": "no.png", "deep": [{"documentsSourceUrl": [{"x": "/docs/' || """ + k + """ || '"}], "documentsSourceNote": "see https://n.example/' || """ + k + """ || ', or (www.x.example)."}]}}</script><script type="application/ld+json">{broken</script>'"""
    )


@query("linked_data", f"""WITH p AS (SELECT page_id, url, replace(html, '</article>', {_script('page_id', 'url')} || '</article>') AS html FROM pages),
  q AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract(html, 'contentUrl": "([^"]*)"', 1) AS image, regexp_extract(html, 'streetAddress": "([^"]*)"', 1) AS street, regexp_extract(html, '"x": "([^"]*)"', 1) AS docs, regexp_extract(html, 'see ([^ ,]*),', 1) AS note FROM p WHERE contains(html, 'ld+json'))
  SELECT page_id, 'address' AS kind, NULL AS value, street, 'Town' AS locality, NULL AS descriptor, NULL AS width FROM q
  UNION ALL SELECT page_id, 'image', image, NULL, NULL, 'jsonld The hall', '640' FROM q UNION ALL SELECT page_id, 'image', root || '/b.png', NULL, NULL, 'jsonld', NULL FROM q
  UNION ALL SELECT page_id, 'link', root || docs, NULL, NULL, NULL, NULL FROM q UNION ALL SELECT page_id, 'link', note, NULL, NULL, NULL, NULL FROM q UNION ALL SELECT page_id, 'link', 'https://www.x.example', NULL, NULL, NULL, NULL FROM q""")
def linked_data(spark, sf):
    """Addresses, images and links of linked data that stands in each page's own html."""
    pages = table(spark, sf, "pages").withColumn("html", F.replace(F.col("html"), F.lit("</article>"), F.concat(F.expr(_script("page_id", "url")), F.lit("</article>"))))
    return linked.linked_data(pages, "page_id").select(F.col("id").alias("page_id"), "kind", "value", "street", "locality", "descriptor", "width")


@query("page_body_div", "SELECT page_id, html AS body FROM pages")
def page_body_div(spark, sf):
    """A whole page within a notice's division, cut out again at the tag that closes it."""
    ship(spark)
    html = F.concat(F.lit('<p>x</p><div id="mycontent"><DIV class="x detail_content">'), F.col("html"), F.lit("</div><div>after</div></div>"))
    return table(spark, sf, "pages").select("page_id", semi.balanced_div(html).alias("body"))


# --- streams and commits -------------------------------------------------------------------------
def _files(df, path: str, part) -> None:
    """Rows as files that arrive in the order of a part number."""
    for n in range(4):
        df.filter(part == n).coalesce(1).write.mode("append").parquet(path)


_EVENT_SQL = "SELECT user_id, event_id, event_type, CAST(value AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


@query("stream_keyed_state", _EVENT_SQL)
def stream_keyed_state(spark, sf):
    """The last event of each user over several micro-batches with a restart between them; state in buckets."""
    root, events = shared_dir(spark, "keyed"), table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    part, stream = F.pmod(F.col("event_id"), F.lit(3)), lambda: jobs.landed(spark, f"{root}/in", events.schema, files=1)
    fold = jobs.last_rows("user_id", ["ts", "event_id"])
    events.filter(part < 2).repartition(2, part).write.parquet(f"{root}/in")
    jobs.run_keyed_fold(stream(), f"{root}/state", f"{root}/checkpoint", "user_id", fold)
    events.filter(part == 2).write.mode("append").parquet(f"{root}/in")
    return jobs.run_keyed_fold(stream(), f"{root}/state", f"{root}/checkpoint", "user_id", fold).select("user_id", "event_id", "event_type", "value")


@query("stream_late_rows", """WITH b AS (SELECT *, ntile(3) OVER (ORDER BY ts, event_id) AS third FROM events)
  SELECT event_id, user_id FROM b WHERE NOT (third = 1 AND event_id % 10 = 0 AND ts < (SELECT max(ts) FROM b WHERE third = 2) - INTERVAL 1 HOUR)""")
def stream_late_rows(spark, sf):
    """Events once each within an hour of the latest: every tenth of the first third comes at the end and is too late,
    every seventh of the second third comes twice. Spark holds a batch against the time seen before the last one."""
    root = shared_dir(spark, "late")
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    # Thirds by rank, from two cuts: the rows at one and two thirds in the order of time.
    total = e.count()
    cuts = [r.o for r in e.orderBy("ts", "event_id").limit(2 * (total // 3) + min(total % 3, 2)).select(F.struct("ts", "event_id").alias("o"), F.monotonically_increasing_id().alias("n")).orderBy(F.desc("n")).limit(1).collect()]
    first = e.orderBy("ts", "event_id").limit(total // 3 + min(total % 3, 1)).agg(F.max(F.struct("ts", "event_id")).alias("o")).first().o
    at, before = F.struct("ts", "event_id"), lambda o: F.struct(F.lit(o.ts).alias("ts"), F.lit(o.event_id).alias("event_id"))
    third = F.when(at <= before(first), 0).when(at <= before(cuts[0]), 1).otherwise(2)
    arrives = F.when((third == 0) & (F.col("event_id") % 10 == 0), 3).otherwise(third)
    sent = e.withColumn("part", arrives).withColumn("again", F.explode(F.when((third == 1) & (F.col("event_id") % 7 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("again")
    _files(sent, f"{root}/in", F.col("part"))
    stream = jobs.landed(spark, f"{root}/in", e.schema, files=1)
    return jobs.once_in_time(stream, "ts", ["event_id"], "1 hour", root).select("event_id", "user_id")


@query("saved_searches_committed", "SELECT CAST(n + 1 AS BIGINT) AS id, 'w' || (n % 2) AS workspace_key, n_name AS name, CAST(1 + CASE WHEN n_nationkey < 2 THEN 1 ELSE 0 END AS BIGINT) AS touched FROM (SELECT n_name, n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS n FROM nation WHERE n_nationkey < 4)")
def saved_searches_committed(spark, sf):
    """Saved searches through the version log, the first two saved twice."""
    root = shared_dir(spark, "saved")
    names = [(r.n_nationkey, r.n_name) for r in table(spark, sf, "nation").filter("n_nationkey < 4").orderBy("n_nationkey").collect()]  # at most four
    empty = spark.createDataFrame([], "id long, workspace_key string, name string, filters_json string, created_at long, updated_at long")
    for k, name in names + names[:2]:
        versions.update(spark, root, lambda t, k=k, name=name: store.save_search(empty if t is None else t, f"w{k % 2}", name, '{"search":"x"}', (F.lit(1) if t is None else F.lit(t.count() + 1)).cast("long")))
    t = versions.current(spark, root)
    return t.select("id", "workspace_key", "name", F.when(F.col("updated_at") > F.col("created_at"), 2).otherwise(1).cast("long").alias("touched"))


# --- stored filters and all facets ---------------------------------------------------------------
_STORED = """'{"search": "  ' || event_type || '  x ", "projectTypes": ["interior_project", "interior_project", ' || event_id || ', "nope"], "sort": ' || CASE event_id % 3 WHEN 0 THEN '"latest"' WHEN 1 THEN '"oldest"' ELSE '1' END || ', "limit": 999, "includeExpired": ' || CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '"true"' ELSE '1' END
  || ', "designScopes": ' || CASE event_id % 5 WHEN 0 THEN '["scheme", "invalid", "scheme", "planning"]' WHEN 1 THEN '"scheme"' WHEN 2 THEN '[]' ELSE '[null, ["scheme"]]' END || ', "minEstimatedValueEur": ' || CASE event_id % 4 WHEN 0 THEN user_id || '.5' WHEN 1 THEN '"7"' WHEN 2 THEN CAST(user_id AS VARCHAR) ELSE 'null' END || ', "jurisdiction": ' || CASE event_id % 2 WHEN 0 THEN '"   "' ELSE '"it"' END || CASE WHEN event_id % 11 = 0 THEN '' ELSE '}' END"""


@query("stored_filters", f"""WITH f AS (SELECT *, {_STORED} AS raw FROM events)
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '{{}}' ELSE '{{' || array_to_string(list_filter([CASE WHEN event_id % 5 = 0 THEN '"designScopes":["scheme","planning"]' END, CASE WHEN event_id % 4 = 0 THEN '"includeExpired":true' END, CASE WHEN event_id % 2 = 1 THEN '"jurisdiction":"it"' END,
    CASE event_id % 4 WHEN 0 THEN '"minEstimatedValueEur":' || user_id || '.5' WHEN 2 THEN '"minEstimatedValueEur":' || user_id END, '"projectTypes":["interior_project"]', '"search":"' || event_type || ' x"', CASE WHEN event_id % 3 = 0 THEN '"sort":"latest"' END], lambda x: x IS NOT NULL), ',') || '}}' END AS filters, length(raw) AS n FROM f""")
def stored_filters(spark, sf):
    """A table of stored filters, cleaned: unknown members, wrong types and unknown values go."""
    raw = table(spark, sf, "events").select("event_id", F.expr(_STORED.replace("AS VARCHAR", "AS STRING")).alias("raw"))
    return raw.select("event_id", saved.clean_filters(F.col("raw")).alias("filters"), F.length("raw").cast("long").alias("n"))


@query("facet_sets", f"""{V}, c AS (SELECT id, ['scheme', 'planning', 'interior_design'][CAST(id % 4 AS BIGINT) + 1] AS scope, ['extension', 'new_build'][CAST(id % 3 AS BIGINT) + 1] AS mode, ['housing', 'education'][CAST(id % 3 AS BIGINT) + 1] AS cat, ['building_project', 'urban_planning'][CAST(id % 3 AS BIGINT) + 1] AS kind FROM v WHERE estimated_contract_value_eur >= 200000),
  a AS (SELECT list(scope) AS s, list(mode) AS m, list(cat) AS b, list(kind) AS k, count(*) AS total FROM c)
  SELECT array_to_string(list_filter(['interior_design', 'architectural_design', 'scheme', 'preliminary', 'construction_docs', 'planning', 'design_service'], lambda x: list_contains(s, x) OR x = 'preliminary'), '|') AS design_scopes,
    array_to_string(list_filter(['new_build', 'renovation', 'extension'], lambda x: list_contains(m, x)), '|') AS project_modes, array_to_string(list_filter(['education', 'healthcare', 'housing'], lambda x: list_contains(b, x)), '|') AS building_categories,
    array_to_string(list_filter(['urban_regeneration', 'environment_design', 'urban_planning', 'interior_project', 'building_project'], lambda x: list_contains(k, x)), '|') AS project_types, total FROM a""")
def facet_sets(spark, sf):
    """The four facets of fixed values of a slice, with a selected one added."""
    k = F.col("id")
    one = lambda values: F.filter(F.array(F.get(F.array(*map(F.lit, values)), (k % (len(values) + 1)).cast("int"))), lambda x: x.isNotNull())
    o = opportunities(spark, sf).filter("estimated_contract_value_eur >= 200000").withColumns({"design_scopes": one(["scheme", "planning", "interior_design"]), "project_modes": one(["extension", "new_build"]), "building_categories": one(["housing", "education"]), "project_types": one(["building_project", "urban_planning"])})
    out = Q.facets(o, Q.Query(design_scopes=["preliminary"]))
    return out.select(*(F.array_join(c, "|").alias(c) for c in ("design_scopes", "project_modes", "building_categories", "project_types")), "total")


@query("announcement_backfill", f"""{V} SELECT id, 'discarded' AS status FROM v WHERE id % 3 > 0 AND status NOT IN ('archived', 'discarded') AND (id % 12) < 9""")
def announcement_backfill(spark, sf):
    """A feed's open records whose summary only announces a notice."""
    summary = F.concat_ws(" ", "title", F.get(F.array(*map(F.lit, _PHRASES)), (F.col("id") % 12).cast("int")))
    o = opportunities(spark, sf).withColumns({"organizer": F.when(F.col("id") % 3 > 0, "National feed").otherwise("Other"), "w": text.plain_text(summary)})
    return store.announcement_changes(o, connectors.feed_judged(F.col("w"))["announces"], "National feed", [F.asc("id")])


@query("watch_membership", "SELECT o_orderkey AS id, 'w' || (o_orderkey % 3) AS workspace_key, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 40 AND l_suppkey % 3 = o_orderkey % 3) AS watched FROM orders")
def watch_membership(spark, sf):
    """Whether each workspace watches an opportunity."""
    entries = table(spark, sf, "lineitem").filter("l_quantity >= 40").select(F.concat(F.lit("w"), (F.col("l_suppkey") % 3).cast("string")).alias("workspace_key"), F.col("l_orderkey").cast("string").alias("opportunity_id"))
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("w"), (F.col("o_orderkey") % 3).cast("string")).alias("workspace_key"), F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("opportunity_id"))
    return store.with_watched(asked, entries).select("id", "workspace_key", "watched")
