"""Connectors: landed JSON, CSV, feeds and pages to documents (source_id, source_url, payload).

Each family takes the landed rows and a Source; a payload is JSON in the common notice form. Live
fetching lands rows through `live.py`; what happens to them afterwards is here and distributed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalyx.functions import dates, money, rules, semi, text
from opalyx.plans import labels as L
from opalyx.plans import notices
from opalyx.sources.catalog import Source

NOTICE = ("title", "buyer", "noticeId", "deadline", "summary", "officialUrl", "opportunityType", "procedureType", "implementationPath", "evidenceLevel", "evidenceNote", "publishedAt", "estimatedValueEur", "estimatedValueText", "location", "cpv")


def is_relevant(words: list[Column], codes: Column | None = None, categories: Column | None = None, **lexicon) -> Column:
    """The common relevance rule over some texts."""
    none = F.array().cast("array<string>")
    haystack = text.plain_text(F.concat_ws(" ", *words))
    settings = {"negative": L.NEGATIVE_WORDS, "positive": L.POSITIVE_WORDS, "prefixes": L.RELEVANT_CODES} | lexicon
    return rules.relevant(haystack, F.transform(F.coalesce(categories if categories is not None else none, none), text.plain_text), F.coalesce(codes if codes is not None else none, none), **settings)


def built_context(*words: Column, lexicon: list[str] = L.BUILT_WORDS) -> Column:
    return rules.any_of(text.plain_text(F.concat_ws(" ", *words)), lexicon)


def since(published: Column, start: date | None) -> Column:
    """Publication bound; a row without a date passes."""
    return F.lit(True) if start is None else published.isNull() | (published >= F.lit(start))


def documents(df: DataFrame, source: Source, page: Column, /, **values: Column) -> DataFrame:
    """Rows to documents; null fields are left out of the payload."""
    fields = [v.cast("string").alias(k) if k == "deadline" or k == "publishedAt" else v.alias(k) for k, v in values.items()]
    return df.select(F.lit(source.source_id).alias("source_id"), F.coalesce(text.or_null(F.trim(page)), F.lit(source.base_url)).alias("source_url"), F.to_json(F.struct(*fields)).alias("payload"))


def buyer_allowed(buyer: Column, allowed: list[str]) -> Column:
    if not allowed:
        return F.lit(True)
    names = {text.driver_plain(a) for a in allowed}
    if "" in names:
        return F.lit(True)
    return F.size(rules.Markers(sorted(names)).hits(text.plain_text(buyer))) > 0


def _service(evidence: str, note: str) -> dict[str, Column]:
    return {"opportunityType": F.lit("public_design_services_procurement"), "implementationPath": F.lit("service_contract_award_after_competitive_selection"), "evidenceLevel": F.lit(evidence), "evidenceNote": F.lit(note)}


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")


def contract_notices_csv(rows: DataFrame, source: Source, limit: int | None = 20, start: date | None = None) -> DataFrame:
    """One language, buyers by allow-list; the latest publications first, those without a date last."""
    c = F.col
    title = text.or_null(F.trim(c("descrizione_avviso")))
    published, plain = dates.parse_date(c("data_pubblicazione_scp")), text.plain_text(title)
    kept = rows.withColumn("_p", published).filter(title.isNotNull() & is_relevant([title, c("tipo_avviso"), c("denominazione_stazione_appaltante")]) & buyer_allowed(c("denominazione_stazione_appaltante"), source.buyer_allowlist) & (built_context(title) | rules.any_of(plain, ["architett", "progettazione", "maitrise d oeuvre"])) & since(F.col("_p"), start))
    top = kept if limit is None else kept.orderBy(F.col("_p").desc_nulls_last(), c("id_avviso")).limit(limit)
    return documents(top, source, c("url_avviso"), officialNoticeId=c("id_avviso"), title=title, buyer=F.trim(c("denominazione_stazione_appaltante")), procedureType=c("tipo_avviso"), deadline=dates.parse_date(c("scadenza_avviso")), publicationDate=F.col("_p").cast("string"), summary=c("tipo_avviso"), url=c("url_avviso"))


def bilingual_csv(rows: DataFrame, source: Source, limit: int = 20, start: date | None = None) -> DataFrame:
    """Columns in two languages: the first that isn't blank."""
    pick = lambda *names: text.first_non_blank(*(F.col(f"`{n}`") for n in names if n in rows.columns), F.lit(""))
    title = pick("title-titre-eng", "title-titre-fra")
    unspsc = pick("unspscDescription-eng", "unspscDescription-fra")
    summary = F.coalesce(pick("description-descriptif-eng", "description-descriptif-fra"), unspsc)
    category = pick("procurementCategory-categorieApprovisionnement")
    fit = is_relevant([title, summary, unspsc]) & ((category == "*CNST") | built_context(title, summary, unspsc))
    kept = rows.withColumn("_p", dates.parse_date(pick("publicationDate-datePublication"))).filter(title.isNotNull() & F.coalesce(fit, F.lit(False)) & since(F.col("_p"), start))
    notice = pick("referenceNumber-numeroReference", "solicitationNumber-numeroSollicitation")
    url = pick("noticeURL-URLavis-eng", "noticeURL-URLavis-fra")
    top = kept.orderBy(F.col("_p").desc_nulls_last(), notice).limit(limit)
    return documents(top, source, url, title=title, buyer=pick("procuringEntity-entiteContractante"), noticeId=notice, deadline=dates.parse_date(pick("tenderClosingDate-appelOffresDateCloture")), summary=F.coalesce(summary, category, unspsc), officialUrl=F.coalesce(url, F.lit(source.base_url)), procedureType=pick("procurementMethod-methodeApprovisionnement-eng", "noticeType-avisType-eng"), publishedAt=F.col("_p"), **_service("official_listing", "Official open tender notice dataset row."))


#: Members of an OCDS release that the connector reads.
OCDS = "releases array<struct<ocid:string,date:string,buyer:struct<name:string>,parties:array<struct<name:string,roles:array<string>>>,tender:struct<title:string,description:string,datePublished:string,procurementMethod:string,procurementMethodDetails:string,classification:struct<id:string>,value:struct<amount:double,currency:string>,minValue:struct<amount:double,currency:string>,tenderPeriod:struct<endDate:string>,documents:array<struct<url:string>>,deliveryAddresses:array<struct<locality:string,region:string>>>>>"


def ocds_releases(payloads: DataFrame, source: Source, limit: int = 20, start: date | None = None) -> DataFrame:
    """Open-contracting releases (column payload), one document each, in the order of the feed."""
    r = payloads.select(F.from_json("payload", OCDS).alias("d")).select(F.posexplode("d.releases").alias("at", "r"))
    tender, code = F.col("r.tender"), F.coalesce(F.trim("r.tender.classification.id"), F.lit(""))
    title, description = text.or_null(F.trim(tender["title"])), F.coalesce(F.trim(tender["description"]), F.lit(""))
    words = text.plain_text(F.concat_ws(" ", title, description))
    fit = semi.any_prefix(F.array(code), L.RELEVANT_CODES) | (~rules.any_of(words, L.NEGATIVE_WORDS) & rules.any_of(words, L.POSITIVE_WORDS) & rules.any_of(words, L.BUILT_WORDS))
    buyer = F.coalesce(text.or_null(F.trim("r.buyer.name")), text.or_null(F.trim(semi.first_where(F.col("r.parties"), lambda p: F.array_contains(p["roles"], "buyer") & (F.trim(p["name"]) != ""))["name"])))
    url = F.coalesce(semi.first_where(tender["documents"], lambda d: F.trim(d["url"]) != "")["url"], F.lit(source.base_url))
    worth = F.coalesce(F.when(tender["value"]["amount"].isNotNull(), tender["value"]), F.when(tender["minValue"]["amount"].isNotNull(), tender["minValue"]))
    place = semi.first_where(tender["deliveryAddresses"], lambda a: F.coalesce(F.trim(a["locality"]), F.trim(a["region"]), F.lit("")) != "")
    currency = F.upper(F.trim(worth["currency"]))
    published = F.coalesce(tender["datePublished"], F.col("r.date"))
    kept = r.filter(title.isNotNull() & fit & since(dates.parse_date(published), start)).orderBy("at").limit(limit)
    return documents(kept, source, url, title=title, buyer=buyer, noticeId=F.col("r.ocid"), deadline=tender["tenderPeriod"]["endDate"], estimatedValueEur=money.euro_only(worth["amount"], currency), estimatedValueText=money.amount_text(worth["amount"], currency, F.lit(None).cast("string")), location=F.coalesce(text.or_null(F.trim(place["locality"])), text.or_null(F.trim(place["region"]))), summary=description, officialUrl=url, cpv=F.when(code != "", F.array(code)), procedureType=F.coalesce(tender["procurementMethodDetails"], tender["procurementMethod"]), publishedAt=published, **_service("official_notice", "Official open-contracting tender release."))


def json_notices(payloads: DataFrame, source: Source, limit: int = 20, start: date | None = None, *, rows_path: str, fields: dict[str, list[str]], limit_first: bool = False, drop: list[str] | None = None) -> DataFrame:
    """A JSON answer's list of notices (column payload): fields by the first path that has a value.

    limit_first takes the limit before the relevance rule, as a server's page does. drop names words of
    result notices."""
    v = F.try_parse_json("payload")
    items = payloads.select(F.posexplode(F.try_variant_get(v, f"$.{rows_path}", "array<variant>")).alias("at", "v"))
    got = {k: semi.first_value(F.col("v"), paths) for k, paths in fields.items()}
    codes = text.eight_digit_codes(F.col("v").cast("string"))
    title = got["title"]
    published = dates.parse_date(got["publishedAt"]) if "publishedAt" in got else F.lit(None).cast("date")
    fit = title.isNotNull() & is_relevant([title, got.get("summary", F.lit(None).cast("string"))], codes) & since(published, start)
    if drop:
        fit = fit & ~rules.any_of(text.plain_text(F.concat_ws(" ", title, got.get("procedureType", F.lit("")))), drop)
    ordered = items.orderBy("at")
    kept = ordered.limit(limit).filter(fit) if limit_first else ordered.filter(fit).limit(limit)
    if "deadline" in got:
        got["deadline"] = dates.parse_date(got["deadline"])
    return documents(kept, source, got.get("officialUrl", F.lit(None).cast("string")), **got, cpv=codes)


def listed_details(listing: DataFrame, details: DataFrame, key: str, cheap: Column) -> DataFrame:
    """List rows joined with their landed detail rows; the cheap filter runs before the join. Null details stay."""
    return listing.filter(cheap).join(details, key, "left")


RSS = "channel struct<item:array<struct<title:string,link:string,description:string,pubDate:string,category:array<string>>>>"


def rss_items(feeds: DataFrame) -> DataFrame:
    """Items of RSS feeds (column payload), with their place in the feed."""
    return feeds.select(F.posexplode(F.from_xml("payload", RSS)["channel"]["item"]).alias("at", "i")).select("at", "i.*")


def table_fields(description: Column) -> Column:
    """`key -> value` of the two-cell rows of a table in a description."""
    keys = text.all_matches(description, r"(?is)<tr[^>]*>\s*<t[hd][^>]*>(.*?)</t[hd]>\s*<td[^>]*>.*?</td>")
    values = text.all_matches(description, r"(?is)<tr[^>]*>\s*<t[hd][^>]*>.*?</t[hd]>\s*<td[^>]*>(.*?)</td>")
    pairs = F.zip_with(F.transform(keys, lambda k: text.lookup_key(text.strip_html(k))), F.transform(values, text.strip_html), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return F.map_from_entries(F.array_distinct(F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())))


# Words of a feed's design notices, its own words for what is built, and phrases of notices that only announce.
FEED_DESIGN = ["design build", "design builder", "design-builder", "design services", "architectural services", "concept design", "detailed design", "preliminary design", "architectural", "architecture", "architect", "landscape architecture", "landscape design", "urban design", "planning competition", "project competition"]
FEED_BUILT = ["design build", "design builder", "design-builder", "infrastructure", "stormwater", "watermain", "shared path", "boardwalk", "hall", "pavilion", "facility", "facilities", "public realm", "street", "camp"]
PREANNOUNCEMENT_WORDS = ["advance notice", "notice of information", "advance notification to the market", "early indication only", "not the commencement of a tender process", "will not form part of any future tender", "intention to release a tender", "future procurement opportunities", "no information from suppliers is requested"]
# Weights of the feed score.
FEED_WEIGHTS = [(("architect", "architecture", "architectural"), 5), (("urban design", "landscape architecture", "landscape design"), 4), (("design build", "design and build", "design builder"), 4), (("concept design", "detailed design", "preliminary design"), 3), (("design services", "architectural services"), 3)]


FEED_MARKERS = rules.Markers(FEED_DESIGN, FEED_BUILT, L.BUILT_WORDS, PREANNOUNCEMENT_WORDS, *(m for m, _ in FEED_WEIGHTS))


def feed_judged(words: Column) -> Column:
    """Struct (relevant, announces, score) of a feed's notice. Relevant: a design notice about something built, in the
    common words or the feed's own. Announces: it only tells that a notice will come."""

    def judged(h: Column) -> Column:
        terms = [F.when(rules.any_hit(h, m), F.lit(w)).otherwise(F.lit(0)) for m, w in FEED_WEIGHTS]
        score = reduce(lambda a, b: a + b, terms) + F.when(rules.any_hit(h, FEED_BUILT), F.lit(1)).otherwise(F.lit(0))
        relevant = rules.any_hit(h, FEED_DESIGN) & rules.any_hit(h, FEED_BUILT + L.BUILT_WORDS)
        return F.struct(relevant.alias("relevant"), rules.any_hit(h, PREANNOUNCEMENT_WORDS).alias("announces"), score.alias("score"))

    return text.bind(FEED_MARKERS.hits(words), judged)


def cell_lines(description: Column, key: str) -> Column:
    """Lines of the cell beside a key in a description's table."""
    cell = F.regexp_extract(description, rf"(?is)<tr[^>]*>\s*<t[hd][^>]*>\s*(?:<b>)?\s*{key}\s*:?\s*(?:</b>)?\s*</t[hd]>\s*<td[^>]*>(.*?)</td>", 1)
    return F.array_compact(F.transform(F.split(cell, r"(?i)<br\s*/?>|\R"), text.strip_html))


def rss_notices(feeds: DataFrame, source: Source, limit: int = 20, start: date | None = None, *, require_professional: bool = False, scored: bool = True) -> DataFrame:
    """RSS notices: the best scores first, then the latest; or, without score, in the order of the feed.

    Scored feeds take design notices about something built that are more than an announcement; the others
    go by the common rule and its gates on categories."""
    items = rss_items(feeds)
    told = table_fields(F.col("description"))
    summary = F.coalesce(told["overview"], told["description"], text.strip_html(F.col("description"))) if scored else text.strip_html(F.col("description"))
    listed = F.concat_ws(" ", F.array_join(F.coalesce("category", F.array().cast("array<string>")), " "), F.array_join(cell_lines(F.col("description"), "categories"), " "))
    words = text.plain_text(F.concat_ws(" ", "title", summary, listed))
    judged = F.col("_j")
    items = items.withColumn("_j", feed_judged(words))
    if scored:
        fit = judged["relevant"] & ~judged["announces"]
    else:
        fit = is_relevant([F.col("title"), summary], categories=F.col("category"), professional_only=require_professional)
    kept = items.withColumns({"_p": dates.parse_date(F.col("pubDate")), "_s": judged["score"]}).filter(fit & since(F.col("_p"), start))
    top = kept.orderBy(F.desc("_s"), F.col("_p").desc_nulls_last(), "at").limit(limit) if scored else kept.orderBy("at").limit(limit)
    f = told
    status = F.when(judged["announces"], "archived")
    return documents(top, source, F.col("link"), title=text.compact(F.col("title")), summary=summary, buyer=F.coalesce(f["buyer"], f["organisation"]), noticeId=F.coalesce(f["reference"], f["rfx_id"]), deadline=dates.parse_date(F.coalesce(f["close_date"], f["deadline"])), officialUrl=F.col("link"), publishedAt=F.col("_p"), statusHint=status, opportunityType=F.lit("public_design_services_procurement"), evidenceLevel=F.lit("official_listing" if scored else "secondary"))


ATOM = "entry array<struct<title:string,summary:string,updated:string,link:array<struct<_href:string,_rel:string>>>>"


def atom_notices(feeds: DataFrame, details: DataFrame, source: Source, limit: int = 20, start: date | None = None, live_states: tuple[str, ...] = ("PUB", "EV")) -> DataFrame:
    """Atom entries with `key: value; ...` summaries, joined with landed detail pages (source_url, html);
    one document for each URL and notice id."""
    entries = feeds.select(F.posexplode(F.from_xml("payload", ATOM)["entry"]).alias("at", "e")).select("at", "e.*")
    link = F.coalesce(semi.first_where(F.col("link"), lambda x: (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate") & (F.trim(x["_href"]) != "")), semi.first_where(F.col("link"), lambda x: F.trim(x["_href"]) != ""))["_href"]
    plain = text.strip_html(F.col("summary"))
    base = entries.withColumns({"url": F.trim(link), "plain": plain, "_p": dates.parse_date(F.col("updated")), "state": F.upper(text.field(plain, "estado"))})
    base = base.filter((F.trim("title") != "") & F.col("url").isNotNull() & F.col("state").isin(*live_states) & since(F.col("_p"), start))
    cheap = ~rules.any_of(text.plain_text(F.concat_ws(" ", "title", "plain")), L.NEGATIVE_WORDS)
    met = listed_details(base, details.select(F.col("source_url").alias("url"), "html"), "url", cheap)
    detail, codes = text.strip_html(F.col("html")), text.eight_digit_codes(F.coalesce("html", F.lit("")))
    fit = is_relevant([F.col("title"), F.col("plain"), detail], codes) & (built_context(F.col("title"), F.col("plain"), detail) | semi.any_prefix(codes, L.RELEVANT_CODES))
    notice = F.coalesce(text.field(F.col("html"), "Expediente"), text.field(F.col("plain"), "id licitaci[oó]n"))
    value = F.coalesce(text.field(F.col("html"), "Valor estimado"), text.field(F.col("plain"), "importe"))
    kept = met.withColumns({"notice": notice, "value": value, "cpv": codes}).filter(fit)
    from opalyx.operators.aggregates import keep_first

    once = keep_first(keep_first(kept, ["url"], [F.asc("at")]).withColumn("_k", F.coalesce("notice", "url")), ["_k"], [F.asc("at")]).orderBy("at").limit(limit)
    return documents(once, source, F.col("url"), title=F.coalesce(text.field(F.col("html"), "Objeto del contrato"), F.trim("title")), buyer=text.field(F.col("plain"), "[oó]rgano de contrataci[oó]n"), noticeId=F.col("notice"), deadline=dates.parse_date(text.field(F.col("html"), "Fecha de presentaci[oó]n")), summary=F.coalesce("plain", "title"), officialUrl=F.col("url"), cpv=F.col("cpv"), estimatedValueEur=money.parse_amount(F.col("value")), estimatedValueText=money.amount_text(money.parse_amount(F.col("value")), F.lit("EUR"), F.col("value")), procedureType=text.field(F.col("html"), "Procedimiento"), publishedAt=F.col("_p"), **_service("official_notice", "Official syndication entry with its public detail page."))


# What planning services, steering and building sites are called in buyers' profiles.
DIRECT_SERVICES = ["objektplanung", "fachplanung", "planungsleistung", "planungsleistungen", "architektenleistung", "architektenleistungen", "ingenieurleistung", "ingenieurleistungen", "generalplanung", "gesamtplanung", "freianlagenplanung", "landschaftsarchitektur", "stadtplanung", "projektleitung", "generalplaner", "bauakustik", "raum und bauakustik"]
STEERING = ["projektsteuerung", "projektsteuerer", "projektsteuererleistungen", "kostenplanung"]
BUILDING_SITES = ["gebaude", "hochbau", "neubau", "umbau", "sanierung", "feuerwache", "schule", "bibliothek", "museum", "campus", "haltestelle", "stadtteilschule", "bibliothek", "sport", "quartier", "txl"]


def municipal_relevant(*words: Column) -> Column:
    """The common rule, a planning service by name, or steering of something built."""
    plain = text.plain_text(F.concat_ws(" ", *words))
    return is_relevant(list(words)) | rules.any_of(plain, DIRECT_SERVICES) | (rules.any_of(plain, STEERING) & rules.any_of(plain, BUILDING_SITES))


def municipal_candidate(*words: Column) -> Column:
    """What a listing's row has to hold so that its detail page is worth reading."""
    return municipal_relevant(*words) | rules.any_of(text.plain_text(F.concat_ws(" ", *words)), DIRECT_SERVICES + STEERING)


def page_route(payload: Column) -> Column:
    """Which parser a landed page needs."""
    head = F.lower(F.substring(F.ltrim(payload), 1, 600))
    return F.when(head.contains("<rss") | head.contains("<feed"), "feed").when(F.lower(payload).contains("<table"), "table").when(F.lower(payload).contains('class="teaser'), "teaser").otherwise("page")


def buyer_pages(pages: DataFrame, source: Source, limit: int = 20, start: date | None = None) -> DataFrame:
    """Pages of buyers' profiles (source_url, payload): feeds, listings in tables or teasers, or one notice as it is."""
    routed = pages.withColumn("route", page_route(F.col("payload")))
    feed = rss_notices(routed.filter("route = 'feed'"), source, limit, start)
    row = {"table": r"(?is)<tr[^>]*>(.*?)</tr>", "teaser": r'(?is)<(?:div|article|li)[^>]*class="teaser[^"]*"[^>]*>(.*?)</(?:div|article|li)>'}
    parts = []
    for route, pattern in row.items():
        rows = routed.filter(F.col("route") == route).select("source_url", F.posexplode(text.all_matches(F.col("payload"), pattern)).alias("at", "row"))
        title, href = text.strip_html(F.regexp_extract("row", r"(?is)<a[^>]*>(.*?)</a>", 1)), text.or_null(F.regexp_extract("row", '(?i)href="([^"]+)"', 1))
        kept = rows.filter(title.isNotNull() & municipal_relevant(text.strip_html(F.col("row")))).orderBy("source_url", "at").limit(limit)
        url = text.resolve_url(F.col("source_url"), href)
        parts.append(documents(kept, source, url, title=title, summary=text.strip_html(F.col("row")), officialUrl=url, deadline=dates.parse_date(text.strip_html(F.col("row"))), evidenceLevel=F.lit("authority_page")))
    whole = routed.filter("route = 'page'").select(F.lit(source.source_id).alias("source_id"), "source_url", "payload")
    return reduce(DataFrame.unionByName, [feed, *parts, whole])


def term_pages(spark: SparkSession, terms: list[str], pages: int) -> DataFrame:
    """Work list of a search: every term with every page."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "term_no int, term string").withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))


def scored_search(hits: DataFrame, details: DataFrame, source: Source, limit: int, *, title_weights: dict[str, int], body_weights: dict[str, int], negative: dict[str, int], threshold: tuple[int, int] = (7, 10)) -> DataFrame:
    """Hits of a term search (id, title, url, published) met once each, joined with landed details (id, html), scored and cut to the best."""
    once = hits.dropDuplicates(["id"])
    met = once.join(details, "id", "left")
    body = F.lower(F.concat_ws(" ", "title", text.strip_html(F.col("html"))))
    score = rules.weighted_score(F.lower("title"), title_weights) + rules.weighted_score(body, body_weights) - rules.weighted_score(body, negative)
    kept = met.withColumn("score", score).filter(F.col("score") >= F.when(F.col("html").isNotNull(), threshold[0]).otherwise(threshold[1]))
    top = kept.orderBy(F.desc("score"), F.desc("published"), "id").limit(limit)
    return documents(top, source, F.col("url"), title=F.col("title"), noticeId=F.col("id").cast("string"), summary=F.substring(body, 1, 4000), officialUrl=F.col("url"), publishedAt=F.col("published"), evidenceLevel=F.lit("official_notice"))


def notice_search(hits: DataFrame, details: DataFrame, source: Source, limit: int, start: date | None = None) -> DataFrame:
    """The term-search register: hits (id, title, url, published, province, business, information) met once each,
    joined with landed details (id, html, category), judged by the notice rules, the best scores first, then the latest.

    A hit without a detail page is judged by its title, with the higher threshold."""
    once = hits.dropDuplicates(["id"]).filter(since(dates.parse_date(F.col("published")), start))
    met = once.join(details.select("id", "html", "category"), "id", "left")
    body = F.coalesce(text.strip_html(F.col("html")), F.lit(""))
    met = met.withColumns({"_b": body, "_d": F.col("html").isNotNull()})
    met = met.withColumns({"_r": notices.relevance(F.col("title"), F.col("_b"), F.col("category"), F.col("_d")), "_p": dates.parse_date(F.col("published"))})
    top = met.filter("_r.relevant").orderBy(F.desc("_r.score"), F.col("_p").desc_nulls_last(), "id").limit(limit)
    top = top.withColumn("_f", notices.features(F.col("title"), F.col("_b"), F.col("category")))
    f, score = F.col("_f"), F.col("_r.score").cast("string")
    note = F.when(F.col("_d"), F.concat(F.lit(f"Official {source.name} notice detail. Relevance score "), score, F.lit(" after detail validation."))).otherwise(F.concat(F.lit(f"Official {source.name} listing retained after detail fetch failed. Relevance score "), score, F.lit(" from title-only screening.")))
    procedure = F.when(F.col("business") == "政府采购", "public_design_services_tender").when(F.coalesce("information", F.lit("")).contains("招标"), "open")
    values = {"title": F.col("title"), "noticeId": F.col("id").cast("string"), "deadline": notices.deadline(F.col("_b"), F.col("_p"), F.col("html")), "summary": F.coalesce(text.or_null(F.substring("_b", 1, 4000)), F.col("title"))}
    values |= {"procedureType": procedure, "publishedAt": F.col("_p"), "location": F.col("province"), "detailUrl": F.col("url")} | _service("official_notice", "") | {"evidenceLevel": F.when(F.col("_d"), "official_notice").otherwise("official_listing"), "evidenceNote": note}
    values |= {"competitionTypes": notices.competition_types(f), "projectTypes": notices.project_types(f), "buildingCategories": notices.building_categories(f), "officialSectors": F.array_sort(f["sectors"]), "builtAssetTypes": F.array_sort(f["assets"]), "designScopes": F.array_sort(f["scopes"]), "projectModes": F.array_sort(f["modes"])}
    return documents(top, source, F.col("url"), **values)


def scaffold(spark: SparkSession, source: Source, *_args, **_more) -> DataFrame:
    """A source that is only prepared: no documents; an error if it is enabled."""
    if source.enabled:
        raise ValueError(f"{source.source_id} is only a scaffold and can't be enabled")
    return spark.createDataFrame([], "source_id string, source_url string, payload string")


def sitemap_urls(robots: Column, host: Column) -> Column:
    """Sitemaps that a robots file names, else the usual place."""
    named = text.all_matches(F.replace(robots, F.lit(" "), F.lit(" ")), r"(?im)^\s*sitemap:\s*(\S+)\s*$")
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.concat(F.lit("https://"), host, F.lit("/sitemap.xml"))))


def sitemap_pages(fetched: DataFrame, depth: int = 2, nested: int = 20) -> DataFrame:
    """(root, url) of the pages that landed sitemaps (url, xml, root) list, through indexes up to a depth."""
    locs = lambda c: F.transform(text.all_matches(c, r"(?i)<loc>\s*([^<]+?)\s*</loc>"), lambda u: F.trim(u))
    is_index = F.lower(F.substring("xml", 1, 500)).contains("<sitemapindex")
    level, out = fetched.filter("root = url").select("root", "url", "xml"), []
    for at in range(depth + 1):
        out.append(level.filter(~is_index).select("root", F.explode(locs(F.col("xml"))).alias("url")))
        if at < depth:
            inner = level.filter(is_index).select("root", F.explode(F.slice(locs(F.col("xml")), 1, nested)).alias("url"))
            level = inner.join(fetched.select("url", "xml"), "url").select("root", "url", "xml")
    return reduce(DataFrame.unionByName, out).distinct()


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "contract_notices_csv": contract_notices_csv,
    "bilingual_csv": bilingual_csv,
    "ocds": ocds_releases,
    "json": json_notices,
    "rss": rss_notices,
    "atom": atom_notices,
    "buyer_pages": buyer_pages,
    "scored_search": scored_search,
    "notice_search": notice_search,
    "scaffold": scaffold,
}


def connector(source: Source) -> Callable[..., DataFrame]:
    """By source id, then by collector family."""
    for key in (source.source_id, source.collector):
        if key in REGISTRY:
            return REGISTRY[key]
    raise LookupError(f"no connector for {source.source_id}")
