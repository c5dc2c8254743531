"""Six registers as definitions over landed answers: what is read, where it lies, and which notices count.

A register's pages land as rows (page, payload); where it keeps details apart, these land by notice id
(id, payload). Paging is a work list that is planned before anything is fetched, so each page is a row of
its own. All functions return documents as the other connectors do.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalyx.functions import dates, money, rules, semi, text
from opalyx.sources.catalog import Source
from opalyx.sources.connectors import built_context, documents, is_relevant, listed_details, since

# Words of the registers' notices.
TED_STRONG = ["architectural and related services", "architectural engineering and planning services", "architectural services", "design contest", "planning competition", "maitrise d oeuvre"]
TED_POSITIVE = ["architect ", " architect", "architecture", "architectural", "design services", "design consultancy", "architekt", "landscape", "masterplan", "urban design", "public space", "planning consultancy"]
TED_NEGATIVE = ["supervision of building work", "construction work", "surveying services", "inspection services", "feasibility study advisory service analysis", "technical testing analysis and consultancy services", "civil engineering consultancy services", "civil engineering led", "consultant for", "water potable", "wastewater", "assainissement"]
TED_CODES = ["71200000", "71210000", "71220000", "71221000", "71222000", "71223000", "71230000", "71420000"]
BOAMP_WORDS = ["architect", "architett", "maitrise d'oeuvre", "maîtrise d'oeuvre"]
SIMAP_WORDS = ["architett", "architecture", "maitre d oeuvre", "planification"]
ANAC_WORDS = ["architett", "archeolog", "restauro", "paesagg"]
DOFFIN_WORDS = ["plan", "planfagleg", "planlegging", "reguleringsplan", "byggesak", "byggesaker", "landskap", "arkitekt"]
TENDERNED_DESIGN = ["architect", "architectenselectie", "architecton", "ontwerp", "landschap", "stedenbouw", "masterplan", "planstudie", "ruimtelijke"]
TENDERNED_BUILT = ["school", "campus", "sporthal", "bibliotheek", "museum", "wijk", "park", "plein", "openbare ruimte", "gebouw", "brug", "station"]
TENDERNED_NEGATIVE = ["brokerdienstverlening", "uitzendkrachten", "accountantsdiensten", "ict", "loopbaan", "outplacement"]


def page_size(limit: int, times: int, least: int) -> int:
    """Rows of a page: a multiple of what is wanted, and a least number."""
    return max(times * limit, least)


def page_list(spark: SparkSession, source: Source, pages: int, size: int, first: int = 0) -> DataFrame:
    """Work list (source_id, page, size) of a register's pages."""
    return spark.range(first, first + pages).select(F.lit(source.source_id).alias("source_id"), F.col("id").cast("int").alias("page"), F.lit(size).alias("size"))


def until_short(pages: DataFrame, path: str, size: int) -> DataFrame:
    """The landed pages up to the first that holds fewer rows than a full page: what lies behind it was not to be asked for."""
    n = F.coalesce(F.size(F.try_variant_get(F.try_parse_json("payload"), f"$.{path}", "array<variant>")), F.lit(0))
    short = pages.filter(n < size).agg(F.min("page").alias("_last"))
    return pages.join(short, F.col("_last").isNull() | (F.col("page") <= F.col("_last"))).drop("_last")


def _items(pages: DataFrame, path: str) -> DataFrame:
    """(page, at, v): the notices of landed pages, in their order."""
    held = F.try_variant_get(F.try_parse_json("payload"), f"$.{path}", "array<variant>")
    return pages.select("page", F.posexplode(held).alias("at", "v"))


def _details(details: DataFrame) -> DataFrame:
    return details.select(F.col("id").alias("notice"), F.try_parse_json("payload").alias("d"))


def _first(items: DataFrame, keep: Column, limit: int | None) -> DataFrame:
    """The first of the items that fit; without a limit all of them."""
    kept = items.filter(keep)
    return kept if limit is None else kept.orderBy("page", "at").limit(limit)


def _words(*columns: Column) -> Column:
    return text.plain_text(F.concat_ws(" ", *columns))


def ted(pages: DataFrame, source: Source, limit: int | None = 20) -> DataFrame:
    """The server filters by code and date; the limit is the server's, so the title rule comes after it."""
    v = F.col("v")
    rows = _first(_items(pages, "notices"), F.lit(True), limit)
    title = semi.localized(v, "notice-title", ("eng", "ENG"))
    codes = F.array_distinct(F.filter(F.transform(semi.at(v, "classification-cpv", "array<string>"), lambda c: F.trim(c)), lambda c: c != ""))
    codes, plain = F.coalesce(codes, F.array().cast("array<string>")), text.plain_text(title)
    fit = rules.decide([(rules.any_of(plain, TED_NEGATIVE), False), (rules.any_of(plain, TED_STRONG), True), (rules.any_of(plain, TED_POSITIVE), True)], False) | F.when(rules.any_of(plain, TED_NEGATIVE), False).otherwise(F.arrays_overlap(codes, F.array(*map(F.lit, TED_CODES))))
    first = lambda name: F.coalesce(semi.first_value(v, [f"{name}[0]"]), F.when(F.schema_of_variant(F.try_variant_get(v, f'$["{name}"]', "variant")) == "STRING", semi.first_value(v, [name])))
    url = semi.first_value(v, ["links.htmlDirect.ENG", "links.htmlDirect.eng", "links.html.ENG", "links.html.eng", "links.xml.MUL"])
    kept = rows.filter(title.isNotNull() & F.coalesce(fit, F.lit(False)))
    return documents(kept, source, url, title=title, noticeId=F.coalesce(first("publication-number"), first("notice-identifier")), buyer=F.coalesce(semi.localized(v, "organisation-name-buyer", ("eng", "ENG")), F.lit("Unknown authority")), procedureType=F.coalesce(first("procedure-type"), F.lit("open")), deadline=first("deadline-receipt-expressions-date-lot"), estimatedValueEur=first("estimated-value-lot"), cpv=codes, publicationDate=first("publication-date"))


def boamp(pages: DataFrame, source: Source, limit: int | None = 20, start: date | None = None) -> DataFrame:
    """A field of each row is a JSON text of its own; result notices go; the limit counts what is left."""
    v = F.col("v")
    title, described = text.or_null(F.trim(semi.at(v, "objet"))), F.array_join(F.coalesce(semi.at(v, "descripteur_libelle", "array<string>"), F.array().cast("array<string>")), " ")
    published = dates.parse_date(semi.at(v, "dateparution"))
    result = rules.any_of(F.lower(semi.at(v, "nature_libelle")), ["résultat", "resultat"])
    fit = title.isNotNull() & ~result & since(published, start) & is_relevant([title, described]) & (built_context(title, described) | rules.any_of(F.lower(title), BOAMP_WORDS))
    nested = semi.at(v, "donnees")
    worth = semi.first_money(nested)
    kept = _first(_items(pages, "results"), fit, limit).withColumn("worth", worth)
    amount, currency, url = F.col("worth.amount"), F.col("worth.currency"), semi.first_value(v, ["url"])
    return documents(kept, source, url, officialNoticeId=semi.first_value(v, ["id", "idweb"]), title=title, buyer=text.or_null(F.trim(semi.at(v, "nomacheteur"))), procedureType=semi.at(v, "procedure_libelle"), deadline=dates.parse_date(semi.at(v, "datelimitereponse")), publicationDate=published.cast("string"), estimatedValueEur=money.euro_only(amount, currency), estimatedValueText=money.amount_text(amount, currency, F.lit(None).cast("string")), cpv=semi.codes_in(F.coalesce(nested, F.lit(""))), summary=text.or_null(described), url=F.coalesce(url, F.lit(source.base_url)))


def simap(pages: DataFrame, details: DataFrame, source: Source, limit: int | None = 20, start: date | None = None) -> DataFrame:
    """Projects of the landed pages (each names the last item of the one before) with their publications' details, by project id."""
    v, d = F.col("v"), F.col("d")
    rows = _items(pages, "projects").withColumn("notice", text.or_null(F.trim(semi.at(v, "id"))))
    published = dates.parse_date(semi.at(v, "publicationDate"))
    cheap = (F.lower(semi.at(v, "pubType")) == "competition") & F.col("notice").isNotNull() & since(published, start)
    met = listed_details(rows, _details(details), "notice", cheap)
    office = lambda name: semi.localized(d, f'project-info.procOfficeAddress.{name}')
    title = F.coalesce(semi.localized(d, 'project-info.title'), semi.localized(v, "title"))
    described = text.strip_html(semi.localized(d, "procurement.orderDescription"))
    portal = F.coalesce(semi.first_value(d, ['project-info.documentsSourceUrl']), semi.localized(d, 'project-info.offerDigitalExternalPlatformUrl'))
    budget = text.first_match(described, [r"(L['’]objectif budgétaire[^.]*\.)", r"(Das Kostenziel[^.]*\.)", r"(Il budget[^.]*\.)", r"(Budget[^.]*CHF[^.]*\.)"])
    price, currency = semi.first_value(d, ["terms.compensation.price", "terms.totalPrice.price"]), semi.first_value(d, ["terms.compensation.currency", "terms.totalPrice.currency"])
    paid = F.when(price.isNotNull(), F.concat(F.lit("Compensation: "), F.coalesce(F.concat(currency, F.lit(" ")), F.lit("")), price, F.lit(".")))
    fit = title.isNotNull() & (built_context(title) | rules.any_of(text.plain_text(title), SIMAP_WORDS))
    page = F.concat(F.lit("https://www.simap.ch/de/project-detail/"), F.col("notice"))
    return documents(_first(met, fit, limit), source, page, officialNoticeId=F.coalesce(semi.first_value(d, ["base.publicationNumber"]), semi.first_value(v, ["publicationNumber", "projectNumber"])), title=title, buyer=F.coalesce(office("name"), semi.localized(v, "procOfficeName")), location=F.coalesce(office("city"), office("locality"), office("place")), procedureType=F.coalesce(semi.first_value(d, ["base.processType"]), semi.first_value(v, ["processType"])), projectSubType=F.coalesce(semi.first_value(d, ["base.projectSubType"]), semi.first_value(v, ["projectSubType"])), deadline=dates.parse_date(semi.first_value(d, ["dates.offerDeadline"])), publicationDate=published.cast("string"), cpv=semi.codes_in(F.coalesce(d.cast("string"), F.lit(""))), description=described, estimatedValueText=budget, officialUrl=F.coalesce(portal, semi.localized(d, 'project-info.procOfficeAddress.url'), page), documentsPortalUrl=portal, prizeSummary=F.coalesce(semi.localized(d, "terms.compensationNote"), semi.localized(d, "terms.totalPriceNote"), paid), authorityEmail=office("email"))


def section_items(sections: Column) -> Column:
    """The items of all sections, in order; a section without a list of items adds none."""
    return F.flatten(F.transform(sections, lambda x: F.coalesce(F.try_variant_get(x, "$.items", "array<variant>"), F.array().cast("array<variant>"))))


def anac(pages: DataFrame, source: Source, limit: int | None = 20, start: date | None = None, most: int = 5) -> DataFrame:
    """Notices whose fields lie in the sections of a template, of at most so many pages."""
    v, t = F.col("v"), F.col("t")
    rows = _items(pages.filter(F.col("page") < most), "content").withColumn("t", F.try_variant_get(v, "$.template[0].template", "variant"))
    sections = F.coalesce(F.try_variant_get(t, "$.sections", "array<variant>"), F.array().cast("array<variant>"))
    rows = rows.withColumns({"sections": sections, "items": section_items(sections)})
    head = F.get("items", F.lit(0))
    title = F.coalesce(semi.first_value(t, ["metadata.titolo", "metadata.descrizione"]), semi.first_value(head, ["descrizione"]))
    summary = F.coalesce(semi.first_value(t, ["metadata.descrizione"]), title)
    published, closes = dates.parse_date(semi.at(v, "dataPubblicazione")), semi.first_value(v, ["dataScadenza"])
    awarded = F.lower(summary).contains("aggiudicazione") & closes.isNull()
    fit = title.isNotNull() & is_relevant([title, summary]) & (built_context(title, summary) | rules.any_of(text.plain_text(title), ANAC_WORDS)) & ~awarded & since(published, start)
    pick = lambda column, path: F.get(F.filter(F.transform(column, lambda x: semi.first_value(x, [path])), lambda x: x.isNotNull()), F.lit(0))
    link = F.coalesce(pick(F.col("sections"), "fields.documenti_di_gara_link"), pick(F.col("items"), "documenti_di_gara_link"))
    notice, code = semi.first_value(v, ["idAvviso"]), semi.first_value(v, ["codiceScheda"])
    public = notice_page(notice, F.lower(F.coalesce(code, F.lit(""))).startswith("ad"))
    return documents(_first(rows, fit, limit), source, public, officialNoticeId=notice, title=title, buyer=pick(F.col("sections"), "fields.soggetti_sa[0].denominazione_amministrazione"), procedureType=code, deadline=dates.parse_date(closes), publicationDate=published.cast("string"), estimatedValueEur=semi.first_value(head, ["valore_affidamento"]), summary=summary, officialUrl=F.coalesce(link, F.lit(source.base_url)), sourceApiUrl=F.concat(F.lit("https://pubblicitalegale.anticorruzione.it/api/v0/avvisi/"), notice), sourcePublicUrl=public)


def notice_page(notice: Column, result: Column) -> Column:
    """Public page of a notice of that register, on one of two routes."""
    clean = text.or_null(F.trim(notice))
    return F.concat(F.lit("https://pubblicitalegale.anticorruzione.it/"), F.when(result, "esiti").otherwise("bandi"), F.lit("/"), clean, F.lit("?ricercaArchivio=true"))


def doffin(pages: DataFrame, details: DataFrame, source: Source, limit: int | None = 20, start: date | None = None, most: int = 5, size: int | None = None) -> DataFrame:
    """Hits of a faceted search, at most so many pages up to a short one, with their details by id."""
    v, d = F.col("v"), F.col("d")
    size = size or page_size(limit or 0, 3, 20)
    rows = _items(until_short(pages.filter(F.col("page").between(1, most)), "hits", size), "hits").withColumn("notice", text.or_null(F.trim(semi.at(v, "id"))))
    met = listed_details(rows, _details(details), "notice", F.col("notice").isNotNull())
    either = lambda *paths: F.coalesce(semi.first_value(d, list(paths)), semi.first_value(v, list(paths)))
    title, described, published = either("heading"), F.coalesce(either("description"), F.lit("")), dates.parse_date(either("publicationDate"))
    codes = F.filter(F.coalesce(semi.at(d, "allCpvCodes", "array<string>"), F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    fit = title.isNotNull() & since(published, start) & is_relevant([title, described], codes) & (built_context(title, described) | rules.any_of(_words(title, described), DOFFIN_WORDS))
    amount, currency = semi.at(d, "core.estimatedValue.amount", "double"), F.upper(F.trim(semi.at(d, "core.estimatedValue.code")))
    page = F.concat(F.lit("https://www.doffin.no/notices/"), F.col("notice"))
    return documents(_first(met, fit, limit), source, page, title=title, buyer=either("buyer[0].name"), noticeId=F.col("notice"), deadline=dates.parse_date(either("deadline")), estimatedValueEur=money.euro_only(amount, currency), estimatedValueText=money.amount_text(amount, currency, semi.at(d, "core.estimatedValue.fullLocalizedText")), summary=described, officialUrl=page, cpv=codes, opportunityType=F.lit("public_design_services_procurement"), procedureType=F.coalesce(semi.first_value(d, ["noticeType"]), semi.first_value(v, ["type"])), implementationPath=F.lit("service_contract_award_after_competitive_selection"), evidenceLevel=F.lit("official_notice"), publishedAt=published.cast("string"))


def tenderned(pages: DataFrame, details: DataFrame, source: Source, limit: int | None = 20, start: date | None = None, most: int = 6) -> DataFrame:
    """Open service publications of at most so many pages; a cheap title rule before the details, the full one after."""
    v, d = F.col("v"), F.col("d")
    rows = _items(pages.filter(F.col("page") < most), "content").withColumn("notice", text.or_null(F.trim(semi.at(v, "publicatieId"))))
    published = dates.parse_date(semi.at(v, "publicatieDatum"))
    listed = _words(semi.at(v, "aanbestedingNaam"), semi.at(v, "opdrachtBeschrijving"))
    kind = (semi.at(v, "typePublicatie.code") == "AAO") & (semi.at(v, "typeOpdracht.code") == "D") & (semi.at(v, "publicatiestatus.code") == "PUB") & semi.first_value(v, ["sluitingsDatum"]).isNotNull()
    cheap = kind & F.col("notice").isNotNull() & since(published, start) & semi.first_value(v, ["aanbestedingNaam"]).isNotNull() & ~rules.any_of(listed, TENDERNED_NEGATIVE) & rules.any_of(listed, TENDERNED_DESIGN)
    met = listed_details(rows, _details(details), "notice", F.coalesce(cheap, F.lit(False)))
    either = lambda path: F.coalesce(semi.first_value(d, [path]), semi.first_value(v, [path]))
    title, described = either("aanbestedingNaam"), F.coalesce(either("opdrachtBeschrijving"), F.lit(""))
    codes = F.filter(F.transform(F.coalesce(F.try_variant_get(d, "$.cpvCodes", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.trim(F.split(F.coalesce(semi.at(c, "code"), F.lit("")), "-")[0])), lambda c: c != "")
    fit = is_relevant([title, described], codes) & (built_context(title, described) | rules.any_of(_words(title, described), TENDERNED_BUILT))
    whole = lambda href: F.when(href.rlike("^https?://"), href).otherwise(F.concat(F.lit("https://www.tenderned.nl"), href))
    page = F.coalesce(semi.first_value(v, ["link.href"]), F.concat(F.lit("https://www.tenderned.nl/aankondigingen/overzicht/"), F.col("notice")))
    detail = F.concat(F.lit(f"{source.base_url}/"), F.col("notice"))
    return documents(_first(met, fit, limit), source, detail, title=title, buyer=either("opdrachtgeverNaam"), noticeId=F.col("notice"), deadline=dates.parse_date(either("sluitingsDatum")), summary=described, officialUrl=page, briefPdfUrl=whole(semi.first_value(d, ["links.pdf.href"])), cpv=codes, opportunityType=F.lit("public_design_services_procurement"), procedureType=F.coalesce(semi.first_value(d, ["procedureCode.omschrijving"]), semi.first_value(v, ["procedure.omschrijving"])), implementationPath=F.lit("service_contract_award_after_competitive_selection"), evidenceLevel=F.lit("official_notice"), publishedAt=published.cast("string"))


#: Registers by source id, and whether their details land apart.
REGISTERS = {"ted": (ted, False), "boamp": (boamp, False), "simap": (simap, True), "anac": (anac, False), "doffin": (doffin, True), "tenderned": (tenderned, True)}
