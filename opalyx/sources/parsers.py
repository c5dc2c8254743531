"""Parsers: documents (source_id, source_url, payload) to records, as Column expressions.

A parser names, for each raw field, the JSON paths and, for labelled pages, the patterns it looks at;
record_columns() turns raw fields into a canonical record. Rows without a title carry an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalyx.functions import dates, money, rules, semi, text
from opalyx.plans import classify

CONFIDENCE = 0.78
_ID = ["officialNoticeId", "noticeId", "id"]
_PLACE = ["location", "place", "city", "municipality"]
_SERVICES, _AWARD = "public_design_services_procurement", "service_contract_award_after_competitive_selection"


@dataclass(frozen=True)
class Parser:
    name: str
    json: dict[str, list[str]]
    page: dict[str, list[str]] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    note: str = ""
    foreign_currency: str | None = None
    archives: bool = False


_COMMON = {"notice_id": _ID, "cpv": ["cpv", "cpvCodes"], "location": _PLACE, "value_text": ["estimatedValueText", "estimatedValueDisplay"], "official_url": ["officialUrl", "url"], "documents_url": ["documentsPortalUrl"], "brief_url": ["briefPdfUrl"], "prize": ["prizeSummary", "compensationSummary"], "evidence_level": ["evidenceLevel"], "evidence_note": ["evidenceNote"]}
_NOTICE = _COMMON | {"title": ["title", "noticeTitle", "summary"], "authority": ["buyer", "authority"], "deadline": ["deadline", "submissionDeadline"], "value": ["estimatedValueEur", "estimatedValue"], "eligibility": ["eligibility", "summary", "description"], "procedure": ["procedureType", "noticeType", "processType"]}
_HUB = _NOTICE | {"title": ["title", "description", "summary"], "deadline": ["deadline", "scadenza"], "value": ["estimatedValueEur", "estimatedValue", "estimatedValueText"], "eligibility": ["summary", "description"]}

# Labels of the pages that each parser reads.
PARSERS = {
    p.name: p
    for p in (
        Parser("ted", _NOTICE | {"implementation": ["implementationPath"]}, {"title": [r"<h1[^>]*>\s*([^<]+)</h1>", r"Title[^:]*:\s*([^<\n]+)"], "authority": [r"(?:Buyer|Contracting authority)[^:]*:\s*([^<\n]+)"], "notice_id": [r"(?:Notice|Publication) number[^:]*:\s*([^<\n]+)"], "deadline": [r"Deadline[^:]*:\s*([^<\n]+)"], "value": [r"Estimated value[^:]*:\s*([^<\n]+)"], "eligibility": [r"Eligibility[^:]*:\s*([^<\n]+)"], "procedure": [r"Procedure[^:]*:\s*([^<\n]+)"], "cpv": [r"CPV[^:]*:\s*([^<\n]+)"]}, {"opportunity_type": "public_design_contest", "procedure": "design_contest", "implementation": _AWARD}, "Parsed from an official journal notice."),
        Parser("boamp", _NOTICE, {"title": [r"<h1[^>]*>\s*(?:Avis de concours\s*[-:]\s*)?([^<]+)</h1>", r"Titre[^:]*:\s*([^<\n]+)"], "authority": [r"Pouvoir adjudicateur[^:]*:\s*([^<\n]+)", r"Acheteur[^:]*:\s*([^<\n]+)"], "notice_id": [r"Identifiant officiel[^:]*:\s*([^<\n]+)", r"Référence[^:]*:\s*([^<\n]+)"], "deadline": [r"Date limite[^:]*:\s*([^<\n]+)", r"Date de remise[^:]*:\s*([^<\n]+)"], "value": [r"Valeur estimée[^:]*:\s*([^<\n]+)", r"Montant estimé[^:]*:\s*([^<\n]+)"], "eligibility": [r"Exigences[^:]*:\s*([^<\n]+)", r"Conditions de participation[^:]*:\s*([^<\n]+)"], "cpv": [r"CPV(?: principal)?[^:]*:\s*([^<\n]+)"], "procedure": [r"Type de procédure[^:]*:\s*([^<\n]+)", r"Procédure[^:]*:\s*([^<\n]+)"]}, {"opportunity_type": _SERVICES, "procedure": "maitrise_d_oeuvre_procurement", "implementation": _AWARD}, "Parsed from BOAMP notice payload. Verify full procurement dossier before publishing."),
        Parser("simap", _NOTICE, {"title": [r"<h1[^>]*>\s*([^<]+)</h1>", r"Titel[^:]*:\s*([^<\n]+)"], "authority": [r"Vergabestelle[^:]*:\s*([^<\n]+)", r"Autorité adjudicatrice[^:]*:\s*([^<\n]+)"], "notice_id": [r"Meldungsnummer[^:]*:\s*([^<\n]+)", r"Num[eé]ro d'avis[^:]*:\s*([^<\n]+)"], "deadline": [r"Abgabetermin[^:]*:\s*([^<\n]+)", r"Délai de remise[^:]*:\s*([^<\n]+)"], "value": [r"Gesch[aä]tzter Auftragswert[^:]*:\s*([^<\n]+)", r"Valeur estimée[^:]*:\s*([^<\n]+)"], "eligibility": [r"Teilnahmebedingungen[^:]*:\s*([^<\n]+)", r"Conditions de participation[^:]*:\s*([^<\n]+)"], "procedure": [r"Verfahrensart[^:]*:\s*([^<\n]+)", r"Procédure[^:]*:\s*([^<\n]+)"], "cpv": [r"CPV[^:]*:\s*([^<\n]+)"]}, {"opportunity_type": "public_design_contest", "procedure": "planning_competition", "implementation": _AWARD}, "Parsed from simap notice payload. Non-EUR value may need manual currency normalization.", foreign_currency="CHF"),
        Parser("bdncp", _HUB | {"procedure": ["procedureType", "codiceScheda"]}, {}, {"opportunity_type": _SERVICES, "procedure": "anac_public_notice", "implementation": _AWARD}, "Parsed from the public ANAC legal-publicity API. Use the linked procurement documents as the canonical dossier.", archives=True),
        Parser("procurement_hub", _HUB, {}, {"opportunity_type": _SERVICES, "procedure": "official_procurement_notice", "implementation": _AWARD}, "Parsed from the official Servizio Contratti Pubblici open-data feed. Confirm the notice page before acting."),
        Parser("buyer_profile", _NOTICE, {"title": [r"<h1[^>]*>\s*([^<]+)</h1>", r"(?:Objet|Oggetto|Bezeichnung|Titel)[^:]*:\s*([^<\n]+)", r"<title[^>]*>([^<]+)</title>"], "authority": [r"(?:Vergabestelle|Auftraggeber|Stazione appaltante|Ente|Acheteur|Maître d'ouvrage)[^:]*:\s*([^<\n]+)"], "notice_id": [r"(?:Vergabenummer|Aktenzeichen|CIG|Référence)[^:]*:\s*([^<\n]+)"], "deadline": [r"(?:Abgabefrist|Angebotsfrist|Scadenza|Date limite)[^:]*:\s*([^<\n]+)"], "value": [r"(?:Auftragswert|Importo|Montant)[^:]*:\s*([^<\n]+)"], "eligibility": [r"(?:Eignung|Requisiti|Conditions)[^:]*:\s*([^<\n]+)"], "procedure": [r"(?:Verfahrensart|Tipo di procedura|Type de procédure)[^:]*:\s*([^<\n]+)"], "cpv": [r"CPV[^:]*:\s*([^<\n]+)"]}, {"opportunity_type": _SERVICES, "procedure": "authority_profile_notice", "implementation": _AWARD}, "Parsed from a buyer profile page."),
        Parser("generic", _COMMON | {"title": ["title", "headline"], "authority": ["buyer", "authority", "organizer"], "deadline": ["deadline", "deadlineAt"], "value": ["estimatedValueEur", "estimatedValue"], "eligibility": ["summary", "description"], "procedure": ["procedureType"], "opportunity_type": ["opportunityType"], "implementation": ["implementationPath"]}, {}, {}, "Secondary discovery listing. Verify against the linked official notice before taking action."),
    )
}
_LISTS = {"project_types": ["projectTypes"], "building_categories": ["buildingCategories"], "official_sectors": ["officialSectors"], "built_asset_types": ["builtAssetTypes"], "design_scopes": ["designScopes"], "project_modes": ["projectModes"]}


def archived_status(v: Column) -> Column:
    """Award notices of one register are archived, by code, kind, link or wording."""
    low = lambda *paths: F.lower(F.coalesce(semi.first_value(v, list(paths)), F.lit("")))
    gone = low("procedureType", "codiceScheda").startswith("ad") | low("sourceKind", "noticeKind").isin("aggiudicazione", "esito", "archived", "completed") | low("sourcePublicUrl").contains("/esiti/") | rules.any_of(low("summary", "description"), ["aggiudicazione", "affidamento diretto"])
    return F.when(gone, "archived").otherwise("discovered")


def raw_fields(parser: Parser, payload: Column) -> dict[str, Column]:
    v, is_json = F.try_parse_json(payload), semi.is_object(payload)

    def one(name: str) -> Column:
        got = [F.when(is_json, semi.first_value(v, parser.json[name]))] if name in parser.json and name != "cpv" else []
        if name in parser.page:
            got.append(F.when(~is_json, text.first_match(payload, parser.page[name])))
        if name in parser.defaults:
            got.append(F.lit(parser.defaults[name]))
        return F.coalesce(*got) if got else F.lit(None).cast("string")

    names = {*parser.json, *parser.page, *parser.defaults}
    out = {n: one(n) for n in names | {"title", "authority", "notice_id", "deadline", "value", "value_text", "eligibility", "procedure", "location", "official_url", "documents_url", "brief_url", "prize", "evidence_level", "evidence_note", "opportunity_type", "implementation"}}
    from_page = F.filter(F.transform(F.split(text.first_match(payload, parser.page["cpv"]), ","), lambda x: F.trim(x)), lambda c: c != "") if "cpv" in parser.page else F.array().cast("array<string>")
    out["cpv"] = F.when(is_json, semi.list_value(v, parser.json["cpv"])).otherwise(F.coalesce(from_page, F.array().cast("array<string>")))
    out |= {k: F.when(is_json, semi.list_value(v, paths)).otherwise(F.array().cast("array<string>")) for k, paths in _LISTS.items()}
    out["status"] = archived_status(v) if parser.archives else F.lit("discovered")
    return out


def parse(docs: DataFrame, sources: DataFrame, parser: Parser) -> DataFrame:
    """Records of a parser's documents with a column error: null, or why there is no record.

    sources: source_id, name, jurisdiction, source_tier, regions, languages (a small table)."""
    raw = raw_fields(parser, F.col("payload"))
    base = docs.select("source_id", "source_url", "payload", *(c.alias(f"r_{n}") for n, c in raw.items())).join(sources.select("source_id", "name", "jurisdiction", "source_tier", "regions", "languages"), "source_id", "left")
    r = lambda n: F.col(f"r_{n}")
    kind = F.coalesce(classify.opportunity_type(r("opportunity_type")), text.compact(r("opportunity_type")), F.lit("unknown"))
    procedure = classify.procedure_type(r("procedure"))
    path = classify.implementation_path(r("implementation"), kind)
    types = classify.competition_types(F.concat_ws(" ", r("title"), r("eligibility"), path, procedure))
    value_text = F.coalesce(r("value_text"), r("value"))
    amount = money.parse_amount(r("value"))
    if parser.foreign_currency:
        amount = F.when(~F.coalesce(F.upper(r("value")).contains(parser.foreign_currency), F.lit(False)), amount)
    out = base.withColumns({"opportunity_type": kind, "procedure_type": procedure, "implementation_path": path, "competition_types": types, "estimated_contract_value_eur": amount})
    explicit = lambda n, inferred: F.when(F.size(r(n)) > 0, r(n)).otherwise(inferred)
    has = lambda *names: reduce(lambda a, b: a | b, (F.array_contains("competition_types", n) for n in names))
    projects = F.array_compact(F.array(F.when(has("adaptive_reuse"), "urban_regeneration"), F.when(has("landscape"), "environment_design"), F.when(has("masterplan", "urban_design"), "urban_planning"), F.when(has("interior"), "interior_project"), F.when(has("architecture", "public_building", "healthcare", "education", "housing"), "building_project")))
    buildings = F.array_compact(F.array(F.when(has("healthcare"), "healthcare"), F.when(has("education"), "education"), F.when(has("housing"), "housing"), F.when(has("public_building"), "civic_public")))
    deadline = dates.parse_date(r("deadline"))
    architect = classify.architect_required(F.concat_ws(" ", r("eligibility"), r("title"), F.col("procedure_type")))
    partner = classify.partner_required(r("eligibility"))
    evidence = classify.evidence_level(r("evidence_level"), F.col("source_tier"))
    fee = F.lit(0.0)
    score = classify.qualification_score(evidence=evidence, notice_id=r("notice_id"), path=F.col("implementation_path"), architect=architect, partner=partner, value=F.col("estimated_contract_value_eur"), value_text=value_text, registration=fee, submission=fee, authority=r("authority"))
    key = text.dedup_key(r("title"), F.col("name"), dates.canonical_deadline(deadline))
    return out.select(
        key.alias("id"), key.alias("dedup_key"), text.compact(r("title")).alias("title"), F.col("name").alias("organizer"), text.compact(r("authority")).alias("authority_name"),
        F.coalesce(r("official_url"), F.col("source_url")).alias("official_url"), "source_url", r("status").alias("status"), "opportunity_type", "jurisdiction", "procedure_type",
        text.compact(r("notice_id")).alias("official_notice_id"), "regions", "languages", "competition_types",
        explicit("project_types", projects).alias("project_types"), explicit("building_categories", buildings).alias("building_categories"),
        *(r(n).alias(n) for n in ("official_sectors", "built_asset_types", "design_scopes", "project_modes")),
        F.array(F.lit("professionals"), F.lit("multidisciplinary")).alias("audience"), r("cpv").alias("cpv_codes"), "implementation_path",
        architect.alias("licensed_architect_required"), partner.alias("local_partner_required"), fee.alias("registration_fee_eur"), fee.alias("submission_fee_eur"),
        "estimated_contract_value_eur", text.compact(value_text).alias("estimated_contract_value_text"), r("prize").alias("prize_summary"),
        F.coalesce(text.compact(r("location")), text.place_of(r("title"), r("authority"))).alias("location_label"), deadline.alias("deadline_at"), text.compact(r("eligibility")).alias("eligibility_summary"),
        r("brief_url").alias("brief_pdf_url"), r("documents_url").alias("documents_portal_url"), F.lit(CONFIDENCE).alias("extraction_confidence"), evidence.alias("evidence_level"),
        F.coalesce(r("evidence_note"), F.lit(parser.note)).alias("evidence_note"), score.alias("qualification_score"), "source_id",
        F.when(text.compact(r("title")).isNull(), F.when(semi.is_object(F.col("payload")) | F.lit(bool(parser.page)), "no title in the payload").otherwise("payload is no JSON object")).alias("error"),
    )


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, failures): one bad payload stops no other."""
    return parsed.filter("error IS NULL").drop("error"), parsed.filter("error IS NOT NULL").select("source_id", "source_url", "error")


#: Enrichment steps by name: functions from records to records.
VERIFIERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def verifier(name: str):
    def add(f):
        VERIFIERS[name] = f
        return f

    return add


# Words of paths that publish notices, words of titles that tell pages little, and the least score of a page.
PATH_WORDS = ["ausschreibung", "ausschreibungen", "wettbewerb", "projekte-und-ausschreibungen", "planung-ausfuehrung", "hochbauvorhaben"]
TITLE_STOPS = ["concours", "ouvert", "selection", "sous", "reserve", "obtention", "credit", "lotissement", "renovation", "partielle", "densification", "fuer", "pour", "selection", "maitre", "oeuvre", "offener", "projektwettbewerb", "generalplanende", "verfahren", "project", "competition", "competitione", "planung", "projets", "prozedura", "verfahren", "wohnen", "stadt", "zurich"]
PAGE_SCORE, PAGES_TRIED = 30, 5


def url_score(url: Column, tokens: Column) -> Column:
    """How well a page's address fits a title's words."""
    plain = text.plain_text(url)
    by_words = F.aggregate(tokens, F.lit(0), lambda s, t: s + F.when(plain.contains(t), F.length(t)).otherwise(0))
    low = F.lower(url)
    return by_words + F.when(low.endswith(".html"), 15).otherwise(0) + F.when(rules.any_of(low, PATH_WORDS), 10).otherwise(0) - F.when(low.contains("/content/dam/"), 20).otherwise(0)


def page_texts(html: Column) -> Column:
    """Struct (named, body): what a page's title and its text hold, as plain words."""
    named = text.plain_text(F.regexp_extract(html, "(?i)<title>([^<]+)</title>", 1))
    return F.struct(named.alias("named"), text.plain_text(text.strip_html(html)).alias("body"))


def sought(title: Column, authority: Column) -> Column:
    """Struct (tokens, buyer): the words by which a record's page is known."""
    return F.struct(text.keywords(title, TITLE_STOPS).alias("tokens"), text.keywords(F.coalesce(authority, F.lit("")), TITLE_STOPS).alias("buyer"))


def texts_score(url: Column, page: Column, words: Column) -> Column:
    """page_score() of page_texts() and the words sought()."""
    weigh = lambda ws, of: F.aggregate(ws, F.lit(0), lambda s, t: s + of(t))
    by_title = weigh(words["tokens"], lambda t: F.when(page["named"].contains(t), 4 * F.length(t)).when(page["body"].contains(t), 2 * F.length(t)).otherwise(0))
    by_buyer = weigh(words["buyer"], lambda t: F.when(page["body"].contains(t), F.length(t)).otherwise(0))
    return url_score(url, words["tokens"]) + by_title + by_buyer


def page_score(url: Column, html: Column, title: Column, authority: Column) -> Column:
    """How well a page fits a record: its address, the title's words in its title (four times) or else its text
    (twice), and the authority's words in its text; each word counts its letters."""
    return text.bind(F.struct(page_texts(html).alias("page"), sought(title, authority).alias("words")), lambda p: texts_score(url, p["page"], p["words"]))


@verifier("official_pages")
def official_pages(records: DataFrame, pages: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """Records with the best-fitting of their candidate pages (id, url, html).

    The five best addresses with a score are tried in order and the first page that fits is taken; pages as a
    browser rendered them are a second tier, for the records that the first left open. A page's canonical
    address stands for it."""
    from opalyx.operators.aggregates import by_tiers, first_passing

    authority = F.col("authority_name") if "authority_name" in records.columns else F.lit(None).cast("string")
    asked = records.select("id", sought(F.col("title"), authority).alias("words"))

    def choose(met: DataFrame) -> DataFrame:
        known = met.select("id", "url", "html").join(asked, "id").withColumn("s", url_score(F.col("url"), F.col("words")["tokens"])).filter("s > 0")
        # Only pages that are tried are read.
        best = first_passing(known, "id", [F.desc("s"), F.asc("url")], PAGES_TRIED, text.bind(page_texts(F.col("html")), lambda p: texts_score(F.col("url"), p, F.col("words")) >= PAGE_SCORE))
        canonical = text.or_null(F.trim(F.regexp_extract("html", '(?i)<link[^>]+rel="canonical"[^>]+href="([^"]+)"', 1)))
        return best.select("id", F.coalesce(canonical, F.col("url")).alias("_url"))

    best = by_tiers(asked, [pages] if rendered is None else [pages, rendered], "id", choose)
    out = records.join(best, "id", "left")
    note = F.when(F.col("_url").isNotNull(), text.append_note(F.col("evidence_note"), F.lit("Official page found by title."))).otherwise(F.col("evidence_note"))
    return out.withColumns({"official_url": F.coalesce("_url", "official_url"), "evidence_note": note}).drop("_url")
