"""The typed query: validation, predicate, order, page, feed projection and facets."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalyx.functions import dates, money, semi, text
from opalyx.plans import classify
from opalyx.plans import labels as L

SORTS = ("deadline", "latest", "highest_value")
_ENUMS = {"project_types": L.PROJECT_TYPES, "building_categories": L.BUILDING_CATEGORIES, "design_scopes": L.DESIGN_SCOPES, "project_modes": L.PROJECT_MODES}
_NUMBERS = ("min_value", "max_value", "min_score", "published_within_days")


@dataclass(frozen=True)
class Query:
    search: str | None = None
    jurisdiction: str | None = None
    procedure_type: str | None = None
    implementation_path: str | None = None
    architect_required: bool | None = None
    min_score: float | None = None
    published_within_days: float | None = None
    include_expired: bool = False
    deadline_after: str | None = None
    deadline_before: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    project_types: list[str] = field(default_factory=list)
    building_categories: list[str] = field(default_factory=list)
    design_scopes: list[str] = field(default_factory=list)
    project_modes: list[str] = field(default_factory=list)
    sort: str = "deadline"
    limit: int = 24
    offset: int = 0

    @classmethod
    def from_params(cls, params: dict[str, str | list[str]]) -> Query:
        """From request parameters: unknown keys, wrong enum values and numbers that aren't finite are left out."""
        out: dict = {"limit": 500}
        for f in fields(cls):
            raw = params.get(f.name)
            if raw in (None, "", []):
                continue
            many = raw if isinstance(raw, list) else [raw]
            if f.name in ("project_types", "building_categories", "design_scopes", "project_modes"):
                allowed = _ENUMS.get(f.name)
                out[f.name] = [v for v in many if allowed is None or v in allowed]
            elif f.name in _NUMBERS or f.name in ("limit", "offset"):
                try:
                    number = float(many[0])
                except ValueError:
                    continue
                if number == number and abs(number) != float("inf"):
                    out[f.name] = int(number) if f.name in ("limit", "offset") else number
            elif f.name in ("architect_required", "include_expired"):
                if many[0] in ("true", "1", True):
                    out[f.name] = True
            elif f.name == "sort":
                if many[0] in SORTS:
                    out["sort"] = many[0]
            else:
                out[f.name] = str(many[0]).strip()
        return cls(**out)

    @classmethod
    def from_json(cls, payload: str) -> Query:
        """From a saved search; malformed text is the empty query."""
        try:
            data = json.loads(payload)
        except ValueError:
            data = None
        return cls.from_params(data if isinstance(data, dict) else {})

    def active(self) -> dict:
        """The filters that are set, without order and page."""
        return {k: v for k, v in asdict(self).items() if k not in ("sort", "limit", "offset") and v not in (None, [], False, "")}

    def to_json(self) -> str:
        """Equal filters give equal texts."""
        return json.dumps(self.active(), sort_keys=True, ensure_ascii=False)

    def to_params(self) -> dict[str, str | list[str]]:
        """Request parameters that from_params() reads as this query: what is at its default is left out."""
        shown: dict[str, str | list[str]] = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if value in (None, "", []) or (f.name == "sort" and value == "deadline") or (f.name == "offset" and value <= 0):
                continue
            if isinstance(value, bool):
                if value:
                    shown[f.name] = "true"
            elif isinstance(value, list):
                shown[f.name] = list(dict.fromkeys(value))
            else:
                shown[f.name] = f"{value:g}" if isinstance(value, float) else str(value)
        return shown

    def clamped(self, most: int) -> Query:
        return replace(self, limit=max(1, min(self.limit, most)), offset=max(0, self.offset))


def _at_least(c: Column, low: float) -> Column:
    """coalesce(c, 0) >= low; for a positive bound in the form that Parquet can use."""
    return c >= low if low > 0 else F.coalesce(c, F.lit(0.0)) >= low


def _at_most(c: Column, high: float) -> Column:
    return c.isNull() | (c <= high) if high >= 0 else c <= high


def predicate(q: Query, today: date, now: datetime | None = None) -> Column:
    """Conjunction of the query's filters. today and now are arguments: nothing here reads a clock."""
    terms: list[Column] = []
    needle = (q.search or "").strip().lower()
    if needle:
        terms.append(reduce(lambda a, b: a | b, (F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle) for c in ("title", "authority_name", "organizer", "official_notice_id"))))
    if q.jurisdiction:
        terms.append(F.col("jurisdiction") == q.jurisdiction)
    if q.procedure_type:
        spellings = classify.expand_procedure(q.procedure_type)
        terms.append(F.col("procedure_type").isin(spellings) if spellings else F.lit(False))
    if q.implementation_path:
        terms.append(F.col("implementation_path") == q.implementation_path)
    if q.architect_required is not None:
        terms.append(F.col("licensed_architect_required") == F.lit(q.architect_required))
    if q.min_score is not None:
        terms.append(_at_least(F.col("qualification_score"), q.min_score))
    if q.published_within_days is not None:
        since = (now or datetime.combine(today, datetime.min.time())) - timedelta(days=q.published_within_days)
        terms.append(F.col("discovered_at") >= F.lit(since).cast("timestamp_ntz"))
    hidden = ["discarded"] if q.include_expired else ["archived", "discarded"]
    terms.append(~F.col("status").isin(hidden))
    after, deadline = dates.iso_or_none(q.deadline_after), F.col("deadline_at")
    if after:
        terms.append(deadline >= F.lit(after if q.include_expired else max(after, today.isoformat())).cast("date"))
    elif not q.include_expired:
        terms.append(deadline.isNull() | (deadline >= F.lit(today)))
    if q.deadline_before:
        terms.append(deadline <= F.lit(q.deadline_before).try_cast("date"))
    if q.min_value is not None:
        terms.append(_at_least(F.col("estimated_contract_value_eur"), q.min_value))
    if q.max_value is not None:
        terms.append(_at_most(F.col("estimated_contract_value_eur"), q.max_value))
    for name in ("project_types", "building_categories", "design_scopes", "project_modes"):
        if wanted := getattr(q, name):
            terms.append(F.arrays_overlap(F.col(name), F.array(*map(F.lit, wanted))))
    return reduce(lambda a, b: a & b, terms)


def order(sort: str) -> list[Column]:
    """Order of a feed; the id makes it total."""
    score = F.coalesce("qualification_score", F.lit(0.0)).desc()
    return {
        "deadline": [F.col("deadline_at").asc_nulls_last(), score, F.desc("updated_at"), F.asc("id")],
        "latest": [F.desc("updated_at"), score, F.asc("id")],
        "highest_value": [F.coalesce("estimated_contract_value_eur", F.lit(0.0)).desc(), score, F.desc("updated_at"), F.asc("id")],
    }[sort]


def visible(df: DataFrame, q: Query, today: date, now: datetime | None = None) -> DataFrame:
    derived = any(getattr(q, n) for n in ("project_types", "building_categories"))
    return (classify.with_classes(df) if derived else df).filter(predicate(q, today, now))


def page(df: DataFrame, q: Query, today: date, now: datetime | None = None) -> DataFrame:
    """One page of a feed: a top-k, never a full sort."""
    out = visible(df, q, today, now).orderBy(*order(q.sort))
    return (out.offset(q.offset) if q.offset else out).limit(q.limit)


def by_id(df: DataFrame, slug: str) -> DataFrame:
    """The row with this id, as given or percent-decoded."""
    from urllib.parse import unquote

    return df.filter(F.col("id").cast("string").isin(list(dict.fromkeys([slug, unquote(slug)])))).limit(1)


def feed_item(df: DataFrame) -> DataFrame:
    """Display contract of a row: labels, keys and typed extras. Columns that a table lacks count as null."""
    kinds = {"registration_fee_eur": "double", "submission_fee_eur": "double", "local_partner_required": "boolean", "licensed_architect_required": "boolean", "estimated_contract_value_eur": "double", "competition_types": "array<string>", "cpv_codes": "array<string>"}
    c = lambda n: F.col(n) if n in df.columns else F.lit(None).cast(kinds.get(n, "string"))
    none = F.array().cast("array<string>")
    tags = F.slice(F.concat(F.transform(F.coalesce(c("competition_types"), none), text.title_case), F.coalesce(c("cpv_codes"), none)), 1, 4)
    needs = F.concat_ws(" · ", F.when(c("licensed_architect_required"), "Licensed architect required"), F.when(c("local_partner_required"), "Local partner likely"))
    path, evidence = text.label(c("implementation_path"), L.IMPLEMENTATION_LABELS, "Implementation path pending"), text.label(c("evidence_level"), L.EVIDENCE_LABELS, "Evidence level pending")
    return df.select(
        "id",
        F.col("id").alias("slug"),
        "title",
        F.concat_ws(" · ", F.coalesce(c("authority_name"), c("organizer"), F.lit("Unnamed authority")), classify.procedure_label(c("procedure_type"))).alias("subtitle"),
        F.coalesce(c("authority_name"), c("organizer"), F.lit("Unknown authority")).alias("authority"),
        text.title_case(c("jurisdiction")).alias("jurisdiction_label"),
        text.label(c("opportunity_type"), L.OPPORTUNITY_TYPE_LABELS, "Opportunity type pending").alias("opportunity_type_label"),
        classify.procedure_label(c("procedure_type")).alias("procedure_label"),
        classify.procedure_key(c("procedure_type")).alias("procedure_key"),
        path.alias("implementation_label"),
        text.label(c("status"), L.STATUS_LABELS, "Status pending").alias("status_label"),
        dates.closes_label(c("deadline_at")).alias("deadline_label"),
        money.fee_label(c("registration_fee_eur"), c("submission_fee_eur")).alias("fee_label"),
        money.value_label(c("estimated_contract_value_eur"), c("estimated_contract_value_text"), c("prize_summary")).alias("value_label"),
        F.coalesce(text.or_null(needs), c("eligibility_summary"), F.lit("Qualification pending")).alias("qualification_label"),
        F.when(c("evidence_level").isin("official_notice", "official_listing"), "Primary official source").otherwise("Secondary source").alias("source_tier_label"),
        evidence.alias("evidence_label"),
        F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("Procurement-backed"))).alias("tags"),
        F.concat(F.lit("Implementation path: "), path, F.lit(". Evidence level: "), evidence, F.lit(".")).alias("description"),
        c("licensed_architect_required").alias("architect_required"),
        dates.stamp_label(c("discovered_at"), "Captured").alias("discovered_label"),
        dates.stamp_label(c("updated_at"), "Updated").alias("updated_label"),
    )


#: Columns that the page for professionals doesn't get.
INTERNAL = "audience building_categories brief_pdf_url competition_types cpv_codes deadline_at discovered_at discovered_label documents_portal_url estimated_contract_value_eur estimated_contract_value_text evidence_level extraction_confidence geo_confidence geo_lat geo_lng geo_source implementation_path jurisdiction languages licensed_architect_required architect_required location_label local_partner_required official_notice_id official_sectors built_asset_types design_scopes project_modes opportunity_type organizer prize_summary project_types procedure_type procedure_key qualification_score regions registration_fee_eur source_url status submission_fee_eur updated_at updated_label".split()
LISTED = ("id", "title", "organizer", "authority_name", "status", "opportunity_type", "deadline_at", "qualification_score", "official_url")


def professional(items: DataFrame) -> DataFrame:
    """Items of the feed as the page for professionals shows them: labels, no raw values."""
    return items.drop(*INTERNAL)


def narrow_list(df: DataFrame, limit: int = 20) -> DataFrame:
    """The operators' list: nine columns, by deadline, undated last, then the latest update."""
    return df.orderBy(F.col("deadline_at").asc_nulls_last(), F.desc("updated_at"), F.asc("id")).limit(limit).select(*(c for c in LISTED if c in df.columns))


FACETS = ("jurisdictions", "procedure_types", "implementation_paths")


def facets(df: DataFrame, q: Query) -> DataFrame:
    """One row of facet values of a slice (after all its filters) with the selected ones added, and the slice's total.

    Each facet's distinct values are gathered in one aggregation; their number is bounded by the vocabularies."""
    rows = df.withColumns({"_j": text.compact(F.col("jurisdiction")), "_p": classify.procedure_key(F.col("procedure_type")), "_i": text.compact(F.col("implementation_path"))})
    pick = lambda values, chosen: F.array_sort(F.array_distinct(F.concat(values, F.array(*map(F.lit, chosen)).cast("array<string>"))))
    many = lambda name: F.array_distinct(F.flatten(F.collect_set(name))) if name in df.columns else F.array().cast("array<string>")
    procedure = [k for k in [_presented(q.procedure_type)] if k]
    out = rows.agg(F.collect_set("_j").alias("_js"), F.collect_set("_p").alias("_ps"), F.collect_set("_i").alias("_is"), many("project_types").alias("_t"), many("building_categories").alias("_b"), many("design_scopes").alias("_d"), many("project_modes").alias("_m"), F.count("*").alias("total"))
    empty = F.col("total") == 0
    nothing = F.array().cast("array<string>")
    return out.select(
        F.when(empty, nothing).otherwise(pick(F.col("_js"), [q.jurisdiction] if q.jurisdiction else [])).alias("jurisdictions"),
        F.when(empty, nothing).otherwise(pick(F.col("_ps"), procedure)).alias("procedure_types"),
        F.when(empty, nothing).otherwise(pick(F.col("_is"), [q.implementation_path] if q.implementation_path else [])).alias("implementation_paths"),
        F.when(empty, nothing).otherwise(semi.in_order(F.concat("_t", F.array(*map(F.lit, q.project_types)).cast("array<string>")), L.PROJECT_TYPES)).alias("project_types"),
        F.when(empty, nothing).otherwise(semi.in_order(F.concat("_b", F.array(*map(F.lit, q.building_categories)).cast("array<string>")), L.BUILDING_CATEGORIES)).alias("building_categories"),
        F.when(empty, nothing).otherwise(semi.in_order(F.concat("_d", F.array(*map(F.lit, q.design_scopes)).cast("array<string>")), L.DESIGN_SCOPES)).alias("design_scopes"),
        F.when(empty, nothing).otherwise(semi.in_order(F.concat("_m", F.array(*map(F.lit, q.project_modes)).cast("array<string>")), L.PROJECT_MODES)).alias("project_modes"),
        "total",
    )


def _presented(value: str | None) -> str | None:
    if not value:
        return None
    key = classify.driver_lookup_key(value)
    return None if key in classify.SUPPRESSED else classify.PROCEDURES.get(key, value)
