"""Derived attributes of opportunities: normalised types, multi-label classes, score, tri-state flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalyx.functions import rules, semi, text
from opalyx.plans import labels as L


def _aliases(groups: dict[str, list[str]], lookup_key) -> dict[str, str]:
    return {lookup_key(a): k for k, names in groups.items() for a in names}


def driver_lookup_key(value: str | None) -> str | None:
    """text.lookup_key for a value on the driver."""
    import re
    import unicodedata

    folded = "".join(c for c in unicodedata.normalize("NFD", value or "") if c.isascii()).lower()
    return re.sub("[^a-z0-9]+", "_", folded).strip("_") or None


PROCEDURES = _aliases(L.PROCEDURE_ALIASES, driver_lookup_key)
SUPPRESSED = {driver_lookup_key(a) for a in L.SUPPRESSED_PROCEDURES}
OPPORTUNITY_TYPES = _aliases(L.OPPORTUNITY_TYPE_ALIASES, driver_lookup_key)


def expand_procedure(value: str) -> list[str]:
    """All spellings that a procedure filter stands for; none for a suppressed one."""
    key = driver_lookup_key(value)
    if key is None or (key not in SUPPRESSED and key not in PROCEDURES):
        return [value]
    return [] if key in SUPPRESSED else list(L.PROCEDURE_ALIASES[PROCEDURES[key]])


def procedure_key(raw: Column) -> Column:
    """Canonical key of a procedure text: null where it looks like markup or is suppressed, itself where unknown."""
    both = F.struct(text.compact(raw).alias("clean"), text.lookup_key(raw).alias("key"))

    def named(x: Column) -> Column:
        refused = x["clean"].isNull() | x["clean"].rlike(r'[<>{}\[\]"]') | F.coalesce(x["key"].isin(*SUPPRESSED), F.lit(False))
        return F.when(refused, None).otherwise(F.coalesce(text.lookup(x["key"], PROCEDURES), x["clean"]))

    return text.bind(both, named)


def procedure_label(raw: Column) -> Column:
    key = procedure_key(raw)
    return F.coalesce(text.label(key, L.PROCEDURE_LABELS, "Procedure pending"), F.lit("Procedure pending"))


def opportunity_type(raw: Column) -> Column:
    key = text.lookup_key(raw)
    return F.coalesce(
        text.lookup(key, OPPORTUNITY_TYPES),
        F.when(rules.any_of(key, ["contest", "competition"]), "public_design_contest").when(key.contains("framework"), "framework_design_services").when(rules.any_of(key, ["service", "procurement", "tender", "proposal"]), "public_design_services_procurement"),
    )


def procedure_type(raw: Column) -> Column:
    key = text.lookup_key(raw)
    guessed = F.when(key.contains("framework"), "framework_agreement").when(rules.any_of(key, ["contest", "competition"]), "design_contest").when(rules.any_of(key, ["proposal", "tender", "procurement"]), "public_design_services_tender")
    return F.when(key.isin(*SUPPRESSED), None).otherwise(F.coalesce(text.lookup(key, PROCEDURES), guessed))


def implementation_path(raw: Column, kind: Column) -> Column:
    key = text.lookup_key(raw)
    framework = F.when(kind == "framework_design_services", "framework_selection_for_repeated_design_commissions")
    return F.when(key == "unknown", None).when(key.isin(*L.IMPLEMENTATION_LABELS), key).otherwise(framework)


def evidence_level(raw: Column, tier: Column) -> Column:
    key = text.lookup_key(raw)
    return F.when(key.isin(*L.EVIDENCE_LABELS), key).when(tier == "primary", "official_notice").otherwise("secondary")


def competition_types(haystack: Column) -> Column:
    found = rules.label_set(F.lower(haystack), L.COMPETITION_WORDS)
    return F.when(F.size(found) == 0, F.array(F.lit("architecture"))).otherwise(found)


#: Words of categories and of project types, found in one scan each.
CATEGORY_MARKERS = rules.Markers(*L.CATEGORY_WORDS.values())
PROJECT_MARKERS = rules.Markers(*L.PROJECT_WORDS.values())


def building_categories(words: Column, types: Column, explicit: Column) -> Column:
    """Explicit categories in the fixed order, else those whose words or competition types occur. words: hits of CATEGORY_MARKERS."""
    given = semi.in_order(explicit, L.BUILDING_CATEGORIES)
    found = F.array_compact(F.array(*(F.when(rules.any_hit(words, L.CATEGORY_WORDS[c]) | (F.array_contains(types, L.CATEGORY_TYPES[c]) if c in L.CATEGORY_TYPES else F.lit(False)), F.lit(c)) for c in L.BUILDING_CATEGORIES)))
    return F.when(F.size(given) > 0, given).otherwise(found)


def project_types(words: Column, types: Column, categories: Column, procedure: Column, explicit: Column) -> Column:
    """Explicit types in the fixed order, else the first class that fits. words: hits of PROJECT_MARKERS."""
    given = semi.in_order(explicit, L.PROJECT_TYPES)

    def fits(kind: str) -> Column:
        by_type = F.arrays_overlap(types, F.array(*map(F.lit, L.PROJECT_TYPES_BY_COMPETITION[kind])))
        return (rules.any_hit(words, L.PROJECT_WORDS[kind]) if kind in L.PROJECT_WORDS else F.lit(False)) | F.coalesce(by_type, F.lit(False))

    planning = fits("urban_planning") | text.match_text(procedure).contains("planning_competition")
    first = rules.first_class([
        ("urban_regeneration", fits("urban_regeneration")),
        ("environment_design", fits("environment_design")),
        ("urban_planning", planning),
        ("interior_project", fits("interior_project")),
        ("building_project", fits("building_project") | (F.size(categories) > 0)),
    ])
    return F.when(F.size(given) > 0, given).otherwise(F.array_compact(F.array(first)))


def with_classes(df: DataFrame) -> DataFrame:
    """df with building_categories and project_types derived once, so that filters on them are ordinary predicates."""
    none = F.array().cast("array<string>")
    get = lambda c: F.coalesce(F.col(c), none) if c in df.columns else none
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    types = F.transform(get("competition_types"), text.fold)
    place = text.match_text(F.concat_ws(" ", col("title"), col("eligibility_summary"), col("authority_name"), col("organizer")))
    work = text.match_text(F.concat_ws(" ", col("title"), col("eligibility_summary"), col("procedure_type"), col("implementation_path")))
    found = F.struct(CATEGORY_MARKERS.hits(place).alias("place"), PROJECT_MARKERS.hits(work).alias("work"), types.alias("types"))
    given_categories, given_types = get("building_categories"), get("project_types")

    def classes(f: Column) -> Column:
        named = building_categories(f["place"], f["types"], given_categories)
        return text.bind(named, lambda b: F.struct(b.alias("categories"), project_types(f["work"], f["types"], b, col("procedure_type"), given_types).alias("projects")))

    at = "_classes"
    while at in df.columns:
        at = "_" + at
    return df.withColumn(at, text.bind(found, classes)).withColumns({"building_categories": F.col(f"{at}.categories"), "project_types": F.col(f"{at}.projects")}).drop(at)


def qualification_score(*, evidence: Column, notice_id: Column, path: Column, architect: Column, partner: Column, value: Column, value_text: Column, registration: Column, submission: Column, authority: Column) -> Column:
    """Additive score with fixed weights, in this order, at most 1."""
    given = lambda c: F.coalesce(c != "", F.lit(False))
    free = (F.coalesce(registration, F.lit(0.0)) == 0) & (F.coalesce(submission, F.lit(0.0)) == 0)
    terms = [(evidence.isin("official_notice", "official_listing"), 0.2), (given(notice_id), 0.15), (given(path), 0.15), (F.coalesce(architect, F.lit(False)), 0.15), (F.coalesce(partner, F.lit(False)), 0.05), (value.isNotNull() | given(value_text), 0.1), (free, 0.1), (given(authority), 0.1)]
    score = F.lit(0.15)
    for condition, weight in terms:
        score = score + F.when(condition, weight).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def architect_required(haystack: Column) -> Column:
    return rules.any_true_or_unknown(F.lower(haystack), L.ARCHITECT_WORDS)


def partner_required(haystack: Column) -> Column:
    return rules.any_true_or_unknown(F.lower(haystack), L.PARTNER_WORDS)
