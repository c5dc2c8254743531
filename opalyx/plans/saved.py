"""Stored filters of a whole table, cleaned in columns: unknown members, wrong types and values that no list holds go."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opalyx.functions.text import bind, or_null
from opalyx.plans import labels as L

# Members of a stored filter in the order they are written, and the values that a sort may have.
MEMBERS = [
    ("buildingCategories", L.BUILDING_CATEGORIES),
    ("designScopes", L.DESIGN_SCOPES),
    ("deadlineAfter", "text"),
    ("deadlineBefore", "text"),
    ("implementationPath", "text"),
    ("includeExpired", "flag"),
    ("jurisdiction", "text"),
    ("licensedArchitectRequired", "flag"),
    ("maxEstimatedValueEur", "number"),
    ("minEstimatedValueEur", "number"),
    ("minQualificationScore", "number"),
    ("procedureType", "text"),
    ("projectTypes", L.PROJECT_TYPES),
    ("projectModes", L.PROJECT_MODES),
    ("publishedWithinDays", "number"),
    ("search", "text"),
    ("sort", "sort"),
]
SORTS = ["deadline", "latest", "highest_value"]


def _member(v: Column, name: str, kind: str | list[str]) -> Column:
    """`"name":value` of a member that holds something, else null."""
    path = f"$.{name}"
    type_ = F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))
    string = F.when(type_ == "STRING", or_null(F.trim(F.regexp_replace(F.try_variant_get(v, path, "string"), r"\s+", " "))))
    quoted = lambda array: F.regexp_replace(F.to_json(array), r"^\[|\]$", "")
    if kind == "text":
        value = F.when(string.isNotNull(), quoted(F.array(string)))
    elif kind == "sort":
        exact = F.when(type_ == "STRING", F.try_variant_get(v, path, "string"))
        value = F.when(exact.isin(SORTS), quoted(F.array(exact)))
    elif kind == "flag":
        value = F.when((type_ == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), "true")
    elif kind == "number":
        n = F.try_variant_get(v, path, "double")
        whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
        finite = type_.rlike("^(?:BIGINT|DOUBLE|DECIMAL|FLOAT|INT)") & (F.abs(n) < float("inf"))
        value = F.when(finite, F.when(whole, n.cast("long").cast("string")).otherwise(n.cast("string")))
    else:
        items = F.filter(F.try_variant_get(v, path, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
        kept = F.array_distinct(F.filter(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), lambda x: x.isin(kind)))
        value = bind(F.when(type_.startswith("ARRAY"), kept), lambda k: F.when(F.size(k) > 0, F.to_json(k)))
    return F.concat(F.lit(f'"{name}":'), value)


def clean_filters(payload: Column) -> Column:
    """The canonical JSON of a stored filter: equal filters give equal texts; what is no JSON object is {}."""
    v = F.try_parse_json(payload)
    members = bind(v, lambda x: F.array_compact(F.array(*(_member(x, name, kind) for name, kind in MEMBERS))))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))).otherwise("{}")


def is_empty(canonical: Column) -> Column:
    """A search that may not be saved."""
    return canonical == "{}"
