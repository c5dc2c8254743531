"""Stored filters cleaned in columns."""

import json

from pyspark.sql import functions as F

from opalyx.plans import saved

CASES = [
    ({"search": "  italy  ", "projectTypes": ["interior_project", "interior_project"], "buildingCategories": ["education", "education"], "designScopes": ["scheme", "scheme", "invalid_value"], "projectModes": ["renovation", "renovation", "invalid_value"], "sort": "latest", "limit": 999}, {"search": "italy", "projectTypes": ["interior_project"], "buildingCategories": ["education"], "designScopes": ["scheme"], "projectModes": ["renovation"], "sort": "latest"}),
    ({"jurisdiction": "germany", "sort": "deadline"}, {"jurisdiction": "germany", "sort": "deadline"}),
    ({"includeExpired": False, "licensedArchitectRequired": True, "sort": "x", "search": 5}, {"licensedArchitectRequired": True}),
    ({"minEstimatedValueEur": 0, "maxEstimatedValueEur": "9", "minQualificationScore": 0.25, "publishedWithinDays": 30.0}, {"minEstimatedValueEur": 0, "minQualificationScore": 0.25, "publishedWithinDays": 30}),
    ({"search": 'a "quoted"\n\\ text é', "projectTypes": "building_project", "designScopes": {"a": 1}}, {"search": 'a "quoted" \\ text é'}),
    ({}, {}),
    ([1], {}),
    ("text", {}),
]


def test_filters_of_a_table(spark):
    rows = [(k, json.dumps(raw)) for k, (raw, _) in enumerate(CASES)] + [(90, None), (91, ""), (92, "{broken")]
    df = spark.createDataFrame(rows, "k int, j string").select("k", saved.clean_filters(F.col("j")).alias("f"))
    got = {r.k: r.f for r in df.select("k", "f", saved.is_empty(F.col("f")).alias("e")).collect()}
    assert {k: json.loads(v) for k, v in got.items()} == {k: want for k, (_, want) in enumerate(CASES)} | {90: {}, 91: {}, 92: {}}
    order = [n for n, _ in saved.MEMBERS]
    assert all(list(json.loads(v)) == sorted(json.loads(v), key=order.index) for v in got.values())
