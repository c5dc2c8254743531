from datetime import date

import pytest
from pyspark.sql import functions as F

from opalyx import queries
from opalyx.operators import review, store
from opalyx.plans import query as Q
from opalyx.plans import schema


def now():  # a Column needs a session
    return F.lit("2026-01-02").cast("timestamp")



def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_upsert_keeps_first_and_last_and_is_idempotent(spark):
    ddl = "id string, title string, status string, seq int"
    state = table(spark, [("a", "First", "new", 0)], ddl)
    batch = table(spark, [("a", "Second", "mid", 1), ("a", "Third", "late", 2), ("b", "B", "x", 1)], ddl)
    once = store.upsert(state, batch, "id", F.col("seq"), ("title",))
    assert sorted(map(tuple, once.collect())) == [("a", "First", "late", 2), ("b", "B", "x", 1)]
    assert sorted(map(tuple, store.upsert(once, batch, "id", F.col("seq"), ("title",)).collect())) == sorted(map(tuple, once.collect()))


@pytest.mark.parametrize("old,in_batch,status,active", [("pending", True, "pending", True), ("deferred", True, "deferred", True), ("accepted", True, "pending", True), ("rejected", True, "pending", True), ("accepted", False, "accepted", False), ("pending", False, "pending", False)])
def test_queue_sync(spark, old, in_batch, status, active):
    ddl = "queue_id string, origin string, status string, is_active boolean, first_detected_at string, updated_at string"
    state = table(spark, [("q", "worker_diagnostic", old, True, "t0", "t0")], ddl)
    batch = table(spark, [("q", "worker_diagnostic", "pending", "t1")] if in_batch else [], "queue_id string, origin string, status string, first_detected_at string")
    row = store.sync_queue(state, batch, F.lit("t2")).first()
    assert (row["status"], row["is_active"], row["first_detected_at"]) == (status, active, "t0")


def test_operator_items_stay_active(spark):
    state = table(spark, [("q", "operator", "pending", True, "t0", "t0")], "queue_id string, origin string, status string, is_active boolean, first_detected_at string, updated_at string")
    assert store.sync_queue(state, state.limit(0), F.lit("t")).first()["is_active"]


def test_health_keeps_last_success(spark):
    runs = table(spark, [(1, "s", "success", "t1"), (2, "s", "failed", "t2")], "id int, source_id string, status string, completed_at string")
    row = store.fold_health(runs, F.col("id")).first()
    assert (row["last_status"], row["last_success_at"]) == ("failed", "t1")


def test_expiry_and_sweep(spark):
    df = table(spark, [("a", date(2026, 1, 1)), ("b", date(2026, 1, 9)), ("c", None)], "id string, deadline_at date")
    assert [r["id"] for r in store.sweep(df, date(2026, 1, 10), 7).collect()] == ["a"]


def test_saved_search_is_idempotent(spark):
    saved = table(spark, [], "id long, workspace_key string, name string, filters_json string, created_at timestamp, updated_at timestamp")
    text = Q.Query(jurisdiction="france").to_json()
    once = store.save_search(saved, "w", " mine ", text, now())
    twice = store.save_search(once, "w", "mine", text, now())
    assert [(r["id"], r["name"]) for r in twice.collect()] == [(1, "mine")]
    with pytest.raises(ValueError):
        store.save_search(saved, "w", "x", "{}", now())


def test_decisions(spark):
    queue = table(spark, [("q", "pending", "t0")], "queue_id string, status string, updated_at string")
    decisions = table(spark, [(1, "q", "accepted", "t1"), (2, "q", "rejected", "t2"), (3, "z", "accepted", "t3"), (4, "q", "odd", "t4")], "id int, queue_id string, decision string, created_at string")
    assert tuple(store.decide(queue, decisions.filter("id < 3")).first()) == ("q", "rejected", "t2")
    assert sorted(r["id"] for r in store.undecidable(queue, decisions).collect()) == [3, 4]


def test_align_schema(spark):
    df = table(spark, [("x",)], "id string")
    from pyspark.sql import types as T

    target = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("n", T.LongType()), T.StructField("status", T.StringType(), False)])
    assert tuple(schema.align_schema(df, target).first()) == ("x", None, "discovered")
    with pytest.raises(schema.UnsafeDrift):
        schema.align_schema(df, T.StructType([T.StructField("must", T.StringType(), False)]))
    assert schema.read_or_empty(spark, "/tmp/none-such-table", schema.OPPORTUNITIES).isEmpty()


def test_query_round_trip_and_suppressed(spark):
    q = Q.Query.from_params({"search": "x", "min_value": "nan", "project_types": ["urban_planning", "bad"], "sort": "odd", "limit": "7"})
    assert (q.min_value, q.project_types, q.sort, q.limit) == (None, ["urban_planning"], "deadline", 7)
    assert Q.Query.from_json(q.to_json()).active() == q.active()
    assert Q.Query.from_json("[broken") == Q.Query(limit=500)
    from opalyx.plans.view import TODAY, opportunities

    v = opportunities(spark, "/root/testdata/sf0.001")
    assert Q.visible(v, Q.Query(procedure_type="AD3"), TODAY).isEmpty()
    empty = Q.facets(Q.visible(v, Q.Query(procedure_type="AD3", jurisdiction="x"), TODAY), Q.Query(jurisdiction="x")).first()
    assert empty["jurisdictions"] == [] and empty["total"] == 0


def test_pushed_filters(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumnRenamed("o_totalprice", "estimated_contract_value_eur").withColumnRenamed("o_orderstatus", "status").withColumn("deadline_at", F.col("o_orderdate").cast("date"))
    kept = df.filter(Q.predicate(Q.Query(min_value=5.0, include_expired=True), date(1998, 6, 1)))
    plan = spark._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(o_totalprice,5.0)" in plan


def test_conflict_signal(spark):
    got = spark.createDataFrame([("A  MISMATCH of dates",), ("fine",), (None,)], "n string").select(review.conflict_signal(F.col("n")).alias("c")).collect()
    assert [bool(r["c"]) for r in got] == [True, False, False]


def test_codes_of_every_row(spark, tmp_path):
    rows = [(7, "first 71200000-0 then 45000000, 71200000 again", 10), (1_000_000, "late 71240000-3", 20), (12_345_678_901, "no code 123456789", 30), (None, "no id 98341000", 40)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made = {r.doc_id: r.codes for r in queries.QUERIES["code_extract"](spark, str(tmp_path)).collect()}
    assert made == {7: "71200000 71240007", 1_000_000: "71200000 71241000", 12_345_678_901: "71200000 71241234", None: None}
    found = {r.doc_id: r.codes for r in queries.QUERIES["code_extract_text"](spark, str(tmp_path)).collect()}
    assert found == {7: "45000000 71200000", 1_000_000: "71240000", 12_345_678_901: "", None: "98341000"}


def test_announcements_are_discarded(spark):
    from opalyx.functions import text
    from opalyx.sources import connectors

    notice = "An Advance Notice: it is an early indication only and is NOT the commencement of a tender process, says the authority."
    rows = [("a", "National feed", "discovered", "New path along a river", notice), ("b", "National feed", "discovered", "Survey of pipes", "Firms are invited to offer the survey of a site."), ("c", "Other", "discovered", "x", notice), ("d", "National feed", "archived", "x", notice)]
    df = spark.createDataFrame(rows, "id string, organizer string, status string, title string, eligibility_summary string")
    announces = connectors.feed_judged(text.plain_text(F.concat_ws(" ", "title", "eligibility_summary")))["announces"]
    assert [tuple(r) for r in store.announcement_changes(df, announces, "National feed", [F.asc("id")], 10).collect()] == [("a", "discarded")]


def test_watched_ids_and_membership(spark):
    entries = spark.createDataFrame([("w", "a", 1), ("w", "b", 3), ("w", "c", 3), ("x", "a", 9)], "workspace_key string, opportunity_id string, updated_at int")
    assert [r[0] for r in store.watched_ids(entries, "w").collect()] == ["c", "b", "a"]
    asked = spark.createDataFrame([(" w ", "a"), ("x", "b"), (None, "a"), ("w", None)], "workspace_key string, opportunity_id string")
    assert {(r.workspace_key, r.opportunity_id): r.watched for r in store.with_watched(asked, entries).collect()} == {(" w ", "a"): True, ("x", "b"): False, (None, "a"): False, ("w", None): False}
