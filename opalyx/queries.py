"""Registered queries: each operator over whole tables, with the DuckDB statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opalyx.functions import dates, geo, money, rules, semi, text
from opalyx.operators import aggregates as agg
from opalyx.operators import review, store
from opalyx.plans import classify
from opalyx.plans import labels as L
from opalyx.plans import query as Q
from opalyx.plans.view import OPPORTUNITIES_SQL, RUNS_SQL, TODAY, opportunities, runs, table
from opalyx.runtime import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
V, R = f"WITH {OPPORTUNITIES_SQL}", f"WITH {RUNS_SQL}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(name: str):
    return lambda spark, sf: table(spark, sf, name)


# --- the read algebra over opportunities -------------------------------------------------------
_VISIBLE = "status NOT IN ('archived', 'discarded') AND (deadline_at IS NULL OR deadline_at >= DATE '1998-06-01')"
_FEED = ["id", "title", "jurisdiction", "deadline_at", "estimated_contract_value_eur", "qualification_score", "updated_at"]
_ORDERS = {
    "deadline": "deadline_at ASC NULLS LAST, coalesce(qualification_score, 0) DESC, updated_at DESC, id",
    "latest": "updated_at DESC, coalesce(qualification_score, 0) DESC, id",
    "highest_value": "coalesce(estimated_contract_value_eur, 0) DESC, coalesce(qualification_score, 0) DESC, updated_at DESC, id",
}


def _feed(name: str, q: Q.Query, where: str | None) -> None:
    tail = f"LIMIT {q.limit} OFFSET {q.offset}"
    sql = f"{V} SELECT {', '.join(_FEED)} FROM v WHERE {where or _VISIBLE} ORDER BY {_ORDERS[q.sort]} {tail}"
    query(name, sql)(lambda spark, sf: Q.page(opportunities(spark, sf), q, TODAY).select(*_FEED))


def _slice(name: str, q: Q.Query, where: str) -> None:
    query(name, f"{V} SELECT {', '.join(_FEED)} FROM v WHERE {where}")(lambda spark, sf: Q.visible(opportunities(spark, sf), q, TODAY).select(*_FEED))


_feed("feed_deadline", Q.Query(), None)
_feed("feed_latest", Q.Query(sort="latest"), None)
_feed("feed_highest_value", Q.Query(sort="highest_value"), None)
_feed("feed_offset_page", Q.Query(offset=24), None)
_slice("filter_search", Q.Query(search=" Build "), f"(contains(lower(title), 'build') OR contains(lower(coalesce(authority_name, '')), 'build') OR contains(lower(organizer), 'build') OR contains(lower(coalesce(official_notice_id, '')), 'build')) AND {_VISIBLE}")
_slice("filter_equality", Q.Query(jurisdiction="NATION_3", implementation_path="service_contract_award_after_competitive_selection"), f"jurisdiction = 'NATION_3' AND implementation_path = 'service_contract_award_after_competitive_selection' AND {_VISIBLE}")
_slice("filter_bool_tristate", Q.Query(architect_required=False), f"licensed_architect_required = FALSE AND {_VISIBLE}")
_slice("filter_value_range_nulls", Q.Query(min_value=0, max_value=50000), f"coalesce(estimated_contract_value_eur, 0) >= 0 AND coalesce(estimated_contract_value_eur, 0) <= 50000 AND {_VISIBLE}")
_slice("filter_min_score", Q.Query(min_score=0.7), f"coalesce(qualification_score, 0) >= 0.7 AND {_VISIBLE}")
_slice("filter_recency", Q.Query(published_within_days=120, include_expired=True), "discovered_at >= TIMESTAMP '1998-02-01' AND status <> 'discarded'")
_slice("filter_deadline_window", Q.Query(deadline_after="1998-05-01", deadline_before="1998-07-15"), "status NOT IN ('archived', 'discarded') AND deadline_at >= DATE '1998-06-01' AND deadline_at <= DATE '1998-07-15'")
_slice("filter_include_expired", Q.Query(include_expired=True, deadline_after="1997-01-01"), "status <> 'discarded' AND deadline_at >= DATE '1997-01-01'")


@query("filter_alias_expand", f"{V} SELECT id, p FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'Offenes Verfahren' WHEN id % 3 = 1 THEN 'open_procedure' ELSE 'selective' END AS p FROM v WHERE {_VISIBLE}) WHERE p IN ('Offenes Verfahren', 'open_procedure')")
def filter_alias_expand(spark, sf):
    k = F.col("id") % 3
    named = opportunities(spark, sf).withColumn("procedure_type", F.when(k == 0, "Offenes Verfahren").when(k == 1, "open_procedure").otherwise("selective"))
    return Q.visible(named, Q.Query(procedure_type="open"), TODAY).select("id", F.col("procedure_type").alias("p"))


@query("point_lookup", f"{V} SELECT {', '.join(_FEED)} FROM v WHERE id = 33")
def point_lookup(spark, sf):
    return Q.by_id(opportunities(spark, sf), "%33%33").unionByName(Q.by_id(opportunities(spark, sf), "33")).select(*_FEED).distinct()


@query("feed_items", f"""{V} SELECT id, coalesce(authority_name, organizer) || ' · ' || procedure_type AS subtitle, jurisdiction AS jurisdiction_label,
  CASE status WHEN 'discovered' THEN 'Discovered' WHEN 'shortlisted' THEN 'Shortlisted' WHEN 'verified' THEN 'Verified' END AS status_label,
  CASE WHEN deadline_at IS NULL THEN 'Deadline pending' ELSE 'Closes ' || strftime(deadline_at, '%d %b %Y') END AS deadline_label,
  CASE WHEN estimated_contract_value_eur IS NULL THEN 'Commercial value pending' ELSE printf('Estimated service value EUR %.2fM', estimated_contract_value_eur / 1000000) END AS value_label,
  CASE WHEN licensed_architect_required THEN 'Licensed architect required' ELSE 'Qualification pending' END AS qualification_label,
  CASE WHEN evidence_level IN ('official_notice', 'official_listing') THEN 'Primary official source' ELSE 'Secondary source' END AS source_tier_label,
  'Updated ' || strftime(updated_at, '%d %b %Y') AS updated_label FROM (SELECT * REPLACE (array_to_string(list_transform(list_filter(string_split_regex(procedure_type, '[_\\s-]+'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), ' ') AS procedure_type, replace(jurisdiction, '_', ' ') AS jurisdiction) FROM v) WHERE {_VISIBLE}""")
def feed_items(spark, sf):
    return Q.feed_item(Q.visible(opportunities(spark, sf), Q.Query(), TODAY)).select("id", "subtitle", "jurisdiction_label", "status_label", "deadline_label", "value_label", "qualification_label", "source_tier_label", "updated_label")


@query("facet_options", f"""{V} SELECT array_to_string(list_sort(list(DISTINCT jurisdiction)), '|') AS jurisdictions, array_to_string(list_sort(list(DISTINCT procedure_type)), '|') AS procedure_types,
  array_to_string(list_sort(list_filter(list(DISTINCT implementation_path), lambda x: x IS NOT NULL)), '|') AS implementation_paths, count(*) AS total FROM v WHERE {_VISIBLE}""")
def facet_options(spark, sf):
    out = Q.facets(Q.visible(opportunities(spark, sf), Q.Query(), TODAY), Q.Query())
    return out.select(*(F.array_join(c, "|").alias(c) for c in Q.FACETS), "total")


@query("slice_total", f"{V} SELECT id, count(*) OVER () AS total FROM v WHERE {_VISIBLE} ORDER BY deadline_at ASC NULLS LAST, id LIMIT 24")
def slice_total(spark, sf):
    rows = Q.visible(opportunities(spark, sf), Q.Query(), TODAY)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.asc_nulls_last("deadline_at"), "id").limit(24).crossJoin(F.broadcast(total)).select("id", "total")


_WORDS = ["gear", "bolt", "ring"]


def _parts(spark, sf):
    p = table(spark, sf, "part")
    low = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return p.select("p_partkey", low.alias("w"), "p_brand")


@query("filter_derived_overlap", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 'gear') OR contains(lower(p_name || ' ' || p_type), 'bolt')")
def filter_derived_overlap(spark, sf):
    labels = rules.label_set(F.col("w"), {k: [k] for k in _WORDS})
    return _parts(spark, sf).withColumn("labels", labels).filter(F.arrays_overlap("labels", F.array(F.lit("gear"), F.lit("bolt")))).select("p_partkey")


# --- aggregates ----------------------------------------------------------------------------------
@query("ops_snapshot", f"{V} SELECT count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (evidence_level IN ('official_notice', 'official_listing')) AS primary_evidence FROM v")
def ops_snapshot(spark, sf):
    return agg.snapshot(opportunities(spark, sf))


@query("radar_first_page", f"{V} SELECT count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (evidence_level IN ('official_notice', 'official_listing')) AS primary_evidence FROM (SELECT * FROM v WHERE {_VISIBLE} ORDER BY {_ORDERS['deadline']} LIMIT 24)")
def radar_first_page(spark, sf):
    return agg.snapshot(Q.page(opportunities(spark, sf), Q.Query(), TODAY))


@query("queue_summary", f"{R} SELECT count(*) AS total, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (parse_failure_count > 0) AS with_failures FROM runs")
def queue_summary(spark, sf):
    s = F.col("status")
    return agg.count_where(runs(spark, sf), failed=s == "failed", empty=s == "empty", with_failures=F.col("parse_failure_count") > 0)


@query("reason_breakdown", f"{R} SELECT status, count(*) AS n FROM runs GROUP BY status")
def reason_breakdown(spark, sf):
    return agg.breakdown(runs(spark, sf), "status")


@query("duplicate_groups", "SELECT text, count(*) AS duplicate_count FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return agg.duplicate_groups(table(spark, sf, "documents"), "text")


@query("duplicate_pressure_summary", "SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS records_in_groups, coalesce(max(n), 0) AS max_group_size FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_pressure_summary(spark, sf):
    return agg.duplicate_pressure(table(spark, sf, "documents"), "text")


@query("batch_duplicate_pressure", """WITH b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), s AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 2 GROUP BY 1)
  SELECT count(*) AS duplicate_groups, coalesce(max(greatest(b.n, coalesce(s.n, 0))), 0) AS max_group_size FROM b LEFT JOIN s ON b.k = s.k WHERE greatest(b.n, coalesce(s.n, 0)) > 1""")
def batch_duplicate_pressure(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_linenumber")
    return agg.batch_pressure(li.filter("l_linenumber = 1"), li.filter("l_linenumber = 2"), "l_partkey")


@query("duplicate_clusters", f"""{V}, r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY updated_at DESC, id) AS n, count(*) OVER (PARTITION BY dedup_key) AS c FROM v)
  SELECT dedup_key, max(c) AS duplicate_count, min(id) FILTER (n = 1) AS primary_id, min(title) FILTER (n = 1) AS primary_title, array_to_string(list(title ORDER BY n) FILTER (n <= 3), '|') AS sample_titles, max(updated_at) AS last_detected_at FROM r WHERE c > 1 GROUP BY dedup_key""")
def duplicate_clusters(spark, sf):
    out = agg.duplicate_clusters(opportunities(spark, sf), "dedup_key", [F.desc("updated_at"), F.asc("id")])
    return out.withColumn("sample_titles", F.array_join("sample_titles", "|"))


@query("pack_coverage", "SELECT n_name AS pack, count(s_suppkey) AS sources, CASE WHEN count(*) FILTER (s_acctbal > 0) > 0 THEN 'enabled' WHEN count(s_suppkey) > 0 THEN 'scaffold_only' ELSE 'empty' END AS coverage FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
def pack_coverage(spark, sf):
    s = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return agg.pack_coverage(s.select(F.col("n_name").alias("pack"), F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") > 0).alias("enabled")))


@query("best_score_per_key", "SELECT l_partkey, max(l_quantity) AS score FROM lineitem GROUP BY l_partkey")
def best_score_per_key(spark, sf):
    return agg.best_score(table(spark, sf, "lineitem").withColumnRenamed("l_quantity", "score"), "l_partkey", "score")


@query("multi_valued_map", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS kinds FROM events GROUP BY user_id")
def multi_valued_map(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("kinds"))


# --- joins, windows, sets ------------------------------------------------------------------------
@query("latest_decision", "SELECT conv_id AS queue_id, max(turn) AS id, arg_max(role, turn) AS decision FROM conversations GROUP BY conv_id")
def latest_decision(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("queue_id"), F.col("turn").alias("id"), F.col("role").alias("decision"), F.lit(None).cast("string").alias("actor_label"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("timestamp").alias("created_at"))
    return review.with_latest_decision(c.select("queue_id").distinct(), c).select("queue_id", "latest_decision.id", "latest_decision.decision")


@query("anti_missing", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08)")
def anti_missing(spark, sf):
    orders, dear = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").filter("l_discount > 0.08")
    return store.missing(orders, dear.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("semi_duplicates", "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def semi_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.xxhash64("text").alias("a"), F.md5("text").alias("b"))
    return d.join(d.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b"), ["a", "b"], "left_semi").select("doc_id")


@query("inner_lookup", f"{V} SELECT v.id, v.title, l_linenumber FROM lineitem JOIN v ON v.id = l_orderkey WHERE l_quantity >= 45")
def inner_lookup(spark, sf):
    watch = table(spark, sf, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return watch.join(opportunities(spark, sf).select("id", "title"), "id").select("id", "title", "l_linenumber")


@query("substring_allowlist", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '0001') OR contains(lower(c_name), '0042')")
def substring_allowlist(spark, sf):
    from opalyx.sources.connectors import buyer_allowed

    return table(spark, sf, "customer").filter(buyer_allowed(F.col("c_name"), ["0001", "0042"])).select("c_custkey")


@query("term_page_worklist", "SELECT n_name AS term, CAST(page AS INTEGER) AS page FROM nation, range(1, 4) t(page)")
def term_page_worklist(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("term"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))


@query("dedupe_row_number", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def dedupe_row_number(spark, sf):
    return agg.keep_first(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("topk_score_per_group", "SELECT l_partkey, l_orderkey, l_linenumber, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n <= 3")
def topk_score_per_group(spark, sf):
    return agg.top_in_group(table(spark, sf, "lineitem"), "l_partkey", [F.desc("l_extendedprice"), *map(F.asc, ("l_orderkey", "l_linenumber", "l_suppkey"))], 3).select("l_partkey", "l_orderkey", "l_linenumber", "rank")


@query("first_passing_candidate", "SELECT l_orderkey, arg_min(l_linenumber, n) AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_discount) AS n FROM lineitem) WHERE n <= 5 AND l_discount >= 0.05 GROUP BY l_orderkey")
def first_passing_candidate(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_partkey", "l_suppkey")
    return agg.first_passing(li, "l_orderkey", [F.desc("l_quantity"), *map(F.asc, ("l_linenumber", "l_partkey", "l_suppkey", "l_discount"))], 5, F.col("l_discount") >= 0.05).select("l_orderkey", "l_linenumber")


@query("backlog_case_sort", f"{V} SELECT id FROM v ORDER BY CASE WHEN deadline_at >= DATE '1998-06-01' THEN 0 WHEN deadline_at IS NULL THEN 1 ELSE 2 END, deadline_at ASC NULLS LAST, updated_at DESC, id LIMIT 500")
def backlog_case_sort(spark, sf):
    return opportunities(spark, sf).orderBy(*review.backlog_order(F.lit(TODAY))).select("id").limit(500)


_HEALTH = f"""{R}, h AS (SELECT source_id, arg_max(source_name, id) AS source_name, arg_max(status, id) AS last_status, arg_max(completed_at, id) AS last_run_completed_at,
  arg_max(completed_at, id) FILTER (status <> 'failed') AS last_success_at, arg_max(document_count, id) AS last_document_count, arg_max(parse_failure_count, id) AS last_parse_failure_count, arg_max(duplicate_group_count, id) AS duplicate_group_count FROM runs GROUP BY source_id)"""
_HEALTH_COLUMNS = ["source_id", "last_status", "last_run_completed_at", "last_success_at", "last_document_count", "last_parse_failure_count", "duplicate_group_count"]


@query("source_health_state", f"{_HEALTH} SELECT {', '.join(_HEALTH_COLUMNS)} FROM h")
def source_health_state(spark, sf):
    return store.fold_health(runs(spark, sf), F.col("id")).select(*_HEALTH_COLUMNS)


@query("health_severity_sort", f"{_HEALTH} SELECT source_id, last_status FROM h ORDER BY CASE WHEN last_status = 'failed' THEN 0 WHEN last_parse_failure_count > 0 THEN 1 WHEN duplicate_group_count > 0 THEN 2 ELSE 3 END, coalesce(last_run_completed_at, last_success_at) NULLS FIRST, source_name LIMIT 20")
def health_severity_sort(spark, sf):
    return store.fold_health(runs(spark, sf), F.col("id")).orderBy(*review.health_order()).select("source_id", "last_status").limit(20)


@query("run_status", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'empty' WHEN event_id % 3 > 0 AND event_id % 4 > 0 THEN 'completed_with_failures' WHEN event_id % 3 > 0 THEN 'failed' ELSE 'success' END AS status FROM events")
def run_status(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", rules.run_status(k % 5, k % 4, k % 3).alias("status"))


@query("queue_sort", f"{V} SELECT id FROM v WHERE extraction_confidence < 0.8 AND status <> 'verified' ORDER BY CASE status WHEN 'discovered' THEN 0 WHEN 'shortlisted' THEN 1 ELSE 2 END, extraction_confidence, updated_at DESC, id LIMIT 100")
def queue_sort(spark, sf):
    q = opportunities(spark, sf).filter("extraction_confidence < 0.8 AND status <> 'verified'")
    q = q.withColumns({"priority": -F.col("extraction_confidence"), "last_detected_at": F.col("updated_at"), "queue_id": F.col("id")})
    return q.orderBy(*review.queue_order({"discovered": 0, "shortlisted": 1})).select("id").limit(100)


@query("candidate_union", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region UNION ALL SELECT c_mktsegment, 'segment' FROM customer")
def candidate_union(spark, sf):
    parts = [("nation", "n_name", "nation"), ("region", "r_name", "region"), ("customer", "c_mktsegment", "segment")]
    return reduce(DataFrame.unionByName, [table(spark, sf, t).select(F.col(c).alias("name"), F.lit(k).alias("kind")) for t, c, k in parts])


@query("taxonomy_difference", "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#22', 'Brand#33')")
def taxonomy_difference(spark, sf):
    known = spark.createDataFrame([("Brand#11",), ("Brand#22",), ("Brand#33",)], "p_brand string")
    return table(spark, sf, "part").select("p_brand").distinct().join(F.broadcast(known), "p_brand", "left_anti")


# --- review candidates ----------------------------------------------------------------------------
@query("review_candidates", f"""{V} SELECT 'low-confidence-record:' || id AS queue_id, 'low_confidence_record' AS reason_code, greatest(45, CAST(trunc((1 - extraction_confidence) * 100) AS INTEGER)) AS priority FROM v WHERE extraction_confidence < 0.8 AND status <> 'verified'
  UNION ALL SELECT 'evidence-conflict:' || id, 'evidence_conflict', 92 FROM v WHERE contains(lower(evidence_note), 'conflict')
  UNION ALL SELECT 'duplicate-cluster:' || dedup_key, 'duplicate_cluster', CAST(85 + least(count(*), 10) AS INTEGER) FROM v GROUP BY dedup_key HAVING count(*) > 1""")
def review_candidates(spark, sf):
    v = opportunities(spark, sf)
    parts = [review.from_conflicts(v), review.from_duplicates(v), review.from_low_confidence(v)]
    return reduce(DataFrame.unionByName, parts).select("queue_id", "reason_code", "priority")


@query("health_candidates", f"""{_HEALTH}, e AS (SELECT source_id, arg_max(last_error, id) AS last_error FROM runs GROUP BY source_id)
  SELECT 'source-run-failed:' || source_id AS queue_id, 100 AS priority FROM h WHERE last_status = 'failed' UNION ALL SELECT 'source-parse-failures:' || source_id, 90 FROM h WHERE last_parse_failure_count > 0""")
def health_candidates(spark, sf):
    return review.from_health(store.fold_health(runs(spark, sf), F.col("id"))).select("queue_id", "priority")


# --- store folds ----------------------------------------------------------------------------------
@query("upsert_fold", "SELECT user_id AS id, arg_min(event_type, event_id) AS title, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upsert_fold(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("title"), F.col("event_type").alias("status"), "value", "event_id")
    return store.upsert(None, e, "id", F.col("event_id"), ("title",)).select("id", "title", "status", "value")


@query("queue_sync", """WITH s AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' ELSE 'deferred' END AS status, o_orderdate AS first_at FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0),
  b AS (SELECT o_orderkey AS k, o_orderdate + INTERVAL 1 DAY AS first_at FROM orders WHERE o_orderkey % 3 <> 1)
  SELECT CAST(coalesce(s.k, b.k) AS VARCHAR) AS queue_id, CASE WHEN b.k IS NULL THEN s.status WHEN s.k IS NOT NULL AND s.status NOT IN ('accepted', 'rejected') THEN s.status ELSE 'pending' END AS status, b.k IS NOT NULL AS is_active, coalesce(s.first_at, b.first_at) AS first_detected_at FROM s FULL JOIN b ON s.k = b.k""")
def queue_sync(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    key, origin = k.cast("string").alias("queue_id"), F.lit("worker_diagnostic").alias("origin")
    state = o.filter((k % 2 == 0) | (k % 3 == 0)).select(key, origin, F.when(k % 4 == 0, "pending").when(k % 4 == 1, "accepted").when(k % 4 == 2, "rejected").otherwise("deferred").alias("status"), F.lit(True).alias("is_active"), F.col("o_orderdate").alias("first_detected_at"), F.col("o_orderdate").alias("updated_at"))
    batch = o.filter(k % 3 != 1).select(key, origin, F.lit("pending").alias("status"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("first_detected_at"))
    return store.sync_queue(state, batch, F.lit(TODAY).cast("timestamp_ntz")).select("queue_id", "status", "is_active", "first_detected_at")


@query("column_update", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier")
def column_update(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return store.update(s, s.filter("s_suppkey % 2 = 0").withColumn("s_acctbal", F.col("s_acctbal") * 2), "s_suppkey", ["s_acctbal"])


@query("cascade_delete", "SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 5 <> 0")
def cascade_delete(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    left = store.delete(c.filter("c_custkey % 5 = 0").select("c_custkey").unionByName(o.filter("o_custkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"))), orders=(o, "o_custkey"), customer=(c, "c_custkey"))
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t, df in left.items()])


@query("retention_sweep", f"{V} SELECT id FROM v WHERE deadline_at < DATE '1998-05-25' ORDER BY deadline_at, id LIMIT 500")
def retention_sweep(spark, sf):
    return store.sweep(opportunities(spark, sf), TODAY)


@query("restore_missing", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def restore_missing(spark, sf):
    c = table(spark, sf, "customer")
    return store.insert_missing(c.filter("c_custkey % 3 = 0").select("c_custkey", "c_name", "c_mktsegment"), c.select("c_custkey", "c_name"), "c_custkey")


@query("backfill_changes", f"{V} SELECT id, 'expired' AS status FROM v WHERE deadline_at < DATE '1998-06-01' AND status <> 'expired'")
def backfill_changes(spark, sf):
    return store.backfill(opportunities(spark, sf), "status", F.when(F.col("deadline_at") < F.lit(TODAY), "expired").otherwise(F.col("status")), [F.asc("id")])


@query("schema_align", "SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS note, CAST(s_nationkey AS BIGINT) AS nation FROM supplier")
def schema_align(spark, sf):
    from pyspark.sql import types as T

    from opalyx.plans.schema import align_schema

    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("note", T.StringType()), T.StructField("nation", T.LongType())])
    return align_schema(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), target)


@query("integrity_checks", f"{V} SELECT 'ids are unique' AS label, TRUE AS ok, '0 offending rows' AS detail UNION ALL SELECT 'scores lie in range', TRUE, '0 offending rows' UNION ALL SELECT 'values are known', count(*) = 0, count(*) || ' offending rows' FROM v WHERE estimated_contract_value_eur IS NULL")
def integrity_checks(spark, sf):
    v = opportunities(spark, sf)
    return store.doctor([("ids are unique", agg.duplicate_groups(v, "id")), ("scores lie in range", v.filter(~F.col("qualification_score").between(0, 1))), ("values are known", v.filter("estimated_contract_value_eur IS NULL"))])


@query("sql_dump_rows", "SELECT 'INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ');' AS statement FROM nation")
def sql_dump_rows(spark, sf):
    from opalyx.sources.sinks import sql_inserts

    return sql_inserts(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation")


# --- scalar functions ------------------------------------------------------------------------------
_KEY = r"regexp_replace(regexp_replace(lower(trim({})), '[^\p{{L}}\p{{N}}_]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g')"


@query("dedup_key", f"SELECT doc_id, coalesce(nullif({_KEY.format('text')}, ''), 'unknown') || '__' || coalesce(nullif({_KEY.format('source')}, ''), 'unknown') || '__' || {_KEY.format('lang')} AS key FROM documents")
def dedup_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.dedup_key(F.col("text"), F.col("source"), F.col("lang")).alias("key"))


@query("lookup_key", "SELECT p_partkey, nullif(regexp_replace(regexp_replace(lower(strip_accents(trim(p_name || ' ' || p_type))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '') AS key FROM part")
def lookup_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.lookup_key(F.concat_ws(" ", "p_name", "p_type")).alias("key"))


@query("match_text", "SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def match_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.match_text(F.col("text")).alias("folded"))


@query("title_case", "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(p_name, '[_\\s-]+'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), ' ') AS label FROM part")
def title_case(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.title_case(F.col("p_name")).alias("label"))


@query("compact_whitespace", "SELECT doc_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS compact FROM documents")
def compact_whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.compact(F.col("text")).alias("compact"))


_PLAIN = "trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("token_keywords", f"SELECT doc_id, array_to_string(w[1:12], ' ') AS keywords FROM (SELECT doc_id, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda p: len(p[1]) >= 6 AND NOT regexp_full_match(p[1], '[0-9]+') AND list_position(t, p[1]) = p[2]), lambda p: p[1]) AS w FROM (SELECT doc_id, string_split({_PLAIN.format('text')}, ' ') AS t FROM documents))")
def token_keywords(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.keywords(F.col("text"), ["zzzzzz"]), " ").alias("keywords"))




@query("strip_html", "SELECT page_id, nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(html, '&quot;', '\"'), '&lt;', '<'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS plain FROM pages")
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@query("html_title", "SELECT page_id, nullif(trim(regexp_replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query("html_links", "SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1), ' ') AS links FROM pages")
def html_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(text.html_links(F.col("html")), " ").alias("links"))


@query("first_regex", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<h2[^>]*>([^<]+)</h2>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)lang=\"([a-z]+)\"', 1)), '')) AS value FROM pages")
def first_regex(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.first_match(F.col("html"), ["<h2[^>]*>([^<]+)</h2>", 'lang="([a-z]+)"']).alias("value"))


@query("code_extract", "SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(n_chars || ' 71200000-0 7124' || lpad(CAST(doc_id AS VARCHAR), 4, '0'), '\\b(\\d{8})(?:-\\d)?\\b', 1)), ' ') AS codes FROM documents".replace("list_distinct(", "list_sort(list_distinct(").replace(", 1)), ' ')", ", 1))), ' ')"))
def code_extract(spark, sf):
    raw = F.concat(F.col("n_chars").cast("string"), F.lit(" 71200000-0 7124"), F.lpad(F.col("doc_id").cast("string"), 4, "0"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(text.eight_digit_codes(raw)), " ").alias("codes"))


@query("code_extract_text", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b(\\d{8})(?:-\\d)?\\b', 1))), ' ') AS codes FROM documents")
def code_extract_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(text.eight_digit_codes(F.col("text"))), " ").alias("codes"))


@query("url_parts", "SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '') AS host, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def url_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.host(F.col("url")).alias("host"), text.slug(F.col("url")).alias("slug"))


_D = "CAST(o_orderdate AS DATE)"


@query("date_parse_multi", f"SELECT o_orderkey, {_D} AS parsed FROM orders WHERE o_orderkey % 8 <> 7 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 8 = 7")
def date_parse_multi(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    shown = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/MM/dd")).when(k == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00:00Z")))
    shown = shown.when(k == 3, F.concat(F.lit("due "), F.date_format(d, "dd/MM/yyyy"))).when(k == 4, F.concat(F.lit("bis "), F.date_format(d, "dd.MM.yyyy"), F.lit(" 12 Uhr")))
    shown = shown.when(k == 5, F.date_format(d, "MMMM d, yyyy")).when(k == 6, F.concat(F.lit("Mon, "), F.date_format(d, "dd MMM yyyy"), F.lit(" 08:00:00 +0000"))).otherwise("31.02.1997")
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_date(shown).alias("parsed"))


@query("date_labels", f"{V} SELECT id, CASE WHEN deadline_at IS NULL THEN 'Deadline pending' ELSE 'Closes ' || strftime(deadline_at, '%d %b %Y') END AS closes, coalesce(CAST(deadline_at AS VARCHAR), 'unknown-date') AS canonical, strftime(discovered_at, '%Y%m%d') AS compact, CAST(date_trunc('month', discovered_at) AS DATE) AS month_start FROM v")
def date_labels(spark, sf):
    v = opportunities(spark, sf)
    return v.select("id", dates.closes_label(F.col("deadline_at")).alias("closes"), dates.canonical_deadline(F.col("deadline_at")).alias("canonical"), dates.compact_day(F.col("discovered_at")).alias("compact"), dates.month_start(F.col("discovered_at")).alias("month_start"))


@query("best_candidate_date", "SELECT l_orderkey, arg_max(CAST(l_shipdate AS DATE), (l_quantity, l_shipdate)) AS best FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN -7 AND 60 GROUP BY l_orderkey")
def best_candidate_date(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("p"))
    met = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.col("l_shipdate").cast("date").alias("day")).join(orders, "l_orderkey")
    return met.groupBy("l_orderkey").agg(dates.best_deadline_in_group(F.col("l_quantity"), F.col("day"), F.col("p"), -7, 60).alias("best")).filter("best IS NOT NULL")


_PRICE = "CAST(floor(l_extendedprice) AS BIGINT)"


@query("money_parse", f"SELECT l_orderkey, l_linenumber, CAST({_PRICE} AS DOUBLE) + CASE WHEN l_orderkey % 4 IN (1, 2) THEN 0.25 ELSE 0 END AS amount FROM lineitem")
def money_parse(spark, sf):
    whole, k = F.floor("l_extendedprice").cast("long"), F.col("l_orderkey") % 4
    dotted = F.format_number(whole, 0)
    shown = F.when(k == 0, F.concat(F.lit("CHF "), F.replace(dotted, F.lit(","), F.lit("'")))).when(k == 1, F.concat(dotted, F.lit(".25 EUR"))).when(k == 2, F.concat(F.lit("EUR "), F.replace(dotted, F.lit(","), F.lit(".")), F.lit(",25"))).otherwise(F.concat(F.lit("about "), whole.cast("string")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", money.parse_amount(shown).alias("amount"))


@query("money_format", f"SELECT l_orderkey, l_linenumber, 'EUR ' || format('{{:,}}', {_PRICE}) AS shown FROM lineitem")
def money_format(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", money.amount_text(F.floor("l_extendedprice").cast("double"), F.lit("EUR"), F.lit(None).cast("string")).alias("shown"))


@query("qualification_score", f"{V} SELECT id, round(least(1.0, 0.15 + CASE WHEN evidence_level IN ('official_notice', 'official_listing') THEN 0.2 ELSE 0 END + CASE WHEN official_notice_id IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN implementation_path IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN licensed_architect_required THEN 0.15 ELSE 0 END + CASE WHEN estimated_contract_value_eur IS NOT NULL THEN 0.1 ELSE 0 END + 0.1 + CASE WHEN authority_name IS NOT NULL THEN 0.1 ELSE 0 END)::DOUBLE, 4) AS score FROM v")
def qualification_score(spark, sf):
    none = F.lit(None).cast("string")
    c = F.col
    score = classify.qualification_score(evidence=c("evidence_level"), notice_id=c("official_notice_id"), path=c("implementation_path"), architect=c("licensed_architect_required"), partner=F.lit(None).cast("boolean"), value=c("estimated_contract_value_eur"), value_text=none, registration=F.lit(0.0), submission=F.lit(0.0), authority=c("authority_name"))
    return opportunities(spark, sf).select("id", F.round(score, 4).alias("score"))


@query("review_priority", f"{V} SELECT id, greatest(45, CAST(trunc((1 - extraction_confidence) * 100) AS INTEGER)) AS priority FROM v")
def review_priority(spark, sf):
    return opportunities(spark, sf).select("id", review.confidence_priority(F.col("extraction_confidence")).alias("priority"))


_LATLNG = "SELECT o_orderkey AS k, CAST(o_orderkey % 170 AS DOUBLE) - 85 + 0.125 AS lat, CAST(o_orderkey % 359 AS DOUBLE) - 179.5 AS lng FROM orders"


def _points(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("k"), ((k % 170).cast("double") - 85 + 0.125).alias("lat"), ((k % 359).cast("double") - 179.5).alias("lng"))


@query("geo_confidence", f"SELECT k, round_even(least(0.96, 0.68 + CASE WHEN k % 2 = 0 THEN 0.14 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 0.1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0.04 ELSE 0 END + greatest(0.0, least(0.08, (CAST(k % 10 AS DOUBLE) / 10 - 0.4) * 0.16)))::DOUBLE, 2) AS confidence FROM ({_LATLNG})")
def geo_confidence(spark, sf):
    k = F.col("k")
    c = geo.geocode_confidence(F.when(k % 2 == 0, "place").otherwise("way"), F.when(k % 3 == 0, "city").otherwise("house"), (k % 10).cast("double") / 10, k % 5 == 0)
    return _points(spark, sf).select("k", c.alias("confidence"))


@query("bbox_diagonal", f"SELECT k, round(sqrt(pow(0.5 * 111.32, 2) + pow(0.25 * 111.32 * cos(radians(lat + 0.25)), 2)), 6) AS km FROM ({_LATLNG})")
def bbox_diagonal(spark, sf):
    lat, lng = F.col("lat"), F.col("lng")
    return _points(spark, sf).select("k", F.round(geo.box_diagonal_km(lat, lat + 0.5, lng, lng + 0.25), 6).alias("km"))


@query("mercator_pixels", f"SELECT k, round((lng + 180) / 360 * 256 * 8192, 4) AS x, round((0.5 - ln((1 + sin(radians(c))) / (1 - sin(radians(c)))) / (4 * pi())) * 256 * 8192, 4) AS y FROM (SELECT k, lng, greatest(least(lat, 85.05112878), -85.05112878) AS c FROM ({_LATLNG}))")
def mercator_pixels(spark, sf):
    p = geo.world_pixels(F.col("lat"), F.col("lng"), F.lit(13))
    return _points(spark, sf).withColumn("p", p).select("k", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("tile_cover", f"SELECT k, CAST((floor((x + 320) / 256) - floor((x - 320) / 256) + 1) * (least(15, floor((y + 320) / 256)) - greatest(0, floor((y - 320) / 256)) + 1) AS INTEGER) AS tiles FROM (SELECT k, (lng + 180) / 360 * 4096 AS x, (0.5 - ln((1 + sin(radians(c))) / (1 - sin(radians(c)))) / (4 * pi())) * 4096 AS y FROM (SELECT k, lng, greatest(least(lat, 85.05112878), -85.05112878) AS c FROM ({_LATLNG})))")
def tile_cover(spark, sf):
    p = geo.world_pixels(F.col("lat"), F.col("lng"), F.lit(4))
    return _points(spark, sf).withColumn("p", p).select("k", F.size(geo.tiles(F.col("p.x"), F.col("p.y"), F.lit(4), 640)).alias("tiles"))


_WAVE = "({a} * sin(6 * {x} * pi()) + {b} * sin(2 * {x} * pi())) * 2 / 3"
_SHIFT = f"""WITH p AS ({_LATLNG}), q AS (SELECT *, lng - 105 AS x, lat - 35 AS y, radians(lat) AS r FROM p), s AS (SELECT *,
  -100 + 2*x + 3*y + 0.2*y*y + 0.1*x*y + 0.2*sqrt(abs(x)) + {_WAVE.format(a=20, b=20, x='x')} + (20*sin(y*pi()) + 40*sin(y/3*pi()))*2/3 + (160*sin(y/12*pi()) + 320*sin(y*pi()/30))*2/3 AS dlat,
  300 + x + 2*y + 0.1*x*x + 0.1*x*y + 0.1*sqrt(abs(x)) + {_WAVE.format(a=20, b=20, x='x')} + (20*sin(x*pi()) + 40*sin(x/3*pi()))*2/3 + (150*sin(x/12*pi()) + 300*sin(x/30*pi()))*2/3 AS dlng,
  1 - 0.00669342162296594323 * pow(sin(r), 2) AS m FROM q)
  SELECT k, round(CASE WHEN o THEN lat ELSE lat - dlat * 180 / (6378245.0 * (1 - 0.00669342162296594323) / (m * sqrt(m)) * pi()) END, 6) AS lat, round(CASE WHEN o THEN lng ELSE lng - dlng * 180 / (6378245.0 / sqrt(m) * cos(r) * pi()) END, 6) AS lng FROM (SELECT *, lng < 72.004 OR lng > 137.8347 OR lat < 0.8293 OR lat > 55.8271 AS o FROM s)"""


@query("datum_shift", _SHIFT)
def datum_shift(spark, sf):
    g = geo.gcj02_to_wgs84(F.col("lat"), F.col("lng"))
    return _points(spark, sf).withColumn("g", g).select("k", F.round("g.lat", 6).alias("lat"), F.round("g.lng", 6).alias("lng"))


@query("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", semi.at(semi.record(F.col("props")), "k", "int").alias("k"))


@query("json_tolerant_array", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '|x' ELSE '' END AS items FROM events")
def json_tolerant_array(spark, sf):
    k = F.col("event_id") % 3
    payload = F.when(k == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('", 7, null, "x"]'))).when(k == 1, F.lit('{"a": 1}')).otherwise(F.lit("[broken"))
    return table(spark, sf, "events").select("event_id", F.array_join(semi.string_items(payload), "|").alias("items"))


@query("json_path_pick", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS picked FROM events")
def json_path_pick(spark, sf):
    made = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.struct(F.lit("  ").alias("b"), F.col("event_type").alias("c")).alias("a")))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", semi.first_value(semi.record(made), ["a.b", "a.c", "k"]).alias("picked"))


@query("xml_feed_parse", "SELECT p_brand, count(*) AS items, min(p_name) AS first_title FROM part GROUP BY p_brand")
def xml_feed_parse(spark, sf):
    from opalyx.sources.connectors import rss_items

    item = F.concat(F.lit("<item><title>"), F.col("p_name"), F.lit("</title><link>"), F.col("p_brand"), F.lit("</link><category>a</category><category>b</category></item>"))
    # a feed holds the parts of a brand in a range of keys, so none grows with the table
    feeds = table(spark, sf, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 1000).alias("feed")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("payload"))
    return rss_items(feeds).groupBy(F.col("link").alias("p_brand")).agg(F.count("*").alias("items"), F.min("title").alias("first_title"))


# --- rules ------------------------------------------------------------------------------------------
_W = "lower(p_name || ' ' || p_type)"


@query("weighted_score", f"SELECT p_partkey, CASE WHEN contains({_W}, 'gear') THEN 5 ELSE 0 END + CASE WHEN contains({_W}, 'bolt') THEN 3 ELSE 0 END + CASE WHEN contains({_W}, 'small') THEN -2 ELSE 0 END AS score FROM part")
def weighted_score(spark, sf):
    return _parts(spark, sf).select("p_partkey", rules.weighted_score(F.col("w"), {"gear": 5, "bolt": 3, "small": -2}).alias("score"))


@query("label_set", f"SELECT p_partkey, concat_ws('|', CASE WHEN contains({_W}, 'gear') OR contains({_W}, 'ring') THEN 'metal' END, CASE WHEN contains({_W}, 'small') THEN 'small' END) AS labels FROM part")
def label_set(spark, sf):
    return _parts(spark, sf).select("p_partkey", F.array_join(rules.label_set(F.col("w"), {"metal": ["gear", "ring"], "small": ["small"]}), "|").alias("labels"))


@query("first_match_class", f"SELECT p_partkey, CASE WHEN contains({_W}, 'gear') THEN 'gear' WHEN contains({_W}, 'bolt') THEN 'bolt' ELSE 'other' END AS class FROM part")
def first_match_class(spark, sf):
    w = F.col("w")
    return _parts(spark, sf).select("p_partkey", rules.first_class([("gear", rules.any_of(w, ["gear"])), ("bolt", rules.any_of(w, ["bolt"]))], "other").alias("class"))


@query("relevance_decision", f"SELECT p_partkey, CASE WHEN contains({_W}, 'small') THEN FALSE WHEN contains({_W}, 'gear') THEN TRUE ELSE starts_with(p_brand, 'Brand#1') END AS relevant FROM part")
def relevance_decision(spark, sf):
    none = F.array().cast("array<string>")
    return _parts(spark, sf).select("p_partkey", rules.relevant(F.col("w"), none, F.array("p_brand"), negative=["small"], positive=["gear"], prefixes=("Brand#1",)).alias("relevant"))


@query("multi_label", f"SELECT doc_id, concat_ws('|', CASE WHEN contains(t, 'tion') THEN 'a' END, CASE WHEN contains(t, 'ment') THEN 'b' END, CASE WHEN contains(t, 'sch') THEN 'c' END) AS labels FROM (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents)")
def multi_label(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(rules.label_set(text.match_text(F.col("text")), {"a": ["tion"], "b": ["ment"], "c": ["sch"]}), "|").alias("labels"))


@query("derived_classes", f"{V} SELECT id, CASE id % 4 WHEN 0 THEN 'environment_design' WHEN 1 THEN 'building_project' WHEN 2 THEN 'interior_project' ELSE '' END AS project_types, CASE id % 4 WHEN 1 THEN 'education' ELSE '' END AS building_categories FROM v")
def derived_classes(spark, sf):
    k = F.col("id") % 4
    titled = opportunities(spark, sf).withColumn("title", F.when(k == 0, "A public garden").when(k == 1, "École primaire").when(k == 2, "Fit-out of a hall").otherwise("Notice")).withColumn("eligibility_summary", F.lit(None).cast("string"))
    titled = titled.withColumns({"procedure_type": F.lit("open"), "implementation_path": F.lit(None).cast("string")})
    return classify.with_classes(titled).select("id", F.array_join("project_types", "|").alias("project_types"), F.array_join("building_categories", "|").alias("building_categories"))


@query("ingest_good_bad_split", "SELECT CASE WHEN page_id % 3 = 0 THEN 'failed' ELSE 'parsed' END AS outcome, count(*) AS n FROM pages GROUP BY 1")
def ingest_good_bad_split(spark, sf):
    from opalyx.sources import parsers

    k = F.col("page_id")
    docs = table(spark, sf, "pages").select(F.lit("s").alias("source_id"), F.col("url").alias("source_url"), F.when(k % 3 == 0, "not json").otherwise(F.to_json(F.struct(F.concat(F.lit("Notice "), k.cast("string")).alias("title"), F.lit("1.250,50").alias("estimatedValue")))).alias("payload"))
    sources = spark.createDataFrame([("s", "Source", "france", "primary", ["europe"], ["fr"])], "source_id string, name string, jurisdiction string, source_tier string, regions array<string>, languages array<string>")
    good, bad = parsers.split(parsers.parse(docs, sources, parsers.PARSERS["generic"]))
    tag = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("outcome"), "n")
    return tag(good, "parsed").unionByName(tag(bad, "failed"))


# --- streaming ----------------------------------------------------------------------------------------
_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("stream_latest_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_latest_state(spark, sf):
    from opalyx.streaming import jobs

    ship(spark)
    return jobs.latest_state(spark, *_folder(spark, sf), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("stream_seen_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_seen_dedup(spark, sf):
    from opalyx.streaming import jobs

    return jobs.seen_once(spark, *_folder(spark, sf), ["user_id", "event_type"]).select("user_id", "event_type")


def _folder(spark: SparkSession, sf: str) -> tuple[str, str, str]:
    """Folder, schema and pattern of the events: a file beside the other tables, or a folder of parts."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/events.parquet")
    parts = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return (f"{sf}/events.parquet", _EVENTS, "*.parquet") if parts else (sf, _EVENTS, "events.parquet")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the default feed page."""
    return Q.feed_item(Q.page(opportunities(spark, sf_dir), Q.Query(), TODAY))


from opalyx import queries_rules  # noqa: E402, F401  (registers its queries)
