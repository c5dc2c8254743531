"""Views of the order tables in the shape of the store, for the registered queries.

The same definitions are kept as DuckDB text for the comparison. Nulls are induced by key, as the tables hold none.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = date(1998, 6, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their customers and nations as opportunities."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    every = lambda n, c: F.when(k % n != 0, c)
    return joined.select(
        k.alias("id"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
        F.col("c_name").alias("organizer"),
        every(5, F.col("c_mktsegment")).alias("authority_name"),
        F.col("n_name").alias("jurisdiction"),
        F.col("o_orderpriority").alias("procedure_type"),
        F.when(k % 13 == 0, "discarded").when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "P", "shortlisted").otherwise(F.when(k % 11 == 0, "verified").otherwise("discovered")).alias("status"),
        every(10, F.col("o_orderdate").cast("date")).alias("deadline_at"),
        every(7, F.col("o_totalprice")).alias("estimated_contract_value_eur"),
        every(9, (k % 100).cast("double") / F.lit(100.0)).alias("qualification_score"),
        F.when(k % 3 == 1, True).when(k % 3 == 2, False).alias("licensed_architect_required"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderdate").alias("discovered_at"),
        every(4, F.concat(F.lit("N-"), k.cast("string"))).alias("official_notice_id"),
        F.when(k % 6 == 1, "framework_selection_for_repeated_design_commissions").when(k % 6 == 2, "service_contract_award_after_competitive_selection").alias("implementation_path"),
        F.when(k % 4 == 0, "official_notice").when(k % 4 == 1, "official_listing").when(k % 4 == 2, "authority_page").otherwise("secondary").alias("evidence_level"),
        ((k % 50).cast("double") / F.lit(50.0)).alias("extraction_confidence"),
        F.when(k % 17 == 0, "Portal and notice conflict on the date").when(k % 5 == 0, "Checked").alias("evidence_note"),
        F.concat_ws("__", F.lower("c_mktsegment"), F.col("o_orderdate").cast("date").cast("string")).alias("dedup_key"),
    )


OPPORTUNITIES_SQL = """v AS (
  SELECT o_orderkey AS id, o_orderpriority || ' ' || c_mktsegment AS title, c_name AS organizer,
    CASE WHEN o_orderkey % 5 <> 0 THEN c_mktsegment END AS authority_name, n_name AS jurisdiction, o_orderpriority AS procedure_type,
    CASE WHEN o_orderkey % 13 = 0 THEN 'discarded' WHEN o_orderstatus = 'F' THEN 'archived' WHEN o_orderstatus = 'P' THEN 'shortlisted' WHEN o_orderkey % 11 = 0 THEN 'verified' ELSE 'discovered' END AS status,
    CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS deadline_at,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS estimated_contract_value_eur,
    CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS qualification_score,
    CASE WHEN o_orderkey % 3 = 1 THEN TRUE WHEN o_orderkey % 3 = 2 THEN FALSE END AS licensed_architect_required,
    o_orderdate AS updated_at, o_orderdate AS discovered_at,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'N-' || CAST(o_orderkey AS VARCHAR) END AS official_notice_id,
    CASE WHEN o_orderkey % 6 = 1 THEN 'framework_selection_for_repeated_design_commissions' WHEN o_orderkey % 6 = 2 THEN 'service_contract_award_after_competitive_selection' END AS implementation_path,
    CASE WHEN o_orderkey % 4 = 0 THEN 'official_notice' WHEN o_orderkey % 4 = 1 THEN 'official_listing' WHEN o_orderkey % 4 = 2 THEN 'authority_page' ELSE 'secondary' END AS evidence_level,
    CAST(o_orderkey % 50 AS DOUBLE) / CAST(50 AS DOUBLE) AS extraction_confidence,
    CASE WHEN o_orderkey % 17 = 0 THEN 'Portal and notice conflict on the date' WHEN o_orderkey % 5 = 0 THEN 'Checked' END AS evidence_note,
    lower(c_mktsegment) || '__' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dedup_key
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a run log of sources."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("source_id"),
        F.concat(F.lit("Source "), F.col("user_id").cast("string")).alias("source_name"),
        F.when(kind == "error", "failed").when(kind == "signup", "empty").when(kind == "click", "completed_with_failures").otherwise("success").alias("status"),
        F.col("ts").alias("completed_at"),
        F.floor("value").cast("long").alias("document_count"),
        F.when(kind == "click", F.col("event_id") % 4).otherwise(0).cast("long").alias("parse_failure_count"),
        (F.col("event_id") % 3).cast("long").alias("duplicate_group_count"),
        F.when(kind == "error", F.concat(F.lit("run "), F.col("event_id").cast("string"))).alias("last_error"),
    )


RUNS_SQL = """runs AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS source_id, 'Source ' || CAST(user_id AS VARCHAR) AS source_name,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'empty' WHEN event_type = 'click' THEN 'completed_with_failures' ELSE 'success' END AS status,
    ts AS completed_at, CAST(floor(value) AS BIGINT) AS document_count,
    CAST(CASE WHEN event_type = 'click' THEN event_id % 4 ELSE 0 END AS BIGINT) AS parse_failure_count,
    CAST(event_id % 3 AS BIGINT) AS duplicate_group_count,
    CASE WHEN event_type = 'error' THEN 'run ' || CAST(event_id AS VARCHAR) END AS last_error
  FROM events)"""

QUEUE_SQL = """queue AS (
  SELECT conv_id AS queue_id, min(turn) AS first_turn, count(*) AS turns FROM conversations GROUP BY conv_id)"""
