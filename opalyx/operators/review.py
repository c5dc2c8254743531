"""Review queue: candidates from four rules, joined decisions, order and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalyx.functions import rules
from opalyx.operators import aggregates
from opalyx.plans.labels import CONFLICT_WORDS

LOW_CONFIDENCE = 0.8
COLUMNS = ("queue_id", "origin", "reason_code", "priority", "title", "summary", "source_id", "competition_id", "dedup_key", "evidence_note", "payload_json", "last_detected_at")


def _candidate(df: DataFrame, reason: str, key: Column, **values: Column) -> DataFrame:
    fixed = {"queue_id": F.concat(F.lit(reason.replace("_", "-") + ":"), key.cast("string")), "origin": F.lit("worker_diagnostic"), "reason_code": F.lit(reason)}
    given = fixed | values
    return df.select(*(given.get(c, F.lit(None).cast("string")).alias(c) for c in COLUMNS))


def from_health(health: DataFrame) -> DataFrame:
    at = F.coalesce("last_run_completed_at", "last_run_started_at") if "last_run_started_at" in health.columns else F.col("last_run_completed_at")
    common = {"title": F.col("source_name"), "source_id": F.col("source_id").cast("string"), "evidence_note": F.col("last_error"), "last_detected_at": at}
    failed = _candidate(health.filter(F.col("last_status") == "failed"), "source_run_failed", F.col("source_id"), priority=F.lit(100), summary=F.lit("Latest ingest run failed before canonical review could complete."), payload_json=F.to_json(F.struct("last_status", "last_error")), **common)
    n = F.col("last_parse_failure_count")
    parses = _candidate(health.filter(n > 0), "source_parse_failures", F.col("source_id"), priority=F.lit(90), summary=F.concat(n.cast("string"), F.when(n == 1, " payload").otherwise(" payloads"), F.lit(" failed parser validation in the latest run.")), payload_json=F.to_json(F.struct("last_status", "last_parse_failure_count")), **common)
    return failed.unionByName(parses)


def conflict_signal(note: Column) -> Column:
    return rules.any_of(F.regexp_replace(F.lower(F.trim(note)), r"\s+", " "), CONFLICT_WORDS)


def from_conflicts(df: DataFrame) -> DataFrame:
    return _candidate(df.filter(conflict_signal(F.col("evidence_note"))), "evidence_conflict", F.col("id"), priority=F.lit(92), title=F.col("title"), summary=F.lit("Evidence notes record an explicit conflict that needs operator review."), competition_id=F.col("id").cast("string"), dedup_key=F.col("dedup_key"), evidence_note=F.col("evidence_note"), last_detected_at=F.col("updated_at"))


def from_duplicates(df: DataFrame) -> DataFrame:
    clusters = aggregates.duplicate_clusters(df, "dedup_key", [F.desc("updated_at"), F.asc("id")])
    n = F.col("duplicate_count")
    return _candidate(clusters, "duplicate_cluster", F.col("dedup_key"), priority=(F.lit(85) + F.least(n, F.lit(10))).cast("int"), title=F.col("primary_title"), summary=F.concat(n.cast("string"), F.lit(" canonical records currently share the same dedup key.")), competition_id=F.col("primary_id").cast("string"), dedup_key=F.col("dedup_key"), payload_json=F.to_json(F.struct("duplicate_count", "sample_titles")), last_detected_at=F.col("last_detected_at"))


def confidence_priority(confidence: Column) -> Column:
    return F.greatest(F.lit(45), ((F.lit(1.0) - confidence) * 100).cast("int"))


def from_low_confidence(df: DataFrame) -> DataFrame:
    c = F.col("extraction_confidence")
    return _candidate(df.filter((c < LOW_CONFIDENCE) & (F.col("status") != "verified")), "low_confidence_record", F.col("id"), priority=confidence_priority(c), title=F.col("title"), summary=F.concat(F.lit("Extraction confidence "), F.format_string("%.2f", c), F.lit(" on a "), F.col("status"), F.lit(" canonical record.")), competition_id=F.col("id").cast("string"), dedup_key=F.col("dedup_key"), last_detected_at=F.col("updated_at"))


def candidates(opportunities: DataFrame, health: DataFrame) -> DataFrame:
    parts = [from_health(health), from_conflicts(opportunities), from_duplicates(opportunities), from_low_confidence(opportunities)]
    return reduce(DataFrame.unionByName, parts)


def candidate_order() -> list[Column]:
    return [F.desc("priority"), F.asc_nulls_first("last_detected_at"), F.asc("queue_id")]


def with_latest_decision(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each item with its latest decision as a struct, or null: one aggregation and one join."""
    last = decisions.groupBy("queue_id").agg(F.max_by(F.struct("id", "decision", "actor_label", "note", "created_at"), "id").alias("latest_decision"))
    return queue.join(last, "queue_id", "left")


def filtered(queue: DataFrame, active_only: bool = True, status: str = "all", reason: str = "all") -> DataFrame:
    out = queue.filter("is_active") if active_only else queue
    out = out if status == "all" else out.filter(F.col("status") == status)
    return out if reason == "all" else out.filter(F.col("reason_code") == reason)


def queue_order(status_rank: dict[str, int] | None = None) -> list[Column]:
    rank = status_rank or {"pending": 0, "deferred": 1, "accepted": 2, "rejected": 3}
    place = F.coalesce(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("status")], F.lit(len(rank)))
    return [place.asc(), F.desc("priority"), F.desc("last_detected_at"), F.asc("queue_id")]


def health_order() -> list[Column]:
    severity = F.when(F.col("last_status") == "failed", 0).when(F.coalesce("last_parse_failure_count", F.lit(0)) > 0, 1).when(F.coalesce("duplicate_group_count", F.lit(0)) > 0, 2).otherwise(3)
    return [severity.asc(), F.coalesce("last_run_completed_at", "last_success_at").asc_nulls_first(), F.asc("source_name")]


def backlog_order(today: Column) -> list[Column]:
    """Upcoming, then undated, then expired; each by deadline, update and id."""
    place = F.when(F.col("deadline_at") >= today, 0).when(F.col("deadline_at").isNull(), 1).otherwise(2)
    return [place.asc(), F.col("deadline_at").asc_nulls_last(), F.desc("updated_at"), F.asc("id")]
