"""Ingest of one source: documents to records, state, run log and review queue, as pure folds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalyx.functions import rules
from opalyx.operators import store
from opalyx.sources import parsers


class PartialFailure(RuntimeError):
    """Some payloads failed; what could be parsed has been kept."""


@dataclass
class Ingested:
    records: DataFrame
    failures: DataFrame
    run: DataFrame


def ingest(docs: DataFrame, sources: DataFrame, parser: str, today: date, retention_days: int = 7, pages: DataFrame | None = None, verifier: str | None = None) -> Ingested:
    """Parse, drop what is stale, verify, drop what has become stale; counts of the run for each source."""
    parsed = parsers.parse(docs, sources, parsers.PARSERS[parser])
    good, bad = parsers.split(parsed)
    good = good.filter(~store.expired(good, today, retention_days))
    if verifier and pages is not None:
        good = parsers.VERIFIERS[verifier](good, pages)
        good = good.filter(~store.expired(good, today, retention_days))
    counts = docs.groupBy("source_id").agg(F.count("*").alias("document_count"))
    counts = counts.join(good.groupBy("source_id").agg(F.count("*").alias("upserted_count")), "source_id", "left").join(bad.groupBy("source_id").agg(F.count("*").alias("parse_failure_count")), "source_id", "left").fillna(0)
    run = counts.withColumn("status", rules.run_status(F.col("document_count"), F.col("upserted_count"), F.col("parse_failure_count")))
    return Ingested(good.drop("source_id"), bad, run)


def geocoded(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Records with coordinates from a cache (location_key, lat, lng, confidence); a row without coordinates is a known miss."""
    from opalyx.functions import text

    key = F.concat_ws(":", F.coalesce(F.lower(F.replace(F.col("jurisdiction"), F.lit("-"), F.lit("_"))), F.lit("unknown")), text.location_key(F.col("location_label")))
    hit = cache.select(F.col("location_key").alias("_k"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("confidence").alias("_c"))
    return records.withColumn("_k", key).join(hit, "_k", "left").withColumns({"geo_lat": F.col("_lat"), "geo_lng": F.col("_lng"), "geo_confidence": F.col("_c")}).drop("_k", "_lat", "_lng", "_c")


def geocode_misses(records: DataFrame, cache: DataFrame, now: Column | None = None, expires_days: int = 30) -> DataFrame:
    """Places that no cache row, known miss included, answers. With now, misses fetched more than so many days before are asked again."""
    from opalyx.functions import text

    key = F.concat_ws(":", F.coalesce(F.lower(F.replace(F.col("jurisdiction"), F.lit("-"), F.lit("_"))), F.lit("unknown")), text.location_key(F.col("location_label")))
    return records.filter(F.col("location_label").isNotNull()).select(key.alias("location_key"), "location_label", "jurisdiction").distinct().join(fresh(cache, now, expires_days).select("location_key"), "location_key", "left_anti")


def fresh(cache: DataFrame, now: Column | None = None, expires_days: int = 30) -> DataFrame:
    """Cache rows that count: answers for ever, misses until they expire."""
    if now is None:
        return cache
    return cache.filter(F.col("lat").isNotNull() | (F.col("fetched_at") > now - F.make_dt_interval(F.lit(expires_days))))


def remember(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with new answers (location_key, lat, lng, confidence, fetched_at, failed): a place that isn't known is
    kept as a miss, a failed request as nothing, and an answer replaces a miss."""
    told = answers.filter(~F.coalesce("failed", F.lit(False))).select(*cache.columns)
    rows = cache.unionByName(told)
    others = [c for c in cache.columns if c != "location_key"]
    return rows.groupBy("location_key").agg(F.max_by(F.struct(*others), F.struct(F.col("lat").isNotNull(), "fetched_at")).alias("_v")).select("location_key", "_v.*")


def run_batch(jobs: list, continue_on_error: bool = True) -> list[tuple[str, Exception | None]]:
    """Run (name, function) jobs one after the other; failures are kept, or stop the batch."""
    out: list[tuple[str, Exception | None]] = []
    for name, job in jobs:
        try:
            job()
            out.append((name, None))
        except Exception as error:
            out.append((name, error))
            if not continue_on_error:
                raise
    return out
