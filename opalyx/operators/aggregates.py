"""Counts, duplicates, representatives and top-k in groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalyx.runtime import written


def snapshot(df: DataFrame) -> DataFrame:
    """Total, verified and officially evidenced records, in one pass."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("evidence_level").isin("official_notice", "official_listing")).alias("primary_evidence"))


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """Total and, for each name, the rows for which its condition holds; 0 over no rows."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def breakdown(df: DataFrame, key: str, count: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(count)).orderBy(F.desc(count), F.asc(key))


def duplicate_groups(df: DataFrame, key: str) -> DataFrame:
    """Keys of more than one row with their counts. Counted in part before the shuffle, so a hot key costs a row for each task."""
    return df.groupBy(key).agg(F.count("*").alias("duplicate_count")).filter("duplicate_count > 1")


def duplicate_pressure(df: DataFrame, key: str) -> DataFrame:
    """Groups of duplicates, the rows in them and the largest."""
    return duplicate_groups(df, key).agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("records_in_groups"), F.coalesce(F.max("duplicate_count"), F.lit(0)).alias("max_group_size"))


def batch_pressure(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Duplicate groups among a batch's keys: the larger of its own and the stored count of each."""
    own = batch.groupBy(key).agg(F.count("*").alias("b"))
    kept = stored.groupBy(key).agg(F.count("*").alias("s"))
    size = F.greatest("b", F.coalesce("s", F.lit(0)))
    return own.join(kept, key, "left").filter(size > 1).agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.max(size), F.lit(0)).alias("max_group_size"))


def duplicate_clusters(df: DataFrame, key: str, order: list[Column], sample: int = 3) -> DataFrame:
    """Clusters of one key: size, the first row in the order, the first few titles, the latest update.

    A cluster is reduced to its bounded parts by ranks; only its count and maximum are over all of its rows."""
    w = Window.partitionBy(key).orderBy(*order)
    top = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample)
    heads = top.groupBy(key).agg(F.min_by("id", "_r").alias("primary_id"), F.min_by("title", "_r").alias("primary_title"), F.array_sort(F.collect_list(F.struct("_r", "title"))).alias("_t"))
    sizes = df.groupBy(key).agg(F.count("*").alias("duplicate_count"), F.max("updated_at").alias("last_detected_at")).filter("duplicate_count > 1")
    return sizes.join(heads, key).withColumn("sample_titles", F.transform("_t", lambda x: x["title"])).drop("_t")


def latest_by(df: DataFrame, key: str, order: Column, values: list[str]) -> DataFrame:
    """The values of each key's last row: an aggregation, without window or self-join."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_v")).select(key, "_v.*")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in the order. Spark keeps one row for each key and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_in_group(df: DataFrame, key: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def by_tiers(records: DataFrame, tiers: list[DataFrame], key: str, choose: Callable[[DataFrame], DataFrame], candidate: str | None = None) -> DataFrame:
    """What choose() makes of the first tier of candidates that gives a record (key) anything.

    A later tier meets only the records that the earlier ones left open; candidate: a column whose values,
    once met by a record in a tier, aren't tried again in later ones."""
    found, open_, seen = [], records.select(key).distinct(), None
    for at, tier in enumerate(tiers):
        met = tier.join(open_, key, "left_semi")
        if candidate and seen is not None:
            met = met.join(seen, [key, candidate], "left_anti")
        got = written(choose(met), "tier")
        found.append(got)
        if at + 1 < len(tiers):
            open_ = open_.join(got.select(key), key, "left_anti")
            tried = tier.select(key, candidate) if candidate else None
            seen = tried if seen is None else seen.unionByName(tried).distinct()
    return reduce(DataFrame.unionByName, found)


def first_passing(df: DataFrame, key: str, order: list[Column], k: int, passes: Column) -> DataFrame:
    """Of each group's k best rows the first that passes."""
    return top_in_group(df, key, order, k, "_r").filter(passes).groupBy(key).agg(F.min_by(F.struct(*df.columns), "_r").alias("_v")).select("_v.*")


def best_score(df: DataFrame, key: str, score: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(score).alias(score))


def pack_coverage(sources: DataFrame) -> DataFrame:
    """For each country pack: enabled, scaffold only, or empty."""
    per = sources.groupBy("pack").agg(F.max(F.coalesce("enabled", F.lit(False))).alias("_e"), F.count("source_id").alias("sources"))
    return per.select("pack", "sources", F.when(F.col("_e"), "enabled").when(F.col("sources") > 0, "scaffold_only").otherwise("empty").alias("coverage"))
