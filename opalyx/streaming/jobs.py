"""Scheduled micro-batches as Structured Streaming with availableNow: each run takes what has arrived since the last."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opalyx.operators import store, versions
from opalyx.runtime import shared_dir
from opalyx.sources.sinks import latest_version, write_version


def landed(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def run_fold(stream: DataFrame, state_root: str, checkpoint: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
    """Fold each micro-batch into a versioned state table; a repeated batch gives the same state for idempotent folds."""
    spark = stream.sparkSession

    def step(batch: DataFrame, _: int) -> None:
        at = latest_version(batch.sparkSession, state_root)
        state = batch.sparkSession.read.parquet(at) if at else None
        write_version(fold(state, batch), state_root)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(latest_version(spark, state_root))


def latest_state(spark: SparkSession, folder: str, schema, pattern: str, key: str, order: str) -> DataFrame:
    """Last row of each key over all that has arrived."""
    stream = landed(spark, folder, schema, pattern)
    root = shared_dir(spark, "latest")

    def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if state is None else state.unionByName(batch)
        others = [c for c in batch.columns if c != key]
        return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order, *[c for c in others if c.endswith("_id")])).alias("_v")).select(key, "_v.*")

    return run_fold(stream, f"{root}/state", f"{root}/checkpoint", fold)


def run_keyed_fold(stream: DataFrame, root: str, checkpoint: str, key: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = 64) -> DataFrame:
    """Fold each micro-batch into keyed state of which it rewrites only the buckets it touches. A restart goes on
    where the checkpoint ends; a micro-batch that was committed before it is not folded again."""
    spark = stream.sparkSession
    
    def step(batch: DataFrame, n: int) -> None:
        versions.fold_keyed(batch, root, key, fold, buckets, n)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return versions.current(spark, root)


def last_rows(key: str, order: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A fold that keeps the last row of each key."""

    def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if state is None else state.unionByName(batch)
        others = [c for c in batch.columns if c != key]
        return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_v")).select(key, "_v.*")

    return fold


def once_in_time(stream: DataFrame, time: str, keys: list[str], delay: str, root: str) -> DataFrame:
    """Rows of a stream once for each key while its time is open: what is older than the latest time seen, as of the
    batch before the last, by more than the delay is dropped, and keys older than that are forgotten, so the state
    stays bounded. Appended to Parquet."""
    out = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(out.schema).parquet(f"{root}/out")


def seen_once(spark: SparkSession, folder: str, schema, pattern: str, keys: list[str], table: str = "seen") -> DataFrame:
    """First occurrence of each key within the run: stateful deduplication, appended to Parquet."""
    root = shared_dir(spark, table)
    out = landed(spark, folder, schema, pattern).dropDuplicates(keys)
    query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def window_filter(df: DataFrame, published: str, start: date | None) -> DataFrame:
    """Publication bound of a batch; rows without a date stay."""
    return df if start is None else df.filter(F.col(published).isNull() | (F.col(published) >= F.lit(start)))


def fresh_only(df: DataFrame, today: date, retention_days: int) -> DataFrame:
    return df.filter(~store.expired(df, today, retention_days))
