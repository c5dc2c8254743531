"""Sinks: versioned tables, SQL dumps, JSON rows and small state files."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, root: str, partitions: int | None = None) -> str:
    """Write a new version folder beside the older ones; what is read is never overwritten. Returns its path."""
    path = f"{root.rstrip('/')}/v={datetime.now(UTC).strftime('%Y%m%dT%H%M%S%f')}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return path


def latest_version(spark: SparkSession, root: str) -> str | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(done, default=None)


def sql_literal(c: Column, kind: str) -> Column:
    if kind in ("string", "date", "timestamp", "timestamp_ntz"):
        shown = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind.startswith(("array", "struct", "map")):
        shown = F.concat(F.lit("'"), F.replace(F.to_json(c), F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind == "boolean":
        shown = F.when(c, "1").otherwise("0")
    else:
        shown = c.cast("string")
    return F.when(c.isNull(), "NULL").otherwise(shown)


def sql_inserts(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement for each row."""
    names = ", ".join(df.columns)
    values = F.concat_ws(", ", *(sql_literal(F.col(n), k) for n, k in df.dtypes))
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), values, F.lit(");")).alias("statement"))


def sql_dump(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """(part, statement): deletes, children first, then inserts, parents first. tables: parents before children."""
    spark = tables[0][1].sparkSession
    deletes = spark.createDataFrame([(i, f"DELETE FROM {t};") for i, (t, _) in enumerate(reversed(tables))], "part int, statement string")
    for i, (name, df) in enumerate(tables):
        deletes = deletes.unionByName(sql_inserts(df, name).select(F.lit(len(tables) + i).alias("part"), "statement"))
    return deletes


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def newest_assets(df: DataFrame) -> DataFrame:
    """(name, file): for each canonical name the file of its highest version."""
    return df.groupBy("name").agg(F.max_by("file", "version").alias("file"))
