"""Session helpers: shipping this package to executors and folders that all of them share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"
_shipped: set[str] = set()
_fallback: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application.

    Arrow batches are kept to BATCH_BYTES in the session, unless the application sets that itself: a worker
    holds a batch and what it makes of it."""
    app = spark.sparkContext.applicationId
    if spark.sparkContext.getConf().get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(), "opalyx_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("opalyx", os.path.relpath(path, top)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, removed when the application ends.

    Where the setting is missing on a local master (tests) a temporary folder is set; elsewhere that is an error,
    as other machines could not see the folder.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or _fallback.get(app)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = _fallback[app] = "file://" + tempfile.mkdtemp(prefix="opalyx-shared-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/opalyx/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it as Parquet to a shared folder and read it again."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of keys up to which a key table is sent to every task.
BROADCAST_KEYS = 1_000_000


def with_keys(df: DataFrame, keys: DataFrame, on, how: str) -> DataFrame:
    """df left_semi or left_anti joined to distinct keys: sent to the tasks where they are counted to be few, else dealt by key."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(broadcast(keys) if few else keys, on, how)
