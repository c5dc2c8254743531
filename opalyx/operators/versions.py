"""Tables with a version log: a commit wins only over the version it was made from.

A table is a folder with `_log/<version>.json` and data folders of which each version names those it
consists of. A log file is made only if it isn't there yet, so of two writers from one version one wins
and the other reads again and retries. Data folders are never overwritten.

Keyed state lies in buckets by the hash of its key: a change rewrites the buckets that it touches, and
the new version names the others' folders as they were.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Other writers won every time."""


class VersionLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def latest(self) -> tuple[int, dict]:
        """The last version and its entry; (0, {}) for a table that isn't there yet."""
        folder = self._path("_log")
        fs = folder.getFileSystem(self._conf)
        if not fs.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        version = max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=0)
        return version, self.entry(version) if version else {}

    def entry(self, version: int) -> dict:
        path = self._path("_log", f"{version:020d}.json")
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, expected: int, entry: dict) -> bool:
        """Make the version after the expected one; False where another writer has made it."""
        path, text = self._path("_log", f"{expected + 1:020d}.json"), json.dumps(entry, sort_keys=True)
        fs = path.getFileSystem(self._conf)
        fs.mkdirs(path.getParent())
        if fs.getScheme() == "file":
            return _linked(urlsplit(path.toUri().toString()).path, text)
        try:
            out = fs.create(path, False)
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True


def _linked(path: str, text: str) -> bool:
    """A whole file under a new name; a hard link fails where the name is taken."""
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "w", encoding="utf-8") as f:
        f.write(text)
    try:
        os.link(draft, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The table of the last version."""
    entry = VersionLog(spark, root).latest()[1]
    folders = sorted(set(entry.get("folders", {}).values()))
    if not folders:
        return None
    return spark.read.schema(entry["schema"]).parquet(*(f"{root.rstrip('/')}/{f}" for f in folders))


def update(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame | None], tries: int = 5) -> int:
    """Replace a table by change(table), made anew where another writer was first. Returns the version; None from change changes nothing."""
    log = VersionLog(spark, root)
    for _ in range(tries):
        version, _entry = log.latest()
        changed = change(current(spark, root))
        if changed is None:
            return version
        folder = f"data/{uuid.uuid4().hex}"
        changed.write.parquet(f"{log.root}/{folder}")
        if log.commit(version, {"folders": {"all": folder}, "schema": _ddl(changed)}):
            return version + 1
    raise Conflict(f"{tries} writers were first at {root}")


def once_a_day(spark: SparkSession, root: str, job: str, day: str) -> bool:
    """Whether this caller is the one that may run a job today: of several, one gets True."""
    log = VersionLog(spark, f"{root.rstrip('/')}/{job}")
    version, entry = log.latest()
    return entry.get("day") != day and log.commit(version, {"day": day})


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {k}" for n, k in df.dtypes)


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def fold_keyed(batch: DataFrame, root: str, key: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = 64, batch_id: int | None = None, tries: int = 5) -> int:
    """Fold a batch into keyed state: fold(rows of the touched buckets, batch) replaces those buckets.

    A batch id that the state has seen changes nothing, so a repeated micro-batch counts once. The number of
    buckets is that of the first batch for ever. Returns the version."""
    spark, log = batch.sparkSession, VersionLog(batch.sparkSession, root)
    for _ in range(tries):
        version, entry = log.latest()
        if batch_id is not None and entry.get("batch", -1) >= batch_id:
            return version
        n = entry.get("buckets", buckets)
        touched = [r[0] for r in batch.select(bucket_of(key, n)).distinct().collect()]  # at most n numbers
        folders = dict(entry.get("folders", {}))
        old = [folders[str(b)] for b in touched if str(b) in folders]
        state = spark.read.schema(entry["schema"]).parquet(*(f"{log.root}/{f}" for f in old)) if old else None
        folder, new = f"data/{uuid.uuid4().hex}", fold(state, batch)
        marked = new.withColumn("_bucket", bucket_of(key, n))
        marked.repartition(min(n, max(1, len(touched))), "_bucket").write.partitionBy("_bucket").parquet(f"{log.root}/{folder}")
        folders |= {str(b): f"{folder}/_bucket={b}" for b in touched if _there(log, f"{folder}/_bucket={b}")}
        if log.commit(version, {"folders": folders, "schema": _ddl(new), "buckets": n, "batch": batch_id if batch_id is not None else entry.get("batch", -1)}):
            return version + 1
    raise Conflict(f"{tries} writers were first at {root}")


def _there(log: VersionLog, folder: str) -> bool:
    path = log._path(folder)
    return path.getFileSystem(log._conf).exists(path)
