"""The version log, keyed state in buckets, streams with restarts, linked data."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from opalyx.functions import linked
from opalyx.operators import store, versions
from opalyx.runtime import shared_dir
from opalyx.streaming import jobs

KV = "k long, v long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def size_of(root):
    top = root.removeprefix("file://")
    return {p: os.path.getsize(os.path.join(d, p)) for d, _, names in os.walk(top) for p in names if p.endswith(".parquet")}


def test_one_of_two_writers_wins_and_the_other_retries(spark):
    root, met, tries = shared_dir(spark, "log"), threading.Barrier(2, timeout=60), []
    versions.update(spark, root, lambda _: spark.createDataFrame([(0, 0)], KV))

    def writer(n):
        def change(t):
            tries.append(n)
            if tries.count(n) == 1:
                met.wait()  # both have read the same version
            return t.unionByName(spark.createDataFrame([(n, n)], KV))

        versions.update(spark, root, change)

    threads = [threading.Thread(target=writer, args=(n,)) for n in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert rows(versions.current(spark, root)) == [(0, 0), (1, 1), (2, 2)]
    assert len(tries) == 3 and versions.VersionLog(spark, root).latest()[0] == 3


def test_commits_need_the_version_they_were_made_from(spark):
    log = versions.VersionLog(spark, shared_dir(spark, "log"))
    assert log.latest() == (0, {})
    assert log.commit(0, {"a": 1}) and not log.commit(0, {"a": 2}) and log.commit(1, {"a": 3})
    assert log.latest() == (2, {"a": 3}) and log.entry(1) == {"a": 1}
    with pytest.raises(versions.Conflict):
        versions.update(spark, log.root, lambda t: log.commit(log.latest()[0], {"a": 9}) and spark.createDataFrame([], KV), tries=2)


def test_one_runs_a_job_of_a_day(spark):
    root, got = shared_dir(spark, "days"), []
    threads = [threading.Thread(target=lambda: got.append(versions.once_a_day(spark, root, "sweep", "2026-05-01"))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [False, False, False, True]
    assert not versions.once_a_day(spark, root, "sweep", "2026-05-01") and versions.once_a_day(spark, root, "sweep", "2026-05-02") and versions.once_a_day(spark, root, "other", "2026-05-01")


def test_saved_search_of_two_writers_is_one_row(spark):
    root = shared_dir(spark, "saved")
    empty = spark.createDataFrame([], "id long, workspace_key string, name string, filters_json string, created_at long, updated_at long")
    save = lambda n: versions.update(spark, root, lambda t: store.save_search(empty if t is None else t, "w", "name", '{"a":1}', F.lit(n).cast("long")))
    threads = [threading.Thread(target=save, args=(n,)) for n in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [(r.id, r.name) for r in versions.current(spark, root).collect()] == [(1, "name")]


def test_keyed_state_writes_what_a_batch_touches(spark):
    root, fold = shared_dir(spark, "keyed"), jobs.last_rows("k", ["v"])
    versions.fold_keyed(spark.range(5_000).select(F.col("id").alias("k"), F.col("id").alias("v")), root, "k", fold, buckets=16)
    first = size_of(root)
    versions.fold_keyed(spark.createDataFrame([(7, 99_999), (9_999, 1)], KV), root, "k", fold, buckets=999)
    added = {p: n for p, n in size_of(root).items() if p not in first}
    assert sum(added.values()) < sum(first.values()) / 4 and len(added) <= 2
    state = dict(rows(versions.current(spark, root)))
    assert len(state) == 5_001 and state[7] == 99_999 and state[8] == 8 and state[9_999] == 1
    assert versions.VersionLog(spark, root).latest()[1]["buckets"] == 16


def test_a_repeated_batch_counts_once(spark):
    root = shared_dir(spark, "keyed")

    def add(state, batch):
        every = batch if state is None else state.unionByName(batch)
        return every.groupBy("k").agg(F.sum("v").alias("v"))

    one = spark.createDataFrame([(1, 10), (None, 5)], KV)
    assert [versions.fold_keyed(one, root, "k", add, 4, n) for n in (0, 0, 1)] == [1, 1, 2]
    assert sorted(map(tuple, versions.current(spark, root).collect()), key=str) == [(1, 20), (None, 10)]


def test_a_stream_goes_on_after_a_restart(spark):
    root, fold = shared_dir(spark, "stream"), jobs.last_rows("k", ["v"])
    for n in range(4):
        spark.createDataFrame([(k, 10 * n + k) for k in range(n, 6)], KV).coalesce(1).write.mode("append").parquet(f"{root}/in")
        if n in (1, 3):
            out = jobs.run_keyed_fold(jobs.landed(spark, f"{root}/in", KV, files=1), f"{root}/state", f"{root}/checkpoint", "k", fold, 4)
    assert rows(out) == [(0, 0), (1, 11), (2, 22), (3, 33), (4, 34), (5, 35)]
    assert versions.VersionLog(spark, f"{root}/state").latest()[0] == 4


def test_late_rows_are_dropped_and_repeats_once(spark):
    root = shared_dir(spark, "late")
    for part in ([(1, 0), (2, 10)], [(3, 1000), (3, 1000)], [(4, 2000)], [(5, 5), (6, 1990), (4, 2000)]):
        spark.createDataFrame(part, "id long, s long").select("id", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = jobs.landed(spark, f"{root}/in", "id long, ts timestamp", files=1)
    assert sorted(r.id for r in jobs.once_in_time(stream, "ts", ["id"], "100 seconds", root).collect()) == [1, 2, 3, 4, 6]


def test_linked_data_of_any_depth(spark):
    deep = {"streetAddress": "Deep 1"}
    for _ in range(12):
        deep = {"a": [deep]}
    page = lambda *values: "<p>x</p>" + "".join(f'<SCRIPT type="application/ld+json" id="i">{v if isinstance(v, str) else json.dumps(v)}</SCRIPT>' for v in values)
    pages = spark.createDataFrame(
        [
            (1, "https://h.org/a/b", page(deep, {"image": "x.png", "b": {"image": "no.png"}}, "{broken")),
            (2, "https://h.org/", page([{"image": {"url": "/y.png", "width": "10", "height": 20, "name": "N"}}, "z.png"], {"offerDigitalExternalPlatformUrl": ["https://o.org/1", {"q": ["www.o.org/2"]}]})),
            (3, "https://h.org/", page({"streetAddress": 5, "postalCode": "0042", "alternateName": "Alt"})),
            (4, None, None),
            (5, "https://h.org/", "no scripts"),
        ],
        "page_id long, url string, html string",
    )
    got = sorted((r.id, r.kind, r.value or "", r.street or "", r.postal_code or "", r.name or "", r.descriptor or "", r.width or "", r.height or "") for r in linked.linked_data(pages, "page_id").collect())
    assert got == [
        (1, "address", "", "Deep 1", "", "", "", "", ""),
        (1, "image", "https://h.org/a/x.png", "", "", "", "jsonld", "", ""),
        (2, "image", "https://h.org/y.png", "", "", "", "jsonld N", "10", "20"),
        (2, "image", "https://h.org/z.png", "", "", "", "jsonld image", "", ""),
        (2, "link", "https://o.org/1", "", "", "", "", "", ""),
        (2, "link", "https://www.o.org/2", "", "", "", "", "", ""),
        (3, "address", "", "", "0042", "Alt", "", "", ""),
    ]
    assert linked.linked_data(pages.filter("page_id > 3"), "page_id").count() == 0
