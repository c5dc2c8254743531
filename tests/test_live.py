"""Listings page by page from local files, pushed bounds, streams that resume, pacing, misses that expire."""

import json

import pytest
from pyspark.sql import functions as F

from opalyx.sources import ingest, live


@pytest.fixture(scope="module")
def registered(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in (live.HttpSource, live.PagedSource):
        spark.dataSource.register(s)
    return spark


def write(folder, name, items):
    (folder / name).write_text(json.dumps({"data": {"records": items}}))


def item(k, day="2026-05-10"):
    return {"id": k, "publishedAt": day, "title": f"notice {k}"}


def listing(folder, url="page-{page}.json", **more):
    return {"source_id": "s", "url": f"file://{folder}/{url}", "items": "data.records", "key": "id", "published": "publishedAt", "size": 3, "pause": 0} | more


def test_pages_until_a_short_one(tmp_path):
    write(tmp_path, "page-1.json", [item(1), item(2), item(3)])
    write(tmp_path, "page-2.json", [item(4)])
    write(tmp_path, "page-3.json", [item(9)])
    asked = []

    def opener(request, timeout):
        import urllib.request

        asked.append(request.full_url[-11:])
        return urllib.request.urlopen(request, timeout=timeout)

    got = list(live.pages(listing(tmp_path), {}, opener=opener, tries=1))
    assert [x["id"] for x, _, _ in got] == [1, 2, 3, 4] and asked == ["page-1.json", "page-2.json"]
    assert got[-1][2] == {"page": 2, "seen": 1}
    assert [x["id"] for x, _, _ in live.pages(listing(tmp_path, most=1), {}, tries=1)] == [1, 2, 3]
    write(tmp_path, "page-2.json", [item(4), item(5)])
    assert [x["id"] for x, _, _ in live.pages(listing(tmp_path), got[-1][2], tries=1)] == [5]


def test_keyset_pages(tmp_path):
    write(tmp_path, "after-.json", [item(1), item(2), item(3)])
    write(tmp_path, "after-3.json", [item(4), item(5), item(6)])
    write(tmp_path, "after-6.json", [])
    by_key = listing(tmp_path, "after-{last}.json")
    got = list(live.pages(by_key, {}, tries=1))
    assert [x["id"] for x, _, _ in got] == [1, 2, 3, 4, 5, 6] and got[-1][2] == {"last": 6}
    write(tmp_path, "after-6.json", [item(7)])
    assert [x["id"] for x, _, _ in live.pages(by_key, {"last": 6}, tries=1)] == [7]


def test_bounds_are_pushed_into_the_request(registered, tmp_path):
    for since, items in (("", [item(1, "2026-04-01"), item(2), item(3)]), ("2026-05-01", [item(2), item(3, "2026-04-30")])):
        write(tmp_path, f"since-{since}-1.json", items)
    one = listing(tmp_path, "since-{since}-{page}.json", size=9)
    df = registered.read.format("opalyx_pages").option("listings", json.dumps([one, one | {"source_id": "other"}])).load()
    assert sorted((r.source_id, r.item_id) for r in df.collect()) == [(s, k) for s in ("other", "s") for k in "123"]
    bounded = df.filter((F.col("published") >= "2026-05-01") & (F.col("source_id") == "s"))
    rows = bounded.collect()
    assert [r.item_id for r in rows] == ["2"] and "since-2026-05-01-1" in rows[0].source_url and json.loads(rows[0].payload)["title"] == "notice 2"


def test_a_stream_stops_at_a_short_page_and_resumes(registered, tmp_path):
    out = []

    def run():
        stream = registered.readStream.format("opalyx_pages").option("listings", json.dumps([listing(tmp_path)])).option("pages", 2).load()
        query = stream.writeStream.foreachBatch(lambda df, _: out.extend(r.item_id for r in df.collect())).option("checkpointLocation", f"file://{tmp_path}/checkpoint").start()
        query.processAllAvailable()
        query.stop()

    write(tmp_path, "page-1.json", [item(1), item(2), item(3)])
    write(tmp_path, "page-2.json", [item(4)])
    run()
    assert sorted(out) == ["1", "2", "3", "4"]
    write(tmp_path, "page-2.json", [item(4), item(5), item(6)])
    write(tmp_path, "page-3.json", [item(7)])
    run()
    assert sorted(out) == list("1234567")


def test_offsets_give_the_same_items_again(tmp_path):
    for n in (1, 2):
        write(tmp_path, f"page-{n}.json", [item(10 * n + k) for k in range(3)])
    write(tmp_path, "page-3.json", [])
    reader = live.PagedStream({"listings": json.dumps([listing(tmp_path)]), "pages": "1", "tries": "1"})
    first, middle = reader.read(reader.initialOffset())
    second, end = reader.read(middle)
    a, b = list(first), list(second)
    assert [r[2] for r in a] == ["10", "11", "12"] and [r[2] for r in b] == ["20", "21", "22"]
    assert list(reader.readBetweenOffsets(reader.initialOffset(), middle)) == a and list(reader.readBetweenOffsets(middle, end)) == b
    assert list(reader.read(end)[0]) == []


def test_tasks_share_a_pace():
    sent = []
    for index in range(3):
        now = [100.0]

        def sleep(s, now=now):
            now[0] += s

        pace = live.Pace(1.1, 3, index, lambda now=now: now[0], sleep)
        for _ in range(4):
            pace.wait()
            sent.append(now[0])
            now[0] += 0.2  # what a request takes
    gaps = [b - a for a, b in zip(sorted(sent), sorted(sent)[1:], strict=False)]
    assert len(sent) == 12 and min(gaps) >= 1.1 - 1e-9


def test_reads_keep_the_pace(registered, tmp_path):
    import time

    for k in range(4):
        (tmp_path / f"{k}.json").write_text(str(k))
    requests = [{"url": f"file://{tmp_path}/{k}.json", "source_id": "s"} for k in range(4)]
    began = time.monotonic()
    rows = registered.read.format("opalyx_http").option("requests", json.dumps(requests)).option("partitions", 2).option("interval", 0.5).load().collect()
    assert sorted(r.payload for r in rows) == list("0123") and time.monotonic() - began >= 1.0


def test_misses_expire_and_failures_are_not_kept(spark):
    rec = spark.createDataFrame([(p, "portugal") for p in ("Porto", "Nowhere", "Old", "New")], "location_label string, jurisdiction string")
    cache = spark.createDataFrame([("portugal:porto", 41.1, -8.6, 0.9, "2020-01-01"), ("portugal:nowhere", None, None, None, "2026-05-01"), ("portugal:old", None, None, None, "2026-01-01")], "location_key string, lat double, lng double, confidence double, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    now = F.lit("2026-05-10").cast("timestamp")
    assert sorted(r.location_key for r in ingest.geocode_misses(rec, cache, now).collect()) == ["portugal:new", "portugal:old"]
    assert [r.location_key for r in ingest.geocode_misses(rec, cache).collect()] == ["portugal:new"]
    answers = spark.createDataFrame([("portugal:old", 1.0, 2.0, 0.5, "2026-05-10", False), ("portugal:new", None, None, None, "2026-05-10", True), ("portugal:gone", None, None, None, "2026-05-10", False), ("portugal:porto", None, None, None, "2026-05-10", False)], "location_key string, lat double, lng double, confidence double, fetched_at string, failed boolean").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    kept = {r.location_key: r.lat for r in ingest.remember(cache, answers).collect()}
    assert kept == {"portugal:porto": 41.1, "portugal:nowhere": None, "portugal:old": 1.0, "portugal:gone": None}
