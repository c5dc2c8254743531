"""Live fetching as Python data sources: work lists of requests, and listings read page by page.

    spark.dataSource.register(HttpSource)
    spark.read.format("opalyx_http").option("requests", json.dumps([...])).load()

Requests are spread over `partitions`; each is tried a few times; `required` requests fail the read,
others give a null payload. Task retry covers lost executors. With `interval`, all tasks of a read
together send no more than one request in so many seconds.

    spark.dataSource.register(PagedSource)
    spark.read.format("opalyx_pages").option("listings", json.dumps([...])).load().filter("published >= '2026-05-01'")
    spark.readStream.format("opalyx_pages").option("listings", json.dumps([...])).load()

A listing is {source_id, url, items, key, published, size, most}: url holds `{page}`, or `{last}` for the
key of the last item (keyset), and may hold `{since}`; items, key and published are dotted paths; a page
of fewer than size items is the last, as is page `most`. A bound on `published` goes into the request and
ends a listing's old items before they become rows. A stream's offset is the page and how many of its items
were read, or the last key, for each listing: it goes on there after a restart."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, SimpleDataSourceStreamReader

TIMEOUT = 30


def fetch(request: dict, tries: int = 3, opener=None) -> str | None:
    """Body of one request {url, method, headers, json, required} as text without a byte-order mark."""
    import time
    import urllib.request

    body = json.dumps(request["json"]).encode() if request.get("json") is not None else None
    headers = {"Accept": "application/json, text/plain, */*"} | ({"Content-Type": "application/json"} if body else {}) | (request.get("headers") or {})
    for attempt in range(tries):
        try:
            r = urllib.request.Request(request["url"], data=body, headers=headers, method=request.get("method"))
            with (opener or urllib.request.urlopen)(r, timeout=TIMEOUT) as answer:
                return answer.read().decode("utf-8-sig", "replace")
        except Exception:
            if attempt + 1 == tries:
                if request.get("required", True):
                    raise
                return None
            time.sleep(request.get("pause", 0.5) * (attempt + 1))
    return None


class Pace:
    """The share of one of n tasks in a rate that all of them keep: its turns are n intervals apart, after its own first."""

    def __init__(self, interval: float, n: int = 1, index: int = 0, clock=None, sleep=None):
        import time

        self.clock, self.sleep = clock or time.monotonic, sleep or time.sleep
        self.every, self.first, self.turn = interval * n, interval * index, None

    def wait(self) -> None:
        now = self.clock()
        self.turn = now + self.first if self.turn is None else max(now, self.turn + self.every)
        if self.turn > now:
            self.sleep(self.turn - now)


class _Part(InputPartition):
    def __init__(self, requests: list[dict], n: int = 1, index: int = 0):
        super().__init__(requests)
        self.requests, self.n, self.index = requests, n, index


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "opalyx_http"

    def schema(self) -> str:
        return "source_id string, source_url string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.requests = json.loads(options.get("requests", "[]"))
        self.parts = int(options.get("partitions", 6))
        self.tries = int(options.get("tries", 3))
        self.interval = float(options.get("interval", 0))

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.parts, len(self.requests)))
        return [_Part(self.requests[i::n], n, i) for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pace = Pace(self.interval, partition.n, partition.index)
        for r in partition.requests:
            if self.interval:
                pace.wait()
            yield r.get("source_id"), r["url"], fetch(r, self.tries)


def _at(value, path: str):
    for name in path.split(".") if path else []:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def read_page(listing: dict, place: dict, since: str | None = None, tries: int = 3, opener=None) -> tuple[list[dict], str]:
    """Items of the page at a place {page} or {last}, and its address; none where there is no such page."""
    from urllib.parse import quote

    values = {"page": str(place.get("page", 1)), "last": quote(str(place.get("last") or ""), safe=""), "since": since or ""}
    url = listing["url"]
    for name, value in values.items():
        url = url.replace("{" + name + "}", value)
    body = fetch({"url": url, "required": False, "pause": listing.get("pause", 0.5)} | {k: listing[k] for k in ("headers", "method", "json") if k in listing}, tries, opener)
    try:
        items = _at(json.loads(body), listing.get("items", "")) if body else []
    except ValueError:
        items = []
    return [x for x in items if isinstance(x, dict)] if isinstance(items, list) else [], url


def pages(listing: dict, place: dict, since: str | None = None, budget: int | None = None, tries: int = 3, opener=None) -> Iterator[tuple[dict, str, dict]]:
    """(item, address, place after it) from a place on, until a short page, the listing's last or so many pages."""
    keyset, size, most = "{last}" in listing["url"], int(listing.get("size", 0)), int(listing.get("most", 1_000_000))
    place, read = dict(place), 0
    while (budget is None or read < budget) and place.get("page", 1) <= most:
        items, url = read_page(listing, place, since, tries, opener)
        read += 1
        seen = 0 if keyset else place.get("seen", 0)
        page, full = place.get("page", 1), bool(items) and len(items) >= size
        for n, item in enumerate(items[seen:], seen + 1):
            after = {"page": page + 1, "seen": 0} if full and n == len(items) else {"page": page, "seen": n}
            place = {"last": _at(item, listing["key"])} if keyset else after
            yield item, url, place
        if not full:
            return
        if not keyset:
            place = {"page": page + 1, "seen": 0}


def _rows(listing: dict, place: dict, since: str | None, budget: int | None, tries: int) -> Iterator[tuple[tuple, dict]]:
    for item, url, after in pages(listing, place, since, budget, tries):
        published = _at(item, listing.get("published", "published"))
        day = str(published)[:10] if published else None
        if since and day and day < since:
            continue
        yield (listing.get("source_id"), url, str(_at(item, listing["key"])), day, json.dumps(item, ensure_ascii=False)), after


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "opalyx_pages"

    def schema(self) -> str:
        return "source_id string, source_url string, item_id string, published string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PagedStream(self.options)


class PagedReader(DataSourceReader):
    """A task for each listing, whose pages follow one another."""

    def __init__(self, options: dict):
        self.listings = json.loads(options.get("listings", "[]"))
        self.tries = int(options.get("tries", 3))
        self.since: str | None = options.get("since")
        self.only: str | None = None

    def pushFilters(self, filters: list) -> Iterator:
        """Bounds on published and one source are read by; Spark still applies all of them."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("published",) and isinstance(f.value, str):
                self.since = max(self.since or "", f.value[:10])
            elif isinstance(f, EqualTo) and f.attribute == ("source_id",):
                self.only = f.value
            yield f

    def partitions(self) -> list[InputPartition]:
        return [_Part([x]) for x in self.listings if self.only in (None, x.get("source_id"))] or [_Part([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for listing in partition.requests:
            for row, _ in _rows(listing, {}, self.since, None, self.tries):
                yield row


class PagedStream(SimpleDataSourceStreamReader):
    """Each trigger reads up to `pages` pages of every listing from where the last one ended."""

    def __init__(self, options: dict):
        self.listings = json.loads(options.get("listings", "[]"))
        self.tries, self.budget, self.since = int(options.get("tries", 3)), int(options.get("pages", 5)), options.get("since")

    def initialOffset(self) -> dict:
        return {str(n): {} for n in range(len(self.listings))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, end = [], dict(start)
        for n, listing in enumerate(self.listings):
            for item, url, after in pages(listing, start.get(str(n), {}), self.since, self.budget, self.tries):
                end[str(n)] = after
                out.append((n, item, url))
        return iter([self._row(*x) for x in out]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same items again, after a failure."""
        for n, listing in enumerate(self.listings):
            if start.get(str(n)) == end.get(str(n)):
                continue
            for item, url, after in pages(listing, start.get(str(n), {}), self.since, None, self.tries):
                yield self._row(n, item, url)
                if after == end.get(str(n)):
                    break

    def _row(self, n: int, item: dict, url: str) -> tuple:
        listing = self.listings[n]
        published = _at(item, listing.get("published", "published"))
        return listing.get("source_id"), url, str(_at(item, listing["key"])), str(published)[:10] if published else None, json.dumps(item, ensure_ascii=False)
