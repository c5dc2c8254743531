"""N-gram Jaccard self-join by T-occurrence search, with the components of its links.

Documents with one set of word shingles form a class, met once. A link between classes needs an
overlap of at least T = ceil(share * (n + m) / (1 + share)) of their n and m shingles.

1. Classes: fingerprint of the set, least document, n.
2. Which classes can meet. All shingles have one order: those that a task finds in several of the
   texts it reads together come last, as far as a bounded list of them goes, the others go by their
   hash. Linked sets of n shingles share one of
   their first n - ceil(share * n) + 1 (any order is exact; this one keeps passages that many texts
   hold out of the prefixes). From BUCKET_SHARE on, and below it in bands from BUCKET_SIZE on, sets meet by
   buckets instead: linked sets differ in
   at most d shingles of a band's size, shingles are dealt by hash into M > d buckets, so linked sets
   hold some bucket alike; empty buckets, and those of frequent shingles alone, say little, so M
   leaves room for them: a set gives the latter too where both are more than that room, and the former where
   they alone are. A long set's prefix has hundreds of shingles, of which in a growing
   corpus ever more sets hold one; a bucket alike takes all that either set has there. A set gives its prefix, or its buckets' contents as hashes, in its own band of sizes and in the next, where
   it is a node of its own: linked sets have one of the two bands in common, and chains that ran on
   from band to band would tie most sets together. Nodes with an entry in common are chained, tasks
   chaining their own first and passing on one set for each entry, so an entry's rows number the
   tasks, not the documents. The connected pieces of the chains hold all links between them.
3. A piece of more than one block is first met by hubs: in each round a few of its nodes are compared
   with all of it, row by row, and what links to a hub that is tied to the piece's core joins the
   core. So a large group of near copies becomes one core in time that follows its size. Rounds go
   on while they shrink what is left open.
4. Only pairs with an open node can still lack a link that matters. Open nodes are dealt out in
   blocks, which meet each other and the blocks of the core; a pair of blocks is a search
   (DivideSkip): a document's longest inverted lists are set aside, its short ones are merged by a
   heap, and what occurs there is looked up by binary search in the rest; documents that reach T are
   linked. Pairs already connected in that block pair are skipped; what is returned is a
   forest of true links, no list of pairs. In a piece of long sets, which many short passages tie
   together, blocks first meet with a fifth of the hash space of each set: that bounds an overlap
   from above, so most pairs are certain not to be linked, and what can be linked forms smaller
   pieces. A piece without a large core that doesn't fall apart still costs the square of its open blocks.
5. Components of the links; each gets its least document.

Defined results: null or empty text, or white space alone: no shingles, n_shingles 0, component_id
the own doc_id; rows that repeat an id keep a row each; a null doc_id counts after all others, and
a component without any id has none; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opalyx.llm.common import release, texts
from opalyx.llm.graph import components
from opalyx.runtime import discard, ship, with_keys, written

WORDS, SHARE = 3, 90
BLOCK_ROWS, BLOCK_SHINGLES = 512, 200_000
#: Share from which classes meet by their buckets instead of prefixes: a bucket then holds six shingles or more.
BUCKET_SHARE = 85
#: First size of the bands that meet by buckets whatever the share.
BUCKET_SIZE = 100
#: Texts that hold a shingle, as far as tasks have met it more than once, from which it says little in a bucket.
FREQUENT = 16
#: Hubs of a piece in a round; rounds end when they shrink the open nodes by less than this share.
HUBS, SHRINK = 4, 0.125
#: Shingles of a set, on average, from which a piece of several blocks goes through the sieve.
LONG_SET = 100
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_set(text: Column, words: int = WORDS) -> Column:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence where it has fewer words."""
    tokens = F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[ \\t-\\r]+"), lambda w: w != "")

    def hashed(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
        whole = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))
        return F.when(F.size(w) >= words, F.sort_array(F.array_distinct(each))).otherwise(whole)

    return F.transform(F.array(tokens), hashed)[0]  # the lambda binds the words once


def _fingerprint(hashes: Column) -> Column:
    return F.concat_ws(":", F.xxhash64(F.lit(1), hashes).cast("string"), F.xxhash64(F.lit(2), hashes).cast("string"))


def class_of(text: Column, words: int) -> Column:
    """The class of a text: fingerprint of its shingle set, null without words."""
    return F.transform(F.array(shingle_set(F.coalesce(text.cast("string"), F.lit("")), words)), lambda s: F.when(F.size(s) > 0, _fingerprint(s)))[0]


def required(n: np.ndarray | int, share: int) -> np.ndarray | int:
    return -((-n * share) // 100)


def overlaps_enough(inter: int, a: int, b: int, share: int) -> bool:
    return 100 * inter >= share * (a + b - inter)


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _ranked(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Each set as the sorted places of its hashes in the order of their inverted lists' lengths, shortest first."""
    u, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(u), "i4")
    place[np.lexsort((u, n))] = np.arange(len(u), dtype="i4")
    return [np.sort(x) for x in np.split(place[at], np.cumsum([len(x) for x in sets])[:-1])]


def divide_skip(sets: list[np.ndarray], queries: list[int], indexed: list[int], share: int = SHARE, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of true links between queries and indexed sets (positions in sets; distinct hashes).

    A set's lists are divided: as many of the longest as the overlap allows to set aside are long, the
    rest short, for queries and indexed sets alike, so linked sets meet in a list that is short for
    both. The heap merges a query's short lists in order of document; what occurs there is looked up
    by binary search in the rest. Documents with the query's label are known to be connected with it.
    """
    if not queries or not indexed:
        return []
    label = np.arange(len(sets)) if label is None else label
    ranked = _ranked(sets)
    short = [r[: len(r) - int(required(len(r), share)) + 1].tolist() for r in ranked]
    found: dict[int, list[int]] = {}
    for d in indexed:  # ascending, so lists are sorted
        for x in short[d]:
            found.setdefault(x, []).append(d)
    lists = {x: np.asarray(v) for x, v in found.items()}
    links = []
    for q in queries:
        own, n = ranked[q], len(ranked[q])
        runs = [run.tolist() for x in short[q] if x in lists and len(run := lists[x][label[lists[x]] != label[q]])]
        heads = [(run[0], i, 0) for i, run in enumerate(runs)]
        heapq.heapify(heads)
        while heads:
            d = heads[0][0]
            while heads and heads[0][0] == d:
                _, i, at = heads[0]
                if at + 1 < len(runs[i]):
                    heapq.heapreplace(heads, (runs[i][at + 1], i, at + 1))
                else:
                    heapq.heappop(heads)
            m = len(ranked[d])
            if min(n, m) < math.ceil(share * (n + m) / (100 + share)) or label[d] == label[q]:
                continue
            at = np.searchsorted(ranked[d], own)
            at[at == m] = 0
            if overlaps_enough(int(np.count_nonzero(ranked[d][at] == own)), n, m, share):
                label[label == label[q]] = label[d]
                links.append((q, d))
    return links


def bands(longest: int, share: int = SHARE) -> np.ndarray:
    """First sizes of the bands up to a size; a set of a band links with none beyond the next."""
    lows = [1]
    while lows[-1] <= longest:
        lows.append(max(lows[-1], (100 * lows[-1]) // share) + 1)
    return np.asarray(lows)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_table(longest: int, share: int = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sizes of the bands up to a size, and for each its buckets and the room for empty ones."""
    lows, buckets, rooms = [], [], []
    low = 1
    while True:
        high = max(low, (100 * low) // share)  # a set of a band links with none beyond the next
        d = (2 * high * (100 - share)) // (100 + share)
        m, room = d + 1, 0
        for _ in range(6 if d else 0):
            empty = m * math.exp(-low / m)
            room = math.ceil(1.5 * empty + 2 * math.sqrt(empty))
            m = d + 1 + room
        lows.append(low)
        buckets.append(m)
        rooms.append(room)
        if low > longest:
            return np.asarray(lows), np.asarray(buckets), np.asarray(rooms)
        low = high + 1


def _often(s: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of some hashes are among the sorted ones, and where."""
    at = np.searchsorted(hashes, s)
    at[at == len(hashes)] = 0
    return hashes[at] == s if len(hashes) else np.zeros(len(s), bool), at


def signatures(s: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray], common: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """The band of a set of 64-bit hashes, its signatures there and in the next band; common: sorted hashes that say little."""
    lows, buckets, rooms = table
    own = int(np.searchsorted(lows, len(s), "right")) - 1
    s = np.sort(s.view("u8"))
    h = _mix(s)
    order = np.argsort(h)
    h = h[order]
    rare = None if common is None else ~_often(s.view("i8"), common)[0][order]
    made = []
    for band in (own, own + 1):
        m, room = int(buckets[band]), int(rooms[band])
        # the bucket by the high half of the hash; content as the sum of spread hashes
        which = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        content = np.add.reduceat(_mix(h + np.uint64(0x9E3779B97F4A7C15)), starts)
        used = which[starts]
        tag = np.uint64(band << 34)
        entries = _mix(content ^ _mix(tag + used))
        telling = np.ones(len(used), bool) if rare is None else np.logical_or.reduceat(rare, starts)
        out = [entries if m - np.count_nonzero(telling) > room else entries[telling]]
        if m - len(used) > room:
            empty = np.setdiff1d(np.arange(m, dtype="u8"), used, assume_unique=True)
            out.append(_mix(_mix(tag + empty) + np.uint64(0xD6E8FEB86659FD93)))
        made.append(np.concatenate(out).view("i8"))
    return own, *made


def prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], share: int) -> np.ndarray:
    """The first n - ceil(share * n) + 1 of a set of n hashes, common ones last; common: (sorted hashes, places among themselves)."""
    k = len(s) - int(required(len(s), share)) + 1
    hashes, places = common
    often, at = _often(s, hashes)
    rare = s[~often]
    if len(rare) > k:
        return np.partition(rare, k - 1)[:k]
    return np.concatenate([rare, s[often][np.argsort(places[at[often]])[: k - len(rare)]]])


def common_shingles(sets: DataFrame, most: int = 1_000_000, together: int = 1_500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that recur among the texts a task reads together, at most so many of the commonest, from the rarest on:
    (sorted hashes, places, sorted hashes of the frequent ones). sets: h, s of every row. All rows are met, but what
    comes of it only sets an order and what buckets are told apart by; links are the same whatever it is."""

    def recur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def counted() -> pa.RecordBatch:
            x = np.concatenate(held)
            held.clear()
            x.sort()
            again = x[1:][x[1:] == x[:-1]]  # a shingle of n texts is here n - 1 times
            x, n = np.unique(again, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(n + 1, pa.int64())], ["x", "n"])

        for batch in batches:
            for h, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if h in seen or not len(s):
                    continue
                seen.add(h)
                held.append(np.asarray(s.values, "i8"))
                size += len(held[-1])
                if size >= together:
                    yield counted()
                    size = 0
                    seen.clear()
        if size:
            yield counted()

    each = sets.select("h", "s").mapInArrow(recur, "x long, n long").groupBy("x").agg(F.sum("n").alias("n"))
    got = each.orderBy(F.desc("n"), "x").limit(most).toArrow()
    hashes, n = np.asarray(got.column("x"), "i8")[::-1], np.asarray(got.column("n"), "i8")[::-1]
    order = np.argsort(hashes)
    return hashes[order], order.astype("i4"), np.sort(hashes[n >= FREQUENT])


def _in_band(h: Column, band: Column) -> Column:
    """A class as a node of a band."""
    return F.xxhash64(h, band)


def classes(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(members, reps). members: doc_id, fp, h, n, t, band, prefix, next for each row, the last three once for each class and
    task; next, the entries in the next band, only where they differ.
    reps: node, fp, h, n, band, doc_id (the least), t. h is half a fingerprint, t the hash of a row's text."""
    ship(docs.sparkSession)
    s = texts(docs).select("doc_id", F.xxhash64("text").alias("t"), shingle_set(F.col("text"), words).alias("s")).withColumn("h", F.xxhash64(F.lit(1), "s"))
    by_buckets = share >= BUCKET_SHARE
    common = docs.sparkSession.sparkContext.broadcast(None if by_buckets else common_shingles(s))

    def entries(s: np.ndarray, lows: np.ndarray, table: tuple) -> tuple[int, np.ndarray, np.ndarray | None]:
        if by_buckets:
            return signatures(s, table)
        own = int(np.searchsorted(lows, len(s), "right")) - 1
        if lows[own] >= BUCKET_SIZE:
            return signatures(s, table, common.value[2])
        first = prefix(s, common.value[:2], share)
        return own, first, signatures(s, table, common.value[2])[2] if lows[own + 1] >= BUCKET_SIZE else None

    def sign(batches: Iterator[pa.RecordBatch], remembered: int = 50_000) -> Iterator[pa.RecordBatch]:
        release()
        lows, table, seen = bands(1 << 12, share), bucket_table(1 << 12, share), set()
        for batch in batches:
            fps, ns, band, made, after = batch.column(1).to_pylist(), batch.column(3).to_pylist(), [], [], []
            for fp, n, s in zip(fps, ns, batch.column(5), strict=True):
                if n == 0 or fp in seen:
                    band.append(None)
                    made.append(None)
                    after.append(None)
                    continue
                if n >= lows[-2]:
                    lows, table = bands(2 * n, share), bucket_table(2 * n, share)
                values = np.asarray(s.values, "i8")
                own, first, second = entries(values, lows, table)
                band.append(own)
                made.append(first)
                after.append(second)
                if len(seen) < remembered:
                    seen.add(fp)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(band, pa.int32()), pa.array(made, pa.list_(pa.int64())), pa.array(after, pa.list_(pa.int64()))], ["doc_id", "fp", "h", "n", "t", "band", "prefix", "next"])

    n = F.size("s")
    made = s.select("doc_id", F.when(n > 0, _fingerprint(F.col("s"))).alias("fp"), "h", n.cast("long").alias("n"), "t", "s")
    members = written(made.mapInArrow(sign, "doc_id long, fp string, h long, n long, t long, band int, prefix array<long>, next array<long>"), "members")
    reps = members.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("t", "doc_id"), F.min("t")).alias("t"), F.first("n").alias("n"), F.first("h").alias("h"), F.max("band").alias("band")).withColumn("node", F.monotonically_increasing_id())
    return members, written(reps, "classes")


def _planes(x: np.ndarray) -> bytes:
    """Bytes of integers by place, so that leading zeros lie together and compress."""
    return x.view("u1").reshape(-1, x.itemsize).T.tobytes()


def _from_planes(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(width, -1).T).view(dtype).ravel()


def _chained(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries in order, the first node of each, and edges from each node to the next of its entry."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    head = np.concatenate([[True], sig[1:] != sig[:-1]])
    again = np.flatnonzero(~head[1:] & (node[1:] != node[:-1]))
    pairs = np.unique(np.stack([node[again], node[again + 1]], 1), axis=0)
    return sig[head], node[head], pairs


def chain_edges(members: DataFrame, per_part: int = 150_000) -> DataFrame:
    """Edges (a, b) between nodes of bands, whose connected pieces hold all links.

    Prefix entries, mixed with their band, are dealt into parts by range. A task sends each part one row
    of sorted entries, 48 bits of each, as differences, with their nodes, about 6 bytes for an entry. Entries that
    are alike in these bits by chance only add an edge."""
    spark = members.sparkSession
    total = members.agg(F.coalesce(F.sum(F.size("prefix") + F.size(F.coalesce("next", "prefix"))), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // per_part))

    def combine(batches: Iterator[pa.RecordBatch], limit: int = 300_000) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sig, node, pairs = _chained(np.concatenate(sigs), np.concatenate(nodes))
            part = (sig >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(parts + 1, dtype="u8"))
            rows = []
            for k in range(parts):
                own, at = slice(cuts[k], cuts[k + 1]), k * len(pairs) // parts
                edges = pairs[at : (k + 1) * len(pairs) // parts]
                if cuts[k] == cuts[k + 1] and not len(edges):
                    continue
                names, index = np.unique(node[own], return_inverse=True)
                rows.append((k, _planes(np.diff(sig[own], prepend=np.uint64(0))), _planes(index.astype("<u4")), names.tobytes(), np.ascontiguousarray(edges).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 4), strict=True)], ["part", "sigs", "index", "names", "edges"])

        for batch in batches:
            band = np.asarray(batch.column(2), "u8")
            for k in (0, 1):
                column = batch.column(3 + k)
                lens = np.asarray(column.value_lengths().fill_null(0), "i8")
                entries = np.asarray(column.flatten(), "i8").view("u8")
                sigs.append(_mix(entries ^ np.repeat(_mix(band + np.uint64(k + 1)), lens)) >> np.uint64(16))
                nodes.append(np.repeat(np.asarray(batch.column(k), "i8"), lens))
                size += len(entries)
            if size >= limit:
                yield flush()
                sigs, nodes, size = [], [], 0
        if size:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        sig = [np.cumsum(_from_planes(x.as_py(), "<u8"), dtype="u8") for x in table.column("sigs")]
        node = [np.frombuffer(n.as_py(), "i8")[_from_planes(i.as_py(), "<u4")] for n, i in zip(table.column("names"), table.column("index"), strict=True)]
        pairs = [np.frombuffer(e.as_py(), "i8").reshape(-1, 2) for e in table.column("edges")]
        pairs = np.unique(np.concatenate([_chained(np.concatenate(sig), np.concatenate(node))[2], *pairs]), axis=0) if sum(map(len, sig)) else np.unique(np.concatenate(pairs), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    held = members.filter("prefix IS NOT NULL").select(_in_band(F.col("h"), F.col("band")).alias("node"), _in_band(F.col("h"), F.col("band") + 1).alias("node2"), "band", "prefix", F.coalesce("next", "prefix").alias("next"))
    packed = held.mapInArrow(combine, "part long, sigs binary, index binary, names binary, edges binary")
    return packed.groupBy("part").applyInArrow(meet, "a long, b long")


def with_text_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """wanted (node, doc_id, t, ...) with the set s of their text; only these texts are shuffled, each id and text once."""
    pair = lambda i, t: F.xxhash64(i, F.isnull(i), t)
    own = texts(docs).withColumn("t", F.xxhash64("text")).withColumn("p", pair("doc_id", "t")).drop("doc_id")
    wanted = wanted.withColumn("p", pair("doc_id", "t")).drop("doc_id")
    own = with_keys(own, wanted.select("p", "t").distinct(), ["p", "t"], "left_semi").dropDuplicates(["p", "t"])
    return own.join(wanted, ["p", "t"]).withColumn("s", shingle_set(F.col("text"), words)).drop("p", "t", "text")


def _blocks(rows: Column, shingles: Column, block_rows: int, block_shingles: int) -> Column:
    return F.greatest(F.ceil(rows / block_rows), F.ceil(F.coalesce(shingles, F.lit(0)) / block_shingles)).cast("int")


def _small(df: DataFrame, size, most_rows: int = 20_000, most_bytes: int = 32_000_000) -> DataFrame:
    """df to be sent to all tasks where it is counted to be small; size: bytes of a row's arrays."""
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) + size), F.lit(0))).first()
    return F.broadcast(df) if n <= most_rows and held <= most_bytes else df


def hub_links(sets: DataFrame, share: int, block_rows: int, block_shingles: int) -> tuple[DataFrame, list[DataFrame]]:
    """(cores, links). sets: component, node, n, s of the pieces to be met by hubs. cores: component, node, core (whether
    connected with all else of the core); links: tables (a, b) of true links that connect each core."""
    nodes, links, open_before = sets.select("component", "node", "n", F.lit(False).alias("core")), [], None
    while True:
        per = nodes.groupBy("component").agg(F.count_if(~F.col("core")).alias("open"), _blocks(F.count("*"), F.sum("n"), block_rows, block_shingles).alias("blocks"), F.count_if("core").alias("held"))
        per = written(per.filter((F.col("open") > 0) & (F.col("blocks") > 1)), "open")
        n_open = per.agg(F.coalesce(F.sum("open"), F.lit(0))).first()[0]
        if not n_open or (open_before is not None and n_open > (1 - SHRINK) * open_before):
            return nodes, links
        open_before = n_open
        order = Window.partitionBy("component").orderBy(F.xxhash64("node", F.lit(len(links))), "node")
        picked = nodes.filter(~F.col("core")).join(per.select("component"), "component", "left_semi").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= HUBS)
        hubs = _small(picked.select("component", "node"), 0).join(sets, ["component", "node"]).groupBy("component").agg(F.collect_list(F.struct(F.col("node").alias("hub"), "n", "s")).alias("hubs"))
        both = F.size(F.array_intersect("s", F.col("x.s"))).cast("long")
        hubs = written(hubs, "hubs")
        met = sets.join(_small(hubs, F.aggregate("hubs", F.lit(0).cast("long"), lambda a, x: a + 8 * x["n"])), "component").select("component", "node", "n", "s", F.explode("hubs").alias("x")).select("component", "node", F.col("x.hub").alias("hub"), (F.col("n") + F.col("x.n")).alias("sum"), both.alias("both"))
        near = written(met.filter(100 * F.col("both") >= share * (F.col("sum") - F.col("both"))).select("component", "node", "hub"), "near")
        # A hub is tied to the core by a link with it; where there is no core yet, the hub with most links starts it.
        stars = near.join(nodes.select("component", "node", "core"), ["component", "node"]).groupBy("component", "hub").agg(F.count("*").alias("links"), F.max("core").alias("tied"))
        best = stars.groupBy("component").agg(F.max(F.struct("links", "hub"))["hub"].alias("best"))
        tied = stars.join(best, "component").join(per.select("component", "held"), "component").filter(F.col("tied") | ((F.col("held") == 0) & (F.col("hub") == F.col("best")))).select("component", "hub")
        star = written(near.join(tied, ["component", "hub"]), "star")
        joined = star.select("component", "node", F.lit(True).alias("now")).distinct()
        nodes = written(nodes.join(joined, ["component", "node"], "left").select("component", "node", "n", (F.col("core") | F.coalesce("now", F.lit(False))).alias("core")), "cores")
        links.append(star.filter(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")))


def _placed(members: DataFrame, sides: DataFrame) -> DataFrame:
    """Nodes of pieces (component, node, core, ...) with their block and the blocks it meets (with). sides: component, open
    and held, the numbers of blocks of open nodes and of the core. Open blocks come first. An open block meets every
    block once, itself included; blocks of the core meet open ones alone. No set is moved for this."""
    block = F.when(F.col("core"), F.col("open") + F.pmod(F.xxhash64("node"), F.greatest("held", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("open"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("core"), F.col("open")).otherwise(F.col("open") + F.col("held")) - 1)
    return members.join(sides, "component").withColumn("block", block).withColumn("with", other)


def _dealt(placed: DataFrame, carried: list[str]) -> DataFrame:
    """A row for each pair (i, j) of blocks that a node goes to."""
    met = placed.withColumn("other", F.explode("with"))
    return met.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "core", "node", "open", "held", *carried)


def sieve(sets: list[np.ndarray], n: np.ndarray, left: list[int], right: list[int], label: np.ndarray, share: int) -> list[tuple[int, int]]:
    """A forest of pairs that can be linked, judged by a part of the hash space: sets are what n shingles each have there.

    What two sets have in common is at most what they have in common there and the rest of the smaller one. Sets with one
    label are known to be connected."""
    if not left or not right:
        return []
    owner = np.repeat(np.asarray(right), [len(sets[d]) for d in right])
    flat = np.concatenate([sets[d] for d in right])
    order = np.argsort(flat, kind="stable")
    u, first, many = np.unique(flat[order], return_index=True, return_counts=True)
    owner, place, rest, out = owner[order], np.asarray(right), n - np.asarray([len(x) for x in sets]), []
    for q in left:
        apart = label[place] != label[q]
        if not apart.any():
            continue
        at = np.searchsorted(u, sets[q])
        at = at[u[np.minimum(at, len(u) - 1)] == sets[q]] if len(u) else at[:0]
        lens = many[at]
        met = owner[np.repeat(first[at] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
        common = np.bincount(met, minlength=len(sets))[place]
        m = n[place]
        need = -((-share * (n[q] + m)) // (100 + share)) - np.minimum(rest[q], rest[place])
        for d in place[apart & (common >= need) & (100 * np.minimum(n[q], m) >= share * np.maximum(n[q], m))]:
            if label[d] != label[q]:
                label[label == label[q]] = label[d]
                out.append((q, int(d)))
    return out


def sieved_pairs(sets: DataFrame, cores: DataFrame, share: int, block_rows: int, block_shingles: int) -> DataFrame:
    """(a, b): pairs that connect all nodes of a piece that can be linked. Blocks meet with a fifth of the hash space, in 32
    bits, of each set, by which it is certain of most pairs that they can't."""
    part = F.transform(F.filter("s", lambda x: F.pmod(x, F.lit(5)) == 0), lambda x: F.shiftright(x, 32).cast("int"))
    # the part is taken before anything is shuffled
    parts = written(sets.select("component", "node", F.col("n").cast("long").alias("n"), part.alias("s")), "parts")
    sides = cores.groupBy("component").agg(*(_blocks(F.count_if(c), F.sum(F.when(c, F.col("n"))) / 5, 4 * block_rows, block_shingles).alias(a) for a, c in (("open", ~F.col("core")), ("held", F.col("core")))))

    def search(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        node, block, core, n = (table.column(x).to_pylist() for x in ("node", "block", "core", "n"))
        parts = [np.sort(np.asarray(s.values, "i4")) for s in table.column("s")]
        left = [k for k, x in enumerate(block) if x == i]
        right = left if i == j else [k for k, x in enumerate(block) if x == j]
        label = np.arange(len(parts))
        held = np.flatnonzero(core)
        label[held] = held[:1].sum()
        found = sieve(parts, np.asarray(n), left, right, label, share)
        return pa.table({"a": pa.array([node[x] for x, _ in found], pa.int64()), "b": pa.array([node[y] for _, y in found], pa.int64())})

    placed = written(_placed(cores.select("component", "node", "core"), sides.filter("open > 0")), "placed")
    members = parts.join(_small(placed, 4 * F.size("with") + 40), ["component", "node"])
    return _dealt(members, ["n", "s"]).groupBy("component", "i", "j").applyInArrow(search, "a long, b long")


def true_links(docs: DataFrame, reps: DataFrame, pieces: DataFrame, words: int, share: int, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES, long_set: int = LONG_SET) -> DataFrame:
    """(a, b): links between classes that connect what is linked within each piece (nodes of bands, component)."""
    banded = reps.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).withColumn("key", _in_band(F.col("h"), F.col("band"))).drop("band", "h")
    size = written(pieces.withColumnRenamed("node", "key").join(banded, "key").select("component", "node", "n", "doc_id", "t"), "pieces")
    per = size.groupBy("component").agg(_blocks(F.count("*"), F.sum("n"), block_rows, block_shingles).alias("blocks"), (F.avg("n") >= long_set).alias("long"))
    per = per.filter("blocks > 1").select("component", "long")
    large = written(size.join(per, "component"), "large")
    sets = written(with_text_sets(docs, large, words), "sets")
    cores, links = hub_links(sets, share, block_rows, block_shingles)
    core = F.coalesce("core", F.lit(False))
    only = written(large.filter("long").select("component").distinct(), "long")
    if not only.isEmpty():
        can = sieved_pairs(sets.join(only, "component", "left_semi"), cores.join(only, "component", "left_semi"), share, block_rows, block_shingles)
        for more in links:
            can = can.unionByName(more)
        # Such a piece falls into smaller ones, with its core in one of them; a node in none has no link.
        apart = large.join(only, "component", "left_semi").drop("component", "long").join(components(can), "node")
        size = written(size.join(only, "component", "left_anti").unionByName(apart), "apart")
    of = size.join(cores.select("node", "core"), "node", "left").withColumn("core", core)
    sides = of.groupBy("component").agg(*(_blocks(F.count_if(c), F.sum(F.when(c, F.col("n"))), block_rows, block_shingles).alias(a) for a, c in (("open", ~F.col("core")), ("held", F.col("core")))))
    placed = written(_placed(of, sides.filter("open > 0")), "placed")
    dealt = _dealt(with_text_sets(docs, placed, words), ["s"])
    # Pieces of one block share rooms, each of about a block's shingles.
    rooms = max(1, -(-size.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // block_shingles))
    single = F.col("open") + F.col("held") == 1
    dealt = dealt.withColumn("room", F.when(single, F.pmod(F.xxhash64("component"), F.lit(rooms))).otherwise(F.col("component"))).withColumn("single", single)

    def search(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        pieces: dict[int, list] = {}
        for piece, node, block, core, s in zip(*(table.column(x).to_pylist() for x in ("component", "node", "block", "core")), table.column("s"), strict=True):
            pieces.setdefault(piece, []).append((np.asarray(s.values, "i8"), node, block, core))
        links = []
        for rows in pieces.values():
            rows.sort(key=lambda x: (len(x[0]), x[1]))
            left = [k for k, x in enumerate(rows) if x[2] == i]
            right = left if i == j else [k for k, x in enumerate(rows) if x[2] == j]
            label = np.arange(len(rows))
            held = [k for k, x in enumerate(rows) if x[3]]
            label[held] = held[0] if held else 0
            links += [(rows[x][1], rows[y][1]) for x, y in divide_skip([x[0] for x in rows], left, right, share, label)]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    found = dealt.drop("open", "held").groupBy("single", "room", "i", "j").applyInArrow(search, "a long, b long")
    for more in links:
        found = found.unionByName(more)
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, share: int = SHARE, block_rows: int = BLOCK_ROWS, long_set: int = LONG_SET) -> DataFrame:
    """A row for each document: doc_id, fp (of its set, null if empty), n_shingles, component_id, node_component (a component's own key)."""
    ship(docs.sparkSession)
    members, reps = classes(docs, words, share)
    pieces = components(chain_edges(members))
    # the prefixes are used up
    slim = written(members.select("doc_id", "fp", "n"), "documents")
    discard(members)
    members = slim
    linked = components(true_links(docs, reps, pieces, words, share, block_rows, long_set=long_set))
    named = reps.select("node", "fp", "doc_id").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = written(named.join(least, "component").select("fp", "component_id", F.col("component").alias("node_component")), "components")
    return members.join(by_class, "fp", "left").select("doc_id", "fp", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node_component")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
