"""Periodic runs of words: branching tandem repeats of a suffix tree, rotated and merged.

A run is a stretch of words with smallest period q, of at least max(12, 2 q) words, that no
neighbouring word extends. Tasks take documents whole, a few hundred thousand words at a time.

1. Cover. At least GRAM words of a run recur q words on, so its words all lie in repeated stretches
   of GRAM words. What such stretches, equal in hash and within one document, cover is cut into
   segments; the same within each segment, until nothing more falls away. A run lies in one segment,
   and hashes that collide only leave more to look at.
2. Suffix tree. Segments have letters of their own, so one suffix array of all (prefix doubling) holds
   the tree of each; its internal nodes are the intervals of equal least common prefix.
3. Stoye and Gusfield: of each node of depth D the leaf lists of all children but the largest are
   walked, n log n leaves in all. Leaves i and i + D under the node whose next words differ are a
   branching tandem repeat, the last square of a run that ends at i + 2 D.
4. Rotation to the left as far as words agree gives the run's start; repeats with one end whose
   period is a multiple of a shorter one's are the same run.

Memory follows the longest document: some 30 numbers for each word that repeats.

Defined results: null and empty texts have no words and no runs; a null doc_id stays null and its
words are as they are; each of several rows with one id has its own result; ties for the longest run
go to the smaller start, then period; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from opalyx.llm.common import texts
from opalyx.runtime import ship

LEAST, GRAM = 12, 6
#: Words of documents that are looked at together, and leaves of a walk that are held at a time.
WORDS_AT_ONCE, LEAVES_AT_ONCE = 300_000, 1_000_000
_WORD = re.compile("[^ \t-\r]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], "u8")


def _covered(words: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which words lie in a stretch of GRAM words that occurs twice in its part."""
    n = len(words) - GRAM + 1
    out = np.zeros(len(words) + 1, np.int32)
    if n <= 0:
        return out[:-1] > 0
    h = part[:n].astype("u8") * _ODD[GRAM]
    for k in range(GRAM):
        h += words[k : k + n] * _ODD[k]
    at = np.flatnonzero(part[:n] == part[GRAM - 1 :])
    order = at[np.argsort(h[at])]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    out[twice] += 1
    out[twice + GRAM] -= 1
    return np.cumsum(out[:-1]) > 0


def segments(words: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that runs can hold, and the segment of each; parts are numbered in order."""
    place = np.arange(len(words))
    while True:
        inside = _covered(words, part)
        if inside.all():
            return place, part
        words, place, part = words[inside], place[inside], part[inside]
        cuts = np.ones(len(place), np.int64)
        cuts[1:] = (np.diff(place) > 1) | (np.diff(part) != 0)
        part = np.cumsum(cuts)


def suffix_array(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, the place of each, and the common prefix of each with the one before it."""
    n = len(code)
    place, k, held = code.astype(np.int64), 1, []
    while True:
        key = place * (n + 1)
        key[: n - k] += place[k:] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        held.append(np.append(place, -1).astype(np.int32))
        place = new
        if new[order[-1]] == n - 1:
            break
        k *= 2
    a, b = order[:-1], order[1:]
    shared = np.zeros(n - 1, np.int64)
    for j in reversed(range(len(held))):
        equal = held[j][np.minimum(a + shared, n)] == held[j][np.minimum(b + shared, n)]
        shared[equal] += 1 << j
    return order, place, np.concatenate([[0], shared])


def nodes(shared: np.ndarray) -> np.ndarray:
    """Internal nodes as rows: depth, first and last leaf, first leaf and size of the largest child."""
    out, stack = [], []
    for i, depth in enumerate([*shared[1:].tolist(), 0], 1):
        low, size = i - 1, 1
        while stack and stack[-1][0] >= depth:
            top = stack[-1]
            if size > top[3]:
                top[2], top[3] = low, size
            if top[0] == depth:
                break
            stack.pop()
            out.append((top[0], top[1], i - 1, top[2], top[3]))
            low, size = top[1], i - top[1]
        if depth and (not stack or stack[-1][0] < depth):
            stack.append([depth, low, low, size])
    return np.array(out, np.int64).reshape(-1, 5)


def branching(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching tandem repeats."""
    n = len(code)
    order, place, shared = suffix_array(code)
    tree = nodes(shared)
    sizes = tree[:, 2] - tree[:, 1] + 1 - tree[:, 4]
    ends = np.cumsum(sizes)
    letter = np.append(code, -1)
    starts, periods, done = [], [], 0
    while done < len(tree):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + LEAVES_AT_ONCE)))
        own = np.repeat(np.arange(done, upto), sizes[done:upto])
        t = np.arange(len(own)) - np.repeat(ends[done:upto] - sizes[done:upto] - (ends[done - 1] if done else 0), sizes[done:upto])
        depth, low, high, child, most = tree[own].T
        i = order[low + t + np.where(low + t >= child, most, 0)]
        for j, first in ((i + depth, i), (i - depth, i - depth)):
            within = (j >= 0) & (j < n)
            at = place[np.where(within, j, 0)]
            ok = within & (at >= low) & (at <= high)
            f, d = first[ok], depth[ok]
            ok = letter[np.minimum(f + d, n)] != letter[np.minimum(f + 2 * d, n)]
            starts.append(f[ok])
            periods.append(d[ok])
        done = upto
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)]), axis=1)
    return both[0], both[1]


def _rotated(code: np.ndarray, start: int, period: int) -> int:
    """The first word from which on words agree with those a period later."""
    step = 32
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(code[low:start] != code[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 4
    return 0


def runs_in(code: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least LEAST words."""
    start, period = branching(code)
    low = start.copy()
    for _ in range(LEAST - 2):  # short periods: only what can be rotated up to LEAST words
        more = (start + 2 * period - low < LEAST) & (low > 0)
        more &= code[np.maximum(low - 1, 0)] == code[np.minimum(np.maximum(low - 1, 0) + period, len(code) - 1)]
        low = low - more
    keep = start + 2 * period - low >= LEAST
    end = (start + 2 * period)[keep]
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for q, e in sorted(zip(period[keep].tolist(), end.tolist(), strict=True)):
        if not any(q % p == 0 and e - 2 * q >= s for s, p in found[e]):
            found[e].append((_rotated(code, e - 2 * q, q), q))
    return [(s, e - s, q) for e, those in found.items() for s, q in those]


def runs_of(documents: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document's words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(w) for w in documents], np.int64)
    total = int(sizes.sum())
    hashes = np.fromiter((hash(w) for words in documents for w in words), np.int64, total).astype("u8")
    first = np.cumsum(sizes) - sizes
    place, part = segments(hashes, np.repeat(np.arange(len(documents)), sizes))
    if not len(place):
        return out
    doc = np.searchsorted(np.cumsum(sizes), place, "right")
    ids = defaultdict(count().__next__)
    exact = np.array([ids[documents[d][k]] for d, k in zip(doc.tolist(), (place - first[doc]).tolist(), strict=True)], np.int64)
    _, code = np.unique(part * (len(ids) + 1) + exact, return_inverse=True)
    for s, length, q in runs_in(code):
        d = int(doc[s])
        out[d].append((int(place[s] - first[d]), length, q))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that are left when each run keeps its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for s, length, q in runs:
            gone[s + q] += 1
            gone[s + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
    return " ".join(words)


def repeated_tail(doc_id: int | None, words: list[str]) -> list[str]:
    """The words with a periodic tail where the id's hash says so."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _row(doc_id: int | None, words: list[str], runs: list[tuple[int, int, int]], whole: bool) -> tuple:
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    rest = collapsed(words, runs)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    outputs = ([{"start": s, "length": length, "period": q} for s, length, q in runs], rest) if whole else (None, None)
    return (doc_id, len(runs), *told, sha(listed), sha(rest), *outputs)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prepare=None, whole: bool = True, words_at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """Each document's runs, the longest one, digests, and the text without what repeats.

    prepare: words of (doc_id, words), before runs are looked for. whole: with the columns runs and collapsed, else null."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            found = runs_of([w for _, w in held])
            rows = [_row(i, w, r, whole) for (i, w), r in zip(held, found, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                words, i = _WORD.findall(text.as_py()), i.as_py()
                held.append((i, prepare(i, words) if prepare else words))
                size += len(words) + 20
                if size >= words_at_once:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return texts(docs, id_col, text_col).mapInArrow(run, _DDL)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), prepare=repeated_tail, whole=False).drop("runs", "collapsed")
