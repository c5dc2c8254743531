"""Packing of token sequences by non-negative least squares over shallow length combinations.

A document's ids are cut at every full window; what is left over (1 to window - 1 ids) is packed in
blocks of many documents:

1. enumerate the pairs, and for each length a few triples, of lengths present that fill a window;
2. solve how often to repeat each combination against the histogram of lengths, with repeats >= 0
   (accelerated projected gradient on the least-squares problem);
3. round down, then up where lengths are left, and give each combination its documents;
4. pack the rest greedily, longest first, cutting a document where a window is full.

Blocks follow one another within a partition; the open window of one block is handed on to the
next, so a partition ends with at most one window that isn't full. Memory is bounded by a block of
documents' leftovers. Nothing is shuffled: partitions number their own sequences.

Defined results: null text counts as empty, which still has its end id; a null doc_id stays null;
each of several rows with one id is packed for itself; texts of any length are cut at full windows;
equal leftovers take the combination's places in the order they came, which changes no piece but its
place; an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from opalyx.llm.common import COARSE, texts, tokenizer_memo
from opalyx.runtime import ship

WINDOW, BLOCK_DOCS, TRIPLES = 1024, 4096, 8
#: Pieces in a generation of the memo, which a worker keeps for its later tasks.
MEMO = 600_000


def combinations(present: np.ndarray, window: int, triples: int = TRIPLES) -> np.ndarray:
    """Rows of three lengths (0: none) from those present whose sum is the window: all pairs, up to so many triples for each longest length."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    a = present[(present * 2 <= window) & have[window - present]]
    rows = [np.stack([window - a, a, np.zeros_like(a)], 1)]
    for x in present[present * 3 >= window]:
        rest = window - x
        b = present[(present * 2 >= rest) & (present <= min(x, rest - 1))]
        b = b[have[rest - b]]
        if len(b) > triples:
            b = b[np.linspace(0, len(b) - 1, triples).astype(int)]
        rows.append(np.stack([np.full_like(b, x), b, rest - b], 1))
    return np.concatenate(rows)


def repeats(combos: np.ndarray, histogram: np.ndarray, steps: int = 150) -> np.ndarray:
    """Non-negative least squares: how often each combination is used so that its lengths meet the histogram."""
    used = (combos > 0).astype("f8")
    size = len(histogram)

    def lengths(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos.ravel(), (used * x[:, None]).ravel(), size)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[combos] * used).sum(1)

    v = np.ones(len(combos))
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = back(lengths(v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    x = y = np.zeros(len(combos))
    t, goal = 1.0, histogram.astype("f8")
    for _ in range(steps):
        new = np.maximum(0.0, y - back(lengths(y) - goal) / (1.02 * top))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
    return x


class Packer:
    """Packs leftovers given one at a time; emits (key, start, part, sequence, offset) pieces through put()."""

    def __init__(self, put, window: int = WINDOW, block: int = BLOCK_DOCS):
        self.put, self.window, self.block = put, window, block
        self.held: list[tuple] = []
        self.sequences = 0
        self.open_id, self.open_len = -1, 0

    def sequence(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def add(self, key, start: int, part, length: int) -> None:
        if length == self.window:
            self.put(key, start, part, length, self.sequence(), 0)
            return
        self.held.append((key, start, part, length))
        if len(self.held) >= self.block:
            self._pack()

    def close(self) -> None:
        if self.held:
            self._pack()

    def _pack(self) -> None:
        by_length: dict[int, list[tuple]] = {}
        for row in self.held:
            by_length.setdefault(row[3], []).append(row)
        self.held = []
        left = np.zeros(self.window + 1, "i8")
        for n, rows in by_length.items():
            left[n] = len(rows)
        combos = combinations(np.flatnonzero(left), self.window)
        if len(combos):
            x = repeats(combos, left)
            for up in (False, True):  # rounded down, then the fractions, the largest first
                for i in np.argsort(-(x - np.floor(x) if up else x), kind="stable"):
                    n = 1 if up else int(x[i] + 1e-6)
                    if not up and n == 0:
                        break
                    if up and x[i] < 1e-3:
                        continue
                    need: dict[int, int] = {}
                    for c in combos[i].tolist():
                        if c:
                            need[c] = need.get(c, 0) + 1
                    n = min(n, *(int(left[c]) // k for c, k in need.items()))
                    for _ in range(n):
                        at, seq = 0, self.sequence()
                        for c in combos[i].tolist():
                            if c:
                                self.put(*by_length[c].pop(), seq, at)
                                left[c] -= 1
                                at += c
        for n in sorted(by_length, reverse=True):
            for row in by_length[n]:
                self._fill(*row)

    def _fill(self, key, start: int, part, length: int) -> None:
        taken = 0
        while taken < length:
            if self.open_id < 0:
                self.open_id, self.open_len = self.sequence(), 0
            n = min(length - taken, self.window - self.open_len)
            self.put(key, start + taken, part[taken : taken + n], n, self.open_id, self.open_len)
            self.open_len += n
            taken += n
            if self.open_len == self.window:
                self.open_id = -1


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW, block: int = BLOCK_DOCS, memo_pieces: int = MEMO) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        memo, end = tokenizer_memo(tokenizer_path, "<u4", memo_pieces), np.asarray([end_id], "<u4").tobytes()
        rows: list[tuple] = []

        def put(key, start, part, length, sequence, offset) -> None:
            rows.append((key[0], start, length, zlib.crc32(np.ascontiguousarray(part)), key[1], base + sequence, offset))

        packer = Packer(put, window, block)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(memo.join(COARSE.findall(text)) + end, "<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    packer.add((doc_id, len(ids)), start, part if len(part) == window else part.copy(), len(part))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows.clear()
        packer.close()
        if rows:
            yield _batch(rows)

    return texts(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types, strict=True)], schema=_OUT)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
