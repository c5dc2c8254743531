"""Byte-level BPE of long texts by overlapping chunks, and decoding.

Encoding. A text is cut into chunks that overlap. Chunks are pre-tokenised in parallel; a chunk's
first boundaries may be wrong, as its start may lie inside a pre-token, and its last ones too, as
its end may cut one off. Two chunks are stitched at the first place in their overlap where both
have a boundary, not after white space, whose split depends on what follows: the pattern keeps no
state between matches, so from a common boundary on both go on alike. The pieces between these places are encoded in parallel and their ids joined. Where
an overlap holds no common boundary (a run longer than the overlap), the left chunk's text is
carried on from its last certain boundary until the two meet. A text of one chunk is one piece.

Decoding joins the bytes of the ids, in order.

Defined results: a null text counts as empty and has no ids; each of several rows with one id has
a row of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalyx.llm.common import COARSE, Memo, load_ranks, texts, tiktoken_encoding
from opalyx.runtime import ship

CHUNK, OVERLAP = 16_384, 512
#: No alternative of the pattern looks further than this beyond the end of its match.
LOOK = 3
#: Pieces a generation of the memo keeps; a task's encoding and decoding run in two processes, each with its own tables.
MEMO = 150_000
#: Rows whose ids are made at a time.
ROWS = 500

_memos: dict = {}


def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, start: int, pattern, last: bool) -> np.ndarray:
    """Ends (and the start) of the pre-tokens of a chunk at offset start of its text; without those the chunk's end may have moved."""
    ends = [0, *(m.end() for m in pattern.finditer(text))]
    if not last:
        limit = len(text) - LOOK
        ends = [e for e in ends if e < limit]
    return np.asarray(ends, "i8") + start


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str, bool]]:
    """(offset, text, whether the last) of the overlapping chunks."""
    out, at = [], 0
    while True:
        last = at + size + overlap >= len(text)
        out.append((at, text[at : at + size + overlap], last))
        if last:
            return out
        at += size


def stitch(parts: list[tuple[int, str, bool, np.ndarray]], pattern) -> list[str]:
    """Pieces of the text whose chunks (offset, text, last, boundaries) are given in order."""
    pieces, held, at = [], "", 0  # held: the text from the last cut, at: its offset
    trusted = parts[0][3]
    held = parts[0][1]
    for offset, text, last, own in parts[1:]:
        common = np.intersect1d(trusted[trusted >= offset], own, assume_unique=True).tolist()
        # a run of white space before the cut would be split in another way at a piece's end
        cut = next((c for c in common if c > at and not held[c - at - 1].isspace()), -1)
        if cut >= 0:
            pieces.append(held[: cut - at])
            held, at, trusted = text[cut - offset :], cut, own[own >= cut]
        else:  # go on from the last certain boundary over the next chunk's text as well
            sure = int(trusted[-1]) if len(trusted) else at
            held = held[: offset - at] + text
            trusted = np.concatenate([trusted[:-1], boundaries(held[sure - at :], sure, pattern, last)])
    return [*pieces, held]


def piece_memo(ranks_path: str, pattern: str) -> Memo:
    """Coarse pieces keep each pre-token whole, so the ids of a text are those of its coarse pieces."""
    key = (ranks_path, pattern)
    if key not in _memos:
        encode = tiktoken_encoding(ranks_path, pattern).encode_ordinary
        _memos[key] = Memo(lambda pieces: [np.asarray(encode(p), "<u4").tobytes() for p in pieces], MEMO)
    return _memos[key]


def decode_bytes(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_tables: dict = {}


def byte_table(ranks_path: str) -> list[bytes]:
    """Bytes of each id."""
    if ranks_path not in _tables:
        ranks = load_ranks(ranks_path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _tables[ranks_path] = table
    return _tables[ranks_path]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): ids is binary, little-endian 32-bit.

    Texts of one chunk stay where they were read. The chunks of longer texts are dealt out, met
    again by text for stitching, and the pieces dealt out once more for encoding; a group holds
    one text, which its row held before.
    """
    ship(docs.sparkSession)
    source = texts(docs)
    short, long = source.filter(F.length("text") <= chunk), source.filter(F.length("text") > chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = piece_memo(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([memo.join(COARSE.findall(t)) for t in part.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, uid, row = chunks(text, chunk, overlap), f"{part}:{row}", row + 1
                yield pa.RecordBatch.from_arrays([pa.array([uid] * len(found)), pa.array([doc_id] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found]), pa.array([x[2] for x in found])], ["uid", "doc_id", "at", "text", "last"])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _pattern(pattern)
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            ends = []
            for at, text, last in rows:
                own = boundaries(text, at, compiled, last)
                ends.append(own[(own <= at + overlap) | (own >= at + chunk)])  # what stitching can ask for
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int64()))], [*batch.schema.names, "ends"])

    def pieces(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("at", "text", "last")), table.column("ends"), strict=True), key=lambda r: r[0])
        got = stitch([(a, t, e, np.asarray(b.as_py(), "i8")) for a, t, e, b in rows], _pattern(pattern))
        n, uid, doc_id = len(got), table.column("uid")[0].as_py(), table.column("doc_id")[0].as_py()
        return pa.table({"uid": [uid] * n, "doc_id": pa.array([doc_id] * n, pa.int64()), "at": pa.array(range(n), pa.int64()), "text": pa.array(got, pa.string())})

    def encode_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = piece_memo(ranks_path, pattern)
        for batch in batches:
            ids = [memo.join(COARSE.findall(t)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["uid", "doc_id", "at", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("at").to_pylist(), table.column("ids").to_pylist(), strict=True))
        return pa.table({"doc_id": pa.array([table.column("doc_id")[0].as_py()], pa.int64()), "ids": pa.array([b"".join(x for _, x in rows)], pa.binary())})

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stitched = long.mapInArrow(cut, "uid string, doc_id long, at long, text string, last boolean").repartition(n).mapInArrow(pretokenise, "uid string, doc_id long, at long, text string, last boolean, ends array<long>").groupBy("uid").applyInArrow(pieces, "uid string, doc_id long, at long, text string")
    long_ids = stitched.repartition(n).mapInArrow(encode_piece, "uid string, doc_id long, at long, ids binary").groupBy("uid").applyInArrow(joined, "doc_id long, ids binary")
    return short.mapInArrow(whole, "doc_id long, ids binary").unionByName(long_ids)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds decoded (binary) to (doc_id, ids)."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(ranks_path)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([decode_bytes(x, table) for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, P.PATTERN), ranks)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
