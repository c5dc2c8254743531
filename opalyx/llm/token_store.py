"""Token-ID files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file holds documents in ascending id order. Its parts, one after the other:

* data frames: each a zstandard frame (with content checksum) of the ids of whole documents;
* an index frame: a JSON line (id width, counts) and the arrays of document ids, null flags, token
  counts and documents for each data frame;
* a skippable frame with the seek table of the public seekable layout: for each frame its
  compressed size, its size and the low 32 bits of the XXH64 of its content; then the number of
  frames, a descriptor byte and a magic number.

A reader takes the seek table from the end of a file and decompresses only the frames asked for.

Defined results: a null text counts as empty; a null id sorts first and stays null; rows that share
an id are ordered by the hash of their text and each keeps an entry of its own; an empty table
gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalyx.llm.common import WORDS, texts, tokenizer_memo
from opalyx.runtime import shared_dir, ship

SEEK_MAGIC, SKIP_MAGIC = 0x8F92EAB1, 0x184D2A5E


def checksum(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class FrameWriter:
    """Writes one file. add() takes documents in order; close() writes the index and the seek table."""

    def __init__(self, sink, width: int, frame_bytes: int = 1 << 20, level: int = 3):
        import zstandard

        self.sink, self.width, self.frame_bytes = sink, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.pending: list[bytes] = []
        self.pending_bytes = self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.nulls: list[bool] = []
        self.counts: list[int] = []
        self.per_frame: list[int] = []

    def _frame(self, content: bytes) -> None:
        data = self.zstd.compress(content)
        self.sink.write(data)
        self.size += len(data)
        self.table.append((len(data), len(content), checksum(content)))

    def _flush(self) -> None:
        if self.pending:
            self._frame(b"".join(self.pending))
            self.per_frame.append(len(self.pending))
            self.pending, self.pending_bytes = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // self.width)
        self.pending.append(ids)
        self.pending_bytes += len(ids)
        if self.pending_bytes >= self.frame_bytes:
            self._flush()

    def close(self) -> None:
        self._flush()
        head = json.dumps({"width": self.width, "docs": len(self.ids), "frames": len(self.per_frame)}).encode() + b"\n"
        self._frame(head + np.asarray(self.ids, "<i8").tobytes() + np.asarray(self.nulls, "u1").tobytes() + np.asarray(self.counts, "<u4").tobytes() + np.asarray(self.per_frame, "<u4").tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIP_MAGIC, len(body)) + body)
        self.size += 8 + len(body)


class FrameReader:
    """Random access to one file given an object with seek, read and size."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * frames)
        self.table = [struct.unpack("<III", e) for e in _cut(source.read(12 * frames), 12)]
        self.at = np.concatenate([[0], np.cumsum([x[0] for x in self.table], dtype="i8")])
        index = self.frame(frames - 1)
        cut = index.index(b"\n") + 1
        head = json.loads(index[:cut])
        n, k, self.width = head["docs"], head["frames"], head["width"]
        self.ids = np.frombuffer(index, "<i8", n, cut)
        self.nulls = np.frombuffer(index, "u1", n, cut + 8 * n)
        self.counts = np.frombuffer(index, "<u4", n, cut + 9 * n)
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(index, "<u4", k, cut + 13 * n), dtype="i8")])

    def frame(self, k: int) -> bytes:
        packed, size, check = self.table[k]
        self.source.seek(int(self.at[k]))
        content = self.zstd.decompress(self.source.read(packed), max_output_size=size)
        if len(content) != size or checksum(content) != check:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, wanted: list[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, token ids) of the documents at these positions, or of all; reads only their frames."""
        order = range(len(self.ids)) if wanted is None else sorted(wanted)
        now, content, starts = -1, b"", np.zeros(1, "i8")
        for i in order:
            k = int(np.searchsorted(self.first, i, "right")) - 1
            if k != now:
                now, content = k, self.frame(k)
                starts = np.concatenate([[0], np.cumsum(self.counts[self.first[k] : self.first[k + 1]], dtype="i8")])
            j = i - int(self.first[k])
            yield None if self.nulls[i] else int(self.ids[i]), np.frombuffer(content, f"<u{self.width}", int(self.counts[i]), int(starts[j]) * self.width)


def _cut(data: bytes, n: int) -> list[bytes]:
    return [data[i : i + n] for i in range(0, len(data), n)]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def encode_words(text: str, memo) -> bytes:
    """Ids of a text. The word tokenizer folds white space and no pre-token spans it, so a text's ids are those of its words."""
    return memo.join(WORDS.findall(text))


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, *, width: int = 2, partitions: int | None = None, file_docs: int = 1 << 20) -> list[dict]:
    """Write the ids of all documents to files in folder; return the files in id order.

    The rows are dealt by ranges of (id, text hash, row), so that neither a repeated id nor a
    repeated row fills one task. A file's name is new in each attempt and only the files that
    finished tasks name are used, so lost executors leave no wrong file. One entry for each file
    comes to the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = texts(docs).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(n, "doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        memo, end = tokenizer_memo(tokenizer_path, f"<u{width}"), np.asarray([end_id], f"<u{width}").tobytes()
        out, k, now, sink, uri, files = None, 0, None, None, "", []

        def finish() -> None:
            out.close()
            sink.close()
            files.append({"part": part, "file": k, "uri": uri, "docs": len(out.ids), "tokens": int(sum(out.counts)), "bytes": out.size})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    uri = f"{folder}/part-{part:06d}-{k:04d}-{uuid.uuid4().hex}.ids.zst"
                    now, path = _open(uri)
                    now.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = now.open_output_stream(path, compression=None)
                    out = FrameWriter(sink, width)
                out.add(doc_id, encode_words(text, memo) + end)
                if len(out.ids) >= file_docs:
                    finish()
                    out, k = None, k + 1
        if out is not None:
            finish()
        if files:
            yield pa.RecordBatch.from_pylist(files, schema=_FILES)

    # part numbers follow the id ranges
    return [r.asDict() for r in sorted(dealt.mapInArrow(write, "part long, file long, uri string, docs long, tokens long, bytes long").collect())]


_FILES = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("uri", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("frame_bytes", pa.int64())])


def read_token_digests(spark: SparkSession, files: list[dict]) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32, frame_bytes (of its file)."""
    ship(spark)
    base, rows = 0, []
    for f in files:
        rows.append((f["uri"], base, f["bytes"]))
        base += f["tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now, path = _open(uri)
                with now.open_input_file(path) as source:
                    got: list[tuple] = []
                    for doc_id, ids in FrameReader(source, size).documents():
                        got.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), size))
                        start += len(ids)
                        if len(got) >= 20_000:
                            yield _rows(got, _READ)
                            got = []
                    if got:
                        yield _rows(got, _READ)

    table = spark.createDataFrame(rows, "uri string, base long, bytes long") if rows else spark.createDataFrame([], "uri string, base long, bytes long")
    return table.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_digests(spark, files)
