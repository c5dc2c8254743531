"""Media columns: lossless 8-bit samples in Ogg, written and read back.

A payload's blocks of 64 bytes go in turn to the logical streams of one physical Ogg file. Each
stream begins with a header packet (a magic word, channel number, channels, block size, rate) and
ends with a page marked last. Reading verifies each page's checksum, rebuilds packets from lacing
values across page borders, sorts pages by serial number into streams, derives times from granule
positions (samples of the payload up to the end of the last packet that a page completes) and
interleaves the blocks again.

Defined results: null text counts as empty, so its payload is 64 zero bytes; equal texts give equal
bytes, as serial numbers follow from the payload's length alone; texts of any length are stored whole;
rows that repeat an id or a text have a row each; an empty table gives no rows; columns other than the
id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from opalyx.llm.common import texts
from opalyx.runtime import ship

BLOCK, RATE, MAGIC = 64, 8000, b"pcm8blk\x00"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, no inversions: zlib's on mirrored bits."""
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK), len(raw)


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    check = page_checksum(head + body)
    return head[:22] + struct.pack("<I", check) + head[26:] + body


def _stream_pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """Pages of one logical stream: the header packet alone on its page, then the others, up to 255 segments a page."""
    pages = [_page(2, 0, serial, 0, *_laced(packets[0]))]
    lacing, body, granule, carried, kind = bytearray(), [], -1, False, 0
    for packet, at in zip(packets[1:], granules[1:], strict=True):
        sizes, pos = _laced(packet)[0], 0
        for i, size in enumerate(sizes):
            if len(lacing) == 255:
                pages.append(_page(1 if carried else 0, granule, serial, len(pages), bytes(lacing), b"".join(body)))
                lacing, body, granule, carried = bytearray(), [], -1, i > 0
            lacing.append(size)
            body.append(packet[pos : pos + size])
            pos += size
        granule = at
    kind = (1 if carried else 0) | 4
    pages.append(_page(kind, granule, serial, len(pages), bytes(lacing), b"".join(body)))
    return pages


def _laced(packet: bytes) -> tuple[bytes, bytes]:
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255]), packet


def write_ogg(payload: bytes, streams: int = 2, packet_blocks: int = 16) -> bytes:
    """Mux a payload (a multiple of 64 bytes) into logical streams whose pages alternate."""
    blocks = np.frombuffer(payload, "u1").reshape(-1, BLOCK)
    queues = []
    for s in range(streams):
        own = blocks[s::streams]
        parts = [own[i : i + packet_blocks].tobytes() for i in range(0, len(own), packet_blocks)]
        ends = [min(len(payload), (min(i + packet_blocks, len(own)) * streams) * BLOCK) for i in range(0, len(own), packet_blocks)]
        header = MAGIC + struct.pack("<BBHIQ", s, streams, BLOCK, RATE, len(payload))
        queues.append(_stream_pages(0x0A11CE00 + s, [header, *parts], [0, *ends]))
    out = [q[0] for q in queues]  # all first pages lead
    for i in range(1, max(map(len, queues))):
        out += [q[i] for q in queues if i < len(q)]
    return b"".join(out)


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(kind, granule, serial, number, lacing, body) of each page; ValueError on a wrong checksum or layout."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            raise ValueError(f"no page at byte {at}")
        _, version, kind, granule, serial, number, check, n = struct.unpack_from("<4sBBqIIIB", data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or end > len(data):
            raise ValueError(f"page at byte {at} is cut off or of another version")
        if page_checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != check:
            raise ValueError(f"checksum of the page at byte {at} is wrong")
        yield kind, granule, serial, number, lacing, data[at + 27 + n : end]
        at = end


def demux(data: bytes) -> dict[int, dict]:
    """serial -> packets, granule of each packet's page, pages, whether begun and ended."""
    streams: dict[int, dict] = {}
    for kind, granule, serial, number, lacing, body in read_pages(data):
        s = streams.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "open": [], "ended": False, "last": 0})
        if number != s["pages"] or s["ended"] or bool(kind & 1) != bool(s["open"]) or bool(kind & 2) != (number == 0):
            raise ValueError(f"page {number} of stream {serial:#x} is out of order")
        s["pages"] += 1
        pos = 0
        for size in lacing:
            s["open"].append(body[pos : pos + size])
            pos += size
            if size < 255:
                s["packets"].append(b"".join(s["open"]))
                s["granules"].append(granule)
                s["open"] = []
        s["last"] = max(s["last"], granule)
        s["ended"] = bool(kind & 4)
    if any(s["open"] or not s["ended"] for s in streams.values()):
        raise ValueError("a stream isn't complete")
    return streams


def read_ogg(data: bytes) -> tuple[bytes, dict]:
    """The payload and what the container tells: streams, pages, packets, seconds."""
    streams = demux(data)
    order, total = {}, 0
    for serial, s in streams.items():
        if s["packets"][0][:8] != MAGIC:
            raise ValueError(f"stream {serial:#x} has another codec")
        channel, channels, block, rate, total = struct.unpack("<BBHIQ", s["packets"][0][8:])
        order[channel] = s
    if sorted(order) != list(range(channels)):
        raise ValueError("a logical stream is missing")
    blocks = np.empty((total // block, block), "u1")
    for c, s in order.items():
        blocks[c::channels] = np.frombuffer(b"".join(s["packets"][1:]), "u1").reshape(-1, block)
    return blocks.tobytes(), {"streams": channels, "pages": sum(s["pages"] for s in streams.values()), "packets": sum(len(s["packets"]) for s in streams.values()), "seconds": max(s["last"] for s in streams.values()) / rate}


def features(payload: bytes, told: dict) -> str:
    """Mean, deviation and zero-level crossings of the samples with the container's counts and duration."""
    x = np.frombuffer(payload, "u1")
    n = len(x)
    total, squares = int(x.sum(dtype="u8")), int((x.astype("u4") ** 2).sum(dtype="u8"))
    high = x >= 128
    return f"mean={total / n:.4f};sd={max(0.0, squares / n - (total / n) ** 2) ** 0.5:.4f};crossings={int(np.count_nonzero(high[1:] != high[:-1]))};streams={told['streams']};pages={told['pages']};packets={told['packets']};seconds={told['seconds']:.4f}"


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as an Ogg file in a binary column."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                made = [payload_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([write_ogg(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Read each file back: digests of the payload and of the file, and the features."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                payload, told = read_ogg(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, told)))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_media(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
