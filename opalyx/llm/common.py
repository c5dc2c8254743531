"""What several operators share: column pick-up, memoised tokenizer pieces, prefix sums."""

from __future__ import annotations

import base64
import contextlib
import ctypes
import gc
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it; Python's own class also takes U+001C to U+001F.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_to_empty: bool = True) -> DataFrame:
    """Only (doc_id, text); other columns, whatever their names, are never read."""
    text: Column = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(text, F.lit("")) if null_to_empty else text).alias("text"))


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Memo:
    """piece -> little-endian ids as bytes, encoded many pieces at a time.

    Bounded: two generations of at most so many entries; a full young one becomes the old one, and
    what is used again comes back. Long pieces are not kept.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 600_000, longest: int = 48):
        self.encode_many, self.limit, self.longest = encode_many, limit, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def join(self, pieces: list[str]) -> bytes:
        """The ids of all pieces, one after the other."""
        found = list(map(self.young.get, pieces))
        if None not in found:
            return b"".join(found)
        absent = {p for p, f in zip(pieces, found, strict=True) if f is None}
        new = {p: was for p in absent if (was := self.old.get(p)) is not None}
        missing = [p for p in absent if p not in new]
        if missing:
            new.update(zip(missing, self.encode_many(missing), strict=True))
        out = b"".join([new[p] if f is None else f for p, f in zip(pieces, found, strict=True)])
        if len(self.young) + len(new) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update((p, ids) for p, ids in new.items() if len(p) <= self.longest)
        return out


_LATIN, _STOP = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", ".,!?;:"
#: Cuts a text where byte-level pre-tokens end: the white-space rules of the pre-token pattern with
#: every run of other characters as one piece, but for stops after a Latin word, pieces of their own.
COARSE = re.compile(f" ?[{_LATIN}]+(?=[{_STOP}]*+(?:[{SPACE}]|\\Z))|(?<=[{_LATIN}])[{_STOP}]++(?=[{SPACE}]|\\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same for a word tokenizer that drops white space and whose pre-tokens never span it.
WORDS = re.compile(f"[{_LATIN}]+(?=[{_STOP}]*+(?:[ \\n]|\\Z))|(?<=[{_LATIN}])[{_STOP}]++(?=[ \\n]|\\Z)|[^ \\n]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_encoders: dict = {}


def release() -> None:
    """Give up what operators before this one hold in the worker process: tokenizers and their memos."""
    if _encoders:
        _encoders.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can hand memory back
            ctypes.CDLL(None).malloc_trim(0)


def tokenizer_memo(path: str, dtype: str, limit: int = 600_000) -> Memo:
    """Memo over a tokenizers file, one for each worker process."""
    key = (path, dtype, limit)
    if key not in _encoders:
        import os

        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _encoders[key] = Memo(lambda pieces: [np.asarray(e.ids, dtype).tobytes() for e in t.encode_batch_fast(pieces, add_special_tokens=False)], limit)
    return _encoders[key]


def tiktoken_encoding(path: str, pattern: str):
    key = (path, pattern)
    if key not in _encoders:
        import tiktoken

        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return _encoders[key]
