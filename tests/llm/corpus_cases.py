"""Rows that every corpus operator has to handle, and the words they are made of."""

import random

WORDS = "the river bank holds seven old stones under bright morning light while ten small boats drift past quiet green hills and empty stone houses near a long grey wall".split()
#: Names the operators use inside, as further columns of the input.
CLASHING = ("node", "fp", "h", "n", "s", "spans", "term", "kind", "uid", "at", "ids", "component", "_hash", "prediction", "__t", "_shared", "_dropped", "_key", "_kept_id", "_kept_fp", "_fp", "_spans", "_terms", "_text", "_language", "t", "p", "core", "hub", "block", "query_id", "score", "start")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


LONG = prose(0, 9_000) + " " + "x" * 40_000 + "  \n\n" + "漢字" * 3_000 + " 12345678901234567890"

EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\r\n "),
    (4, "two words"),
    (5, "the same row twice over here"),
    (5, "the same row twice over here"),
    (5, "another text under that id"),
    (None, "a text that has no id at all"),
    (None, None),
    (6, LONG),
    (7, "é ü Ω 漢字 😀 a b c, d.  e!?  ;: -- 'll it's\n\n end "),
    (8, "\u0000 zero � <|endoftext|> </s> [CLS] 1e9"),
    (-9, "negative id"),
]


def table(spark, rows, lang=None):
    """documents with the clashing columns; rows are (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else lang, None, None if r[1] is None else len(r[1]), *["x"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(full, SCHEMA)
