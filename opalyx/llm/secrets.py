"""Secrets: base patterns, and strings that look drawn at random by two character Markov models.

All of it is DataFrame and SQL functions. Patterns give the base spans (assign, access, hex). Further
candidates are runs of key characters of at least LEAST, with letters and either digits or both cases,
that overlap no base span. Each is scored by two first-order chains over characters,

    score = sum over its characters of log2 P_random(c | before) - log2 P_ordinary(c | before)   (bits)

and is a span of the kind random where the score is at least BITS, and PER_CHAR for each character.

Labelled samples: random are the keys that the base patterns found anywhere in the corpus and
GENERATED strings of each of four forms (hexadecimal, base64, its URL form, capitals with digits),
written from SHA-256 digests; ordinary are the words and identifiers, outside base spans, of the first
SAMPLE_CHARS characters of at most SAMPLE_DOCS differing texts, those with the least hashes. The
transitions are counted by Spark; two tables of some 4,600 counts come to the driver, whatever the
corpus, and go back as one array of milli-bits inside the expression. Nothing is shuffled but those
counts, the hashes of texts and the sample.

Patterns are written without backtracking; each is equal to the plain form of its contract.

Defined results: null text counts as empty and has no spans; each row has its own result whether or
not its id or text is repeated; texts of any length are read whole; an empty table gives no rows;
find() keeps other columns, whatever their names, and a null text stays null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalyx.llm.common import texts
from opalyx.llm.pii import _SPANS, _bind, _positions

KINDS = ("assign", "access", "hex")
EXTRA = ("random",)
_SET = r"[\"']?\x20*+[:=]\x20*+[\"']?"
_NAME = r"(?i)(?:password|passwd|secret|token|api_?key)"
PATTERNS = {
    "assign": rf"{_NAME}{_SET}[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
#: What every match of a kind holds.
NEEDLE = {"assign": None, "access": "AKIA", "hex": None}
#: Characters of an assigned value; of the other kinds the patterns say it.
VALUE_CHARS = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_RUN = "[A-Za-z0-9+/_=-]"
LEAST, BITS, PER_CHAR = 16, 16.0, 0.5
GENERATED, SAMPLE_DOCS, SAMPLE_CHARS, SHORTEST = 5_000, 2_000, 4_000, 3
#: Added to every count of a transition.
PRIOR = 0.5


def _matched(text: Column, pattern: str, kind: str, needle: str | None = None) -> Column:
    """Spans of all matches in order."""
    p = F.lit(pattern)
    empty = F.array().cast(_SPANS)
    matches = F.regexp_extract_all(text, p, F.lit(0))
    if needle:
        matches = F.when(F.contains(text, F.lit(needle)), matches).otherwise(F.array().cast("array<string>"))
    return _bind(matches, lambda m: F.when(F.size(m) > 0, _positions(text, p, F.lit(kind), m)).otherwise(empty))


def _value(span: Column) -> Column:
    """The key itself: of an assignment what is assigned."""
    return F.when(span["kind"] == "assign", F.regexp_replace(span["value"], f"^{_NAME}{_SET}", "")).otherwise(span["value"])


def spans_of(text: Column, kind: str) -> Column:
    """Valid spans of one kind in order: array of (kind, start, end, value), in code points, end exclusive."""
    found = _matched(text, PATTERNS[kind], kind, NEEDLE[kind])
    return F.filter(found, lambda s: F.length(_value(s)) >= VALUE_CHARS) if kind == "assign" else found


def base_spans(text: Column) -> Column:
    return F.concat(*(spans_of(text, k) for k in KINDS))


def _mixed(value: Column) -> Column:
    """Letters with digits, or of both cases."""
    return value.rlike("[A-Za-z]") & (value.rlike("[0-9]") | (value.rlike("[A-Z]") & value.rlike("[a-z]")))


def _transitions(token: Column) -> Column:
    """Place in the table of each character after the one before it; 0 stands before the first."""
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.when(i == 1, 0).otherwise(at(i - 1)) * len(ALPHABET) + at(i) - 1)


def _outside(text: Column, spans: Column) -> Column:
    """The text with each base span as a space."""
    return F.aggregate(spans, text, lambda t, s: F.replace(t, s["value"], F.lit(" ")))


def samples(docs: DataFrame, text: str = "text", *, generated: int = GENERATED, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, least: int = LEAST) -> DataFrame:
    """(random, token): the labelled samples."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keys = docs.select(F.explode(F.filter(F.transform(base_spans(t), _value), lambda v: (F.length(v) >= least) & _mixed(v))).alias("token"))
    digest = F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256))
    code = F.base64(digest)
    forms = F.array(F.lower(F.hex(digest)), code, F.translate(code, "+/", "-_"), F.upper(F.regexp_replace(code, "[^A-Za-z0-9]", "")))
    made = docs.sparkSession.range(generated).select(F.explode(F.transform(forms, lambda f: F.substring(f, 1, 40))).alias("token"))
    # The cut among the hashes first, so that no task gathers texts; copies of a text are one.
    hashed = docs.select(F.xxhash64(t).alias("h"), F.substring(t, 1, sample_chars).alias("t"))
    cut = hashed.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h").alias("h")).first()["h"]
    some = hashed.filter(F.col("h") <= F.lit(cut).cast("long")).groupBy("h").agg(F.min("t").alias("t"))
    words = F.regexp_extract_all(_outside(F.col("t"), base_spans(F.col("t"))), F.lit(f"{_RUN}{{{SHORTEST},}}+"), F.lit(0))
    plain = some.select(F.explode(words).alias("token"))
    named = lambda df, yes: df.select(F.lit(yes).alias("random"), F.regexp_replace("token", "[^A-Za-z0-9+/_=-]", "").alias("token")).filter("token <> ''")
    return named(keys, True).unionByName(named(made, True)).unionByName(named(plain, False))


def train(labelled: DataFrame) -> list[int]:
    """Milli-bits that each transition speaks for random; (random, token) of any number of rows."""
    k = len(ALPHABET)
    counts = {True: [PRIOR] * (k + 1) * k, False: [PRIOR] * (k + 1) * k}
    pairs = labelled.select("random", F.explode(_transitions(F.col("token"))).alias("at")).groupBy("random", "at").count()
    for r in pairs.collect():  # at most two for each transition
        counts[r["random"]][r["at"]] += r["count"]
    rows = {c: [sum(n[i : i + k]) for i in range(0, len(n), k)] for c, n in counts.items()}
    return [round(1000 * math.log2(a * rows[False][i // k] / (b * rows[True][i // k]))) for i, (a, b) in enumerate(zip(counts[True], counts[False], strict=True))]


def score(token: Column, model: list[int]) -> Column:
    """Milli-bits of a token of the alphabet's characters."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    return F.aggregate(_transitions(token), F.lit(0).cast("long"), lambda s, at: s + F.element_at(table, at + 1))


def random_spans(text: Column, base: Column, model: list[int], *, least: int = LEAST, bits: float = BITS, per_char: float = PER_CHAR) -> Column:
    """Spans of candidates that the models call random, apart from the base spans."""
    runs = _matched(text, rf"(?<!{_RUN}){_RUN}{{{least},}}+", EXTRA[0])
    able = F.filter(runs, lambda s: _mixed(s["value"]) & ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    enough = lambda v: F.greatest(F.lit(1000 * bits), 1000 * per_char * F.length(v))
    return F.filter(able, lambda s: score(s["value"], model) >= enough(s["value"]))


def find(docs: DataFrame, model: list[int], text: str = "text", spans: str = "spans", **limits) -> DataFrame:
    """docs with a column of all spans: base ones by kind and start, then random ones."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn(spans, _bind(base_spans(t), lambda b: F.concat(b, random_spans(t, b, model, **limits))))


def digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    place = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    order = F.array_sort(F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.struct(s["start"].alias("s"), place(s).alias("k"), s["end"].alias("e"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = find(docs, train(samples(docs)))
    s = F.col("spans")

    def number(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(digest(s, KINDS), 256).alias("base_sha256"), digest(s, (*KINDS, *EXTRA)).alias("spans"))
