"""Personal data: base patterns, and terms that disclose what the patterns protect.

All of it is DataFrame and SQL functions. Patterns give the base spans (email, ip, card, phone).
Their matches are the protected entities. A term (a word outside the spans, anywhere in a text)
discloses an entity where the corpus says so: it stands in several differing texts with that
entity, and that entity makes up much of the term's texts,

    share = texts(term, entity) / texts(term)
    information = log2(share * rows / texts(entity))   (pointwise, in bits)

From share `generalise` on, a term's occurrences become spans of the kind term (to be replaced by a
placeholder), from `remove` on of the kind reveal (to be removed). Of an entity's texts those count
once that have the same characters beside it, so copies and near copies of one text disclose
nothing by themselves. An entity or a pair met in fewer than least_texts of these isn't judged: one
or two texts are no estimate of a share.

Spans are made once and written. Terms are found inside the row, from the hashes of the disclosing
terms in one row that goes to every task, where they are counted to be at most FEW_TERMS; beyond
that, words meet terms by a join, and what is found meets the rows by the hash of their text.

Patterns are written without backtracking (possessive, with look-behind for the start of a run) so
that long runs cost linear time and no stack; each is equal to the plain form of its contract.

Defined results: null text counts as empty and has no spans; each row has its own result whether or
not its id or text is repeated; texts of any length are read whole; an empty table gives no rows;
find() keeps other columns, whatever their names, and a null text stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalyx.llm.common import free, texts
from opalyx.runtime import with_keys, written

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("term", "reveal")
_LOCAL = "[A-Za-z0-9._%+-]"
# A match starts at a run's start or where the last match ended (\G).
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What every match of a kind holds.
NEEDLE = {"email": "@", "ip": ".", "card": None, "phone": "+"}
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "reveal": ""}
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
_WORDS = r"[^\p{L}\p{N}]+"
#: Terms up to which their hashes are one row for every task (8 bytes each).
FEW_TERMS = 2_000


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _luhn(digits: Column) -> Column:
    """Whether the digits' checksum, every second from the right doubled, is a multiple of ten."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.when(F.ltrim(p, F.lit("0")) == "", 0).otherwise(256)) <= 255)
    if kind == "card":
        return _bind(digits, lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _positions(text: Column, pattern: Column, kind: Column, matches: Column) -> Column:
    """Spans of the pattern's matches, from the lengths of what lies between them."""
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(between, matches, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, p: Column) -> Column:
        began = s["at"] + p["b"]
        ended = began + F.length(p["m"])
        span = F.struct(kind.alias("kind"), began.alias("start"), ended.alias("end"), p["m"].alias("value"))
        return F.when(p["m"].isNull(), s).otherwise(F.struct(ended.alias("at"), F.concat(s["out"], F.array(span)).alias("out")))

    return F.aggregate(pairs, start, step, lambda s: s["out"])


def spans_of(text: Column, kind: str) -> Column:
    """Valid spans of one kind in order: array of (kind, start, end, value), in code points, end exclusive."""
    pattern = F.lit(PATTERNS[kind])

    def found(matches: Column) -> Column:
        spans = F.filter(_positions(text, pattern, F.lit(kind), matches), lambda s: _valid(kind, s["value"]))
        return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(_SPANS))

    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    if NEEDLE[kind]:
        matches = F.when(F.contains(text, F.lit(NEEDLE[kind])), matches).otherwise(F.array().cast("array<string>"))
    return _bind(matches, found)


def base_spans(text: Column) -> Column:
    return F.concat(*(spans_of(text, k) for k in KINDS))


def _key(span: Column) -> Column:
    """What a span's value stands for: numbers by their digits, else in lower case."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"])))


def _outside(text: Column, spans: Column) -> Column:
    """The text with each span as a space."""
    return F.when(F.size(spans) > 0, masked(text, spans, dict.fromkeys(MASKS, " "))).otherwise(text)


def _terms_of(text: Column) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), _WORDS), lambda w: w != ""))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _few(terms: DataFrame) -> bool:
    return terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS


def disclosing_terms(docs: DataFrame, spans: str = "base", *, least_texts: int = 3, generalise: float = 0.5, remove: float = 0.9, bits: float = 0.0, beside: int = 60) -> DataFrame:
    """(term, kind): hashes of the terms to generalise (term) or remove (reveal). docs has text and the base spans."""
    text, s = F.col("text"), F.col(spans)

    def entities(keys: Column, contexts: Column) -> Column:
        """Each entity of a text once, with the context of its first span."""
        return F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("entity"), F.element_at(contexts, F.array_position(keys, k).cast("int")).alias("context")))

    def context(x: Column) -> Column:
        return F.xxhash64(F.lower(F.substring(text, F.greatest(F.lit(1), x["start"] + 1 - beside), F.least(x["start"], F.lit(beside)))), F.lower(F.substring(text, x["end"] + 1, F.lit(beside))))

    own = _bind(F.transform(s, lambda x: F.xxhash64(_key(x))), lambda k: _bind(F.transform(s, context), lambda c: entities(k, c)))
    seen = docs.filter(F.size(spans) > 0).select(F.xxhash64("text").alias("t"), "text", spans)
    met = written(seen.select("t", F.explode(own).alias("e")).select("e.entity", "e.context", "t").groupBy("entity", "context").agg(F.min("t").alias("t")), "entities")
    several = met.groupBy("entity").agg(F.count("*").alias("of_entity")).filter(F.col("of_entity") >= least_texts)
    chosen = met.join(several, "entity").groupBy("t").agg(F.collect_list(F.struct("entity", "of_entity")).alias("entities"))
    words = written(seen.groupBy("t").agg(F.first(_hashes(_terms_of(_outside(text, s)))).alias("words")), "words")
    both = chosen.join(words, "t").select(F.explode("entities").alias("e"), "words").select("e.*", F.explode("words").alias("term"))
    pairs = written(both.groupBy("entity", "of_entity", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= least_texts), "pairs")
    # The texts with spans alone bound a term's texts from below: a term of many can't disclose one entity.
    of_term = with_keys(words.select(F.explode("words").alias("term")), pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("of_term"))
    pairs = written(pairs.join(of_term, "term").filter(F.col("both") >= generalise * F.col("of_term")), "pairs")
    # All texts of the terms that are left, each text once.
    held = _met(docs, text, s, pairs.select("term").distinct()).groupBy("term").agg(F.count_distinct("t").alias("texts"))
    share = F.col("both") / F.col("texts")
    info = F.log2(share * F.lit(docs.count()) / F.col("of_entity"))
    best = pairs.join(held, "term").select("term", share.alias("share"), info.alias("info"))
    return best.filter((F.col("share") >= generalise) & (F.col("info") > bits)).groupBy("term").agg(F.max("share").alias("share")).select("term", F.when(F.col("share") >= remove, "reveal").otherwise("term").alias("kind"))


def _met(docs: DataFrame, text: Column, spans: Column, terms: DataFrame) -> DataFrame:
    """(t: hash of the text, term) of the terms that stand in a text; rows of one text repeat them."""
    words = docs.select(F.xxhash64(text).alias("t"), F.explode(_hashes(_terms_of(_outside(text, spans)))).alias("term"))
    return with_keys(words, terms, "term", "left_semi")


def add_term_spans(docs: DataFrame, terms: DataFrame, text: str, spans: str) -> DataFrame:
    """docs with the spans of disclosing terms added to the column spans; none lies in a base span. terms: (term, kind)."""
    t, s, at = F.coalesce(F.col(text), F.lit("")), F.col(spans), free(docs, "_terms")
    if _few(terms):
        one = terms.agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("term"))).alias(k) for k in EXTRA)).select(F.struct(*EXTRA).alias(at))
        joined = docs.crossJoin(F.broadcast(one))
        own = _bind(_hashes(_terms_of(_outside(t, s))), lambda w: F.struct(*(F.array_intersect(w, F.col(at)[k]).alias(k) for k in EXTRA)))
        joined = joined.withColumn(at, own)
    else:
        key = free(docs, "_text")
        found = _met(docs, t, s, terms.select("term")).distinct().join(terms, "term")
        found = found.groupBy(F.col("t").alias(key)).agg(F.struct(*(F.collect_list(F.when(F.col("kind") == k, F.col("term"))).alias(k) for k in EXTRA)).alias(at))
        joined = docs.withColumn(key, F.xxhash64(t)).join(found, key, "left").drop(key)

    def of(kind: str) -> Column:
        hits = F.coalesce(F.col(at)[kind], F.array().cast("array<long>"))
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.filter(_terms_of(t), lambda w: F.array_contains(hits, F.xxhash64(w))), "|"), F.lit(r")(?![\p{L}\p{N}])"))
        matched = _bind(pattern, lambda p: _bind(F.regexp_extract_all(t, p, F.lit(0)), lambda m: _positions(t, p, F.lit(kind), m)))
        apart = F.filter(matched, lambda x: ~F.exists(s, lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
        return F.when(F.size(hits) > 0, apart).otherwise(F.array().cast(_SPANS))

    return joined.withColumn(spans, F.concat(s, *map(of, EXTRA))).drop(at)


def find(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with a column of all spans: base ones by kind and start, then those of disclosing terms."""
    plain = written(docs.withColumn(spans, base_spans(F.coalesce(F.col(text), F.lit("")))), "spans")
    terms = written(disclosing_terms(plain.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(spans).alias("base"))), "terms")
    return plain if terms.isEmpty() else add_term_spans(plain, terms, text, spans)


def masked(text: Column, spans: Column, masks: dict[str, str] = MASKS) -> Column:
    """The text with each span replaced by the mask of its kind; of overlapping spans the first names the mask."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    mask = F.create_map(*[F.lit(x) for kv in masks.items() for x in kv])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, p: Column) -> Column:
        fresh = F.concat(s["out"], F.substring(text, s["at"] + 1, p["start"] - s["at"]), mask[p["kind"]])
        return F.struct(F.greatest(s["at"], p["end"]).alias("at"), F.when(p["start"] >= s["at"], fresh).otherwise(s["out"]).alias("out"))

    whole = F.aggregate(order, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(whole)


def digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    order = F.array_sort(F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.struct(F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    s = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(digest(s, KINDS), 256).alias("base_sha256"), digest(s, (*KINDS, *EXTRA)).alias("spans"))
