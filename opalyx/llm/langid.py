"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams
(log-likelihood ratios of the two halves of the languages, the mean over a text, put on a logistic
scale) gives a margin. Decoding weighs the bits by their loss: the language whose codeword has the
least sum of log(1 + exp(-bit * margin)) wins. The score is the winner's share under
softmax(-loss); a text is flagged as ambiguous where the runner-up comes close.

The classifiers are fitted on a sample bounded by per_language texts for each language, drawn by a
hash from all labelled rows, and the first longest characters of each; predictions read whole texts and nothing
but texts.

Defined results: `und` with score 0 where the text is null or has no letter, or where there is
nothing to learn from; one language alone is always the answer, with score 1; ties go to the
language that comes first by name; held_out is false for a null doc_id, which isn't learned from;
texts of any length are read whole; repeated rows have a row each; an empty table has no model and
gives no rows; predict() keeps other columns, whatever their names but that of the result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opalyx.llm.common import release
from opalyx.runtime import ship

GRAMS, BUCKETS_LOG2, SCALE_STEPS, AMBIGUOUS = (2, 3, 4), 15, 60, 0.1
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits, float32
    scale: np.ndarray  # bits
    shift: np.ndarray


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """Codes of k languages: all ways to halve up to 5; beyond, the best-separated of many random drafts."""
    if k <= 5:
        bits = [(1, *rest) for rest in itertools.product((1, -1), repeat=k - 1)]
        return np.asarray([b for b in bits if -1 in b]).T.reshape(k, -1)
    rng, n = np.random.default_rng(seed), 4 * int(np.ceil(np.log2(k))) + 3
    best, far = None, -1
    for _ in range(200):
        draft = rng.choice((-1, 1), (k, n))
        apart = (n - draft @ draft.T) // 2 + n * np.eye(k, dtype=int)
        if (abs(draft.sum(0)) < k).all() and apart.min() > far:
            best, far = draft, apart.min()
    return best


def grams(text: str) -> np.ndarray:
    """Bucket of each n-gram of the folded text (letters kept, all else a space)."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_FOLD), "u1")
    blank = raw == 0x20
    raw = raw[~(blank & np.concatenate([[False], blank[:-1]]))].astype("u4")  # runs of spaces as one
    out = []
    for n in GRAMS:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, n * 0x9E37, "u4")
        for i in range(n):
            h = (h ^ raw[i : len(raw) - n + 1 + i]) * np.uint32(0x01000193)
        out.append((h ^ (h >> np.uint32(15))) & np.uint32((1 << BUCKETS_LOG2) - 1))
    return np.concatenate(out) if out else np.zeros(0, "u4")


def fit(texts: list[str], labels: list[str], smooth: float = 0.5) -> Model:
    languages = sorted(set(labels))
    codes = codewords(len(languages))
    counts = np.zeros((len(languages), 1 << BUCKETS_LOG2))
    rows = [grams(t) for t in texts]
    which = np.asarray([languages.index(x) for x in labels])
    for g, k in zip(rows, which, strict=True):
        counts[k] += np.bincount(g, minlength=1 << BUCKETS_LOG2)
    share = (counts + smooth) / (counts + smooth).sum(1, keepdims=True)
    bits = codes.shape[1] if len(languages) > 1 else 0
    weights = np.zeros((1 << BUCKETS_LOG2, bits), "f4")
    for b in range(bits):
        weights[:, b] = np.log(share[codes[:, b] > 0].mean(0)) - np.log(share[codes[:, b] < 0].mean(0))
    # Put the mean log-ratios on a logistic scale, a slope and a shift for each bit.
    x = np.stack([weights[g].mean(0) if len(g) else np.zeros(bits) for g in rows]) if bits else np.zeros((len(rows), 0))
    y = codes[which][:, :bits] if bits else x
    scale, shift = np.full(bits, 4.0), np.zeros(bits)
    for _ in range(SCALE_STEPS):
        p = 1 / (1 + np.exp(np.clip(y * (x * scale + shift), -30, 30)))
        scale += 2.0 * (p * y * x).mean(0) - 0.002 * scale
        shift += 0.5 * (p * y).mean(0)
    return Model(languages, codes, weights, np.maximum(scale, 1.0), shift)


def decode(model: Model, text: str | None) -> tuple[str, float, float]:
    """(language, score, lead over the second) of a whole text."""
    if text is None or not model.languages or not any(map(str.isalpha, text)):
        return "und", 0.0, 0.0
    if len(model.languages) == 1:
        return model.languages[0], 1.0, 1.0
    total, n = np.zeros(model.weights.shape[1]), 0
    for at in range(0, len(text), 1 << 18):  # parts keep the memory of a very long text bounded
        g = grams(text[at : at + (1 << 18)])
        total += model.weights[g].sum(0, dtype="f8")
        n += len(g)
    margin = total / max(1, n) * model.scale + model.shift
    loss = np.logaddexp(0, -model.codes * margin).sum(1)
    share = np.exp(loss.min() - loss)
    share /= share.sum()
    best = int(share.argmax())
    second = float(np.partition(share, -2)[-2])
    return model.languages[best], float(share[best]), float(share[best]) - second


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = 500, longest: int = 6000) -> Model:
    """Fit on the rows that are not held out. Counts for each language come to the driver, then the bounded sample."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    usable = rows.withColumn("text", F.substring("text", 1, longest))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((0, 0)), np.zeros((1, 0), "f4"), np.zeros(0), np.zeros(0))
    whole = 1 << 30
    spark = docs.sparkSession
    limits = spark.createDataFrame([(k, min(whole, whole * 3 * per_language // (2 * n) + 1)) for k, n in counts.items()], "lang string, most long")
    # By id and text, so that rows under one id are drawn apart; rows that repeat both are one draw, cut at the limit.
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(whole))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    sample = usable.join(F.broadcast(limits), "lang").withColumn("draw", drawn).filter(F.col("draw") < F.col("most")).withColumn("place", place).filter(F.col("place") <= per_language)
    chosen = sorted(sample.select("lang", "text", "place").collect(), key=lambda r: (r["lang"], r["place"]))
    # A language of a few rows, all drawn over the bound of the first cut, still has its first ones.
    missed = set(counts) - {r["lang"] for r in chosen}
    if missed:
        rest = usable.filter(F.col("lang").isin(*missed)).withColumn("draw", drawn).withColumn("place", place).filter(F.col("place") <= per_language)
        chosen += sorted(rest.select("lang", "text", "place").collect(), key=lambda r: (r["lang"], r["place"]))
    return fit([r["text"] for r in chosen], [r["lang"] for r in chosen])


def predict(docs: DataFrame, model: Model, to: str = "prediction", text_col: str = "text") -> DataFrame:
    """Adds a struct (lang_pred, score, lead, ambiguous: whether the lead is small). The model's size is fixed by its buckets and bits."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, lead double, ambiguous boolean")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for part in parts:
            made = [decode(shared.value, t.as_py()) for t in part]
            lang, score, lead = zip(*made, strict=True) if made else ((), (), ())
            near = [x < AMBIGUOUS and name != "und" for name, x in zip(lang, lead, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(lead, pa.float64()), pa.array(near, pa.bool_())], ["lang_pred", "score", "lead", "ambiguous"])

    return docs.withColumn(to, run(F.col(text_col).cast("string")))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs)
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "prediction.lang_pred", "prediction.score", "prediction.ambiguous")
