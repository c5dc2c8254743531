"""A corpus pipeline: language ID, near duplicates, personal data, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again
as the docs of the next one. All but the last return the columns of documents.

* language: documents without a language that could be named (no letter, or null) go; so do those
  whose two likeliest languages can't be told apart.
* near_duplicates: of documents linked by a Jaccard similarity of 0.8 or more on shingles of five
  words, the one with the least id stays. Documents without words have no links and stay.
* personal_data: personal data and what discloses it are masked in the text; n_chars follows.
* packing: what is left is packed into sequences of 1024 tokens; a row for each piece.

Defined results of all stages: other columns are kept whatever their names (packing returns its own),
an empty table gives an empty one, texts of any length are read whole. Null texts: language lets
them go; near_duplicates and personal_data keep them as they are; packing counts them as empty.
Repeated rows: language and personal_data treat each for itself; of rows that repeat id and class
near_duplicates keeps one, and of rows under one id it tells those of differing classes apart;
packing gives each its pieces. A tie for the row that stays goes to the smaller id, rows without id last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalyx.llm import jaccard, langid, packing, pii
from opalyx.llm.common import free
from opalyx.runtime import with_keys, written

#: Least lead of the likeliest language over the second, as shares.
LEAD = 0.02
WORDS, SHARE = 5, 80
#: Pieces in the packing's memo: fewer than it takes alone, as the workers have met other stages before.
MEMO_PIECES = 200_000


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    p = free(docs, "_language")
    named = langid.predict(docs, model, p)
    return named.filter((F.col(f"{p}.lang_pred") != "und") & (F.col(f"{p}.lead") >= LEAD)).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, fp, key_fp = (free(docs, x) for x in ("_key", "_fp", "_key_fp"))
    groups = written(jaccard.near_duplicates(docs, WORDS, SHARE), "groups")
    members = groups.filter(F.col("fp").isNotNull())
    # The least (id, class) of each component stays.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("fp"))
    kept = members.groupBy("node_component").agg(F.min(order).alias("k"))
    marked = members.join(kept, "node_component").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("fp") == F.col("k.fp")))
    marked = written(marked.select("doc_id", "fp", "stays"), "marked")
    # An id that one row has decides by itself; rows that share an id, or have none, are told apart by class.
    shared = written(groups.groupBy("doc_id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias(key)), "shared")
    dropped = marked.filter(~F.col("stays") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(key)).distinct()
    own = F.col("doc_id").cast("long")
    alone = with_keys(with_keys(docs, shared, own.eqNullSafe(F.col(key)), "left_anti"), dropped, own == F.col(key), "left_anti")
    several = with_keys(docs, shared, own.eqNullSafe(F.col(key)), "left_semi").withColumn(fp, jaccard.class_of(F.col("text"), WORDS))
    stay = marked.filter("stays").select(F.col("doc_id").alias(key), F.col("fp").alias(key_fp)).distinct()
    met = several.filter(F.col(fp).isNotNull()).join(stay, own.eqNullSafe(F.col(key)) & (F.col(fp) == F.col(key_fp)), "left_semi")
    # Rows that repeat both id and class: one stays. Rows without words all stay.
    return alone.unionByName(met.dropDuplicates(["doc_id", fp]).drop(fp)).unionByName(several.filter(F.col(fp).isNull()).drop(fp)).select(*_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    s = free(docs, "_spans")
    found = pii.find(docs, "text", s)
    clean = pii.masked(F.col("text"), F.col(s))
    out = [clean.alias("text") if c == "text" else F.length(clean).cast(docs.schema[c].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*out)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), memo_pieces=MEMO_PIECES)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID and the packing can't be stated in SQL; tests compare each stage with brute force.
ORACLE_SQL = None
