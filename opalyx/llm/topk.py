"""Exact top-k inner products by the three-phase uniform threshold algorithm.

A vector's components are split into m slices; the inner product is the sum of m partial products,
one from each list. A node holds the slices of one block of candidates, and so m local lists for
each query. Equal vectors are one candidate, with the k + 1 least of their ids; no other id of them
can be among a query's k best.

1. Each node returns, for each query, the vectors of the k highest entries of each of its lists,
   with their scores. The k-th highest of these scores is the cutoff t, hence never above the true
   k-th score.
2. With t for each query, a vector whose total reaches t has an entry of at least t / m in some list
   (also where scores are negative). Nodes collect the entries at or over ceil(t / m), add up what
   they hold of such a vector, and return it where it can reach t.
3. The vectors that are left are scored exactly, and ranked with their ids.

What phases 1 and 2 return follows k and the number of blocks, not the pairs. Queries meet the
candidates in blocks: a block of bounded size is held by a task while the queries stream past it,
so nothing is broadcast and no pair of rows leaves a node but the vectors returned.

Defined results: vectors that are null, or hold a null or non-finite component, or whose id is
null, take no part; vectors of differing lengths are compared over the longest, missing components
as 0; of rows that repeat an id each counts as a candidate of its own, as a query the least vector
counts, and a query's own id is never its candidate; ties go to the smaller id; fewer candidates
than k give fewer rows; empty tables give no rows; columns other than the id and the vector are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opalyx.runtime import ship, written

#: Two lists keep the cutoff of one list, t / m, far enough out to collect few entries.
LISTS = 2


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as long, without the vectors that take no part."""
    v = F.col(vector_col)
    whole = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    lens = np.asarray(column.value_lengths().fill_null(0), "i8")
    out = np.zeros((len(lens), width), "i8")
    rows = np.repeat(np.arange(len(lens)), lens)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lens) - lens, lens)] = np.asarray(column.flatten(), "i8")
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can pass 2**53, else in integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**52:
        return (q.astype("f8") @ c.T.astype("f8")).astype("i8")
    return q @ c.T


def _by_blocks(batches: Iterator[pa.RecordBatch], width: int, query_block: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From rows sorted by (block, is_query): (only ids, candidates' numbers and matrix, queries' rows and matrix), query_block at a time."""
    block, held, c = None, [], None
    for batch in batches:
        blocks, asks = np.asarray(batch.column("cb")), np.asarray(batch.column("is_query").cast(pa.int8()))
        cuts = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1]), [True]]))
        for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = batch.slice(at, end - at)
            if blocks[at] != block:
                block, held, c = blocks[at], [], None
            if not asks[at]:
                held.append((np.asarray(part.column("u")), np.asarray(part.column("only").fill_null(_NO_ID)), _matrix(part.column("v"), width)))
                continue
            if c is None and held:
                c = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            for k in range(0, part.num_rows if c else 0, query_block):
                q = part.slice(k, query_block)
                yield *c, q, _matrix(q.column("v"), width)


_NO_ID = np.iinfo("i8").min
#: Below every score.
_LOWEST = -(1 << 62)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, *, query_block: int = 512, candidate_block: int = 8192, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query. Both inputs are (vec_id, v)."""
    spark = candidates.sparkSession
    ship(spark)
    once = candidates.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("rows"))
    least = once.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    stored = written(least.groupBy("v").agg(F.collect_list(F.struct("vec_id", "rows")).alias("ids")).withColumn("u", F.monotonically_increasing_id()), "vectors")
    n, width = stored.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    asked = written(queries.groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v"), "queries")
    width, c_blocks = max(1, width), max(1, -(-n // candidate_block))
    edges = np.linspace(0, width, lists + 1).astype(int)
    # The id of a vector that has no other: it isn't a candidate of that query.
    held = stored.select(F.pmod(F.xxhash64("u"), F.lit(c_blocks)).cast("int").alias("cb"), F.lit(False).alias("is_query"), "u", F.when(F.size("ids") == 1, F.col("ids")[0]["vec_id"]).alias("only"), F.lit(None).cast("long").alias("cut"), "v")

    def nodes(asked: DataFrame, work, schema: str) -> DataFrame:
        sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"), F.lit(True).alias("is_query"), F.col("query_id").alias("u"), F.lit(None).cast("long").alias("only"), "cut", "v")
        return held.unionByName(sent).repartition("cb").sortWithinPartitions("cb", "is_query").mapInArrow(work, schema)

    def local(batches: Iterator[pa.RecordBatch]):
        for u, only, c, part, q in _by_blocks(batches, width, query_block):
            q_ids = np.asarray(part.column("u"))
            parts = [_products(q[:, edges[j] : edges[j + 1]], c[:, edges[j] : edges[j + 1]]) for j in range(lists)]
            yield u, q_ids, q_ids[:, None] != only[None, :], parts, part

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, q_ids, other, parts, _ in local(batches):
            total, m = sum(parts), min(k, len(u))
            named = np.zeros(other.shape, bool)
            for part in parts:
                masked = np.where(other, part, _LOWEST)
                np.put_along_axis(named, np.argpartition(masked, len(u) - m, axis=1)[:, len(u) - m :], True, axis=1)
            rows, cols = np.nonzero(named & other)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(u[cols]), pa.array(total[rows, cols])], ["query_id", "u", "score"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, q_ids, other, parts, part in local(batches):
            cut = np.asarray(part.column("cut"))[:, None]
            floor = -(-cut // lists)
            rows, cols = np.nonzero(np.any([p >= floor for p in parts], axis=0) & (sum(parts) >= cut) & other)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(u[cols])], ["query_id", "u"])

    def best(rows: DataFrame, *ties) -> DataFrame:
        """The k best rows of each query; tasks keep k rows of a query before they are dealt."""
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    # Phase 1. With fewer than k scores there is no cutoff: everything is collected.
    gathered = nodes(asked.withColumn("cut", F.lit(None).cast("long")), first, "query_id long, u long, score long")
    cut = best(gathered, "u").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("cut"))
    with_cut = asked.join(cut, "query_id").select("query_id", "v", F.when(F.col("n") >= k, F.col("cut")).otherwise(F.lit(_LOWEST)).alias("cut"))
    # Phase 2.
    left = written(nodes(with_cut, second, "query_id long, u long"), "left")
    # Phase 3.
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    scored = left.join(stored, "u").join(asked.withColumnRenamed("v", "qv"), "query_id").select("query_id", dot.alias("score"), F.explode("ids").alias("x"))
    rows = scored.filter(F.col("x.vec_id") != F.col("query_id")).select("query_id", "score", "x.vec_id", F.explode(F.sequence(F.lit(1), F.col("x.rows").cast("int"))))
    return best(rows.drop("col"), "vec_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


#: Repeated ids in the tables do not occur; the plain statement of the contract.
OP9_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
