"""Connected components of an edge table, by contraction, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalyx.runtime import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge (a, b of type long).

    Each round orders the nodes anew by a hash. Every node points at the first of its neighbours and
    itself, pointers are followed twice, and edges are rewritten to what their ends point at; loops
    and repeats go. A node with an edge is as likely as not to come after one of its neighbours,
    whatever the graph, and is then contracted away: the nodes that are left are expected to halve at
    least, so rounds follow the logarithm of the largest component, and they go on until no edge is
    left. What a round's nodes point at is kept as it is and followed from the last round back to the
    first, so a node is joined once for each round that it had an edge in, twice or so. A node with very many edges is one key of an aggregation that tasks prepare in part, and
    of joins whose other side has one row for it, which Spark can split.
    """
    left = written(_tidy(edges), "edges")
    hops: list[DataFrame] = []
    while not left.isEmpty():
        place = lambda c, r=len(hops): F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("h"), F.col(c).alias("up"))
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        first = both.groupBy("node").agg(F.min(place("to")).alias("m")).select("node", F.least(place("node"), "m")["up"].alias("up"))
        first = written(first, "pointers")
        done = [left, first]
        hop = first.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        jumped = first.join(hop, "up").select("node", F.col("up2").alias("up"))
        jumped = written(jumped.join(hop, "up").select("node", F.col("up2").alias("up")), "pointers")
        hops.append(jumped)
        a, b = jumped.select(F.col("node").alias("a"), F.col("up").alias("ua")), jumped.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        left = written(_tidy(left.join(a, "a").join(b, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b"))), "edges")
        discard(*done)
    if not hops:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    held = hops.pop()
    labels = held.withColumnRenamed("up", "component")
    while hops:
        done = [held, hops.pop()]
        held = labels = written(done[1].join(labels.withColumnRenamed("node", "up"), "up", "left").select("node", F.coalesce("component", "up").alias("component")), "labels")
        discard(*done)
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    named = written(labels.join(least, "component").select("node", F.col("least").alias("component")), "labels")
    discard(held)
    return named


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
