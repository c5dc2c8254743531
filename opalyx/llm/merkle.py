"""Merkle manifest of a dataset: exact ranks by digit histograms, a trie of rank digits, proofs.

Leaves are ranked within their group without a global sort. A row's key is a string of hexadecimal
digits in the order wanted: its doc_id (null first), its leaf hash, the row's number. Histograms of
the keys' leading digits are taken level by level, and only within cells that still hold more than
CELL rows; a cell's first rank is its parent's plus the counts of smaller digits beside it. The digits
that all keys of a cell share are passed over at once. What is left in a cell, at most CELL rows, is
numbered by a window. A doc_id that stands in very many rows is split by the digits that follow it.

Ranks written to the base fanout are the keys of a trie: nodes that agree in all but their last m
digits meet in one task, which hashes m levels and passes on one node for the next longest prefix.
Going back down, each block adds its own part to the path of siblings that its node already has. A
task holds a block of at most fanout ** m nodes. The groups' own roots, ranked by their names'
bytes, make the upper tree in the same way.

Defined results: a null field counts as "-"; a null doc_id ranks first and is never tampered; rows
that share an id rank by their leaf hash, and equal rows have leaves of their own, one after another;
texts of any length are hashed whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opalyx.runtime import written

FANOUT, BLOCK = 2, 1024
#: Rows of a cell that one window may number, and digits of one histogram (of 16 each).
CELL, DIGITS = 4096, 3
#: Rows of a table of cells up to which it is sent to every task.
FEW = 200_000
_PATH = "array<struct<before:string,after:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def node_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def ranked(rows: DataFrame, key: Column, *, cell: int = CELL, digits: int = DIGITS) -> DataFrame:
    """rows (with a column g, never null) and their rank from 0 within g by key, a string of hexadecimal digits unique in g; size: rows of g."""

    def extent(by: list) -> list:
        """How many rows, and up to which digit the next histogram goes: past what the least and the greatest key share."""
        lo, hi = F.min("_key"), F.max("_key")
        same = F.aggregate(F.sequence(F.lit(1), F.length("hi")), F.lit(0), lambda c, i: F.when((c == i - 1) & (F.substring("lo", i, F.lit(1)) == F.substring("hi", i, F.lit(1))), i).otherwise(c))
        return left.groupBy(*by).agg(F.count("*").alias("n"), lo.alias("lo"), hi.alias("hi")).withColumn("cut", same + digits)

    left = rows.withColumn("_key", key).withColumn("at", F.lit(""))
    cells = extent(["g", "at"]).select("g", "at", F.lit(0).cast("long").alias("first"), "n", "cut", F.col("n").alias("size"))
    ready = []
    while True:
        cells = written(cells, "cells")
        left = left.join(_few(cells), [c for c in ("g", "at", "size") if c in left.columns])
        ready.append(left.filter(F.col("n") <= cell).drop("cut", "n"))
        if cells.filter(F.col("n") > cell).isEmpty():
            break
        left = left.filter(F.col("n") > cell).withColumn("parent", F.col("at")).withColumn("at", F.expr("substring(_key, 1, cut)")).drop("cut", "n")
        kids = extent(["g", "size", "parent", "first", "at"])
        before = Window.partitionBy("g", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        cells = kids.select("g", "at", (F.col("first") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first"), "n", "cut", "size")
        left = left.drop("parent", "first")
    number = F.row_number().over(Window.partitionBy("g", "at").orderBy("_key"))
    return reduce(DataFrame.unionByName, ready).withColumn("rank", F.col("first") + number - 1).drop("first", "at", "_key")


def _levels_in(block: int, fanout: int) -> int:
    m = 1
    while fanout ** (m + 1) <= block:
        m += 1
    return m


def _depth(size: Column, fanout: int) -> Column:
    """Levels above size leaves until one node is left."""
    powers = [fanout**d for d in range(64) if fanout**d < 2**63]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < size))


def _blocks(nodes: DataFrame, step: int, fanout: int, m: int) -> DataFrame:
    """(g, size, rank of the block, kids in order, levels: the hashes of each level from the kids' up)."""
    rest = [c for c in nodes.columns if c not in ("g", "size", "rank")]
    width = fanout**m
    up = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / fanout).cast("int")), lambda i: F.sha2(F.array_join(F.slice(x, i * fanout + 1, F.lit(fanout)), ""), 256))
    climb = F.least(F.lit(m), F.greatest(F.lit(0), _depth(F.col("size"), fanout) - m * step))
    leaves = F.transform("kids", lambda k: k["node"])
    levels = _bind(leaves, lambda a: F.when(F.col("climb") == 0, F.array(a)).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("climb")), F.array(a), lambda s, _: F.concat(s, F.array(up(F.element_at(s, -1)))))))
    met = nodes.groupBy("g", "size", F.floor(F.col("rank") / width).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", *rest))).alias("kids"))
    return met.withColumn("climb", climb).select("g", "size", F.col("block").alias("rank"), "kids", levels.alias("levels"))


def _opened(blocks: DataFrame, above: DataFrame, fanout: int, m: int) -> DataFrame:
    """A row for each kid, with the path of its siblings up to the root; above has the path of each block by (g, rank)."""
    size = F.array(*(F.lit(fanout**j) for j in range(m + 1)))

    def own(levels: Column, i: Column) -> Column:
        def at(j: Column) -> Column:
            def sides(p: Column) -> Column:
                start = p - p % fanout
                row = levels[j]
                before, after = F.slice(row, start + 1, p - start), F.slice(row, p + 2, start + fanout - 1 - p)
                return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

            return _bind(F.floor(i / F.element_at(size, j + 1)).cast("int"), sides)

        return F.when(F.size(levels) == 1, F.array().cast(_PATH)).otherwise(F.transform(F.sequence(F.lit(0), F.size(levels) - 2), at))

    with_paths = _bind(F.col("levels"), lambda lv: F.transform("kids", lambda k, i: F.struct(k.alias("kid"), own(lv, i).alias("own"))))
    carried = [c for c in above.columns if c not in ("g", "size", "rank", "path")]
    joined = blocks.drop("size").join(above, ["g", "rank"])
    rows = joined.select("g", "size", *carried, F.col("path").alias("upper"), F.explode(with_paths).alias("x"))
    return rows.select("g", "size", *carried, "x.kid.*", F.concat("x.own", "upper").alias("path"))


def paths(nodes: DataFrame, upper: Callable[[DataFrame], DataFrame], *, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """Each node (g, size, rank, node, ...) with its path of siblings (from the node up; before, after) in the tree of its group.

    upper gets (g, node), the groups' roots, and returns (g, path, ...): what goes on above them."""
    m = _levels_in(block, fanout)
    depth = nodes.agg(F.max(_depth(F.col("size"), fanout)).alias("d")).first()["d"] or 0
    tables = [nodes]
    for step in range(max(1, -(-depth // m))):
        roots = _blocks(tables[step].select("g", "size", "rank", "node"), step, fanout, m).select("g", "size", "rank", F.element_at(F.element_at("levels", -1), 1).alias("node"))
        tables.append(written(roots, "nodes"))
    tops = tables.pop()
    above = tops.select("g", "size", "rank").join(upper(tops.select("g", "node")), "g")
    for step in reversed(range(len(tables))):
        above = _opened(_blocks(tables[step], step, fanout, m), above, fanout, m)
        if step:
            above = written(above.drop("node"), "paths")
    return above


def manifest(docs: DataFrame, changes: Column | None = None, *, fanout: int = FANOUT, block: int = BLOCK, cell: int = CELL, digits: int = DIGITS) -> DataFrame:
    """(doc_id, leaf, path, subroot, root, changed) of every row; changed: its leaf with n_chars one higher where changes holds, else null."""
    lang = F.col("lang").cast("string")
    leaf = lambda n: node_hash(*(field(n if c == "n_chars" else F.col(c)) for c in FIELDS))
    changed = F.when(changes, leaf(F.col("n_chars") + 1)) if changes is not None else F.lit(None).cast("string")
    g = F.when(lang.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.hex(lang)))
    rows = docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf(F.col("n_chars"))).alias("node"), F.unhex(changed).alias("changed"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "leaves")
    sixteen = lambda x: F.lpad(F.hex(x), 16, "0")
    ident = F.when(F.col("doc_id").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), sixteen(F.col("doc_id").bitwiseXOR(F.lit(-(2**63))))))
    leaves = ranked(rows, F.concat(ident, F.hex("node"), sixteen(F.col("row"))), cell=cell, digits=digits)
    leaves = written(leaves.select("g", "size", "rank", "doc_id", "node", "changed"), "ranked")

    def upper(subroots: DataFrame) -> DataFrame:
        langs = written(ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), "node"), F.col("group"), cell=cell, digits=digits), "groups")
        top = lambda roots: roots.select("g", F.array().cast(_PATH).alias("path"), F.col("node").alias("root"))
        found = paths(langs, top, fanout=fanout, block=block)
        return written(found.select(F.col("group").alias("g"), "path", F.col("node").alias("subroot"), "root"), "upper")

    text = leaves.withColumn("node", F.lower(F.hex("node"))).withColumn("changed", F.lower(F.hex("changed")))
    return paths(text, upper, fanout=fanout, block=block).select("doc_id", F.col("node").alias("leaf"), "path", "subroot", "root", "changed")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda h, p: node_hash(p["before"], h, p["after"]))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    proven = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
    rows = proven.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 as a fold over the bytes of a decimal number.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


def _sql_field(name: str, value: str | None = None) -> str:
    v = f"({value or name})::VARCHAR"
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END"


_LEAF = " || ".join(map(_sql_field, FIELDS))
_CHANGED = " || ".join(_sql_field(c, "n_chars + 1" if c == "n_chars" else None) for c in FIELDS)
OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('1' || hex(lang), '0') AS g, sha256({_LEAF}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN sha256({_CHANGED}) END AS changed FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
lower_tree AS (
  SELECT g, 0 AS lvl, pos, n, leaf AS node FROM ranked
  UNION ALL
  SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM lower_tree WHERE n > 1 GROUP BY g, lvl, pos // 2, n),
subs AS (SELECT g, node AS subroot, lvl AS top, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM lower_tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS lvl, pos, n, subroot AS node FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM upper_tree WHERE n > 1 GROUP BY lvl, pos // 2, n),
tops AS (SELECT node AS root, lvl AS top FROM upper_tree WHERE n = 1),
steps AS (
  SELECT r.g, r.pos, l.lvl AS step, (r.pos >> l.lvl) & 1 AS bit, x.node AS sibling FROM ranked r JOIN subs s ON s.g = r.g
    CROSS JOIN (SELECT DISTINCT lvl FROM lower_tree) l LEFT JOIN lower_tree x ON x.g = r.g AND x.lvl = l.lvl AND x.pos = xor(r.pos >> l.lvl, 1) WHERE l.lvl < s.top
  UNION ALL
  SELECT r.g, r.pos, 1000 + l.lvl, (s.pos >> l.lvl) & 1, x.node FROM ranked r JOIN subs s ON s.g = r.g
    CROSS JOIN (SELECT DISTINCT lvl FROM upper_tree) l CROSS JOIN tops t LEFT JOIN upper_tree x ON x.lvl = l.lvl AND x.pos = xor(s.pos >> l.lvl, 1) WHERE l.lvl < t.top),
proofs AS (SELECT g, pos, coalesce(string_agg(sibling, '' ORDER BY step), '') AS proof, list(bit::VARCHAR || coalesce(sibling, '') ORDER BY step) AS path FROM steps GROUP BY g, pos),
folds AS (
  SELECT r.*, s.subroot, t.root, sha256(coalesce(p.proof, '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(changed, leaf), coalesce(p.path, [])), lambda h, x: sha256(CASE WHEN x[1] = '0' THEN h || x[2:] ELSE x[2:] || h END)) AS folded_root
  FROM ranked r JOIN subs s ON s.g = r.g CROSS JOIN tops t LEFT JOIN proofs p ON p.g = r.g AND p.pos = r.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""
