"""The Merkle manifest against a plain version, at small cells and blocks as at the usual ones."""

import hashlib
import zlib

import duckdb
import pytest
from corpus_cases import EDGES, table
from pyspark.sql import functions as F

from opalyx.llm import merkle
from opalyx.runtime import shared_dir


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    i, source, lang, n, text = row
    n = None if n is None else n + more
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes, fanout):
    """Root and, for each node, its siblings as (before, after) from below."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(at):
            start = p - p % fanout
            paths[k].append(("".join(level[start:p]), "".join(level[p + 1 : start + fanout])))
            at[k] = p // fanout
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    done = []
    for lang in order:
        ranked = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        done.append((ranked, *tree([leaf(r) for r in ranked], fanout)))
    root, upper = tree([d[1] for d in done], fanout)
    out = []
    for (ranked, subroot, paths), above in zip(done, upper, strict=True):
        for r, path in zip(ranked, paths, strict=True):
            whole = path + above
            x = leaf(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for before, after in whole:
                x = h(before, x, after)
            out.append((r[0], leaf(r), subroot, root, h(*(b + a for b, a in whole)), x, x == root))
    return sorted(out, key=str)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def rows_of_many(n=700):
    rows = [(k * 37 % 5_000 - 900, "s", ["en", "fr", None, "é", ""][k % 5] if k % 3 else "en", k if k % 11 else None, f"text {k % 50}") for k in range(n)]
    rows += [(77, "hot", "en", 3, "one text")] * 120 + [(78, "hot", "en", k, "other texts") for k in range(150)] + [(None, None, "en", None, None)] * 60 + [(5, "s", f"only {k}", 1, "x") for k in range(9)]
    return rows + [(2**63 - 1, "s", "en", 1, "last"), (-(2**63), "s", "en", 1, "first")]


def digest(spark, docs, **how):
    proven = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, **how)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
    found = proven.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256), merkle.folded(F.coalesce("changed", "leaf"), F.col("path")).alias("f"), "changed").collect()
    return sorted([(*r[:6], r.f == r.root) for r in found], key=str)


@pytest.mark.parametrize(("fanout", "block", "cell", "digits"), [(2, 4, 5, 1), (3, 9, 64, 2), (2, 1024, 4096, 3)])
def test_manifest_is_that_of_the_plain_version(spark, fanout, block, cell, digits):
    rows = rows_of_many()
    assert digest(spark, docs_of(spark, rows), fanout=fanout, block=block, cell=cell, digits=digits) == plain(rows, fanout)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_manifest_of_few_rows(spark, n):
    rows = [(k, None, None, None, None) for k in range(n)]
    assert digest(spark, docs_of(spark, rows)) == plain(rows)


def test_query_and_statement_on_odd_rows(spark):
    path = shared_dir(spark, "manifest")
    table(spark, EDGES, "en").union(table(spark, EDGES)).write.parquet(f"{path}/documents.parquet")
    got = sorted(map(tuple, merkle.op13_merkle(spark, path).collect()), key=str)
    rows = [(i, None, lang, None if t is None else len(t), t) for lang in ("en", None) for i, t in EDGES]
    assert got == plain(rows)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path.removeprefix('file://')}/documents.parquet/*.parquet'")
    rel = c.sql(merkle.OP13_SQL)
    at = [rel.columns.index(x) for x in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]
    assert sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=str) == got


def test_empty_table(spark):
    path = shared_dir(spark, "manifest")
    table(spark, []).write.parquet(f"{path}/documents.parquet")
    assert merkle.op13_merkle(spark, path).collect() == []
