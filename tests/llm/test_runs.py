"""Periodic runs against a version that looks at every start and period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from corpus_cases import EDGES, prose, table
from hypothesis import given, settings
from hypothesis import strategies as st

from opalyx.llm import runs
from opalyx.runtime import shared_dir


def plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q - i), q)  # the least period comes first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def plain_row(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = (*top[0], 1000 * top[0][1] // top[0][2]) if top else (None,) * 4
    return (doc_id, len(found), *told, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def cases():
    rng = random.Random(11)
    out = [["a"] * 40, list("ab") * 9, list("aab") * 5 + list("aa"), list("abaab" * 7 + "abab" * 8), ["x"] * 11, ["x"] * 12, list("abcdef") * 2, list("abcde") * 2 + ["a"], list("abcde") * 2 + list("ab")]
    a, b = "a", "ab"
    while len(b) < 400:  # a Fibonacci word has the most squares
        a, b = b, b + a
    out.append(list(b))
    for _ in range(120):
        w = [rng.choice("ab") for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            s, k = rng.randrange(len(w) + 1), rng.randrange(1, 12)
            w[s:s] = [rng.choice("abcd") for _ in range(k)] * rng.randrange(2, 9) + [rng.choice("abcd")] * rng.randrange(14)
        out.append(w)
    return out


def test_runs_are_those_of_every_start_and_period():
    docs = cases()
    got = runs.runs_of(docs)
    assert got == [sorted(plain_runs(w), key=lambda r: (r[0], r[2])) for w in docs]
    assert sum(map(len, got)) > 100 and runs.runs_of([]) == [] and runs.runs_of([[], ["a"]]) == [[], []]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=70), max_size=4))
def test_runs_of_any_words(docs):
    assert runs.runs_of(docs) == [sorted(plain_runs(w), key=lambda r: (r[0], r[2])) for w in docs]


def test_suffix_array_and_tree():
    rng = random.Random(2)
    code = np.array([rng.randrange(3) for _ in range(200)])
    order, place, shared = runs.suffix_array(code)
    suffix = [tuple(code[i:]) for i in range(200)]
    assert order.tolist() == sorted(range(200), key=suffix.__getitem__) and place[order].tolist() == list(range(200))
    for k in range(1, 200):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        assert shared[k] == next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for depth, low, high, child, size in runs.nodes(shared).tolist():
        assert min(shared[low + 1 : high + 1]) == depth > max(shared[low], shared[high + 1] if high < 199 else 0)
        cuts = [low, *[k for k in range(low + 1, high + 1) if shared[k] == depth], high + 1]
        assert size == max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) and (child, child + size) in list(zip(cuts, cuts[1:], strict=False))


def test_walked_leaves_stay_under_n_log_n(monkeypatch):
    n = 1 << 12
    for code in (np.zeros(n, np.int64), np.array([bin(k).count("1") % 2 for k in range(n)])):
        tree = runs.nodes(runs.suffix_array(code)[2])
        assert (tree[:, 2] - tree[:, 1] + 1 - tree[:, 4]).sum() <= n * 12
    monkeypatch.setattr(runs, "LEAVES_AT_ONCE", 7)
    docs = cases()[:60]
    assert runs.runs_of(docs) == [sorted(plain_runs(w), key=lambda r: (r[0], r[2])) for w in docs]


@pytest.mark.parametrize("at_once", [30, 1_000_000])
def test_query_rows(spark, at_once):
    rows = [(k, " ".join(w)) for k, w in enumerate(cases())] + [(1000 + k, prose(k, 150)) for k in range(60)] + [r for r in EDGES if len(r[1] or "") < 9_000]
    got = runs.periodic_runs(table(spark, rows), prepare=runs.repeated_tail, words_at_once=at_once).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted((plain_row(*r) for r in rows), key=str)
    by = {r.doc_id: r for r in got if r.doc_id == 0}
    assert [tuple(x) for x in by[0].runs] == [(0, 40, 1)] and by[0].collapsed == "a"


def test_long_text_and_empty_table(spark):
    path = shared_dir(spark, "runs")
    unit = prose(3, 2_000)
    table(spark, [(1, " ".join([unit] * 40)), (3, " ".join(["x"] * 60_000))]).write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r for r in runs.op11_runs(spark, path).collect()}
    assert (got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (0, 80_000, 2_000, 40_000)
    assert (got[3].n_runs, got[3].length, got[3].period) == (1, 60_000, 1)
    assert runs.periodic_runs(table(spark, [])).collect() == []
