"""The Jaccard join, components, top-k and the pipeline's stages against plain versions."""

import random
import re

import numpy as np
import pytest
from corpus_cases import CLASHING, EDGES, prose, table
from test_text_operators import check_pieces, key, plain_spans

import corpus_pipeline
from opalyx.llm import graph, jaccard, topk

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, words):
    w = [x for x in re.split("[ \t-\r]+", (text or "").translate(_LOWER)) if x]
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def plain_groups(texts, words, share):
    """Positions -> the least position reachable by links."""
    sets, up = [plain_set(t, words) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(x) for x in range(len(texts))], [len(s) for s in sets]


def near_copies(seed=5):
    """Texts of many lengths with copies edited in ever more places, chains among them."""
    rng, out = random.Random(seed), []
    for k in range(60):
        w = prose(seed * 1000 + k, rng.choice([1, 2, 3, 5, 12, 20, 40, 80, 200])).split()
        for _ in range(rng.randrange(1, 6)):
            out.append(" ".join(w))
            w = w[:]
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["new%d" % rng.randrange(9)], [w[at].upper()], [w[at], "added"]]) or (["left"] if len(w) == 1 else [])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("words", "share"), [(3, 90), (5, 80)])
def test_groups_are_those_of_all_pairs(spark, words, share):
    texts = near_copies()
    groups, sizes = plain_groups(texts, words, share)
    got = {r.doc_id: r for r in jaccard.near_duplicates(table(spark, list(enumerate(texts))), words, share).collect()}
    assert [got[i].component_id for i in range(len(texts))] == groups
    assert [got[i].n_shingles for i in range(len(texts))] == sizes


def test_join_of_odd_rows(spark):
    rows = [*EDGES, (40, "a text that has no id at all"), (50, "TWO Words")]
    got = jaccard.near_duplicates(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert len(got) == len(rows)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key)
    texts = [(i, t, plain_set(t, 3)) for i, t in rows]
    want = []
    for i, _, s in texts:
        same = [k for k, _, x in texts if s and x == s and k is not None]
        want.append((i, len(s), min(same) if same else (i if not s else None)))
    assert found == sorted(want, key=key)
    assert jaccard.near_duplicates(table(spark, [])).count() == 0


def test_blocks_lose_no_link(spark):
    texts = [prose(1, 200)] + [prose(1, 200) + f" tail{k}" for k in range(120)]
    rows = table(spark, list(enumerate(texts)))
    members, reps = jaccard.classes(rows, 3, 90)
    pieces = graph.components(jaccard.chain_edges(members))
    linked = graph.components(jaccard.true_links(rows, reps, pieces, 3, 90, block_rows=10))
    assert linked.select("component").distinct().count() == 1 and linked.count() == len(texts)


@pytest.mark.parametrize(("words", "share", "long_set"), [(3, 90, 1000), (5, 80, 1000), (5, 80, 1)])
def test_groups_of_small_blocks_are_those_of_all_pairs(spark, words, share, long_set):
    """Pieces of many blocks: cores that grow by hubs, open nodes beside them, and a chain whose ends aren't linked."""
    chain, w = [], prose(77, 120).split()
    for k in range(40):
        chain.append(" ".join(w))
        w[(7 * k) % len(w)] = f"changed{k}"
    texts = near_copies(9) + chain + [f"{prose(78, 60)} {prose(900 + k, 4)}" for k in range(30)]
    groups, _ = plain_groups(texts, words, share)
    docs = table(spark, list(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, words, share, block_rows=4, long_set=long_set).collect()}
    assert [got[i] for i in range(len(texts))] == groups


def test_rows_under_one_id_make_no_pairs(spark):
    rows = [(1, f"{prose(5, 40)} {k % 7}") for k in range(300)] + [(None, f"{prose(6, 40)} {k % 5}") for k in range(300)]
    members, reps = jaccard.classes(table(spark, rows), 3, 90)
    sets = jaccard.with_text_sets(table(spark, rows), reps, 3)
    assert sets.count() == reps.count() == 12
    got = jaccard.near_duplicates(table(spark, rows), 3, 90).collect()
    assert len(got) == 600 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (None, None)}


def test_divide_skip_finds_what_all_pairs_find():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 3000, n)) for n in (5, 30, 30, 200) for _ in range(5)]
    sets = sorted((np.unique(np.concatenate([np.delete(b, rng.integers(0, len(b), 2)), rng.integers(0, 3000, 1)])) for b in base for _ in range(4)), key=len)
    up = jaccard.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.overlaps_enough(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 80):
                up.join(i, j)
    mine = jaccard.Forest(len(sets))
    every = list(range(len(sets)))
    for a, b in jaccard.divide_skip(sets, every, every, 80):
        assert jaccard.overlaps_enough(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 80)
        mine.join(a, b)
    assert [mine.root(x) for x in every] == [up.root(x) for x in every]


def test_components_of_a_long_ascending_path(spark):
    path = spark.range(9_999).selectExpr("id + 5 AS a", "id + 6 AS b")
    star = spark.range(500).selectExpr("id + 20000 AS a", "CAST(30000 AS long) AS b")  # every leaf before the hub
    got = graph.components(path.union(star)).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in got} == {5: 10_000, 20_000: 501}


def test_labels_are_followed_once_for_each_round_of_a_node(spark, monkeypatch):
    """Pairs that are done in the first round aren't joined again for each round of a long path beside them."""
    rows, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (out := write(df, name), rows.append(out.count()) if name == "labels" else None)[0])
    pairs = spark.range(2000).selectExpr("1000 + 2 * id AS a", "1001 + 2 * id AS b")
    got = graph.components(pairs.union(spark.range(300).selectExpr("id AS a", "id + 1 AS b"))).groupBy("component").count().collect()
    assert sorted(r["count"] for r in got) == [2] * 2000 + [301]
    assert len(rows) > 3 and sum(rows) < 3 * 4301


def test_long_sets_meet_by_buckets_that_tell(spark):
    """Sets that have a common passage, or one shingle, don't meet for that; linked ones do, also where most is common."""
    rng = np.random.default_rng(8)
    new = lambda n: rng.integers(-(1 << 63), (1 << 63) - 1, n)
    passage, one = np.sort(new(60)), new(1)
    table = jaccard.bucket_table(4096, 80)
    made = [[dict(zip((own, own + 1), map(set, (map(int, a), map(int, b))), strict=True)) for own, a, b in [jaccard.signatures(s, table, passage)]][0] for s in (np.concatenate([passage, one, new(900)]) for _ in range(40))]
    meet = lambda x, y: any(x[k] & y.get(k, set()) for k in x)
    assert sum(meet(x, y) for i, x in enumerate(made) for y in made[:i]) < 40  # of 780 pairs
    for n, common in ((100, 0), (150, 149), (400, 100), (1000, 900), (1000, 1000)):
        for _ in range(20):
            base = new(n)
            drop = rng.permutation(n)[: n // 5]
            other = np.delete(base, drop)
            x, y = ({own: set(map(int, a)), own + 1: set(map(int, b))} for own, a, b in (jaccard.signatures(s, table, np.sort(base[:common])) for s in (base, other)))
            assert meet(x, y)


@pytest.mark.parametrize("frequent", [2, 16])
def test_groups_of_long_texts_with_common_passages(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    passages = [prose(700 + k, 40) for k in range(4)]
    texts = []
    for k in range(30):
        own = prose(800 + k, 60 + 12 * k)
        texts += [f"{passages[k % 4]} {own}", f"{own} {passages[(k + 1) % 4]}", f"{own} {prose(2000 + k, 5 + k)} {passages[k % 4]}"]
    texts += [" ".join(passages), " ".join(passages[::-1]), " ".join([*passages, "and a few more words"]), f"{passages[0]} {passages[1]} {passages[2]}"]
    groups, _ = plain_groups(texts, 5, 80)
    docs = table(spark, list(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, 5, 80, block_rows=4, long_set=1).collect()}
    assert [got[i] for i in range(len(texts))] == groups
    assert 4 < len(set(groups)) < len(texts)


def test_sieve_keeps_what_can_be_linked_connected():
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 1 << 40, n) for n in (60, 60, 200, 1000) for _ in range(4)]
    sets = [np.unique(np.concatenate([np.delete(b, rng.integers(0, len(b), 3)), rng.integers(0, 1 << 40, 3)])) for b in base for _ in range(6)]
    parts, n, every = [s[s % 5 == 0] for s in sets], np.asarray([len(s) for s in sets]), list(range(len(sets)))
    found, mine = jaccard.sieve(parts, n, every, every, np.arange(len(sets)), 80), jaccard.Forest(len(sets))
    assert all(mine.join(a, b) for a, b in found)  # a forest
    for i in every:
        for j in range(i):
            if jaccard.overlaps_enough(len(np.intersect1d(sets[i], sets[j])), int(n[i]), int(n[j]), 80):
                assert mine.root(i) == mine.root(j)
    assert len({mine.root(x) for x in every}) >= 16


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, 500 + k) for k in range(1, 300)] + [(900, 900)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(101)} == {0} and {got[500 + k] for k in range(300)} == {500}


# 9 ------------------------------------------------------------------------------------------


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(8)
    vectors = [(k, [float(x) for x in rng.normal(0, 0.3, 12)], "x") for k in range(600)]
    vectors += [(700 + k, vectors[k][1], "x") for k in range(0, 300, 3)]  # ties
    odd = [(2000, None, "x"), (2100, [None, 1.0], "x"), (2200, [float("nan")] * 12, "x"), (2300, [float("inf")] * 12, "x"), (None, [1.0] * 12, "x"), (2400, [1.0, -1.0], "x"), (2500, [], "x")]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>, v string")
    whole = topk.quantised(df)
    got = topk.top_k(whole.filter("vec_id % 100 = 0"), whole, query_block=3, candidate_block=97).collect()
    used = [(i, np.concatenate([np.floor(1024 * np.float32(v).astype("f8")).astype("i8"), np.zeros(12 - len(v), "i8")])) for i, v, _ in vectors + odd[-2:]]
    want = []
    for q, a in used:
        if q % 100 == 0:
            best = sorted((-int(a @ b), i) for i, b in used if i != q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_of_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [-3.0, 0.5])], "vec_id long, embedding array<float>")
    whole = topk.quantised(two)
    assert [tuple(r) for r in topk.top_k(whole.filter("vec_id = 0"), whole).collect()] == [(0, 1, 1, -3072 * 1024 + 512 * 2048)]
    assert topk.top_k(whole.limit(0), whole).count() == 0 and topk.top_k(whole.limit(0), whole.limit(0)).count() == 0


def test_top_k_of_equal_vectors_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    base = [[float(x) for x in rng.normal(0, 0.2, 64)] for _ in range(9)]
    rows = [(k, base[k % 9 if k % 3 else 0]) for k in range(400)] + [(100, base[3])] * 30 + [(7, base[1])] * 4 + [(200, [float(x) for x in rng.normal(0, 0.2, 40)])]
    whole = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(whole.filter("vec_id % 100 = 0"), whole, query_block=2, candidate_block=2).collect()
    used = [(i, np.concatenate([np.floor(1024 * np.float32(v).astype("f8")).astype("i8"), np.zeros(64 - len(v), "i8")])) for i, v in rows]
    want = []
    for q in (0, 100, 200, 300):
        a = min((tuple(v.tolist()[: len(r[1])]), k) for k, (r, (i, v)) in enumerate(zip(rows, used, strict=True)) if i == q)[1]
        best = sorted((-int(used[a][1] @ b), i) for i, b in used if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


# pipeline -----------------------------------------------------------------------------------

LANGS = {"aa": "zu zo ze zal zur".split(), "bb": "kri kra kro krel krin".split(), "cc": "mul mol mel mund mir".split()}


def corpus():
    rng, rows = random.Random(6), []
    for k in range(150):
        c = rng.choice(list(LANGS))
        rows.append((100 + k, " ".join(rng.choice(LANGS[c]) + rng.choice("aeiou") for _ in range(30)), c))
    rows += [(300, rows[0][1], rows[0][2]), (301, rows[1][1] + " more", rows[1][2]), (302, rows[2][1] + " write to a.b@c.org", rows[2][2])]
    return rows + [(i, t, None) for i, t in EDGES]


def test_language_stage(spark):
    rows = corpus()
    docs = table(spark, rows)
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {r[0] for r in rows if r[2]} <= ids and not ids & {1, 2, 3}


def test_near_duplicate_stage(spark):
    rows = [r for r in corpus() if r[0] != 5]
    texts = [t for _, t, _ in rows]
    docs = table(spark, rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    groups, sizes = plain_groups([texts[k] for k in order], 5, 80)
    want = [rows[k][:2] for n, k in enumerate(order) if groups[n] == n or not sizes[n]]
    assert sorted([(r.doc_id, r.text) for r in kept], key=lambda r: key((r[0], r[1] or ""))) == sorted(want, key=lambda r: key((r[0], r[1] or "")))
    repeated = corpus_pipeline.near_duplicates(spark, table(spark, [(5, "one row that is here two times")] * 2 + [(5, "and one more row under the id")]), "").collect()
    assert sorted(r.text for r in repeated) == ["and one more row under the id", "one row that is here two times"]


def test_personal_data_stage(spark):
    docs = table(spark, corpus())
    out = corpus_pipeline.personal_data(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count() and not any(plain_spans(r.text or "") for r in rows if r.doc_id == 302)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    by = {r.doc_id: r.text for r in rows}
    assert by[1] is None and by[4] == "two words"


def test_run_applies_every_stage(spark, tmp_path):
    for name, rows in (("full", corpus()), ("none", [])):
        table(spark, rows).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            function(spark, docs, "").write.parquet(f"file://{tmp_path}/{name}/{stage}")
            docs = spark.read.parquet(f"file://{tmp_path}/{name}/{stage}")
        got = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        left = [(r.doc_id, r.text) for r in docs.collect()]
        if left:
            check_pieces(got, left)
        assert bool(got) == bool(left)
    assert set(CLASHING) <= set(docs.columns)
