"""Masked pseudo-likelihood: every token predicted from both sides, log-probabilities summed.

Words (lower case, between white space) are hashed to 2**18 buckets. The buckets that the corpus
holds are the leaves of a Huffman tree made from their counts; a window network, written in numpy,
predicts a token itself as the chain of turns from the root to its leaf. Each turn sees the two
tokens on each side (embeddings scaled by place and added, tanh, with a constant: h):

    log P(token | both sides) = sum over its turns of log sigmoid(+-(log odds + h . node))

The log odds are those of the counts below the node. The OWN nodes that most tokens pass have a
vector each. A node below them has seen too little to learn a vector and keeps its log odds, the
shares of the corpus, so the end of a rare token's chain is one number.

Training is spread over the corpus and meets every token of every document once. Documents are dealt
to shards by a hash of their id and text, so many that a shard has about SHARD_TOKENS tokens. In
each round (one, unless more are asked for) every shard trains a copy from the common parameters on
the windows of that round, its documents in the order of that hash (the places of a document are
dealt to the rounds in turn, from its start); the copies are averaged by their windows in the order
of the shards. Nothing depends on
how Spark splits the table, so a job that reruns tasks on other executors, or runs over other
partitions, gives the same scores. Parameters and the tree have a fixed size; what is gathered
grows with the shards and with the buckets in use.

Defined results: null or empty text has 0 tokens, log_prob 0 and no mean (null); rows that repeat an
id have a row each; rows that repeat id and text count each in the tree and train once; equal texts
have equal scores; texts of any length are scored whole; an empty table gives no rows; columns other
than the id and the text are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalyx.llm.common import texts
from opalyx.runtime import ship, with_keys, written

BUCKETS, ROWS, WIDTH = 1 << 18, 1 << 15, 15
OWN, TOP = 1 << 14, 128
SHARD_TOKENS, FAN = 4_000_000, 32
PLACES = (-2, -1, 1, 2)
PAD = BUCKETS
STEP = 4_096
#: Ranges of buckets in which tasks send their counts.
SLICES = 64


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, ids): the buckets of a text's words, written once and read by each pass."""
    kept = texts(docs).select("doc_id", F.btrim(F.lower("text"), F.lit(" \t\n\x0b\x0c\r")).alias("text"))
    words = F.transform(F.split("text", "[ \\t-\\r]+"), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    ids = F.when(F.col("text") == "", F.array().cast("array<int>")).otherwise(words)
    return written(kept.select("doc_id", ids.alias("ids")), "tokens")


class Tree:
    """Huffman tree of the buckets that occur. The node with the most tokens, the root, is node 0."""

    def __init__(self, counts: np.ndarray):
        leaves = np.flatnonzero(counts)
        leaves = leaves[np.argsort(counts[leaves], kind="stable")]
        n = len(leaves)
        inner = max(0, n - 1)
        weight = counts[leaves].tolist() + [0.0] * inner
        up, side = np.zeros(n + inner, "i4"), np.zeros(n + inner, "i1")
        leaf, node = 0, n
        for new in range(n, n + inner):  # leaves and nodes both come in order of their counts
            pair = []
            for _ in range(2):
                if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                    pair.append(leaf)
                    leaf += 1
                else:
                    pair.append(node)
                    node += 1
            weight[new] = weight[pair[0]] + weight[pair[1]]
            up[pair], side[pair[1]] = new, 1
        self.leaves, self.up, self.side = leaves, up, side
        odds = np.zeros(inner, "f4")
        w, one = np.asarray(weight), np.flatnonzero(side)
        odds[n + inner - 1 - up[one]] = np.log(w[one] / (w[up[one]] - w[one]))
        self.odds = odds

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length) of each bucket's turns, from the leaf up, and all turns: twice the node, and 1 where the turn is to the second side."""
        n, last = len(self.leaves), len(self.up) - 1
        at, turns, whose = np.arange(n), [], []
        live = np.arange(n)
        while len(live := live[at[live] < last]):
            turns.append(2 * (last - self.up[at[live]]) + self.side[at[live]])
            whose.append(live)
            at[live] = self.up[at[live]]
        start, length = np.zeros(BUCKETS, "i8"), np.zeros(BUCKETS, "i8")
        if not turns:
            return start, length, np.zeros(0, "i4")
        who = np.concatenate(whose)
        length[self.leaves] = each = np.bincount(who, minlength=n)
        start[self.leaves] = np.cumsum(each) - each
        return start, length, np.concatenate(turns)[np.argsort(who, kind="stable")].astype("i4")


class Turns:
    """The turns of tokens at nodes that have a vector, and the log-probability of the others on the way."""

    def __init__(self, tree: Tree):
        start, whole, self.all = tree.paths()
        self.odds = tree.odds
        node, second = self.all >> 1, self.all & 1
        z = np.where(second == 1, tree.odds[node], -tree.odds[node]).astype("f8")
        cost = np.concatenate([[0.0], np.cumsum(np.where(node >= OWN, np.logaddexp(0, -z), 0.0))])
        live = np.concatenate([[0], np.cumsum(node < OWN)])
        # chains go from the leaf to the root, and nodes are numbered from the root, so those without a vector come first
        self.length = live[start + whole] - live[start]
        self.start = start + whole - self.length
        top = np.concatenate([[0], np.cumsum(node < min(TOP, OWN))])
        self.top = top[start + whole] - top[start]  # the last ones
        self.rest = (cost[start] - cost[start + whole]).astype("f4")

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(turns of each token, nodes, sides) of their turns one after another."""
        lens = self.length.take(tokens)
        first = np.cumsum(lens) - lens
        turns = self.all.take(np.arange(lens.sum()) + np.repeat(self.start.take(tokens) - first, lens))
        return lens, turns >> 1, (turns & 1).astype("f4")


def fresh(seed: int = 3) -> list[np.ndarray]:
    """Embeddings (the last row, for places outside the text, included), scales by place, vectors of the nodes with a constant's."""
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.3, (ROWS + 1, WIDTH)).astype("f4"), np.ones((len(PLACES), WIDTH), "f4"), np.zeros((OWN, WIDTH + 1), "f4")]


def rows_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids == PAD, ROWS, ids & (ROWS - 1)).astype("u2")


def hidden(x: np.ndarray) -> np.ndarray:
    h = np.ones((len(x), WIDTH + 1), "f4")
    np.tanh(x, out=h[:, :WIDTH])
    return h


def _add_up(rows: np.ndarray, values: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows of so many, sums of their values)."""
    met = np.zeros(many, bool)
    met[rows] = True
    used, width = np.flatnonzero(met), values.shape[1]
    place = np.empty(many, "i8")
    place[used] = np.arange(0, width * len(used), width)
    cell = place.take(rows)[:, None] + np.arange(width)
    return used, np.bincount(cell.ravel(), values.ravel(), width * len(used)).astype("f4").reshape(-1, width)


def _wrong(z: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """By how much the turns' probabilities of the second side are off."""
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))) - (turn & 1).astype("f4")


def train_windows(params: list[np.ndarray], turns: Turns, windows: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = 0.1) -> int:
    """Adaptive gradient steps in place, one for each (context rows, tokens) batch; the number of windows."""
    emb, scale, out = params
    g_emb, g_scale, g_out = np.full(len(emb), 0.1, "f4"), np.full_like(scale, 0.1), np.full(len(out), 0.1, "f4")
    n, odds = 0, np.zeros(TOP, "f4")
    odds[: len(turns.odds)] = turns.odds[:TOP]
    for ctx, tokens in windows:
        n += len(tokens)
        less = turns.top.take(tokens) - turns.length.take(tokens)
        by = np.argsort(less, kind="stable")  # longest below the top first, so that a step of all paths is a slice
        ctx, tokens, less = ctx.take(by, axis=0), tokens.take(by), less.take(by)
        if not turns.length.take(tokens).any():
            continue
        start = turns.start.take(tokens)
        e = emb.take(ctx, axis=0)  # windows x places x width
        h = hidden(np.einsum("kpw,pw->kw", e, scale))
        # All windows meet the top nodes in one product; only the turns on their way count.
        lens, below = turns.top.take(tokens), -less
        turn = turns.all.take(np.arange(lens.sum()) + np.repeat(start + below - np.cumsum(lens) + lens, lens))
        at = np.repeat(np.arange(0, TOP * len(lens), TOP), lens) + (turn >> 1)
        top = out[:TOP]
        table = np.zeros((len(ctx), TOP), "f4")
        table.ravel()[at] = _wrong((h @ top.T + odds).ravel().take(at), turn)
        d_h, steps = table @ top, []
        for j in range(below[0]):
            m = int(np.searchsorted(less, -j))
            turn = turns.all.take(start[:m] + j)
            row = turn >> 1
            w = out.take(row, axis=0)
            wrong = _wrong(np.einsum("kw,kw->k", h[:m], w) + turns.odds.take(row), turn)
            w *= wrong[:, None]
            d_h[:m] += w
            steps.append((row, h[:m] * wrong[:, None]))
        changes = [(out, g_out, np.arange(TOP), table.T @ h)]
        if steps:
            rows, low = (np.concatenate(x) for x in zip(*steps, strict=True))
            changes.append((out, g_out, *_add_up(rows, low, OWN)))
        d_x = d_h[:, :WIDTH] * (1 - h[:, :WIDTH] ** 2)
        d_e = (d_x[:, None, :] * scale).reshape(-1, WIDTH)
        d_scale = np.einsum("kpw,kw->pw", e, d_x)
        g_scale += d_scale * d_scale
        scale -= rate * d_scale / np.sqrt(g_scale)
        changes.append((emb, g_emb, *_add_up(ctx.ravel(), d_e, len(emb))))
        for w, g, used, d in changes:
            own = g.take(used) + np.einsum("uw,uw->u", d, d) / d.shape[1]  # one rate for a row
            g[used] = own
            d *= (rate / np.sqrt(own))[:, None]
            w[used] = w.take(used, axis=0) - d
    return n


def padded(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens with two pads before, between and after the documents, and each token's place there."""
    lens = np.diff(offsets)
    place = np.arange(len(values)) + 2 * (1 + np.repeat(np.arange(len(lens)), lens))
    out = np.full(len(values) + 2 * (len(lens) + 1), PAD, "i4")
    out[place] = values
    return out, place


def places_of_round(offsets: np.ndarray, rounds: int, r: int) -> np.ndarray:
    """Which tokens a round trains on: each token of each document is in exactly one round."""
    lens = np.diff(offsets)
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lens)
    return np.flatnonzero(within % rounds == r)


def _lists(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(column)
    lens = np.asarray(ids.value_lengths().fill_null(0), "i8")
    return np.asarray(ids.flatten(), "i4"), np.concatenate([[0], np.cumsum(lens)])


class Scorer:
    def __init__(self, params: list[np.ndarray], tree: Tree):
        emb, scale, self.out = params
        self.places = [emb * s for s in scale]
        self.turns = Turns(tree)

    def log_probs(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each token, given both sides."""
        line, place = padded(values, offsets)
        rows = rows_of(line)
        got = np.zeros(len(values), "f4")
        for a in range(0, len(values), STEP):
            at = place[a : a + STEP]
            x = self.places[0].take(rows.take(at + PLACES[0]), axis=0)
            for e, p in zip(self.places[1:], PLACES[1:], strict=True):
                x += e.take(rows.take(at + p), axis=0)
            own = values[a : a + STEP]
            lens, node, side = self.turns.of(own)
            got[a : a + STEP] = self.turns.rest.take(own)
            if len(node):  # tokens that occur have a turn each, or there is one token alone
                z = np.einsum("dw,dw->d", np.repeat(hidden(x), lens, axis=0), self.out.take(node, axis=0)) + self.turns.odds.take(node)
                z *= 1 - 2 * side  # against the turn that was taken
                cost = np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z)))
                got[a : a + STEP] -= np.add.reduceat(cost, np.cumsum(lens) - lens)
        return got


def packed(arrays: list[np.ndarray]) -> bytes:
    sink = io.BytesIO()
    np.savez(sink, *arrays)
    return sink.getvalue()


def unpacked(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return [z[k] for k in z.files]


def counted(ids: DataFrame) -> DataFrame:
    """(k, n): tokens in each bucket of the SLICES ranges. A task sends a row for each range, however many tokens it has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(BUCKETS, "i8"), [], 0
        for batch in batches:
            held.append(np.asarray(batch.column(0).flatten(), "i4"))
            size += len(held[-1])
            if size >= 2 * BUCKETS:
                total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held, size = [], 0
        if size:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        if total.any():
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(SLICES), pa.int32()), "n": pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())})

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in tables:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(n.as_py(), "i8")
        if sums:
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.int32()), "n": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    return ids.select("ids").mapInArrow(count, "k int, n binary").repartition("k").mapInArrow(add, "k int, n binary")


def corpus_counts(ids: DataFrame) -> np.ndarray:
    """Tokens in each bucket, over the whole corpus."""
    got = counted(ids).toArrow()
    out = np.zeros((SLICES, BUCKETS // SLICES))
    for k, n in zip(got.column("k").to_pylist(), got.column("n"), strict=True):
        out[k] = np.frombuffer(n.as_py(), "i8")
    return out.ravel()


def shards(ids: DataFrame, tokens: int) -> DataFrame:
    """(shard, order, ids) of the documents with tokens: each id and text once, dealt by their hash."""
    n = max(1, -(-tokens // SHARD_TOKENS))
    own = ids.filter(F.size("ids") > 0).select(F.xxhash64("doc_id", F.isnull("doc_id"), "ids").alias("order"), "ids")
    repeated = written(own.groupBy("order").agg(F.count("*").alias("n")).filter("n > 1").select("order"), "repeated")
    if not repeated.isEmpty():
        once = with_keys(own, repeated, "order", "left_semi").dropDuplicates(["order"])
        own = with_keys(own, repeated, "order", "left_anti").unionByName(once)
    return own.select(F.pmod("order", F.lit(n)).cast("int").alias("shard"), "order", "ids")


def train(ids: DataFrame, tree: Tree, tokens: int, rounds: int = 1, batch_windows: int = 2048) -> list[np.ndarray]:
    spark = ids.sparkSession
    params, dealt, n_shards = fresh(), shards(ids, tokens), max(1, -(-tokens // SHARD_TOKENS))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((params, tree))

        def windows(parts: Iterator[tuple[np.ndarray, np.ndarray]], r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """(context rows, tokens) in steps, which grow, so that few windows are several steps."""
            held_ctx, held_own, size, step = [], [], 0, 64
            for values, offsets in parts:
                line, place = padded(values, offsets)
                met = places_of_round(offsets, rounds, r)
                rows, at = rows_of(line), place[met]
                held_ctx.append(np.stack([rows.take(at + p) for p in PLACES], 1))
                held_own.append(values[met])
                size += len(at)
                if size >= 32 * batch_windows:
                    c, y = np.concatenate(held_ctx), np.concatenate(held_own)
                    mixed, k = np.random.default_rng(len(c)).permutation(len(c)), 0
                    while len(c) - k >= step:
                        yield c.take(mixed[k : k + step], axis=0), y.take(mixed[k : k + step])
                        k, step = k + step, min(2 * step, batch_windows)
                    held_ctx, held_own, size = [c[mixed[k:]]], [y[mixed[k:]]], len(c) - k
            if size:
                c, y = np.concatenate(held_ctx), np.concatenate(held_own)
                mixed, k = np.random.default_rng(len(c)).permutation(len(c)), 0
                while k < len(c):
                    yield c[mixed[k : k + step]], y[mixed[k : k + step]]
                    k, step = k + step, min(2 * step, batch_windows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r, windows=windows) -> Iterator[pa.RecordBatch]:
            start, tree = shared.value
            turns = Turns(tree)
            for shard, parts in groupby(_documents(batches), key=lambda x: x[0]):
                own = [p.copy() for p in start]
                n = train_windows(own, turns, windows((x[1:] for x in parts), r))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [n], "p": pa.array([packed(own)], pa.binary())})

        copies = dealt.repartitionById(n_shards, "shard").sortWithinPartitions("shard", "order").select("shard", "ids").mapInArrow(run, "shard int, n long, p binary")
        # In levels of FAN copies, each in the order of the shards: the same sum whatever the partitions.
        of = FAN
        while True:
            copies = copies.repartition(F.floor(F.col("shard") / of)).sortWithinPartitions("shard").mapInArrow(_averaged(of), "shard int, n long, p binary")
            if of * SHARD_TOKENS >= tokens:
                break
            of *= FAN
        copies = copies.collect()
        if not copies:
            break
        params = [x.astype("f4") for x in unpacked(bytes(copies[0]["p"]))]
    return params


def _documents(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, ids, offsets) of rows sorted by shard, always so many documents of a shard but for its last ones."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        names = np.asarray(batch.column(0))
        at = 0
        while at < batch.num_rows:
            if held and held[0].column(0)[0].as_py() != names[at]:
                yield _joined(held)
                held, n = [], 0
            end = min(at + rows - n, int(np.searchsorted(names, names[at], "right")))
            held.append(batch.slice(at, end - at))
            n, at = n + end - at, end
            if n == rows:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray]:
    lists = [_lists(p, 1) for p in parts]
    lens = np.concatenate([np.diff(o) for _, o in lists])
    return parts[0].column(0)[0].as_py(), np.concatenate([v for v, _ in lists]), np.concatenate([[0], np.cumsum(lens)])


def _averaged(of: int):
    """Means of copies by their windows, for each run of so many shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, n, data.as_py()) for batch in batches for k, n, data in zip(batch.column("shard").to_pylist(), batch.column("n").to_pylist(), batch.column("p"), strict=True))
        for group, own in groupby(rows, key=lambda x: x[0] // of):
            n, total = 0, None
            for _, k, data in own:
                part = [x.astype("f8") * k for x in unpacked(data)]
                n, total = n + k, part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([group * of], pa.int32()), "n": [n], "p": pa.array([packed([x / n for x in total])], pa.binary())})

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum of conditional log-probabilities), mean_log_prob."""
    spark = docs.sparkSession
    ship(spark)
    ids = tokens(docs)
    counts = corpus_counts(ids)
    tree = Tree(counts)
    shared = spark.sparkContext.broadcast((train(ids, tree, int(counts.sum())), tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                values, offsets = _lists(part, 1)
                n, each = np.diff(offsets), scorer.log_probs(values, offsets)
                total = np.zeros(len(n))  # each text summed for itself, so that equal texts have equal sums
                total[n > 0] = np.add.reduceat(each.astype("f8"), offsets[:-1][n > 0]) if len(each) else 0.0
                mean = [t / k if k else None for t, k in zip(total.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(mean, pa.float64())], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return ids.mapInArrow(run, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
