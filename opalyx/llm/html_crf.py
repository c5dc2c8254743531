"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (text runs between block-level borders) with the tags, classes, ids
and roles of their ancestors. Features of a block are its ancestors' and its text's (length, link
share, final punctuation and so on); two labels, content and not; weights for features and for
label pairs. Training maximises the likelihood of labelled pages by forward-backward; Viterbi
decodes. The labelled pages are made by rule from many layouts (labelled_pages), as the tables hold
none; the model's size is that of this vocabulary.

Inside a block white space becomes one space; character references are decoded; <br> is white
space; blocks of content are joined by a line feed in page order.

Defined results: null or empty html, or a page without content: empty text, 0 characters; repeated
rows keep a row each; a cut-off tag at a page's end is dropped; pages of any length are read whole;
where two labellings score the same, a block is not content; an empty table gives no rows; columns
other than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalyx.runtime import ship

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select)\b(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[A-Za-z]+")
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul button".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Block:
    __slots__ = ("text", "names", "own", "linked")

    def __init__(self, text: str, names: tuple[str, ...], own: str, linked: int):
        self.text, self.names, self.own, self.linked = text, names, own, linked


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks with text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    count: Counter = Counter()  # names that hold here
    opened: Counter = Counter()  # tags on the stack
    run: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                own = next((t for t, _ in reversed(stack) if t in BLOCK_TAGS), "")
                out.append(Block(text, tuple(count), own, min(linked, len(text))))
            run.clear()
        linked = 0

    def pop() -> str:
        tag, names = stack.pop()
        opened[tag] -= 1
        for n in names:
            count[n] -= 1
            if not count[n]:
                del count[n]
        return tag

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            text = entities.unescape(text) if "&" in text else text
            run.append(text)
            if opened["a"]:
                linked += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            run.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
        if m["end"]:
            if opened[tag] > 0:
                while pop() != tag:
                    pass
            continue
        if tag in VOID_TAGS:
            continue
        if tag in BLOCK_TAGS and opened["p"] > 0:  # a paragraph ends where a block begins
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in BLOCK_TAGS:
                k -= 1
            if k >= 0 and stack[k][0] == "p":
                while pop() != "p":
                    pass
        names = (f"tag={tag}",)
        if m["attrs"] and "=" in m["attrs"]:
            names += tuple({f"name={w.lower()}" for a in _ATTR.finditer(m["attrs"]) for w in _NAME.findall(a[2])})
        stack.append((tag, names))
        opened[tag] += 1
        count.update(names)
    flush()
    return out


def block_features(b: Block) -> list[str]:
    words = b.text.count(" ") + 1
    share = b.linked / len(b.text)
    return [
        *b.names,
        f"own={b.own}",
        f"words={min(6, int(math.log2(words)))}",
        f"links={0 if share == 0 else 1 if share < 0.5 else 2}",
        f"stop={b.text[-1] in '.!?…»”\"'}",
        f"sign={'©' in b.text}",
        "bias",
    ]


class Crf:
    """Two labels, 1 for content. Weights of features count towards label 1; label pairs have weights of their own."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.pairs = np.zeros((2, 2))
        self.start = np.zeros(2)

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        get = self.weights.get
        return np.asarray([sum(get(f, 0.0) for f in r) for r in rows])

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        if not rows:
            return []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        s = self.scores(rows).tolist()
        zero, one = float(self.start[0]), float(self.start[1]) + s[0]
        back: list[tuple[int, int]] = []
        for x in s[1:]:
            from0 = 0 if zero + p00 >= one + p10 else 1
            from1 = 1 if one + p11 >= zero + p01 else 0
            back.append((from0, from1))
            zero, one = max(zero + p00, one + p10), max(zero + p01, one + p11) + x
        label = int(one > zero)
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]

    def marginals(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """P(label) of each block and the expected count of each label pair, by forward-backward in logarithms."""
        n = len(rows)
        emit = np.zeros((n, 2))
        emit[:, 1] = self.scores(rows)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0] = self.start + emit[0]
        for i in range(1, n):
            a[i] = emit[i] + np.logaddexp(*(a[i - 1][:, None] + self.pairs))
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp(*(self.pairs + emit[i + 1] + b[i + 1]).T)
        z = np.logaddexp(*a[-1])
        pairs = sum((np.exp(a[i - 1][:, None] + self.pairs + emit[i] + b[i] - z) for i in range(1, n)), np.zeros((2, 2)))
        return np.exp(a + b - z), pairs

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 4, rate: float = 0.5, decay: float = 1e-4) -> Crf:
        """Stochastic gradient with per-weight step sizes on the conditional log-likelihood."""
        seen: dict[str, float] = {}
        seen_pairs, seen_start = np.full((2, 2), 1e-8), np.full(2, 1e-8)
        for _ in range(epochs):
            for rows, labels in pages:
                p, pairs = self.marginals(rows)
                grad: dict[str, float] = {}
                for r, y, q in zip(rows, labels, p[:, 1].tolist(), strict=True):
                    for f in r:
                        grad[f] = grad.get(f, 0.0) + y - q
                for f, g in grad.items():
                    g -= decay * self.weights.get(f, 0.0)
                    seen[f] = seen.get(f, 1e-8) + g * g
                    self.weights[f] = self.weights.get(f, 0.0) + rate * g / math.sqrt(seen[f])
                d = -pairs
                for x, y in zip(labels, labels[1:], strict=False):
                    d[x, y] += 1
                s = -p[0]
                s[labels[0]] += 1
                seen_pairs += d * d
                seen_start += s * s
                self.pairs += rate * d / np.sqrt(seen_pairs)
                self.start += rate * s / np.sqrt(seen_start)
        return self


# Usual names of page parts.
_MENUS = "nav navbar menu navigation breadcrumb breadcrumbs toc pagination skip tabs topbar".split()
_HEADS = "header masthead banner logo branding site-header".split()
_FEET = "footer colophon copyright legal site-footer bottom".split()
_SIDES = "sidebar aside widget related recommended popular trending archive tags rail".split()
_NOTICES = "cookie notice consent gdpr alert popup modal overlay paywall newsletter subscribe disclaimer".split()
_ADVERTS = "ad ads advert advertisement sponsored sponsor promo promotion adsense banner-ad".split()
_FORMS = "form search login signup contact feedback poll survey".split()
_COMMENTS = "comment comments reply replies discussion disqus respond reader-comments thread".split()
_SHARES = "share sharing social follow byline-tools print".split()
_BODIES = "content main post entry article story body text article-body post-content entry-content main-content".split()


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Feature rows and labels of n pages of varied layout, made by rule. Each block's first word tells its label."""
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        labels: dict[str, int] = {}

        def say(content: bool, low: int, high: int, stop: float, sign: bool = False) -> str:
            key = f"k{len(labels)}k"
            labels[key] = int(content)
            words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
            end = "." if rng.random() < stop else ""
            between = rng.choice([" | ", "!! ", "### "]) if rng.random() < 0.06 else " "
            said = between.join(words)
            if rng.random() < 0.06:
                said = said.upper()
            open_, close = rng.choice([("<b>", "</b>"), ("<span>", "</span>"), ("<i>", "</i>")]) if rng.random() < 0.1 else ("", "")
            return open_ + key + " " + ("&copy; " if sign else "") + said + end + close

        def attr(names: list[str]) -> str:
            return rng.choice(["", f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} x{rng.randint(0, 9)}"'])

        def named(names: list[str]) -> str:
            return f' {rng.choice(["class", "id"])}="{rng.choice(names)}"'

        def links(k: int) -> str:
            return "<ul>" + "".join(f'<li><a href="/{i}">{say(False, 0, 3, 0.1)}</a></li>' for i in range(k)) + "</ul>"

        def menu() -> str:
            return rng.choice([f"<nav{attr(_MENUS)}>{{}}</nav>", f"<div{named(_MENUS)}>{{}}</div>", f"<header{attr(_HEADS)}>{{}}</header>"]).format(links(rng.randint(2, 7)))

        def head() -> str:
            return rng.choice([f"<header{attr(_HEADS)}><p>{{}}</p></header>", f"<div{named(_HEADS)}>{{}}</div>", f"<header><h1>{{}}</h1></header>"]).format(say(False, 1, 9, 0.3))

        def advert() -> str:
            return f"<{(t := rng.choice(['div', 'aside', 'section', 'p']))}{named(_ADVERTS)}>{say(False, 2, 25, 0.8)}</{t}>"

        def notice() -> str:
            return f"<{(t := rng.choice(['div', 'section', 'p', 'aside']))}{named(_NOTICES)}>{say(False, 3, 30, 0.8)} <button>{say(False, 1, 2, 0)}</button></{t}>"

        def side() -> str:
            inner = rng.choice([links(rng.randint(2, 6)), f"<h3>{say(False, 1, 4, 0)}</h3><p>{say(False, 3, 25, 0.7)}</p>"])
            return rng.choice([f"<aside{attr(_SIDES)}>{inner}</aside>", f"<div{named(_SIDES)}>{inner}</div>"])

        def form() -> str:
            return f"<form{attr(_FORMS)}><label>{say(False, 1, 6, 0.2)}</label><input><p>{say(False, 1, 15, 0.6)}</p><button>{say(False, 0, 2, 0)}</button></form>"

        def comments() -> str:
            rows = "".join(f"<{(t := rng.choice(['div', 'li', 'article', 'p']))}{named(_COMMENTS)}>{rng.choice(['<p>{}</p>', '{}']).format(say(False, 3, 60, 0.9))}</{t}>" for _ in range(rng.randint(1, 4)))
            return f"<{(t := rng.choice(['section', 'div', 'ol']))}{named(_COMMENTS)}>{rows}</{t}>"

        def share() -> str:
            return f"<div{named(_SHARES)}>{rng.choice([links(3), say(False, 1, 5, 0)])}</div>"

        def foot() -> str:
            return rng.choice([f"<footer{attr(_FEET)}>{{}}</footer>", f"<div{named(_FEET)}>{{}}</div>"]).format(rng.choice([say(False, 2, 25, 0.7, True), say(False, 2, 20, 0.7), links(3)]))

        def paragraph() -> str:
            kind = rng.random()
            text = say(True, 1 if kind < 0.15 else 5, 90, 0.9)
            if kind < 0.2:
                return f"<p><b>{text}<br>"
            if kind < 0.3:
                return f'<p>{text} <a href="/x">aside</a> {"and on " * rng.randint(0, 5)}</p>'
            if kind < 0.38:
                return f"<blockquote>{text}</blockquote>"
            if kind < 0.44:
                return f"<ul><li>{text}</li><li>{say(True, 1, 14, 0.6)}</li></ul>"
            if kind < 0.5:
                return f"<h2>{say(True, 1, 9, 0.1)}</h2><p>{text}</p>"
            if kind < 0.53:
                return f"<pre>{text}</pre>"
            if kind < 0.6:
                return f"<div>{text}</div>"
            if kind < 0.63:
                return f"<table><tr><td>{text}</td><td>{say(True, 1, 6, 0.3)}</td></tr></table>"
            return f"<p>{text}</p>"

        within = [advert, side, share, notice, form]
        body = [f"<h1>{say(True, 1, 14, 0.4)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 10)):
            body.append(paragraph())
            if rng.random() < 0.08:
                body.append(rng.choice(within)())
        if rng.random() < 0.12:
            body.append(comments())
        shell = rng.random()
        inner = "".join(body)
        if shell < 0.5:
            main = f"<article{attr(_BODIES)}>{inner}</article>"
        elif shell < 0.75:
            main = f"<div{named(_BODIES)}>{inner}</div>"
        elif shell < 0.9:
            main = f"<main>{rng.choice(['<article>{}</article>', '<div>{}</div>', '<section>{}</section>']).format(inner)}</main>"
        else:
            main = inner
        before = [x() for x in rng.sample([menu, head, advert, notice, form, side], rng.randint(1, 4))]
        after = [x() for x in rng.sample([side, comments, advert, notice, foot, share, form], rng.randint(1, 4))]
        blocks = leaf_blocks(f"<html><head><title>t</title></head><body>{''.join(before)}{main}{''.join(after)}{foot()}</body></html>")
        rows, marks = [], []
        for b in blocks:
            key, _, rest = b.text.partition(" ")
            b.text = rest or "x"
            b.linked = min(b.linked, len(b.text))
            rows.append(block_features(b))
            marks.append(labels.get(key, marks[-1] if marks else 0))
        if rows:
            pages.append((rows, marks))
    return pages


@lru_cache(maxsize=1)
def trained() -> Crf:
    return Crf().fit(labelled_pages())


def extract(page: str | None, model: Crf) -> str:
    blocks = leaf_blocks(page or "")
    labels = model.viterbi([block_features(b) for b in blocks])
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def main_text(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, shared.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
