"""Rule engine: lexicons are arguments; rules become Column expressions without joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Markers up to which a text is simply named again for each.
FEW = 4
#: Markers up to which a text is searched for each: a plain search is much cheaper than a step of a pattern.
SEARCHED = 100


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def any_of(text: Column, markers: list[str] | tuple[str, ...]) -> Column:
    held = lambda t: reduce(lambda a, m: a | F.coalesce(t.contains(m), F.lit(False)), markers, F.lit(False))
    return held(text) if len(markers) <= FEW else _once(text, held)


def weighted_score(text: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of the markers that the text holds."""
    return _once(text, lambda t: reduce(lambda a, kv: a + F.when(t.contains(kv[0]), F.lit(kv[1])).otherwise(F.lit(0)), weights.items(), F.lit(0)))


def label_set(text: Column, labels: dict[str, list[str]]) -> Column:
    """Labels whose markers occur, in the order given."""
    return _once(text, lambda t: F.array_compact(F.array(*(F.when(any_of(t, markers), F.lit(name)) for name, markers in labels.items()))))


class Markers:
    """Many markers found in a text, overlapping ones too: up to SEARCHED by a search for each, more in one scan.

    In the scan, at each place the longest marker that begins there is taken, by a pattern that shares common
    beginnings; the markers that lie within it are added from a table. So a text is read once, and
    weights and labels are looked up among the few markers that it holds."""

    def __init__(self, *tables: Iterable[str]):
        self.names = list(dict.fromkeys(m for t in tables for m in t))
        if "" in self.names:
            raise ValueError("a marker is not empty")
        tree: dict = {}
        for m in self.names:
            at = tree
            for c in m:
                at = at.setdefault(c, {})
            at[""] = {}
        first = sorted(tree)
        gate = f"(?=[{_plain(first[0])}-{_plain(first[-1])}])" if first else ""
        self.pattern = f"{gate}(?=({_branches(tree)}))"
        self.within = {m: inside for m in self.names if len(inside := [x for x in self.names if x in m]) > 1} if len(self.names) < 5_000 else self._within()

    def _within(self) -> dict[str, list[str]]:
        known = set(self.names)
        parts = {m: [x for x in dict.fromkeys(m[i:j] for i in range(len(m)) for j in range(i + 1, len(m) + 1)) if x in known] for m in self.names}
        return {m: x for m, x in parts.items() if len(x) > 1}

    def hits(self, text: Column) -> Column:
        """The markers that occur in a text, each once; none for null."""
        if not self.names:
            return F.array().cast("array<string>")
        if len(self.names) <= SEARCHED:
            return _once(F.coalesce(text, F.lit("")), lambda t: F.array_compact(F.array(*(F.when(t.contains(m), F.lit(m)) for m in self.names))))
        found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(1)))
        if not self.within:
            return found
        table = F.create_map(*(x for m, inside in self.within.items() for x in (F.lit(m), F.array(*map(F.lit, inside)))))
        return F.array_distinct(F.flatten(F.transform(found, lambda m: F.coalesce(table[m], F.array(m)))))


def _plain(c: str) -> str:
    return c if c.isalnum() or not c.isascii() else f"\\{c}" if c.isprintable() else f"\\x{ord(c):02x}"


def _branches(tree: dict) -> str:
    kinds = [_plain(c) + _branches(below) for c, below in tree.items() if c]
    if not kinds:
        return ""
    if "" in tree:
        return f"(?:{'|'.join(kinds)})?"
    return kinds[0] if len(kinds) == 1 else f"(?:{'|'.join(kinds)})"


def any_hit(hits: Column, markers: Iterable[str]) -> Column:
    """any_of() over the markers found."""
    return F.arrays_overlap(hits, F.array(*map(F.lit, markers)))


def weight_of(hits: Column, weights: dict[str, int]) -> Column:
    """weighted_score() over the markers found."""
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return F.aggregate(hits, F.lit(0), lambda s, m: s + F.coalesce(table[m], F.lit(0)))


def labels_of(hits: Column, labels: dict[str, list[str]]) -> Column:
    """label_set() over the markers found."""
    return F.array_compact(F.array(*(F.when(any_hit(hits, markers), F.lit(name)) for name, markers in labels.items())))


def first_class(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """Name of the first rule that holds."""
    out = reduce(lambda chain, rule: chain.when(rule[1], F.lit(rule[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0])))
    return out.otherwise(F.lit(otherwise))


def decide(rules: list[tuple[Column, bool]], otherwise: bool) -> Column:
    """Decision list: the outcome of the first condition that holds."""
    out = reduce(lambda chain, rule: chain.when(rule[0], F.lit(rule[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1])))
    return out.otherwise(F.lit(otherwise))


def cut_at_markers(text: Column, markers: list[str]) -> Column:
    """The text up to the earliest marker that isn't at its very start."""
    places = F.filter(F.array(*(F.instr(text, m) for m in markers)), lambda i: i > 1)
    return F.when(F.size(places) > 0, F.substring(text, F.lit(1), F.array_min(places) - 1)).otherwise(text)


def any_true_or_unknown(text: Column, markers: list[str]) -> Column:
    """True where a marker occurs, else null: a text can't show the opposite."""
    return F.when(any_of(text, markers), F.lit(True))


def relevant(text: Column, categories: Column, codes: Column, *, negative: list[str], positive: list[str], prefixes: tuple[str, ...], professional_only: bool = False) -> Column:
    """Category gates, veto words, accepting words, then classification prefixes."""
    professional = F.exists(categories, lambda c: F.coalesce(c.contains("professional"), F.lit(False)))
    student = F.exists(categories, lambda c: F.coalesce(c.contains("student"), F.lit(False)))
    has = F.coalesce(F.size(categories), F.lit(0)) > 0
    gates = [(has & student & ~professional, False)]
    if professional_only:
        gates.append((has & ~professional, False))
    said = _once(text, lambda t: F.struct(any_of(t, negative).alias("negative"), any_of(t, positive).alias("positive")))
    by_code = F.exists(codes, lambda c: reduce(lambda a, p: a | c.startswith(p), prefixes, F.lit(False)))
    return decide([*gates, (said["negative"], False), (said["positive"], True), (F.coalesce(by_code, F.lit(False)), True)], False)


def run_status(documents: Column, upserted: Column, failures: Column) -> Column:
    """Outcome of one ingest run."""
    return F.when(documents == 0, "empty").when((failures > 0) & (upserted > 0), "completed_with_failures").when(failures > 0, "failed").otherwise("success")
