"""Semi-structured values that may be missing or malformed, arrays and small maps."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from opalyx.functions.text import compact, or_null


def string_items(payload: Column) -> Column:
    """The string items of a JSON array; anything else, or malformed text, gives an empty array."""
    variant = F.try_parse_json(payload)
    items = F.when(F.schema_of_variant(variant).startswith("ARRAY"), variant.cast("array<variant>"))
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(strings, lambda v: v.cast("string")), F.array().cast("array<string>"))


def record(payload: Column) -> Column:
    """A JSON object as variant; anything else as the empty object."""
    variant = F.try_parse_json(payload)
    return F.when(F.schema_of_variant(variant).startswith("OBJECT"), variant).otherwise(F.parse_json(F.lit("{}")))


def is_object(payload: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False))


def _path(path: str) -> str:
    """A dotted path as Spark reads it: names may hold hyphens, items are [0], [1]."""
    steps = (re.fullmatch(r"([^\[]*)((?:\[\d+\])*)", part) for part in path.split("."))
    return "$" + "".join(f'["{m[1]}"]{m[2]}' for m in steps)


def at(variant: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(variant, _path(path), kind)


def first_value(variant: Column, paths: list[str]) -> Column:
    """The first of the paths whose scalar isn't blank, as text."""
    return F.coalesce(*(compact(at(variant, p)) for p in paths))


def list_value(variant: Column, paths: list[str]) -> Column:
    """The first path with a list (its clean strings) or a text (alone in a list); else empty."""

    def one(path: str) -> Column:
        listed = F.filter(F.transform(at(variant, path, "array<string>"), compact), lambda x: x.isNotNull())
        text = compact(at(variant, path))
        return F.when(F.size(listed) > 0, listed).when(text.isNotNull() & ~text.startswith("["), F.array(text))

    return F.coalesce(*map(one, paths), F.array().cast("array<string>"))


def localized(variant: Column, path: str, languages: tuple[str, ...] = ("en", "eng", "fr", "de", "it")) -> Column:
    """A text in the preferred language: a plain text, the first item of a list, or a member of an object."""
    plain = F.when(F.schema_of_variant(F.try_variant_get(variant, _path(path), "variant")) == "STRING", at(variant, path))
    members = [at(variant, f"{path}.{x}{item}") for x in languages for item in ("[0]", "")]
    return F.coalesce(or_null(F.trim(plain)), *(or_null(F.trim(m)) for m in members), or_null(F.trim(at(variant, f"{path}[0]"))))


def codes_in(payload: Column) -> Column:
    """Eight-digit codes anywhere in serialised JSON."""
    from opalyx.functions.text import eight_digit_codes

    return eight_digit_codes(payload)


# Types as objects: a type given as text needs a session when the module is imported.
@F.pandas_udf(StructType().add("amount", DoubleType()).add("currency", StringType()))
def first_money(payloads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Depth-first search for the first node that has an amount and a currency. Nesting has no fixed depth, so Python."""

    def search(node) -> tuple[float | None, str | None]:
        stack = [node]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                low = {str(k).lower().lstrip("@"): v for k, v in x.items()}
                amount, currency = low.get("amount", low.get("#text")), low.get("currency", low.get("currencyid"))
                if amount is not None and isinstance(currency, str):
                    try:
                        return float(amount), currency.upper()
                    except (TypeError, ValueError):
                        pass
                stack.extend(reversed(list(x.values())))
            elif isinstance(x, list):
                stack.extend(reversed(x))
        return None, None

    for part in payloads:
        found = []
        for p in part:
            try:
                found.append(search(json.loads(p)) if p else (None, None))
            except ValueError:
                found.append((None, None))
        yield pd.DataFrame(found, columns=["amount", "currency"])


@F.pandas_udf(ArrayType(StructType().add("street", StringType()).add("locality", StringType()).add("region", StringType()).add("postal_code", StringType()).add("country", StringType())))
def linked_addresses(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Postal addresses in the linked-data scripts of pages, at any depth."""
    import re

    script = re.compile(r'<script[^>]*application/ld\+json[^>]*>(.*?)</script>', re.S | re.I)

    def walk(node) -> Iterator[dict]:
        stack = [node]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                if x.get("@type") == "PostalAddress" or "streetAddress" in x:
                    pick = lambda k: x[k] if isinstance(x.get(k), str) else None  # noqa: B023, E731
                    yield {"street": pick("streetAddress"), "locality": pick("addressLocality"), "region": pick("addressRegion"), "postal_code": pick("postalCode"), "country": pick("addressCountry")}
                stack.extend(reversed(list(x.values())))
            elif isinstance(x, list):
                stack.extend(reversed(x))

    def page(html: str | None) -> list[dict]:
        out = []
        for m in script.finditer(html or ""):
            try:
                out += walk(json.loads(m[1]))
            except ValueError:
                continue
        return out

    for part in pages:
        yield part.map(page)


@F.pandas_udf(StringType())
def class_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of a page's elements of the class detail_content: one line for each block, white space within it as one
    space, without scripts, styles, heads and tags of other name spaces. Elements nest to any depth, so Python."""
    import re
    from html.parser import HTMLParser

    blocks = {"article", "blockquote", "br", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "section", "table", "td", "th", "tr"}
    silent = {"head", "link", "meta", "noscript", "script", "style", "title", "xml"}
    empty = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open: list[tuple[str, bool]] = []  # tags from the captured element on, and whether they silence
            self.lines: list[list[str]] = [[]]

        def handle_starttag(self, tag, attrs):
            held = any(k == "class" and "detail_content" in (v or "").split() for k, v in attrs)
            if not self.open and not held:
                return
            if tag in blocks:
                self.lines.append([])
            if tag not in empty:
                self.open.append((tag, tag in silent or ":" in tag))

        def handle_endtag(self, tag):
            names = [t for t, _ in self.open]
            if tag in names:
                while self.open.pop()[0] != tag:
                    pass
            if tag in blocks and (self.open or tag in names):
                self.lines.append([])

        def handle_data(self, data):
            if self.open and not any(quiet for _, quiet in self.open) and data.strip():
                self.lines[-1].append(re.sub(r"\s+", " ", data).strip())

    def read(html: str | None) -> str | None:
        reader = Reader()
        reader.feed(html or "")
        reader.close()
        return "\n".join(" ".join(x) for x in reader.lines if x) or None

    for part in pages:
        yield part.map(read)


@F.pandas_udf(StringType())
def balanced_div(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Source between the first div of the class detail_content and the end tag that balances it; up to the last div tag
    where none does. Counting nested tags isn't regular, so Python."""
    import re

    opened, tag = re.compile(r'<div[^>]+class="[^"]*\bdetail_content\b[^"]*"[^>]*>', re.I), re.compile(r"</?div\b[^>]*>", re.I)

    def cut(html: str | None) -> str | None:
        first = opened.search(html or "")
        if not first:
            return None
        depth, end = 1, first.end()
        for m in tag.finditer(html, first.end()):
            depth += -1 if m[0][1] == "/" else 1
            if depth == 0:
                return html[first.end() : m.start()]
            end = m.end()
        return html[first.end() : end] if end > first.end() else None

    for part in pages:
        yield part.map(cut)


def in_order(values: Column, order: list[str]) -> Column:
    """Members of the fixed order that the array holds."""
    return F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(values, x))


def any_prefix(values: Column, prefixes: tuple[str, ...]) -> Column:
    return F.exists(values, lambda v: v.rlike("^(?:" + "|".join(prefixes) + ")"))


def first_where(values: Column, predicate) -> Column:
    return F.get(F.filter(values, predicate), F.lit(0))


def joined_or(values: Column, fallback: str, separator: str = ", ") -> Column:
    return F.coalesce(or_null(F.array_join(values, separator)), F.lit(fallback))


def canonical_json(**fields: Column) -> Column:
    """An object with its keys sorted and nulls left out: equal filters are equal texts."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))
