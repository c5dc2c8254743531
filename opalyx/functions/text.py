"""Text normalisation, extraction and labels as Column expressions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for Java's regular expressions.
_WIDE_WS = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
WS = rf"[\s\x{{85}}\x{{a0}}{_WIDE_WS}]"
#: Runs of white space other than one plain space.
_UNEVEN = rf"[\t-\r\x{{85}}\x{{a0}}{_WIDE_WS}]{WS}*+| {WS}++"


def _folding_table() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form without marks is one ASCII character, with that character;
    the marks themselves, which go, after them; and characters that become several ASCII characters."""
    one, several = {}, {}
    for c in map(chr, range(0x80, 0x10000)):
        form = "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))
        if form != c and form and form.isascii():
            (one if len(form) == 1 else several)[c] = form
    marks = "".join(c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c))
    return "".join(one) + marks, "".join(one.values()), several


def _class_of(chars: Iterable[str]) -> str:
    """A character class for Java's regular expressions. Java tries each part of a class in turn, so neighbours are
    one range and a few wide ranges, asked first, spare all other characters the rest."""
    exact, wide = [], []
    for n in sorted(map(ord, chars)):
        for ranges, gap in ((exact, 1), (wide, 0x400)):
            if ranges and n - ranges[-1][1] <= gap:
                ranges[-1][1] = n
            else:
                ranges.append([n, n])
    shown = lambda ranges: "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)
    return f"[{shown(wide)}&&[{shown(exact)}]]"


FOLD_FROM, FOLD_TO, FOLD_SEVERAL = _folding_table()
SEVERAL_CLASS = _class_of(FOLD_SEVERAL)


_MARK = "\x01"


def or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def located(c: Column, pattern: str, group: int = 0) -> Column:
    """Matches in order as an array of (start, end, value): places in characters from 0, end exclusive, and a group of the match.

    One scan writes marks around each match and its group, which part the text; a text that holds the mark itself is
    scanned for each of the parts."""
    p = F.lit(pattern)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(between: Column, found: Column, values: Column) -> Column:
        steps = F.zip_with(found, F.slice(F.transform(between, F.length), 1, F.size(found)), lambda m, b: F.struct(b.alias("before"), F.length(m).alias("n")))
        # Where each match begins: what lies before it and before the ones before it.
        ends = F.aggregate(steps, F.array().cast("array<int>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x["before"] + x["n"])))
        return F.zip_with(F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"))), values, lambda at, v: F.struct(at["start"].alias("start"), at["end"].alias("end"), v.alias("value")))

    def parted(pieces: Column) -> Column:
        every = lambda k: F.filter(pieces, lambda x, i: i % 3 == k)
        return F.when(F.size(pieces) > 1, placed(every(0), every(1), every(2))).when(F.size(pieces) == 1, none)

    def scanned(found: Column) -> Column:
        values = F.regexp_extract_all(c, p, F.lit(group)) if group else found
        return F.when(F.size(found) > 0, placed(F.split(c, p, -1), found, values)).when(F.size(found) == 0, none)

    marked = F.split(F.regexp_replace(c, p, F.lit(f"{_MARK}$0{_MARK}${group}{_MARK}")), _MARK, -1)
    return F.when(c.contains(_MARK), bind(F.regexp_extract_all(c, p, F.lit(0)), scanned)).otherwise(bind(marked, parted))


def window(c: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The characters around a place in a text."""
    low = F.greatest(F.lit(0), start - before)
    return F.substring(c, low + 1, end + after - low)


def even(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, _UNEVEN, " ")


def compact(c: Column) -> Column:
    """Runs of white space as one space, trimmed; empty becomes null."""
    return or_null(F.trim(even(c)))


def fold(c: Column) -> Column:
    """Compatibility forms as ASCII, Latin letters without their marks, lower case; other scripts stay."""
    spelled = F.lit(json.dumps(FOLD_SEVERAL))

    def folded(x: Column) -> Column:
        # The few characters that a text holds are replaced one after the other: none of their forms holds another one.
        held = F.array_distinct(F.regexp_extract_all(x, F.lit(SEVERAL_CLASS), F.lit(0)))
        forms = lambda h: bind(F.from_json(spelled, "map<string,string>"), lambda m: F.transform(h, lambda y: F.struct(y.alias("from"), m[y].alias("to"))))
        expanded = bind(held, lambda h: F.when(F.size(h) > 0, F.aggregate(forms(h), x, lambda s, y: F.replace(s, y["from"], y["to"]))).otherwise(x))
        # A text of as many bytes as characters is ASCII.
        return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.lower(F.translate(expanded, FOLD_FROM, FOLD_TO)))

    return bind(c, folded)


def match_text(c: Column) -> Column:
    """What keyword searches look at: folded, null as empty."""
    return fold(F.coalesce(c, F.lit("")))


def plain_text(c: Column) -> Column:
    """ASCII letters and digits only, words parted by one space; null as empty."""
    ascii_only = F.regexp_replace(match_text(c), r"[^\x00-\x7f]", "")
    return F.trim(F.regexp_replace(ascii_only, "[^a-z0-9]+", " "))


def driver_plain(value: str) -> str:
    """plain_text() of a value on the driver."""
    import re

    table = str.maketrans(dict(zip(FOLD_FROM, FOLD_TO + "\0" * (len(FOLD_FROM) - len(FOLD_TO)), strict=True)))
    folded = "".join(FOLD_SEVERAL.get(x, x) for x in value).translate(table).lower()
    return re.sub("[^a-z0-9]+", " ", "".join(x for x in folded if x.isascii() and x != "\0")).strip()


def lookup_key(c: Column) -> Column:
    """Key for alias lookups: folded ASCII with runs of other characters as one underscore; empty becomes null."""
    ascii_only = F.regexp_replace(fold(compact(c)), r"[^\x00-\x7f]", "")
    return or_null(F.regexp_replace(F.regexp_replace(ascii_only, "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def loose_key(c: Column) -> Column:
    """The store's other form of that key: marks go, any other character parts words; null only where there is no text."""
    return F.regexp_replace(F.regexp_replace(fold(compact(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clean_title(c: Column) -> Column:
    """A title without the reference number before it; the title itself where nothing else is left."""
    trimmed = F.trim(c)
    return or_null(F.coalesce(or_null(F.trim(F.regexp_replace(trimmed, r"^\d+(?:[_/-]\d+)+(?:\s+)?", ""))), trimmed))


def location_key(c: Column) -> Column:
    return plain_text(c)


def key_fragment(c: Column) -> Column:
    """Part of a deduplication key: letters and digits of any script, other runs as one hyphen."""
    joined = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_]+", "-")
    return F.coalesce(or_null(F.regexp_replace(joined, "^[-_]+|[-_]+$", "")), F.lit("unknown"))


def dedup_key(title: Column, organizer: Column, deadline: Column) -> Column:
    return F.concat_ws("__", *map(key_fragment, (title, organizer, deadline)))


def title_case(c: Column, default: str = "Unknown") -> Column:
    """First letter of each word raised, the rest kept."""
    parts = F.filter(F.split(c, rf"(?:[_-]|{WS})+"), lambda x: x != "")
    raised = F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))
    return F.when(F.coalesce(c, F.lit("")) == "", default).otherwise(F.array_join(raised, " "))


#: Entities that notices use.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "ndash": "–", "mdash": "—", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "euro": "€", "amp": "&"}


def unescape(c: Column) -> Column:
    """Numeric references and the named entities above; the ampersand last, so that nothing is decoded twice."""
    numeric = F.when(F.contains(c, F.lit("&#")), _numeric(c)).otherwise(c)
    return reduce(lambda out, kv: F.replace(out, F.lit(f"&{kv[0]};"), F.lit(kv[1])), ENTITIES.items(), numeric)


def _numeric(c: Column) -> Column:
    """Decimal and hexadecimal references decoded; those of no character stay."""
    reference = r"^(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));"

    def decoded(part: Column) -> Column:
        hexed = F.regexp_extract(part, reference, 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).otherwise(F.regexp_extract(part, reference, 2)).cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = bind(code, lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        return F.when(part.rlike(reference) & valid, F.concat(char, F.regexp_replace(part, reference, ""))).otherwise(F.concat(F.lit("&#"), part))

    return bind(F.split(c, "&#"), lambda p: F.concat(p[0], F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), decoded), "")))


def strip_html(c: Column) -> Column:
    return compact(F.regexp_replace(unescape(c), "<[^>]+>", " "))


def first_match(c: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that captures something, compacted."""
    return F.coalesce(*(compact(F.regexp_extract(c, f"(?is){p}", 1)) for p in patterns))


def all_matches(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def field(c: Column, label: str) -> Column:
    """Value of `label: value`, up to a tag, a semicolon or the line's end."""
    return compact(F.regexp_extract(c, rf"(?i){label}[^:<]*:\s*([^<;\n]+)", 1))


def eight_digit_codes(c: Column) -> Column:
    """Distinct classification codes in order; with a check digit or without."""
    return F.array_distinct(all_matches(c, r"\b(\d{8})(?:-\d)?\b"))


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*(or_null(F.trim(c)) for c in columns))


def host(url: Column) -> Column:
    return or_null(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def resolve_url(base: Column, link: Column) -> Column:
    """A link as found on a page made absolute: by scheme, host, root or folder."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/])/[^/]*$", "/")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#") | link.startswith("?"), F.concat(F.regexp_replace(base, "[#].*$" , ""), link))
        .otherwise(F.concat(folder, link))
    )


def machine_url(url: Column, markers: tuple[str, ...] = ("/api/", "/rest/", ".json", "format=json")) -> Column:
    return reduce(lambda a, m: a | F.lower(url).contains(m), markers, F.lit(False))


def keywords(c: Column, stop_words: list[str], least: int = 6, most: int = 12) -> Column:
    """First distinct longer words, numbers and stop words left out."""
    words = F.filter(F.split(plain_text(c), " "), lambda w: (F.length(w) >= least) & ~w.rlike("^[0-9]+$") & ~w.isin(stop_words))
    return F.slice(F.array_distinct(words), 1, most)


def html_title(c: Column) -> Column:
    return compact(unescape(F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1)))


def html_links(c: Column) -> Column:
    return all_matches(c, '(?i)href="([^"]+)"')


def html_meta(c: Column, name: str) -> Column:
    return compact(F.regexp_extract(c, rf'(?is)<meta[^>]*(?:name|property)="{name}"[^>]*content="([^"]*)"', 1))


def append_note(note: Column, extra: Column) -> Column:
    """A note with another one added, unless it holds it."""
    return F.when(F.coalesce(note, F.lit("")) == "", extra).when(note.contains(extra), note).otherwise(F.concat_ws(" ", note, extra))


def lookup(c: Column, table: dict[str, str | None]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[c] if pairs else F.lit(None).cast("string")


def label(c: Column, table: dict[str, str], fallback: str) -> Column:
    """The label of a key, else its title case, else the fallback."""
    return F.when(F.coalesce(c, F.lit("")) == "", fallback).otherwise(F.coalesce(lookup(c, table), title_case(c)))


def compatible_labels(a: Column, b: Column) -> Column:
    """Whether one label's words are all among the other's."""
    x, y = F.split(plain_text(a), " "), F.split(plain_text(b), " ")
    return (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


# Words that rule a place name out.
LOCATION_STOP_WORDS = ["amt", "authority", "bauamt", "cabildo", "council", "department", "office", "procurement", "regierung"]
PLACEHOLDER_PLACES = ["beispiel", "demo", "example", "local", "sample", "test", "unknown"]


def clean_place(c: Column) -> Column:
    trimmed = F.regexp_replace(F.regexp_replace(c, f"{WS}+", " "), r"^[ ,;:.()\[\]{}]+|[ ,;:.()\[\]{}]+$", "")
    words = F.split(plain_text(trimmed), " ")
    bad = F.arrays_overlap(words, F.array(*map(F.lit, LOCATION_STOP_WORDS + PLACEHOLDER_PLACES)))
    return F.when((trimmed != "") & (F.size(F.split(trimmed, " ")) <= 5) & (plain_text(trimmed) != "") & ~bad, trimmed)


def place_of(title: Column, authority: Column) -> Column:
    """A place name from a title, else from an authority's name: the first candidate that is clean."""
    name = r"[\p{Lu}][\p{L}\p{N}_'’.\-]+(?:[\s-][\p{Lu}][\p{L}\p{N}_'’.\-]+){0,3}"
    word = r"[\p{L}\p{N}_'’.\-]+(?:[\s-][\p{L}\p{N}_'’.\-]+){0,3}"
    ends = r"(?:\s*[.;,()]|$)"
    take = lambda p, c: or_null(F.regexp_extract(c, p, 1))
    of = F.reverse(F.regexp_extract_all(title, F.lit(rf"\bde\s+({name}){ends}"), F.lit(1)))
    candidates = F.concat(
        F.array(take(rf",\s*(?:\d{{4,6}}\s+)?({word})\s*$", title), take(r"(?i)\bt[eé]rmino municipal de\s+(.+?)(?:\s+de la provincia|\s*[.;,]|$)", title), take(rf"(?i)\bcommune de\s+({name}){ends}", title)),
        F.coalesce(of, F.array().cast("array<string>")),
        F.array(
            take(rf"\b(?:in|at|à|a)\s+({name}){ends}", title),
            take(r"(?i)\b(?:gemeindeverwaltung|gemeinde|commune de|ville de|city of|municipality of|ayuntamiento de|municipio de|comune(?: di)?|citt[aà] di|stadt)\s+(.+?)(?:\s*\(|\s+-|,|$)", authority),
            take(r"(?i)^(.+?)\s+parish council\b", authority),
            take(r"(?i)^(.+?)\s+district council\b", authority),
        ),
    )
    return F.get(F.filter(F.transform(candidates, clean_place), lambda x: x.isNotNull()), F.lit(0))
