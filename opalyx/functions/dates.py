"""Dates: parsing of many formats, labels and windows. No expression reads the clock."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from opalyx.functions import rules
from opalyx.functions.text import WS, bind, compact, located, window

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def _month(name: Column) -> Column:
    return F.when(F.length(name) >= 3, (F.instr(F.lit(_MONTHS), F.lower(F.substring(name, 1, 3))) + 3) / 4)


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """The date, or null where there is none."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("int").cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(m >= 1, F.try_to_date(text, "yyyy-MM-dd"))


def _form(c: Column, pattern: str, order: tuple[int, int, int], named: bool = False) -> Column:
    """The date of a pattern's groups, given as places of year, month and day; groups are read where it matches."""
    y, m, d = (F.regexp_extract(c, pattern, i) for i in order)
    return F.when(c.rlike(pattern), _ymd(y.try_cast("int"), _month(m) if named else m.try_cast("int"), d.try_cast("int")))


def parse_date(raw: Column) -> Column:
    """The first of these that gives a date: ISO (also with slashes, or before a T or space), `12 March 2026`
    (with a weekday before and a time after), and anywhere in the text dd/mm/yyyy, dd.mm.yyyy, `March 12, 2026`."""
    return bind(
        compact(raw),
        lambda c: F.coalesce(
            _form(c, r"^(\d{4})[-/](\d{2})[-/](\d{2})(?:[T ].*)?$", (1, 2, 3)),
            _form(c, r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)),
            _form(c, r"^(?:[A-Za-z]{3}, )?(\d{1,2}) ([A-Za-z]{3,9}) (\d{4})(?: \d{2}:\d{2}:\d{2}.*)?$", (3, 2, 1), named=True),
            _form(c, r"(\d{2})/(\d{2})/(\d{4})", (3, 2, 1)),
            _form(c, r"(\d{2})\.(\d{2})\.(\d{4})", (3, 2, 1)),
            _form(c, r"([A-Za-z]{3,9}) (\d{1,2}), (\d{4})", (3, 1, 2), named=True),
        ),
    )


#: What parts lines, as Unicode has it.
LINES = r"\R|[\x1c-\x1e]"
_WIDE = "０１２３４５６７８９"


def parse_cjk_date(raw: Column) -> Column:
    """Year, month and day marked by their characters, digits perhaps spaced; or ISO with one-digit parts."""
    c = F.regexp_replace(raw, r"\s+", "")
    return F.coalesce(_form(c, r"(\d{4})年(\d{1,2})月(\d{1,2})日", (1, 2, 3)), _form(raw, r"(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3)))


def iso_or_none(value: str | None) -> str | None:
    """A query's date as given, or None where it isn't in ISO form."""
    import re

    value = (value or "").strip()
    return value if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) else None


def closes_label(deadline: Column) -> Column:
    return F.when(deadline.isNull(), "Deadline pending").otherwise(F.concat(F.lit("Closes "), F.date_format(deadline, "dd MMM yyyy")))


def stamp_label(stamp: Column, prefix: str) -> Column:
    return F.when(stamp.isNull(), f"{prefix} pending").otherwise(F.concat(F.lit(f"{prefix} "), F.date_format(stamp, "dd MMM yyyy")))


def local_label(day: Column, language: str) -> Column:
    return F.date_format(day, {"zh": "yyyy'年'M'月'd'日'", "en": "dd MMM yyyy"}[language])


def canonical_deadline(deadline: Column) -> Column:
    return F.coalesce(deadline.cast("string"), F.lit("unknown-date"))


def compact_day(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM").cast("date")


def publication_from(today: date, window_days: int) -> date:
    """Lower bound of an ingest window."""
    return today - timedelta(days=window_days)


def best_deadline(candidates: Column, published: Column, early: int = -7, late: int = 365) -> Column:
    """Of candidates (array of score, day): the highest score, then the latest day, within days of the publication."""
    fit = F.filter(candidates, lambda x: x["day"].isNotNull() & (published.isNull() | F.datediff(x["day"], published).between(early, late)))
    return F.array_max(fit)["day"]


def best_deadline_in_group(score: Column, day: Column, published: Column, early: int = -7, late: int = 365) -> Column:
    """The same over the rows of a group, as an aggregate that tasks prepare in part."""
    fit = day.isNotNull() & (published.isNull() | F.datediff(day, published).between(early, late))
    return F.max(F.when(fit, F.struct(score.alias("score"), day.alias("day"))))["day"]


def label_score(c: Column, labels: dict[str, int], extra: list[tuple[tuple[str, ...], int]] = ()) -> Column:
    """Score of the first label, in the order given, that a text holds, and what further words add."""

    def scored(hits: Column) -> Column:
        score = F.coalesce(*(F.when(F.array_contains(hits, m), F.lit(n)) for m, n in labels.items()), F.lit(0))
        for words, n in extra:
            score = score + F.when(rules.any_hit(hits, words), F.lit(n)).otherwise(F.lit(0))
        return F.when(F.size(hits) == 0, 0).otherwise(score)

    return bind(rules.Markers(labels, *(words for words, _ in extra)).hits(c), scored)


def deadline_candidates(c: Column, *, labels: dict[str, int], extra: list[tuple[tuple[str, ...], int]], forms: list[str], phrases: list[str], before: int = 48, after: int = 24) -> Column:
    """Array of (score, day) of the days in a text that labels speak for; none for null.

    Lines that hold a label: each day of the forms in them, with the line's score. Whole text: each
    match of a phrase (its first group is the day), with the score of the characters around it, 1 at least."""
    score = lambda x: label_score(x, labels, extra)
    dated = lambda n, raw: F.struct(n.alias("score"), parse_cjk_date(raw).alias("day"))

    def of_line(line: Column) -> Column:
        days = F.concat(*(F.regexp_extract_all(line, F.lit(f), F.lit(1)) for f in forms))
        none = F.array().cast("array<struct<score:int,day:date>>")
        return bind(score(line), lambda n: F.when(n > 0, F.transform(days, lambda d: dated(n, d))).otherwise(none))

    def of_phrase(t: Column, phrase: str) -> Column:
        return F.transform(located(t, phrase, 1), lambda m: dated(bind(score(window(t, m["start"], m["end"], before, after)), lambda n: F.when(n > 0, n).otherwise(1)), m["value"]))

    def found(t: Column) -> Column:
        every = F.concat(F.flatten(F.transform(F.split(t, LINES), of_line)), *(of_phrase(t, p) for p in phrases))
        return F.filter(every, lambda x: x["day"].isNotNull())

    narrow = lambda t: F.when(t.rlike(f"[{_WIDE}]"), F.translate(t, _WIDE, "0123456789")).otherwise(t)
    return bind(bind(F.coalesce(c, F.lit("")), narrow), found)
