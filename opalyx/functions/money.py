"""Money: numbers from text in several notations, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opalyx.functions.text import bind, compact, or_null

# The notations of a number.
_GROUPED = r"(?<!\d)(\d{1,3}(?:[.,\s\x{a0}\x{202f}'’]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)(?!\d)"
_SCIENTIFIC = r"(\d+(?:\.\d+)?[eE][+-]?\d+)"


def _number(token: Column) -> Column:
    """One number: the rightmost of both separators is decimal; one that repeats, or has three digits after it, groups."""
    return bind(F.regexp_replace(token, r"['’ \x{a0}\x{202f}]", ""), _decimal)


def _decimal(t: Column) -> Column:
    commas, dots = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))), F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    no_comma, no_dot = F.replace(t, F.lit(","), F.lit("")), F.replace(t, F.lit("."), F.lit(""))
    comma_last = F.locate(",", F.reverse(t)) < F.locate(".", F.reverse(t))
    plain = (
        F.when((commas > 0) & (dots > 0), F.when(comma_last, F.replace(no_dot, F.lit(","), F.lit("."))).otherwise(no_comma))
        .when(commas > 1, no_comma)
        .when(dots > 1, no_dot)
        .when((commas == 1) & t.rlike(r"^\d+,\d{3}$"), no_comma)
        .when(commas == 1, F.replace(t, F.lit(","), F.lit(".")))
        .when((dots == 1) & t.rlike(r"^\d+\.\d{3}$"), no_dot)
        .otherwise(t)
    )
    return plain.try_cast("double")


def parse_amount(raw: Column) -> Column:
    """The first number in a text; scientific notation first."""
    return bind(compact(raw), lambda t: F.coalesce(F.regexp_extract(t, _SCIENTIFIC, 1).try_cast("double"), _number(F.regexp_extract(t, _GROUPED, 1))))


def amount_text(amount: Column, currency: Column, raw: Column) -> Column:
    """The raw text where there is one, else the number with separators and, if not whole, two decimals."""
    shown = F.when(amount == F.floor(amount), F.format_number(amount, 0)).otherwise(F.format_number(amount, 2))
    return F.coalesce(compact(raw), F.when(amount.isNotNull(), F.concat_ws(" ", or_null(currency), shown)))


def euro_only(amount: Column, currency: Column) -> Column:
    return F.when(F.upper(F.trim(currency)) == "EUR", amount)


def fixed(value: Column, places: int) -> Column:
    """A number with so many decimals as C's printf writes it: the double itself is rounded, not its shortest
    spelling, and what lies exactly between goes to the even digit."""
    scale, size = 10**places, F.abs(value)

    def rounded(x: Column) -> Column:
        # The double as two halves of few bits: their products by 2 * scale and their distance from the odd number between two results are exact.
        below, high = F.floor(x["size"] * scale), x["split"] - (x["split"] - x["size"])
        gap = (high * (2.0 * scale) - (2 * below + 1)) + (x["size"] - high) * (2.0 * scale)
        units = F.when((gap > 0) | ((gap == 0) & (below % 2 == 1)), below + 1).otherwise(below)
        return F.format_string(f"%.{places}f", F.when(value < 0, -units.cast("double")).otherwise(units.cast("double")) / scale)

    parts = F.struct(size.alias("size"), (size * 134217729.0).alias("split"))
    return F.when(size < 1e12, bind(parts, rounded)).when(value.isNotNull(), F.format_string(f"%.{places}f", value))


def value_label(value: Column, text: Column, prize: Column) -> Column:
    millions = F.concat(F.lit("Estimated service value EUR "), fixed(value / 1_000_000, 2), F.lit("M"))
    return F.when(value.isNotNull(), millions).otherwise(F.coalesce(or_null(text), or_null(prize), F.lit("Commercial value pending")))


def fee_label(registration: Column, submission: Column) -> Column:
    free = (F.coalesce(registration, F.lit(0.0)) == 0) & (F.coalesce(submission, F.lit(0.0)) == 0)
    part = lambda c, what: F.when(c.isNotNull(), F.concat(F.lit("EUR "), fixed(c, 0), F.lit(f" {what}")))
    return F.when(free, "No participation fee").otherwise(F.concat_ws(" / ", part(registration, "registration"), part(submission, "submission")))
