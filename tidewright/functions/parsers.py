"""Field parsers of extracted texts as Column expressions: numbers, ranges, money, coordinates, durations, qualifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.operators.search import folded

NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
#: What marks a bound, by kind, and the spellings of currencies. Fixed values.
QUALIFIERS = (("minimum", "at least|minimum|no less than|en az|asgari"), ("maximum", "at most|maximum|no more than|within|en çok|azami"), ("approximately", "about|approximately|around|yaklaşık"))
CURRENCIES = (("TL", "₺|türk lirasi|lira|\\btl\\b|\\btry\\b"), ("EUR", "€|euro|\\beur\\b"), ("USD", "\\$|dollar|\\busd\\b"))


def _value(text: Column) -> Column:
    """A number text as DOUBLE: a separator before exactly three last digits marks thousands."""
    grouped = text.rlike("^[0-9]{1,3}(?:[.,][0-9]{3})+$")
    plain = F.when(grouped, F.regexp_replace(text, "[.,]", "")).otherwise(F.regexp_replace(F.regexp_replace(text, "[.,](?=.*[.,])", ""), ",", "."))
    return plain.try_cast("double")


def number(text: Column) -> Column:
    """The first number of a text, or NULL."""
    return _value(F.nullif(F.regexp_extract(text, f"({NUMBER})", 1), F.lit("")))


def number_range(text: Column) -> Column:
    """struct(low, high, is_range): the bounds of "a-b", "a to b", "between a and b", "a ile b"; one number is both."""
    pattern = rf"({NUMBER}) *(?:[-–—]|to|and|ile|ilâ) *({NUMBER})"
    a, b = (_value(F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))) for i in (1, 2))
    one = number(text)
    is_range = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(is_range, F.least(a, b)).otherwise(one).alias("low"), F.when(is_range, F.greatest(a, b)).otherwise(one).alias("high"), F.coalesce(is_range, F.lit(False)).alias("is_range"))


def qualifier(text: Column) -> Column:
    """minimum, maximum, approximately, or NULL; the first listed kind wins."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(QUALIFIERS):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def currency(text: Column) -> Column:
    low = folded(text)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CURRENCIES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def decimal_degrees(text: Column, hemispheres: str, negative: str) -> Column:
    """Degrees with a hemisphere, decimal or in degrees, minutes and seconds; the negative hemispheres are signed."""
    pattern = rf"([0-9]{{1,3}}(?:\.[0-9]+)?)\s*°\s*(?:([0-9]{{1,2}})\s*['′]\s*)?(?:([0-9]{{1,2}}(?:\.[0-9]+)?)\s*[\"″]\s*)?([{hemispheres}])"
    d, m, s = (F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("double"), F.lit(None if i == 1 else 0.0)) for i in (1, 2, 3))
    sign = F.when(F.regexp_extract(text, pattern, 4).isin(*negative), -1.0).otherwise(1.0)
    return F.round(sign * (d + m / 60 + s / 3600), 6)


def latitude(text: Column) -> Column:
    """North or south (K and G in Turkish) in [-90, 90], else NULL."""
    x = decimal_degrees(text, "NSKG", "SG")
    return F.when(x.between(-90, 90), x)


def longitude(text: Column) -> Column:
    """East or west (D and B in Turkish) in [-180, 180], else NULL."""
    x = decimal_degrees(text, "EWDB", "WB")
    return F.when(x.between(-180, 180), x)


def months(text: Column) -> Column:
    """A duration in months, days counting a thirtieth and years twelve; NULL without one."""
    low = folded(text)
    n = F.nullif(F.regexp_extract(low, r"([0-9]+) *(?:months?|ay|days?|gün|years?|yil)", 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(low, r"[0-9]+ *(months?|ay|days?|gün|years?|yil)", 1)
    return F.round(n * F.when(unit.rlike("^(day|gün)"), 1 / 30).when(unit.rlike("^(year|yil)"), 12.0).otherwise(1.0), 6)


def is_year_range(low: Column, high: Column) -> Column:
    return low.between(1900, 2100) & high.between(1900, 2100)
