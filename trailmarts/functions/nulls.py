"""Null rules of the reports, each named once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known_sum(x: Column) -> Column:
    """Ignore unknowns; unknown only when every value is unknown."""
    return F.sum(x)


def strict_sum(x: Column) -> Column:
    """Any unknown makes the sum unknown; an empty set sums to 0."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.coalesce(F.sum(x), F.lit(0.0)))


def all_known(x: Column) -> Column:
    return F.count(x) == F.count(F.lit(1))


def ratio_or_null(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def pct_change(current: Column, previous: Column) -> Column:
    """Percent change, NULL when the base is 0 or either side is unknown."""
    return F.when(previous != 0, (current - previous) / previous * 100)


def points_change(current: Column, previous: Column) -> Column:
    return (current - previous) * 100


def span_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two instants, NULL when negative or unknown."""
    return F.when(end >= start, end - start)


def share_pct(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, 0 when the whole is empty."""
    return F.when(whole > 0, F.round(part / whole * 1000) / 10).otherwise(F.lit(0.0))


def exact_usd(x: Column) -> Column:
    """Sum of dollars as a decimal, the same in whatever order rows meet; dollars count to 12 places."""
    return F.sum(x.try_cast("decimal(28,12)"))


def usd_share_pct(part: Column, whole: Column) -> Column:
    """Share of two ``exact_usd`` in percent with one decimal, halves up; NULL when either side is unknown."""
    units = [(x * F.lit(10**12).cast("decimal(13,0)")).cast("decimal(34,0)") for x in (part, whole)]
    return F.when(whole > 0, F.call_function("div", units[0] * 2000 + units[1], units[1] * 2) / 10)


def known_share_pct(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, NULL when either side is unknown."""
    return F.when(whole > 0, F.round(part / whole * 1000) / 10)
