"""Percentages and means with two exact digits.

Whole-number inputs give exact half-up hundredths, so results do not depend on the
order of a distributed sum nor on an engine's rounding of binary fractions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WIDE = "decimal(38,0)"
LARGEST_COUNT = 400_000_000_000_000  # 20000 times this fits a bigint


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def percent(a: Column, b: Column) -> Column:
    """100*a/b of two bigint row values, two digits, halves away from zero; null on b = 0 and for
    values beyond LARGEST_COUNT, which are junk and must not end the run by an overflow."""
    sane = a.between(-LARGEST_COUNT, LARGEST_COUNT) & b.between(-LARGEST_COUNT, LARGEST_COUNT)
    size = F.abs(b)
    hundredths = _div(F.lit(20000) * F.abs(a) + size, F.lit(2) * size)
    signed = F.when((a < 0) != (b < 0), -hundredths).otherwise(hundredths)
    return F.when(sane & (b != 0), signed / 100.0)


def percent_of_sums(a: Column, b: Column) -> Column:
    """:func:`percent` for totals, which may outgrow 20000*a in a bigint."""
    a, b = a.cast(WIDE), b.cast(WIDE)
    size = F.abs(b)
    hundredths = _div(F.lit(20000).cast("decimal(5,0)") * F.abs(a) + size, F.lit(2) * size)
    signed = F.when((a < 0) != (b < 0), -hundredths).otherwise(hundredths)
    return F.when(b != 0, signed / 100.0)


def hundredths(rate: Column) -> Column:
    """A two-digit rate as a whole number of hundredths (exact to add up)."""
    return F.round(rate.cast("double") * 100).cast("bigint")


def mean_of_rates(rate: Column) -> Column:
    """Aggregate: mean of a non-negative two-digit rate, two digits, half up; nulls ignored."""
    n = F.count(rate)
    return F.when(n > 0, _div(2 * F.sum(hundredths(rate)) + n, 2 * n) / 100.0)


def guarded_trend(recent: Column, before: Column) -> Column:
    """Percent change against the earlier window, null unless that window is positive."""
    return F.when(before > 0, percent_of_sums(recent - before, before))


def fill_ratio(published: Column, part: Column, whole: Column) -> Column:
    """Keep the published rate; compute it where it is missing and both parts are non-zero."""
    return F.coalesce(published, F.when((part != 0) & (whole != 0), percent(part, whole)))
