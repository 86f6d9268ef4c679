"""Date columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..fixed_values import ISO_DATE, PROVINCE_DATES, SHORT_ISO_DATE, TIME_OF_DAY, TIMELINE_DATE_PATTERN, TOLERANT_DATES
from .text import strip


def strict_date(c: Column, fmt: str = ISO_DATE) -> Column:
    """Parse or fail the run (ANSI mode raises on the first bad value)."""
    return F.to_date(c, fmt)


def _shape(fmt: str) -> str:
    """Digits-and-separators pattern of a numeric date format."""
    sizes = {"yyyy": "[0-9]{4}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "M": "[0-9]{1,2}", "d": "[0-9]{1,2}"}
    return "^" + re.sub("yyyy|MM|dd|M|d|[^yMd]+", lambda m: sizes.get(m[0], re.escape(m[0])), fmt) + "$"


def _parsed(text: Column, fmt: str) -> Column:
    """Text of the format's shape as a date. A failed parse raises and catches an exception
    per row inside Spark; the shape test keeps other text away from it. ISO text, with or without
    leading zeros, takes the plain cast, which neither throws nor goes through a timestamp."""
    if fmt in (ISO_DATE, SHORT_ISO_DATE):
        return F.when(text.rlike(_shape(fmt)), text.try_cast("date"))
    return F.when(text.rlike(_shape(fmt)), F.try_to_date(text, fmt))


def tolerant_date(c: Column, formats=tuple(TOLERANT_DATES), times: bool = True) -> Column:
    """Trim, then the first format that parses; null when none does. ``times`` lets a time of day
    follow the date; it is left out. The text stands in the expression twice per format, and a filter
    on the date repeats the whole of it, so it is kept short: of the two ISO forms the wider one serves both."""
    text = strip(c)
    if times:
        text = F.regexp_replace(text, TIME_OF_DAY, "")
    if SHORT_ISO_DATE in formats:
        formats = [f for f in formats if f != ISO_DATE]
    return F.coalesce(*[_parsed(text, f) for f in formats])


def province_date(c: Column) -> Column:
    """Month-day-year, with or without leading zeros; else null."""
    return tolerant_date(c, PROVINCE_DATES, times=False)


def is_timeline_date(c: Column) -> Column:
    return strip(c).rlike(TIMELINE_DATE_PATTERN)


def timeline_date(c: Column) -> Column:
    """A date only where the whole cell is ``yyyy-mm-dd`` (month headings give null)."""
    return F.when(is_timeline_date(c), strip(c).try_cast("date"))


def date_id(d: Column) -> Column:
    """yyyymmdd as an integer, by arithmetic (no text formatting per row)."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def month_id(d: Column) -> Column:
    """yyyymm, the partition of a fact row."""
    return (F.year(d) * 100 + F.month(d)).cast("int")


def date_from_id(key: Column) -> Column:
    return F.make_date(
        F.floor(key / 10000).cast("int"), F.floor(key / 100).cast("int") % 100, key % 100)


def date_attributes(d: Column) -> list[Column]:
    """The dim_date row of a date; ``week`` is the ISO week everywhere."""
    return [
        date_id(d).alias("date_id"),
        d.alias("full_date"),
        F.year(d).cast("int").alias("year"),
        F.month(d).cast("int").alias("month"),
        F.weekofyear(d).cast("int").alias("week"),
        F.quarter(d).cast("int").alias("quarter"),
    ]
