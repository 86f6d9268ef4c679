"""Numbers out of delivered text. Every function is a native column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import BLANK_NUMBER_WORDS
from .text import NBSP, strip

# Spark reads '12d' as 12.0 and 'inf' as Infinity; only plain numerals may reach the cast.
NUMERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _numeral(text: Column) -> Column:
    return F.when(text.rlike(NUMERAL), text)


def tolerant_number(c: Column) -> Column:
    """Double, or null for anything that is not a numeral."""
    return _numeral(strip(c)).try_cast("double")


def tolerant_count(c: Column) -> Column:
    """Whole number; '12.0' is 12; null for junk. Plain integers take the exact and cheap
    cast (it skips ordinary spaces itself), only other text goes on to the numeral check."""
    return F.coalesce(c.try_cast("bigint"), tolerant_number(c).try_cast("bigint"))


def dotted_thousands(c: Column) -> Column:
    """'2.96' is 2,960: dots separate thousands and trailing zeros may be lost.
    Null and blank give 0."""
    text = strip(c)
    last = F.substring_index(text, ".", -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(last))
    whole = F.replace(head, F.lit("."), F.lit(""))
    joined = F.concat(whole, F.rpad(last, F.greatest(F.lit(3), F.length(last)), F.lit("0")))
    return (
        F.when(text.isNull() | (text == ""), F.lit(0).cast("bigint"))
        .when(text.contains("."), joined.try_cast("bigint"))
        .otherwise(tolerant_count(text))
    )


def _plain_text(c: Column) -> Column:
    text = strip(c)
    kept = F.when(~text.isin("", *BLANK_NUMBER_WORDS), text)
    for mark in (",", NBSP, "%"):
        kept = F.replace(kept, F.lit(mark), F.lit(""))
    return strip(kept)


def clean_integer_text(c: Column) -> Column:
    """'1,037' or '53 %' as a whole number, fraction cut off; blanks and junk are null."""
    return tolerant_count(_plain_text(c))


def clean_decimal_text(c: Column) -> Column:
    """The same with two digits kept, as double."""
    return half_up_2(tolerant_number(_plain_text(c)))


def first_digit_run(c: Column) -> Column:
    """First run of digits and dots as a whole number ('9.114[3]' is 9114); else null."""
    run = F.regexp_extract(c, r"[0-9][0-9.]*", 0)
    return F.replace(run, F.lit("."), F.lit("")).try_cast("bigint")


def half_up_2(x: Column) -> Column:
    """Two digits, halves away from zero, the same in every engine."""
    size = F.floor(F.abs(x) * 100 + F.lit(0.5))
    return F.when(x < 0, -size).otherwise(size) / 100.0


def clamp_negative(c: Column) -> Column:
    """Negative to zero; null stays null (``greatest`` would turn it into zero)."""
    return F.when(c < 0, F.lit(0).cast("bigint")).otherwise(c)


def floor_div(a: Column, b: Column) -> Column:
    """Whole-number floor division (b > 0), exact beyond 2^53."""
    return F.call_function("div", a - F.pmod(a, b), b)
