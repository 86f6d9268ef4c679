"""Names, place keys and other text columns."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from ..fixed_values import (
    NULL_WORDS, PLACE_KEY_ALIASES, PROVINCE_SUFFIX, TOTAL_LABEL,
)

NBSP = "\u00a0"
SPACES = " \t\n\r\x0b\x0c" + NBSP


def strip(c: Column) -> Column:
    """Remove white space at both ends, non-breaking spaces included (no regex per row)."""
    return F.btrim(c, F.lit(SPACES))


def null_if_missing_word(c: Column, words=NULL_WORDS) -> Column:
    """Null for the words that mean "no value" in delivered text."""
    return F.when(~strip(c).isin(*words), c)


def clean_place_name(c: Column) -> Column:
    """Footnotes dropped, spaces collapsed, one label for the total row."""
    text = F.regexp_replace(c, NBSP, " ")
    text = F.regexp_replace(text, r"\[[^\]]+\]", "")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(text.startswith(TOTAL_LABEL), F.lit(TOTAL_LABEL)).otherwise(text)


def drop_province_suffix(c: Column) -> Column:
    return strip(F.replace(c, F.lit(PROVINCE_SUFFIX), F.lit("")))


@lru_cache(maxsize=1)
def accent_pairs() -> tuple[str, str]:
    """(accented, plain) lower-case Latin letters, built from Unicode decompositions.
    Spark has no NFD function, so folding is one ``translate`` over this pair."""
    accented, plain = ["đ"], ["d"]
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter == letter.lower() and base != letter and base.isascii() and base.isalpha():
            accented.append(letter)
            plain.append(base.lower())
    return "".join(accented), "".join(plain)


def fold_accents(c: Column) -> Column:
    """Lower case without diacritics, for composed and decomposed input alike."""
    accented, plain = accent_pairs()
    return F.regexp_replace(F.translate(F.lower(c), accented, plain), "[\u0300-\u036f]", "")


def _without_kind(folded: Column) -> Column:
    folded = F.regexp_replace(folded, f"[\\s{NBSP}]+province$", "")
    return F.regexp_replace(folded, f"[\\s{NBSP}]+city$", "")


def place_name_key(c: Column) -> Column:
    """Folded name without a trailing "province"/"city"; spaces and hyphens stay."""
    return strip(_without_kind(fold_accents(c)))


def place_key(c: Column) -> Column:
    """Folded letters and digits only, with the spelling aliases applied."""
    raw = F.regexp_replace(_without_kind(fold_accents(c)), "[^a-z0-9]", "")
    aliased = raw
    for spelling, key in PLACE_KEY_ALIASES.items():
        aliased = F.when(raw == spelling, F.lit(key)).otherwise(aliased)
    return aliased
