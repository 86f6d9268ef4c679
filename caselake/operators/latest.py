"""Latest rows and values per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def latest_row_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """All columns of the newest row per key, nulls included. ``order`` is unique per key.
    One hash aggregate with partial results before the shuffle; no self-join, no sort."""
    return df.groupBy(key).agg(
        F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in columns])


def latest_known_value(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Newest non-null value per key, possibly older than the newest row."""
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def known_max_by(value: str, order: str) -> Column:
    """Aggregate: the non-null ``value`` with the largest ``order``."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def last_non_null(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per key and per column the newest non-null value (``order`` unique per key).

    Text columns go into the key of a first grouping and fixed-width ones into its buffer.
    That step stays a hash aggregate, which shrinks a hot key before the shuffle; with text
    in the buffer it would sort all rows. The second step merges the few text combinations
    of a key."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    fixed = [c for c in columns if c not in texts]
    combos = df.groupBy(key, *texts).agg(
        F.max(order).alias("_order"),
        *[known_max_by(c, order).alias(c) for c in fixed],
        *[F.max(F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_order_{c}") for c in fixed])
    merged = combos.groupBy(key).agg(
        *[known_max_by(c, "_order").alias(c) for c in texts],
        *[F.max_by(c, f"_order_{c}").alias(c) for c in fixed])
    return merged.select(key, *columns)
