"""Surrogate integer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

BUCKET_DIGITS = 2


def key_bucket(column: str, digits: int = BUCKET_DIGITS):
    """First hex digits of the key's md5: spreads any keys evenly over 16^digits buckets."""
    return F.substring(F.md5(F.col(column)), 1, digits)


def number_keys(df: DataFrame, natural: str, id_name: str, start=None, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Dense ids start+1 .. start+n over distinct natural keys, in (bucket, key) order.

    Rows are ranked inside hash buckets, and each bucket is shifted by the rows in the
    buckets before it. Only the bucket counts (at most 16^digits rows, a fixed bound) meet
    in one task; the rows never do. The order depends on the keys alone, so a re-run gives
    the same ids. ``df`` is read twice: pass a stored table, not a long plan."""
    if not 1 <= digits <= 3:
        raise ValueError("digits must be 1, 2 or 3: the bucket counts are broadcast and meet in one task")
    start = F.lit(0) if start is None else start
    bucketed = df.withColumn("_bucket", key_bucket(natural, digits))
    ranked = bucketed.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy(natural)))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        ranked.join(F.broadcast(offsets), "_bucket")  # at most 16^digits rows
        .withColumn(id_name, (start + F.col("_offset") + F.col("_rank")).cast("int"))
        .drop("_bucket", "_rank", "_offset")
    )


def with_new_keys(existing: DataFrame, incoming: DataFrame, natural: str, id_name: str) -> DataFrame:
    """Dimension after a load: known keys keep their id and take the incoming attributes,
    new keys are numbered after the largest id. Keys missing from the load stay. ``incoming`` is read
    once."""
    attributes = [c for c in existing.columns if c not in (id_name, natural)]
    old = existing.select(natural, id_name, *[F.col(c).alias(f"_old_{c}") for c in attributes])
    new = incoming.select(natural, *attributes, F.lit(True).alias("_delivered"))
    # One join tells known, new and untouched keys; its rows are stored because numbering reads them twice.
    joined = materialize(old.join(new, natural, "full_outer"), "keys")
    last = F.coalesce(joined.agg(F.max(id_name)).scalar(), F.lit(0))
    known = joined.filter(F.col(id_name).isNotNull()).select(id_name, natural, *[
        F.when(F.col("_delivered"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in attributes])
    numbered = number_keys(joined.filter(F.col(id_name).isNull()).drop(id_name), natural, id_name, last)
    return known.unionByName(numbered.select(*known.columns)).select(*existing.columns)


def lookup_key(df: DataFrame, dim: DataFrame, natural: str, id_name: str) -> DataFrame:
    """Natural key -> surrogate key; rows without a dimension row are dropped. No hint: the
    planner broadcasts a stored dimension by its file size and shuffles a large one."""
    return df.join(dim.select(natural, id_name), natural, "inner")
