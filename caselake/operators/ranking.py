"""Top lists, shares and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import CLASS_CUTS


def top_n(df: DataFrame, measure: Column, tie: str, n: int) -> DataFrame:
    """The ``n`` largest by ``measure`` (nulls last), ties by ``tie``. Each task keeps its own
    n rows and only those meet; there is no full sort."""
    return df.orderBy(measure.desc_nulls_last(), F.col(tie).asc()).limit(n)


def rank_top(df: DataFrame, measure: Column, tie: str, n: int) -> DataFrame:
    """:func:`top_n` with its position. The ungrouped window sees the n rows of the limit."""
    order = Window.orderBy(measure.desc_nulls_last(), F.col(tie).asc())
    return top_n(df, measure, tie, n).withColumn("rank", F.row_number().over(order))


def top_n_versus_rest(df: DataFrame, value: str, tie: str, n: int = 5) -> DataFrame:
    """Two rows: the sum of the first ``n`` and what is left of the total (not below 0)."""
    amount = F.coalesce(F.col(value), F.lit(0).cast("bigint"))
    top = top_n(df.select(tie, value), F.col(value), tie, n).agg(F.coalesce(F.sum(amount), F.lit(0)).alias("top"))
    total = df.agg(F.coalesce(F.sum(amount), F.lit(0))).scalar()
    rest = F.greatest(total - F.col("top"), F.lit(0).cast("bigint"))
    return top.select(F.explode(F.array(
        F.struct(F.lit("top").alias("part"), F.col("top").alias("value")),
        F.struct(F.lit("rest").alias("part"), rest.alias("value")),
    )).alias("s")).select("s.part", "s.value")


def share_of_max(df: DataFrame, value: str) -> DataFrame:
    """Each value (null as 0) as a share of the largest, with the largest at least 1."""
    amount = F.coalesce(F.col(value), F.lit(0))
    largest = F.greatest(df.agg(F.max(amount)).scalar(), F.lit(1))
    return df.withColumn("share", amount.cast("double") / largest.cast("double"))


def five_classes(df: DataFrame, value: str, cuts=tuple(CLASS_CUTS)) -> DataFrame:
    """Min-max ratio and class 1 (highest) to 5. The range spans the non-zero values and is
    stretched to include 0 below and 1 above; a missing value counts as 0."""
    amount = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    bounds = df.select(F.when(amount != 0, amount).alias("v")).agg(
        F.struct(F.least(F.min("v"), F.lit(0.0)).alias("low"),
                 F.greatest(F.max("v"), F.lit(1.0)).alias("high")).alias("b")).scalar()
    low, high = bounds["low"], bounds["high"]
    ratio = (amount - low) / F.greatest(high - low, F.lit(1.0))
    level = F.lit(len(cuts) + 1)
    for position in range(len(cuts), 0, -1):
        level = F.when(F.col("ratio") >= cuts[position - 1], F.lit(position)).otherwise(level)
    return df.withColumn("ratio", ratio).withColumn("class_no", level)
