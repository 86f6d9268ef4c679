"""Operators on daily series. A series has at most one row per calendar day once its
rows are reduced per date, so a window over one series is bounded by the calendar however
many source rows the series had."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import DAY_LABEL, DOWNSAMPLE_LAST_STEP, DOWNSAMPLE_STEPS, MONTH_LABEL, TREND_DAYS
from ..functions import floor_div
from .clean import keep_last


def rolling_sums(fact: DataFrame, key: str, day: str, value: str, newest: Column,
                 days: int = TREND_DAYS) -> DataFrame:
    """Sums over the last ``days`` days and the ``days`` before, per key, both anchored at
    ``newest`` (the newest day of the whole table). One aggregate, no window, no self-join."""
    recent, before = window_sums(F.col(day), F.col(value), newest, days)
    in_reach = fact.filter((F.col(day) > F.date_sub(newest, 2 * days)) & (F.col(day) <= newest))
    return in_reach.groupBy(key).agg(recent.alias("cases_last7"), before.alias("cases_prev7"))


def window_sums(day: Column, value: Column, newest: Column, days: int = TREND_DAYS) -> tuple[Column, Column]:
    """Aggregates for (newest-days, newest] and (newest-2*days, newest-days]."""
    edge, start = F.date_sub(newest, days), F.date_sub(newest, 2 * days)
    recent = F.sum(F.when((day > edge) & (day <= newest), value))
    before = F.sum(F.when((day > start) & (day <= edge), value))
    return recent, before


def cumulative_to_daily(df: DataFrame, series: list[str], day: str, totals: dict[str, str],
                        order: list[Column] | None = None) -> DataFrame:
    """Running totals -> daily counts, never negative, 0 on a series' first day. ``totals``
    maps total column -> daily column. Rows of one day are reduced to the last one first."""
    order = order or [F.col(t).desc_nulls_last() for t in totals]
    daily = keep_last(df, [*series, day], order)
    w = Window.partitionBy(*series).orderBy(day)
    return daily.withColumns({
        new: F.coalesce(F.greatest(F.col(total) - F.lag(total).over(w), F.lit(0).cast("bigint")),
                        F.lit(0).cast("bigint"))
        for total, new in totals.items()
    })


def newest_rows(df: DataFrame, day: str, n: int) -> DataFrame:
    """The newest ``n`` rows, oldest first: a top-k on ``day``, then a sort of n rows."""
    return df.orderBy(F.col(day).desc()).limit(n).orderBy(F.col(day).asc())


def newest_rows_per_series(df: DataFrame, series: list[str], day: str, n: int) -> DataFrame:
    """The newest ``n`` rows of every series; one row per (series, day) goes in."""
    newest_first = Window.partitionBy(*series).orderBy(F.col(day).desc())
    return df.withColumn("_rn", F.row_number().over(newest_first)).filter(F.col("_rn") <= n).drop("_rn")


def downsample_step(horizon_days: int) -> int:
    """Rows per chunk for a horizon: single days, weeks, then 30 days."""
    for limit, step in DOWNSAMPLE_STEPS:
        if horizon_days <= limit:
            return step
    return DOWNSAMPLE_LAST_STEP


def mean_half_up(value: Column) -> Column:
    """Aggregate: mean over all rows of the group with null as 0, halves up, whole number."""
    total, n = F.coalesce(F.sum(value), F.lit(0)), F.count(F.lit(1))
    return floor_div(2 * total + n, 2 * n)


def chunk_downsample(daily: DataFrame, series: list[str], day: str, step: int, means: dict[str, str],
                     lasts: dict[str, str] | None = None) -> DataFrame:
    """Date-ordered rows of each series in chunks of ``step`` rows: rounded means, first and
    last day, and the chunk's last value of each ``lasts`` column. ``daily`` holds one row
    per (series, day)."""
    w = Window.partitionBy(*series).orderBy(day)
    chunked = daily.withColumn("chunk_no", F.floor((F.row_number().over(w) - 1) / F.lit(step)).cast("int"))
    out = chunked.groupBy(*series, "chunk_no").agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("n_days"),
        *[mean_half_up(F.col(c)).alias(name) for c, name in means.items()],
        *[F.max_by(c, day).alias(name) for c, name in (lasts or {}).items()],
    )
    first, last = F.date_format("first_day", "yyyy-MM-dd"), F.date_format("last_day", "yyyy-MM-dd")
    return out.withColumns({
        "label": F.when(first == last, first).otherwise(F.concat(first, F.lit(" - "), last)),
        "short_label": F.date_format("first_day", MONTH_LABEL if step == DOWNSAMPLE_LAST_STEP else DAY_LABEL),
    })
