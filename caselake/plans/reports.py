"""Report queries. Each takes serving or fact DataFrames and returns a DataFrame with plain
doubles. Limits are checked before a plan is built."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..fixed_values import TOTAL_LABEL
from ..functions import mean_of_rates, percent, percent_of_sums
from ..operators.ranking import top_n
from ..operators.series import newest_rows

# report -> (default, smallest, largest) number of rows
LIMITS = {
    "top_countries": (10, 1, 100),
    "global_trend": (365, 1, 2000),
    "job_history": (20, 1, 100),
    "top_provinces": (15, 1, 100),
    "vaccination_trend": (30, 1, 400),
    "timeline_trend": (2000, 1, 3000),
    "province_cases": (15, 1, 100),
}


def checked(report: str, n: int | None) -> int:
    default, low, high = LIMITS[report]
    n = default if n is None else n
    if isinstance(n, bool) or not isinstance(n, int) or not low <= n <= high:
        raise ValueError(f"{report}: the number of rows must be an integer from {low} to {high}, got {n!r}")
    return n


def global_kpis(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("country_count"),
        F.sum("latest_total_cases").alias("total_cases"),
        F.sum("latest_total_deaths").alias("total_deaths"),
        mean_of_rates(F.col("latest_vaccination_rate")).alias("avg_vaccination_rate"),
        F.max("last_updated").alias("last_updated"))


def top_countries(summary: DataFrame, n: int | None = None) -> DataFrame:
    n = checked("top_countries", n)
    return top_n(summary, F.col("latest_total_cases"), "country_name", n).select(
        "country_name", "latest_total_cases", "latest_total_deaths",
        F.col("latest_vaccination_rate").cast("double").alias("latest_vaccination_rate"),
        F.col("trend_7d_cases").cast("double").alias("trend_7d_cases"), "last_updated")


def global_trend(daily: DataFrame, days: int | None = None, day: str = "date_id") -> DataFrame:
    """Daily totals of the newest days, oldest first."""
    return newest_rows(daily, day, checked("global_trend", days))


def job_history(log: DataFrame, n: int | None = None) -> DataFrame:
    n = checked("job_history", n)
    return log.orderBy(F.col("job_id").desc()).limit(n).select(
        "job_id", "job_name", "status", "rows_processed", "started_at", "finished_at", "error_message")


def vaccination_kpis(summary: DataFrame) -> DataFrame:
    """Totals, the rate of the totals (weighted) and the mean of the rates (unweighted)."""
    return summary.agg(
        F.count(F.lit(1)).alias("province_count"),
        F.sum("population").alias("population"),
        F.sum("doses_distributed").alias("doses_distributed"),
        F.sum("doses_administered").alias("doses_administered"),
        percent_of_sums(F.sum("doses_administered"), F.sum("population")).alias("doses_per_100"),
        mean_of_rates(F.col("doses_per_100")).alias("avg_doses_per_100"),
        F.max("last_updated").alias("last_updated"))


def top_provinces(summary: DataFrame, n: int | None = None) -> DataFrame:
    n = checked("top_provinces", n)
    return top_n(summary, F.col("doses_administered"), "province_name", n).select(
        "province_name", "population", "doses_distributed", "doses_administered",
        F.col("doses_per_100").cast("double").alias("doses_per_100"), "last_updated")


def vaccination_trend(fact: DataFrame, days: int | None = None, day: str = "full_date") -> DataFrame:
    """Doses per day with the rate of the day's totals, newest days, oldest first."""
    n = checked("vaccination_trend", days)
    per_day = fact.groupBy(day).agg(
        F.sum("doses_administered").alias("doses_administered"),
        percent_of_sums(F.sum("doses_administered"), F.sum("population")).alias("doses_per_100"))
    return newest_rows(per_day, day, n)


def latest_timeline_row(daily: DataFrame, provinces: DataFrame) -> DataFrame:
    """The newest cumulative row, its fatality ratio and the number of listed provinces."""
    listed = provinces.filter(F.col("province_name") != TOTAL_LABEL).agg(F.count(F.lit(1))).scalar()
    return daily.orderBy(F.col("full_date").desc()).limit(1).select(
        F.col("full_date").alias("latest_date"), "total_cases", "total_deaths", "new_cases", "new_deaths",
        percent(F.col("total_deaths"), F.col("total_cases")).alias("cfr"), listed.alias("province_count"))


def timeline_trend(daily: DataFrame, days: int | None = None) -> DataFrame:
    n = checked("timeline_trend", days)
    return newest_rows(daily.select(
        "full_date", "total_cases", "total_deaths", "new_cases", "new_deaths"), "full_date", n)


def province_cases_top(provinces: DataFrame, n: int | None = None) -> DataFrame:
    """Provinces by total cases, without the total row, with their fatality ratio."""
    n = checked("province_cases", n)
    rows = provinces.filter(F.col("province_name") != TOTAL_LABEL)
    return top_n(rows, F.col("total_cases"), "province_name", n).select(
        "province_name", "total_cases", "total_deaths", "new_cases",
        percent(F.col("total_deaths"), F.col("total_cases")).alias("cfr"))


def cfr_ranking(summary: DataFrame, among: int = 10, n: int = 8) -> DataFrame:
    """Fatality ratio of the ``among`` countries with most cases, the highest ``n``."""
    biggest = top_countries(summary, among).filter(F.col("latest_total_cases") > 0)
    rated = biggest.select(
        "country_name", percent(F.col("latest_total_deaths"), F.col("latest_total_cases")).alias("cfr"))
    return top_n(rated, F.col("cfr"), "country_name", n)


def top_by_rate(summary: DataFrame, measure: str = "doses_per_100", n: int = 8) -> DataFrame:
    """The first ``n`` by a measure with a missing value counted as 0."""
    return top_n(summary, F.coalesce(F.col(measure).cast("double"), F.lit(0.0)), "province_name", n)
