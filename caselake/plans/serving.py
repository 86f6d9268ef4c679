"""Dimensions, facts and serving tables as DataFrame functions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import TREND_DAYS
from ..functions import date_attributes, date_from_id, date_id, guarded_trend, month_id
from ..operators.keys import lookup_key
from ..operators.latest import known_max_by, last_non_null
from ..operators.series import window_sums

FACT_MEASURES = [
    "new_cases", "new_deaths", "total_cases", "total_deaths", "people_vaccinated", "vaccination_rate",
    "case_fatality_rate",
]


# --- dimensions -------------------------------------------------------------------
def country_attributes(clean: DataFrame) -> DataFrame:
    """Per code the last known name, continent and population, each on its own."""
    last = last_non_null(clean, "iso_code", "full_date", ["location", "continent", "population"])
    return last.withColumnRenamed("location", "country_name")


def dim_date(*sources: DataFrame, day: str = "full_date") -> DataFrame:
    """Distinct days of one or more sources with their attributes. Each source is reduced to
    its days before the union, so what is shuffled is bounded by the calendar."""
    days = None
    for source in sources:
        one = source.select(F.col(day).alias("full_date")).filter(F.col("full_date").isNotNull()).distinct()
        days = one if days is None else days.unionByName(one)
    if len(sources) > 1:
        days = days.distinct()
    return days.select(*date_attributes(F.col("full_date")))


def with_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Attach ``full_date``. No hint: dim_date is stored, so the planner knows its size."""
    return df.join(dates.select("date_id", "full_date"), "date_id")


# --- facts ------------------------------------------------------------------------
def global_fact(clean: DataFrame, countries: DataFrame) -> DataFrame:
    """One row per (country_id, date_id); rows of unknown codes are dropped."""
    keyed = lookup_key(clean, countries, "iso_code", "country_id")
    return keyed.select(
        "country_id", date_id(F.col("full_date")).alias("date_id"), *FACT_MEASURES,
        month_id(F.col("full_date")).alias("month_id"))


# --- serving ----------------------------------------------------------------------
def daily_totals(fact: DataFrame, day: str = "date_id") -> DataFrame:
    """New cases and deaths per day over all places; nulls ignored."""
    return fact.groupBy(day).agg(
        F.sum("new_cases").alias("total_new_cases"), F.sum("new_deaths").alias("total_new_deaths"))


def country_summary(fact: DataFrame, countries: DataFrame, as_of: Column) -> DataFrame:
    """Latest totals, latest known vaccination rate and 7-day trend per country.

    One aggregate of the stored fact replaces five intermediate tables: a single shuffle of
    partial results (numbers only, a hash aggregate), then a join of one row per country.
    The newest date is read from the ``date_id`` column alone. The fact holds one row per
    (country_id, date_id)."""
    newest = date_from_id(fact.agg(F.max("date_id")).scalar())
    recent, before = window_sums(date_from_id(F.col("date_id")), F.col("new_cases"), newest, TREND_DAYS)
    latest = fact.groupBy("country_id").agg(
        F.max_by("total_cases", "date_id").alias("latest_total_cases"),
        F.max_by("total_deaths", "date_id").alias("latest_total_deaths"),
        known_max_by("vaccination_rate", "date_id").alias("latest_vaccination_rate"),
        recent.alias("recent"), before.alias("before"))
    return latest.join(countries.select("country_id", "country_name"), "country_id").select(
        "country_id", "country_name", "latest_total_cases", "latest_total_deaths", "latest_vaccination_rate",
        guarded_trend(F.col("recent"), F.col("before")).alias("trend_7d_cases"),
        as_of.alias("last_updated"))


# --- serving from monthly states ----------------------------------------------------
def country_months(fact: DataFrame) -> DataFrame:
    """Per country and month what the summary needs of it: the newest row's totals, the newest known rate, and
    the new cases of its days (at most 31). A month's state follows from that month's rows alone, so
    states of other months stay as they are, however old the restated day."""
    known = F.when(F.col("vaccination_rate").isNotNull(), F.col("date_id"))
    return fact.groupBy("country_id", "month_id").agg(
        F.max("date_id").alias("newest_date_id"),
        F.max_by("total_cases", "date_id").alias("total_cases"), F.max_by("total_deaths", "date_id").alias("total_deaths"),
        F.max(known).alias("rate_date_id"), F.max_by("vaccination_rate", known).alias("vaccination_rate"),
        F.collect_list(F.when(F.col("new_cases").isNotNull(), F.struct("date_id", "new_cases"))).alias("days"))


def trend_months(newest_date_id: int) -> list[int]:
    """The months that the two trend windows before the newest day reach into."""
    newest = date(newest_date_id // 10000, newest_date_id // 100 % 100, newest_date_id % 100)
    days = [newest - timedelta(days=i) for i in range(2 * TREND_DAYS)]
    return sorted({d.year * 100 + d.month for d in days})


def country_summary_from_months(months: DataFrame, recent_months: DataFrame, newest_date_id: int, countries: DataFrame,
                                as_of: Column) -> DataFrame:
    """``country_summary`` out of the states: latest values from one narrow row per country and month, the
    trend from the days of ``recent_months`` (``trend_months``)."""
    newest = date_from_id(F.lit(newest_date_id))
    latest = months.groupBy("country_id").agg(
        F.max_by("total_cases", "newest_date_id").alias("latest_total_cases"),
        F.max_by("total_deaths", "newest_date_id").alias("latest_total_deaths"),
        F.max_by("vaccination_rate", "rate_date_id").alias("latest_vaccination_rate"))
    days = recent_months.select("country_id", F.explode("days").alias("day")).select("country_id", "day.*")
    recent, before = window_sums(date_from_id(F.col("date_id")), F.col("new_cases"), newest, TREND_DAYS)
    sums = days.groupBy("country_id").agg(recent.alias("recent"), before.alias("before"))
    return latest.join(countries.select("country_id", "country_name"), "country_id").join(sums, "country_id", "left").select(
        "country_id", "country_name", "latest_total_cases", "latest_total_deaths", "latest_vaccination_rate",
        guarded_trend(F.col("recent"), F.col("before")).alias("trend_7d_cases"), as_of.alias("last_updated"))


def province_months(fact: DataFrame) -> DataFrame:
    """Per province and month its newest and its first row."""
    first = {f"first_{c}": F.min_by(c, "date_id") for c in ("new_cases", "total_cases", "total_deaths", "new_deaths")}
    newest = {c: F.max_by(c, "date_id") for c in ("new_cases", "total_cases", "total_deaths", "active_cases")}
    return fact.groupBy("province_id", "month_id").agg(
        F.max("date_id").alias("newest_date_id"), F.min("date_id").alias("first_date_id"),
        *[c.alias(k) for k, c in (newest | first).items()])


def province_summary_from_months(months: DataFrame, provinces: DataFrame, as_of: Column) -> DataFrame:
    """``province_summary`` out of the states."""
    return province_summary(months.withColumnRenamed("newest_date_id", "date_id"), provinces, as_of)


def country_summary_from_clean(clean: DataFrame, newest: Column) -> DataFrame:
    """The same summary straight from cleaned rows in one pass, keyed by the country code.

    Names are part of the first grouping key (numbers only in the buffer, so a hash
    aggregate that shrinks a hot country before the shuffle); the second step merges the
    few names a code has had and takes the last known one."""
    recent, before = window_sums(F.col("full_date"), F.col("new_cases"), newest, TREND_DAYS)
    per_name = clean.groupBy("iso_code", "location").agg(
        F.max("full_date").alias("day"),
        F.max_by("total_cases", "full_date").alias("total_cases"),
        F.max_by("total_deaths", "full_date").alias("total_deaths"),
        known_max_by("vaccination_rate", "full_date").alias("rate"),
        F.max(F.when(F.col("vaccination_rate").isNotNull(), F.col("full_date"))).alias("rate_day"),
        recent.alias("recent"), before.alias("before"))
    per_code = per_name.groupBy("iso_code").agg(
        known_max_by("location", "day").alias("country_name"),
        F.max_by("total_cases", "day").alias("latest_total_cases"),
        F.max_by("total_deaths", "day").alias("latest_total_deaths"),
        F.max_by("rate", "rate_day").alias("latest_vaccination_rate"),
        F.sum("recent").alias("recent"), F.sum("before").alias("before"),
        F.max("day").alias("last_date"))
    return per_code.select(
        "iso_code", "country_name", "latest_total_cases", "latest_total_deaths", "latest_vaccination_rate",
        guarded_trend(F.col("recent"), F.col("before")).alias("trend_7d_cases"), "last_date")


def province_summary(fact: DataFrame, provinces: DataFrame, as_of: Column) -> DataFrame:
    """The newest day of each province with all its measures."""
    latest = fact.groupBy("province_id").agg(
        F.max_by("total_cases", "date_id").alias("latest_total_cases"),
        F.max_by("total_deaths", "date_id").alias("latest_total_deaths"),
        F.max_by("new_cases", "date_id").alias("latest_new_cases"),
        F.max_by("active_cases", "date_id").alias("active_cases"))
    return latest.join(provinces.select("province_id", "province_name"), "province_id").withColumn(
        "last_updated", as_of)


def vaccination_summary(fact: DataFrame, provinces: DataFrame, snapshot_date_id: int, as_of: Column) -> DataFrame:
    """One snapshot day's fact rows with province names."""
    day = fact.filter(F.col("date_id") == snapshot_date_id)
    return day.join(provinces.select("province_id", "province_name"), "province_id").select(
        "province_id", "province_name", fact["population"], "doses_distributed", "doses_administered",
        "doses_per_100", as_of.alias("last_updated"))
