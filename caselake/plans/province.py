"""Load of the province daily source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import date_id, dotted_thousands, month_id, province_date, strip
from ..operators.clean import check_clean, keep_last
from ..operators.keys import lookup_key, with_new_keys
from ..operators.merge import insert_if_absent
from ..operators.series import cumulative_to_daily
from ..session import materialize
from ..sources.joblog import JobLog
from ..sources.store import TableStore, parts_of
from . import serving

JOB = "load_province_daily"
FACT = "fact_province_daily"
STATE = "state_province_monthly"


def clean_province(raw: DataFrame) -> DataFrame:
    """Text columns province_name, new_cases, total_cases, total_deaths, date_raw -> one typed
    row per (province, date). Rows without a name or a date are dropped. Of several rows of one day
    the last one counts where ``raw`` has an ``id`` in the order of delivery, else the one with the
    largest totals."""
    ordered = ["id"] if "id" in raw.columns else []
    typed = raw.select(
        strip(F.col("province_name")).alias("province_name"),
        province_date(F.col("date_raw")).alias("full_date"),
        *[dotted_thousands(F.col(c)).alias(c) for c in ("new_cases", "total_cases", "total_deaths")], *ordered,
    ).dropna(subset=["province_name", "full_date"])
    order = [F.col(c).desc() for c in ordered or ("total_cases", "total_deaths", "new_cases")]
    return keep_last(typed, ["province_name", "full_date"], order).drop("id")


#: The measures a delivery sets. The others keep their stored values; rows of new days have 0.
DELIVERED = ["new_cases", "total_cases", "total_deaths"]


def province_fact(clean: DataFrame, provinces: DataFrame) -> DataFrame:
    """The delivered measures per (province, day)."""
    keyed = lookup_key(clean, provinces, "province_name", "province_id")
    return keyed.select(
        "province_id", date_id(F.col("full_date")).alias("date_id"), *DELIVERED,
        month_id(F.col("full_date")).alias("month_id"))


def with_daily_deaths(delivered: DataFrame, stored: DataFrame) -> DataFrame:
    """Delivered rows with the daily deaths that follow from the running totals, stored days included:
    the first delivered day counts from the day before it, and the stored day after a delivered one,
    whose difference changes, is added. Reads the stored rows of the delivered provinces only. ``stored``
    may have a column ``_closing``: the last row of a month of which only the first and the last are given;
    its own difference is not known here and stays."""
    key = ["province_id", "date_id"]
    columns = [*key, *DELIVERED, "month_id"]
    stored = stored if "_closing" in stored.columns else stored.withColumn("_closing", F.lit(False))
    others = stored.join(delivered.select("province_id").distinct(), "province_id", "left_semi").join(
        delivered.select(*key), key, "left_anti").select(*columns, "_closing", F.col("new_deaths").alias("_before"))
    series = delivered.select(*columns, F.lit(False).alias("_closing"), F.lit(None).cast("bigint").alias("_before"),
                              F.lit(True).alias("_new")).unionByName(others.withColumn("_new", F.lit(False)))
    daily = cumulative_to_daily(series, ["province_id"], "date_id", {"total_deaths": "new_deaths"})
    return daily.filter("_new or not (_closing or _before <=> new_deaths)").select(*columns, "new_deaths")


def neighbours(store: TableStore, months: list) -> DataFrame:
    """Stored rows that deaths of these months may have to be counted from, or change: all rows of the
    months, and the first and last row of each other month, from the states."""
    columns = ["province_id", "date_id", *DELIVERED, "new_deaths", "month_id"]
    if not store.exists(STATE):
        return store.read(FACT).select(*columns, F.lit(False).alias("_closing"))
    own = store.read(FACT, months).select(*columns, F.lit(False).alias("_closing"))
    others = store.read(STATE).filter(~F.col("month_id").isin([int(m) for m in months]))
    first = others.select("province_id", F.col("first_date_id").alias("date_id"), *[
        F.col(f"first_{c}").alias(c) for c in (*DELIVERED, "new_deaths")], "month_id", F.lit(False).alias("_closing"))
    last = others.filter("newest_date_id <> first_date_id").select(
        "province_id", F.col("newest_date_id").alias("date_id"), *DELIVERED, F.lit(None).cast("bigint").alias("new_deaths"),
        "month_id", F.lit(True).alias("_closing"))
    return own.unionByName(first).unionByName(last)


def province_names(clean: DataFrame) -> DataFrame:
    return clean.select("province_name").distinct().select(
        "province_name", F.lit(None).cast("string").alias("region"), F.lit(None).cast("bigint").alias("population"))


def keep_known_attributes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming provinces with region and population of the stored row where the source has none."""
    stored = existing.select(
        "province_name", F.col("region").alias("_region"), F.col("population").alias("_population"))
    return incoming.join(stored, "province_name", "left").select(
        "province_name", F.coalesce("region", "_region").alias("region"),
        F.coalesce("population", "_population").alias("population"))


def load(store: TableStore, raw: DataFrame, as_of: Column, derive_deaths: bool = False) -> DataFrame:
    """Merge one delivery and rebuild the province serving tables. Province keys are stable:
    known names keep their id, so the vaccination fact's keys stay valid."""
    with JobLog(store.spark, store.root).run(JOB) as done:
        clean = materialize(clean_province(raw), "clean-province")
        check_clean(clean)
        existing = store.read("dim_province")
        names = materialize(keep_known_attributes(existing, province_names(clean)), "province-names")
        store.replace("dim_province", with_new_keys(existing, names, "province_name", "province_id"),
                      check=store.constraints("dim_province"))
        store.replace("dim_date", insert_if_absent(store.read("dim_date"), serving.dim_date(clean), ["date_id"]),
                      check=store.constraints("dim_date"))
        provinces = store.read("dim_province")
        delivered, update = province_fact(clean, provinces), DELIVERED
        if derive_deaths:
            days = parts_of(clean.select(month_id(F.col("full_date")).alias("month_id")), "month_id")
            delivered, update = with_daily_deaths(delivered, neighbours(store, days)), [*DELIVERED, "new_deaths"]
        delivered = materialize(delivered, "province-fact")
        months = parts_of(delivered, "month_id")
        rows = store.merge(FACT, delivered, ["province_id", "date_id"], "month_id", ["province_id", "date_id"], update, touched=months,
                           check=store.constraints(FACT))
        refresh_serving(store, as_of, months)
        done(rows)
    return store.read("agg_province_summary")


def refresh_serving(store: TableStore, as_of: Column, months: list | None = None) -> None:
    """Renew the province serving tables; with ``months`` (those a load touched) only these are read from the
    fact, and the states and daily totals of the others stay."""
    if months is None or not store.exists(STATE):
        store.replace(STATE, serving.province_months(store.read(FACT)), "month_id")
        daily = serving.daily_totals(store.read(FACT))
    else:
        touched = store.read(FACT, months)
        store.replace_parts(STATE, serving.province_months(touched), "month_id", months)
        others = store.read("agg_daily_province").filter(~F.floor(F.col("date_id") / 100).cast("int").isin(months))
        daily = others.unionByName(serving.daily_totals(touched))
    store.replace("agg_province_summary", serving.province_summary_from_months(store.read(STATE), store.read("dim_province"), as_of))
    store.replace("agg_daily_province", daily)
