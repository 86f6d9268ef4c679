"""Load of the global daily source: landing -> clean -> star -> serving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions import month_id, strict_date
from ..operators.clean import check_clean, clean_daily, fate_metrics, flag_rows, quality_counts
from ..operators.keys import with_new_keys
from ..operators.merge import insert_if_absent
from ..session import materialize
from ..sources.delimited import read_columns_csv
from ..sources.joblog import JobLog
from ..sources.landing import check_landing, file_states, land_daily, recent_days
from ..sources.store import TableStore, parts_of
from . import serving

JOB = "load_global_daily"
FACT = "fact_global_daily"
STATE = "state_country_monthly"


def extract(store: TableStore, delivered: DataFrame, days: int | None = None) -> int:
    """Replace the landing table by a delivery (as shaped by ``land_daily``). The delivery is read once
    and checked as landed, before it becomes current; the tasks that write it count the fates of its rows.
    ``days`` keeps the rows of the last days only (their dates are ISO text); how many were left out is
    noted with the table."""
    with JobLog(store.spark, store.root).run("extract_global_daily") as done:
        left_out = 0
        if days is not None:
            landed = materialize(delivered, "landed")
            check_landing(landed)
            dated = landed.withColumn("_day", strict_date(F.col("date_raw")))
            delivered = recent_days(dated, "_day", days).drop("_day")
            left_out = landed.count() - delivered.count()
        rows = store.replace("raw_daily", flag_rows(delivered), notes={"left_out_rows": left_out}, check=check_landing,
                             metrics=fate_metrics())
        done(rows)
    return rows


def extract_files(store: TableStore, paths: list[str], read=None) -> list[str]:
    """Add deliveries file by file to the landing table; returns the names of the files that were new. A file is
    known by name, length and time of change: sent again it adds nothing, changed it is landed as a further
    delivery, whose rows come later and so win. The list of known files is noted with the table and
    becomes current together with the rows. Each row names its own file."""
    read = read or (lambda path: land_daily(read_columns_csv(store.spark, path, order="id"), path.rsplit("/", 1)[-1]))
    with JobLog(store.spark, store.root).run("extract_global_daily") as done:
        known = store.notes("raw_daily").get("files", {})
        found = {f"{name}|{size}|{time}": path for path, name, size, time in file_states(store.spark, paths)}
        new = {state: path for state, path in sorted(found.items()) if state not in known}
        rows = 0
        if new:
            # Numbers of a file lie below 2^42 times its place in the whole list, in the order of delivery.
            place = len(known)
            parts = [read(path).withColumn("id", F.col("id") + F.lit((place + i) << 42)) for i, path in enumerate(new.values())]
            rows = store.append("raw_daily", reduce(DataFrame.unionByName, parts), notes={
                "files": known | {state: place + i for i, state in enumerate(new)}}, check=check_landing)
        done(rows)
    return sorted(path.rsplit("/", 1)[-1] for path in new.values())


def transform_load(store: TableStore, as_of: Column) -> DataFrame:
    """Clean the landing table, merge dimensions and fact, renew the serving tables. Dimensions and fact become
    current only if their keys are unique and the fact's are in the dimensions. Returns the country
    summary as stored."""
    with JobLog(store.spark, store.root).run(JOB) as done:
        kept = Observation()
        clean = materialize(clean_daily(store.read("raw_daily")).observe(kept, F.count(F.lit(1)).alias("kept_rows")), "clean-daily")
        check_clean(clean)
        attributes = materialize(serving.country_attributes(clean), "attributes")
        store.replace("dim_country", with_new_keys(store.read("dim_country"), attributes, "iso_code", "country_id"),
                      check=store.constraints("dim_country"))
        store.replace("dim_date", insert_if_absent(store.read("dim_date"), serving.dim_date(clean), ["date_id"]),
                      check=store.constraints("dim_date"))
        fact = serving.global_fact(clean, store.read("dim_country"))
        months = parts_of(clean.select(month_id(F.col("full_date")).alias("month_id")), "month_id")
        rows = store.merge(FACT, fact, ["country_id", "date_id"], "month_id", ["country_id", "date_id"], touched=months,
                           check=store.constraints(FACT), notes={"kept_rows": kept.get["kept_rows"]})
        refresh_serving(store, as_of, months)
        done(rows)
    return store.read("agg_country_summary")


def refresh_serving(store: TableStore, as_of: Column, months: list | None = None) -> None:
    """Renew the serving tables. With ``months`` (those a load touched) only these are read from the fact: their
    daily totals and their states per country are renewed, the others stay. The country summary is made of
    the states, one row per country and month, and of the days of the newest two months in them. Without
    ``months``, or where a table is missing, everything is built from the whole fact."""
    if months is None or not store.exists("agg_daily_global"):
        daily = serving.daily_totals(store.read(FACT))
    else:
        others = store.read("agg_daily_global").filter(~F.floor(F.col("date_id") / 100).cast("int").isin(months))
        daily = others.unionByName(serving.daily_totals(store.read(FACT, months)))
    store.replace("agg_daily_global", daily)
    if months is None or not store.exists(STATE):
        store.replace(STATE, serving.country_months(store.read(FACT)), "month_id")
    else:
        store.replace_parts(STATE, serving.country_months(store.read(FACT, months)), "month_id", months)
    newest = store.read(STATE).agg(F.max("newest_date_id")).first()[0]
    recent = store.read(STATE, [] if newest is None else serving.trend_months(newest))
    store.replace("agg_country_summary", serving.country_summary_from_months(
        store.read(STATE), recent, newest or 10101, store.read("dim_country"), as_of))


def accounting(store: TableStore) -> DataFrame:
    """Row counts of the current landing, with the rows that its date filter left out. Taken from what the landing's
    and the load's writing tasks counted: duplicates are the valid rows less those that were kept. Without
    such notes (files added one by one, or no load yet) the landing is counted anew."""
    landed, loaded = store.notes("raw_daily"), store.notes(FACT)
    left_out = F.lit(landed.get("left_out_rows", 0)).cast("bigint").alias("left_out_rows")
    if "valid_rows" not in landed or "kept_rows" not in loaded:
        return quality_counts(store.read("raw_daily")).withColumn("left_out_rows", left_out)
    counts = {c: landed[c] for c in ("landed_rows", "aggregate_rows", "header_rows", "bad_date_rows")} | {
        "duplicate_rows": landed["valid_rows"] - loaded["kept_rows"], "kept_rows": loaded["kept_rows"]}
    return store.spark.range(1).select(*[F.lit(n).cast("bigint").alias(c) for c, n in counts.items()], left_out)


def bad_dates(store: TableStore) -> list[str]:
    """Up to five samples (id, code, text) of dates in the current landing that do not parse, as the landing's
    writing tasks met them."""
    return [s for s in store.notes("raw_daily").get("bad_date_samples", []) if s is not None]
