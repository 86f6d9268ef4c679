"""Load of the cumulative timeline and of the province case list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clean_place_name, date_id, first_digit_run, month_id, timeline_date
from ..operators.clean import check_clean, keep_last
from ..operators.merge import insert_if_absent
from ..operators.series import cumulative_to_daily
from ..session import materialize
from ..sources.html import positional_rows
from ..sources.joblog import JobLog
from ..sources.store import TableStore
from . import serving

JOB = "load_timeline"
FACT = "fact_timeline_daily"
# table positions on a page (from 0) and cell positions in a row
PROVINCE_TABLE, PROVINCE_CELLS = 1, {"province_name": 0, "total_cases": 1, "total_deaths": 2, "new_cases": 3}
TIMELINE_TABLE, TIMELINE_CELLS = 3, {"date_text": 0, "total_cases_text": 3, "total_deaths_text": 4}


def page_province_text(pages: DataFrame, strict: bool = True) -> DataFrame:
    return positional_rows(pages, PROVINCE_TABLE, PROVINCE_CELLS, strict=strict)


def page_timeline_text(pages: DataFrame, strict: bool = True) -> DataFrame:
    """Timeline rows of each page (one series per page); the first body row is a heading."""
    rows = positional_rows(pages, TIMELINE_TABLE, TIMELINE_CELLS, skip=1, strict=strict)
    return rows.withColumn("series", F.col("page_id").cast("string"))


def timeline_rows(text: DataFrame) -> DataFrame:
    """Rows with a plain date and both totals readable; headings and "n.a." rows go."""
    keep_order = [c for c in ("row_no",) if c in text.columns]
    return text.select(
        "series", timeline_date(F.col("date_text")).alias("full_date"),
        first_digit_run(F.col("total_cases_text")).alias("total_cases"),
        first_digit_run(F.col("total_deaths_text")).alias("total_deaths"), *keep_order,
    ).dropna(subset=["full_date", "total_cases", "total_deaths"])


def timeline_daily(text: DataFrame) -> DataFrame:
    """Cumulative text rows -> daily counts per series."""
    rows = timeline_rows(text)
    order = [F.col("row_no").desc()] if "row_no" in rows.columns else None
    daily = cumulative_to_daily(
        rows, ["series"], "full_date", {"total_cases": "new_cases", "total_deaths": "new_deaths"}, order)
    return daily.select("series", "full_date", "total_cases", "total_deaths", "new_cases", "new_deaths")


def province_cases(text: DataFrame) -> DataFrame:
    """Cleaned names with counts, an unreadable count as 0; nameless rows go."""
    named = text.withColumn("province_name", clean_place_name(F.col("province_name"))).filter(
        F.col("province_name") != "")
    return named.withColumns({
        c: F.coalesce(first_digit_run(F.col(c)), F.lit(0).cast("bigint"))
        for c in ("total_cases", "total_deaths", "new_cases")
    })


def load(store: TableStore, timeline_text: DataFrame, source_url: str, as_of: Column,
         province_text: DataFrame | None = None) -> DataFrame:
    """Replace fact and province list by one delivery; failures are logged as well."""
    with JobLog(store.spark, store.root).run(JOB) as done:
        daily = materialize(timeline_daily(timeline_text), "timeline")
        check_clean(daily)
        store.replace("dim_date", insert_if_absent(store.read("dim_date"), serving.dim_date(daily), ["date_id"]))
        rows = store.replace(FACT, daily.select(
            "*", date_id(F.col("full_date")).alias("date_id"), F.lit(source_url).alias("source_url"),
            month_id(F.col("full_date")).alias("month_id")), "month_id", ["series", "date_id"])
        if province_text is not None:
            listed = materialize(province_cases(province_text), "province-cases")
            rows += store.replace("raw_province_cases", listed.select(
                "*", F.lit(source_url).alias("source_url"), as_of.alias("ingested_at")))
            one_each = keep_last(listed, ["province_name"], [
                F.col(c).desc() for c in ("total_cases", "total_deaths", "new_cases")])
            store.replace("agg_province_cases", one_each.select("*", as_of.alias("last_updated")))
        done(rows)
    return store.read(FACT)
