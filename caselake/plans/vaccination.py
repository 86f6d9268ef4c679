"""Load of the vaccination snapshot by locality."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import LOCALITY_HEADERS, LOCALITY_REQUIRED
from ..functions import clean_decimal_text, clean_integer_text, drop_province_suffix, fill_ratio
from ..operators.clean import check_clean, keep_last
from ..operators.keys import lookup_key, with_new_keys
from ..operators.merge import insert_if_absent
from ..session import materialize
from ..sources.delimited import write_csv_snapshot
from ..sources.joblog import JobLog
from ..sources.store import TableStore
from . import serving

JOB = "load_vaccination"
FACT = "fact_vaccination"
COUNTS = ["population", "doses_distributed", "doses_administered"]


def rename_by_header(df: DataFrame) -> DataFrame:
    """Columns named by keywords in their headers; a missing required column is an error,
    a missing published rate becomes a null column. Works on the schema only."""
    renamed = {}
    for header in df.columns:
        text = " ".join(header.split()).lower()
        name = next((name for keyword, name in LOCALITY_HEADERS if keyword in text), None)
        if name:
            renamed[header] = name
    df = df.withColumnsRenamed(renamed)
    missing = sorted(set(LOCALITY_REQUIRED) - set(df.columns))
    if missing:
        raise ValueError(f"columns not found by their headers: {missing}")
    return df if "doses_per_100" in df.columns else df.withColumn("doses_per_100", F.lit(None).cast("string"))


def clean_localities(text: DataFrame) -> DataFrame:
    """Human-formatted text -> numbers; rows without a name, population or administered doses
    are dropped; a missing rate is computed."""
    named = text.withColumn("province_name", drop_province_suffix(F.col("province_name"))).filter(
        F.col("province_name") != "")
    typed = named.withColumns({
        **{c: clean_integer_text(F.col(c)) for c in COUNTS},
        "doses_per_100": clean_decimal_text(F.col("doses_per_100")),
    })
    return typed.withColumn(
        "doses_per_100", fill_ratio(F.col("doses_per_100"), F.col("doses_administered"), F.col("population"))
    ).dropna(subset=["population", "doses_administered"])


def vaccination_fact(clean: DataFrame, provinces: DataFrame, snapshot: date) -> DataFrame:
    """One row per (province, snapshot day)."""
    one_each = keep_last(clean, ["province_name"], [F.col("doses_administered").desc(), F.col("population").desc()])
    keyed = lookup_key(one_each, provinces, "province_name", "province_id")
    return keyed.select(
        "province_id", F.lit(int(snapshot.strftime("%Y%m%d"))).alias("date_id"), *COUNTS, "doses_per_100",
        F.lit(snapshot.year * 100 + snapshot.month).alias("month_id"))


def load(store: TableStore, text: DataFrame, snapshot: date, source_url: str, as_of: Column,
         snapshot_path: str | None = None) -> DataFrame:
    """Replace the landing table, merge the dimensions, write the snapshot's fact rows and
    rebuild the summary. Region and other provinces' rows are left as they are. ``snapshot_path``: a new folder
    for the cleaned rows as CSV."""
    with JobLog(store.spark, store.root).run(JOB) as done:
        clean = materialize(clean_localities(text), "clean-localities")
        check_clean(clean)
        if snapshot_path:
            write_csv_snapshot(clean, snapshot_path, source_url, F.lit(snapshot))
        store.replace("raw_vaccination", clean.select(
            "*", F.lit(snapshot).alias("snapshot_date"), F.lit(source_url).alias("source_url"),
            as_of.alias("ingested_at")))
        existing = store.read("dim_province")
        populations = keep_last(
            clean, ["province_name"], [F.col("doses_administered").desc(), F.col("population").desc()]
        ).select("province_name", "population")
        regions = existing.select("province_name", "region")
        incoming = materialize(populations.join(regions, "province_name", "left").select(
            "province_name", "region", "population"), "province-names")
        store.replace("dim_province", with_new_keys(existing, incoming, "province_name", "province_id"))
        day = store.spark.range(1).select(F.lit(snapshot).alias("full_date"))
        store.replace("dim_date", insert_if_absent(store.read("dim_date"), serving.dim_date(day), ["date_id"]))
        provinces = store.read("dim_province")
        rows = store.replace(FACT, vaccination_fact(clean, provinces, snapshot), "month_id", ["province_id"], check=store.constraints(FACT))
        store.replace("agg_vaccination_summary", serving.vaccination_summary(
            store.read(FACT), provinces, int(snapshot.strftime("%Y%m%d")), as_of))
        done(rows)
    return store.read("agg_vaccination_summary")
