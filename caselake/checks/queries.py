"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import functions as fn
from ..fixed_values import DAILY_MEASURES, LOCALITY_HEADERS, PROVINCE_HEADERS
from ..operators import (
    audit, clean as cleaning, keys, latest, merge, places as place_ops, ranking, routing, series,
)
from ..plans import global_daily, province, reports, serving, timeline, vaccination
from ..session import materialize, scratch_path
from ..sources import delimited, html, landing
from ..sources.joblog import JobLog
from ..sources.store import TableStore
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "2024-01-01 00:00:00"
SNAPSHOT = date(2024, 1, 1)
SOURCE_URL = "https://example.org/source"
DELIVERY_CUT_DAYS = 200


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# --- shared steps -----------------------------------------------------------------
def typed(spark, sf) -> DataFrame:
    return cleaning.typed_daily(fx.raw_daily(spark, sf))


def clean(spark, sf) -> DataFrame:
    return cleaning.clean_daily(fx.raw_daily(spark, sf))


def newest_day(spark, sf):
    """Newest valid day as a scalar subquery; reads two columns and needs no dedup."""
    return typed(spark, sf).agg(F.max("full_date")).scalar()


def summary(spark, sf) -> DataFrame:
    rows = typed(spark, sf)
    newest = rows.agg(F.max("full_date")).scalar()
    cleaned = cleaning.with_measures(cleaning.deduplicate(rows))
    return serving.country_summary_from_clean(cleaned, newest).withColumnRenamed("last_date", "last_updated")


def localities(spark, sf) -> DataFrame:
    return vaccination.clean_localities(fx.locality_text(spark, sf))


def national_timeline(spark, sf) -> DataFrame:
    daily = timeline.timeline_daily(fx.timeline_text(spark, sf))
    return daily.groupBy("full_date").agg(*[
        F.sum(c).alias(c) for c in ("total_cases", "total_deaths", "new_cases", "new_deaths")])


def listed_provinces(spark, sf) -> DataFrame:
    return timeline.province_cases(timeline.page_province_text(fx.html_pages(spark, sf)))


def days_of(spark, sf) -> DataFrame:
    return serving.dim_date(typed(spark, sf))


def first_and_restated(spark, sf) -> tuple[DataFrame, DataFrame]:
    """An older delivery (up to a cut, first row per key) and a newer one (the recent days,
    last row per key); they overlap, so both new and restated keys occur."""
    rows = typed(spark, sf)
    newest = rows.agg(F.max("full_date")).scalar()
    key = ["iso_code", "full_date"]
    older = rows.filter(F.col("full_date") <= F.date_sub(newest, DELIVERY_CUT_DAYS))
    recent = rows.filter(F.col("full_date") >= F.date_sub(newest, landing.DAYS_TO_KEEP))
    columns = [*key, "new_cases", "new_deaths", "total_cases", "total_deaths"]
    return (
        cleaning.keep_last(older, key, [F.col("id").asc()]).select(*columns),
        cleaning.keep_last(recent, key, [F.col("id").desc()]).select(*columns),
    )


def new_store(spark) -> TableStore:
    return TableStore(spark, scratch_path(spark, "store"))


# --- sources and sinks ------------------------------------------------------------
@query
def scan_csv_columns(spark, sf):
    path = scratch_path(spark, "csv")
    fx.raw_daily(spark, sf).withColumnRenamed("date_raw", "date").withColumn("extra", F.lit("unused")).write.option(
        "header", True).csv(path)
    return delimited.read_columns_csv(spark, path)


@query
def scan_tsv_encoding(spark, sf):
    path = scratch_path(spark, "tsv")
    names = {column: header for header, column in PROVINCE_HEADERS.items()}
    fx.province_text(spark, sf).withColumnsRenamed(names).write.option("header", True).option("sep", "\t").option(
        "encoding", "UTF-16").csv(path)
    return delimited.read_tsv(spark, path).select(
        "province_name", "date_raw", "new_cases", "total_cases", "total_deaths")


@query
def raw_landing(spark, sf):
    path = scratch_path(spark, "landing")
    landed = landing.land_daily(
        fx.raw_daily(spark, sf).withColumnRenamed("date_raw", "date"), "raw-daily.csv", as_of())
    landed.write.parquet(path)
    return spark.read.schema(landed.schema).parquet(path).drop("ingested_at")


@query
def html_tables(spark, sf):
    return html.html_cells(fx.html_pages(spark, sf))


@query
def html_list_items(spark, sf):
    return html.html_list_items(fx.table(spark, sf, "pages"))


@query
def html_locality_rows(spark, sf):
    return html.locality_rows(fx.html_pages(spark, sf))


@query
def html_province_cases(spark, sf):
    return listed_provinces(spark, sf).select("page_id", "province_name", "total_cases", "total_deaths", "new_cases")


@query
def html_timeline_daily(spark, sf):
    return timeline.timeline_daily(timeline.page_timeline_text(fx.html_pages(spark, sf)))


@query
def csv_snapshot_roundtrip(spark, sf):
    path = scratch_path(spark, "snapshot")
    rows = localities(spark, sf)
    delimited.write_csv_snapshot(rows, path, SOURCE_URL, F.lit(SNAPSHOT))
    schema = rows.withColumn("source_url", F.lit("")).withColumn("snapshot_date", F.lit(SNAPSHOT)).schema
    return delimited.read_csv_snapshot(spark, path, schema)


@query
def upsert_full(spark, sf):
    target, source = first_and_restated(spark, sf)
    return merge.upsert(target, source, ["iso_code", "full_date"])


@query
def upsert_partial(spark, sf):
    target, source = first_and_restated(spark, sf)
    target = target.withColumn("active_cases", F.col("total_cases") - F.col("total_deaths"))
    return merge.upsert_columns(
        target, source.drop("new_deaths"), ["iso_code", "full_date"], ["new_cases", "total_cases", "total_deaths"],
        {"new_deaths": 0, "active_cases": 0})


@query
def insert_if_absent(spark, sf):
    target, _ = first_and_restated(spark, sf)
    source = province.clean_province(fx.province_text(spark, sf))
    return merge.insert_if_absent(serving.dim_date(target), serving.dim_date(source), ["date_id"])


@query
def schema_evolve(spark, sf):
    older, recent = first_and_restated(spark, sf)
    return merge.evolve(
        older.select("iso_code", "full_date", F.col("new_cases").cast("int").alias("new_cases")),
        recent.select("iso_code", "full_date", "new_cases", "total_deaths"), {"total_deaths": 0})


# --- scalar functions and filters -------------------------------------------------
@query
def strict_date(spark, sf):
    """The whole order table's dates as text: one bad cell would end the run."""
    iso = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_raw"))
    return iso.select("id", fn.strict_date(F.col("date_raw")).alias("full_date"))


@query
def tolerant_date(spark, sf):
    return fx.raw_daily(spark, sf).select("id", "date_raw", fn.tolerant_date(F.col("date_raw")).alias("full_date"))


@query
def fixed_format_date(spark, sf):
    return fx.province_text(spark, sf).select(
        "province_name", "date_raw", fn.province_date(F.col("date_raw")).alias("full_date"))


@query
def timeline_rows(spark, sf):
    return timeline.timeline_rows(fx.timeline_text(spark, sf))


@query
def tolerant_numeric(spark, sf):
    return fx.raw_daily(spark, sf).select("id", *[fn.tolerant_count(F.col(m)).alias(m) for m in DAILY_MEASURES])


@query
def dotted_thousands(spark, sf):
    return fx.province_text(spark, sf).select(
        "province_name", "date_raw", "total_cases", fn.dotted_thousands(F.col("total_cases")).alias("n_cases"))


@query
def clean_integer_text(spark, sf):
    return fx.locality_text(spark, sf).select(
        "province_name", *[fn.clean_integer_text(F.col(c)).alias(c) for c in vaccination.COUNTS])


@query
def clean_decimal_text(spark, sf):
    return fx.locality_text(spark, sf).select(
        "province_name", fn.clean_decimal_text(F.col("doses_per_100")).alias("doses_per_100"))


@query
def first_digit_run(spark, sf):
    return fx.timeline_text(spark, sf).select(
        "series", "date_text", "total_cases_text", fn.first_digit_run(F.col("total_cases_text")).alias("total_cases"))


@query
def header_alias(spark, sf):
    cells = html.html_cells(fx.html_pages(spark, sf)).filter(F.col("row_no") == 0)
    return cells.select("page_id", "table_no", "cell_no", "cell",
                        html.header_role(F.col("cell"), LOCALITY_HEADERS).alias("column_name"))


@query
def clean_place_name(spark, sf):
    rows = fx.places(spark, sf).select(F.col("place_id").cast("bigint").alias("row_id"), "place_name").unionByName(
        fx.place_rows(spark, sf).select("row_id", F.col("province_name").alias("place_name")))
    return rows.select("row_id", "place_name", fn.clean_place_name(F.col("place_name")).alias("clean_name"),
                       fn.drop_province_suffix(F.col("place_name")).alias("short_name"))


@query
def place_key(spark, sf):
    rows = fx.places(spark, sf).select(F.col("place_id").cast("bigint").alias("row_id"), "place_name").unionByName(
        fx.place_rows(spark, sf).select("row_id", F.col("province_name").alias("place_name")))
    return rows.select("row_id", "place_name", fn.place_key(F.col("place_name")).alias("place_key"),
                       fn.place_name_key(F.col("place_name")).alias("name_key"))


@query
def drop_aggregate_rows(spark, sf):
    return cleaning.drop_aggregate_rows(fx.raw_daily(spark, sf)).select("id", "iso_code", "location")


@query
def drop_null_keys(spark, sf):
    return fx.locality_text(spark, sf).select(
        "province_name", *[fn.clean_integer_text(F.col(c)).alias(c) for c in vaccination.COUNTS]
    ).dropna(subset=["population", "doses_administered"])


@query
def clamp_negative(spark, sf):
    return fx.raw_daily(spark, sf).select(
        "id", *[fn.clamp_negative(fn.tolerant_count(F.col(c))).alias(c) for c in ("new_cases", "new_deaths")])


@query
def safe_percentage(spark, sf):
    counts = fx.raw_daily(spark, sf).select("id", *[fn.tolerant_count(F.col(m)).alias(m) for m in DAILY_MEASURES])
    return counts.select(
        "id", fn.percent(F.col("people_vaccinated"), F.col("population")).alias("vaccination_rate"),
        fn.percent(F.col("total_deaths"), F.col("total_cases")).alias("case_fatality_rate"))


@query
def fill_ratio(spark, sf):
    return localities(spark, sf).select("province_name", "population", "doses_administered", "doses_per_100")


@query
def dim_date(spark, sf):
    return days_of(spark, sf)


@query
def recent_days(spark, sf):
    return landing.recent_days(typed(spark, sf), "full_date").select("id", "iso_code", "full_date")


# --- joins ------------------------------------------------------------------------
@query
def fact_join_date(spark, sf):
    fact = clean(spark, sf).select(
        "iso_code", fn.date_id(F.col("full_date")).alias("date_id"), "new_cases", "new_deaths")
    return serving.with_dates(fact, days_of(spark, sf)).select(
        "iso_code", "date_id", "full_date", "new_cases", "new_deaths")


@query
def latest_row_per_key(spark, sf):
    return latest.latest_row_per_key(
        clean(spark, sf), "iso_code", "full_date", ["new_cases", "total_cases", "total_deaths", "vaccination_rate"])


@query
def rolling_7d_sums(spark, sf):
    return series.rolling_sums(clean(spark, sf), "iso_code", "full_date", "new_cases", newest_day(spark, sf))


@query
def surrogate_key_lookup(spark, sf):
    rows = materialize(clean(spark, sf), "clean")
    attributes = materialize(serving.country_attributes(rows), "attributes")
    countries = materialize(keys.number_keys(attributes, "iso_code", "country_id"), "countries")
    return serving.global_fact(rows, countries)


@query
def scalar_subquery_count(spark, sf):
    rows = typed(spark, sf)
    countries = rows.agg(F.countDistinct("iso_code")).scalar()
    newest = rows.agg(F.max("full_date")).scalar()
    of_day = cleaning.clean_daily(fx.raw_daily(spark, sf)).filter(F.col("full_date") == newest)
    return of_day.select(
        "iso_code", "full_date", "total_cases", countries.alias("country_count"))


@query
def place_lookup_join(spark, sf):
    known = fx.places(spark, sf).select(
        fn.place_key(fn.clean_place_name(F.col("place_name"))).alias("place_key"), "place_id", "lon", "lat")
    rows = fx.place_rows(spark, sf).withColumn("place_key", fn.place_key(F.col("province_name")))
    return place_ops.lookup_places(rows, known, "place_key", "place_id").select(
        "row_id", "province_name", "place_key", "lon", "lat")


@query
def feature_left_join(spark, sf):
    features = fx.places(spark, sf).select(
        "place_id", "place_name", fn.place_key(fn.clean_place_name(F.col("place_name"))).alias("place_key"))
    rows = fx.place_rows(spark, sf).select(
        fn.place_key(F.col("province_name")).alias("place_key"), "row_id", "province_name", "doses_per_100")
    return place_ops.lookup_places(features, rows, "place_key", "row_id", "left")


# --- aggregates -------------------------------------------------------------------
@query
def daily_totals(spark, sf):
    fact = clean(spark, sf).select(fn.date_id(F.col("full_date")).alias("date_id"), "new_cases", "new_deaths")
    return serving.daily_totals(fact)


@query
def last_non_null(spark, sf):
    return latest.last_non_null(
        clean(spark, sf), "iso_code", "full_date", ["location", "continent", "population", "people_vaccinated"])


@query
def country_summary(spark, sf):
    return summary(spark, sf)


@query
def global_kpis(spark, sf):
    return reports.global_kpis(summary(spark, sf))


def _vaccination_summary(spark, sf) -> DataFrame:
    return localities(spark, sf).withColumn("last_updated", F.lit(SNAPSHOT))


@query
def vaccination_kpis(spark, sf):
    return reports.vaccination_kpis(_vaccination_summary(spark, sf))


@query
def vaccination_trend(spark, sf):
    fact = clean(spark, sf).select("full_date", F.col("people_vaccinated").alias("doses_administered"), "population")
    return reports.vaccination_trend(fact)


@query
def latest_timeline_row(spark, sf):
    return reports.latest_timeline_row(national_timeline(spark, sf), listed_provinces(spark, sf))


@query
def distinct_keys(spark, sf):
    rows = typed(spark, sf)
    return rows.agg(F.countDistinct("iso_code").alias("n_countries"), F.countDistinct("full_date").alias("n_days"))


@query
def dedup_keep_last(spark, sf):
    return cleaning.deduplicate(typed(spark, sf))


@query
def province_summary(spark, sf):
    rows = province.clean_province(fx.province_text(spark, sf))
    return latest.latest_row_per_key(
        rows, "province_name", "full_date", ["total_cases", "total_deaths", "new_cases"])


@query
def snapshot_summary(spark, sf):
    rows = materialize(clean(spark, sf), "clean")
    newest = rows.agg(F.max("full_date")).scalar()
    fact = rows.filter(F.col("full_date") == newest).select(
        "iso_code", fn.date_id(F.col("full_date")).alias("date_id"), "people_vaccinated")
    names = materialize(serving.country_attributes(rows), "attributes")
    return fact.join(names, "iso_code").select("iso_code", "country_name", "date_id", "population", "people_vaccinated")


@query
def topn_vs_rest(spark, sf):
    return ranking.top_n_versus_rest(
        materialize(summary(spark, sf), "summary"), "latest_total_cases", "country_name")


def _continent_days(spark, sf) -> DataFrame:
    return clean(spark, sf).groupBy("continent", "full_date").agg(
        F.sum("new_cases").alias("new_cases"), F.sum("new_deaths").alias("new_deaths"))


@query
def chunk_downsample(spark, sf):
    return series.chunk_downsample(
        _continent_days(spark, sf), ["continent"], "full_date", series.downsample_step(2000),
        {"new_cases": "mean_new_cases", "new_deaths": "mean_new_deaths"})


@query
def chunk_mean_and_last(spark, sf):
    daily = timeline.timeline_daily(fx.timeline_text(spark, sf))
    return series.chunk_downsample(
        daily, ["series"], "full_date", 30, {"new_cases": "mean_new_cases", "new_deaths": "mean_new_deaths"},
        {"total_cases": "total_cases", "total_deaths": "total_deaths"})


@query
def five_class_bins(spark, sf):
    return ranking.five_classes(localities(spark, sf).select("province_name", "doses_per_100"), "doses_per_100")


@query
def share_of_max(spark, sf):
    return ranking.share_of_max(
        localities(spark, sf).select("province_name", "doses_administered"), "doses_administered")


@query
def polygon_vertex_centre(spark, sf):
    return place_ops.vertex_centre(fx.vertices(spark, sf))


# --- windows ----------------------------------------------------------------------
@query
def latest_known_value(spark, sf):
    return latest.latest_known_value(clean(spark, sf), "iso_code", "full_date", "vaccination_rate")


@query
def cumulative_to_daily(spark, sf):
    return timeline.timeline_daily(fx.timeline_text(spark, sf))


@query
def ranked_list(spark, sf):
    rows = localities(spark, sf).select("province_name", "doses_administered")
    return ranking.rank_top(rows, F.col("doses_administered"), "province_name", 15)


# --- reports ----------------------------------------------------------------------
@query
def top_countries(spark, sf):
    return reports.top_countries(summary(spark, sf))


@query
def recent_trend(spark, sf):
    return reports.global_trend(serving.daily_totals(clean(spark, sf), "full_date"), day="full_date")


@query
def timeline_trend(spark, sf):
    return reports.timeline_trend(national_timeline(spark, sf))


@query
def job_history(spark, sf):
    return reports.job_history(fx.job_log(spark, sf))


@query
def top_provinces(spark, sf):
    return reports.top_provinces(_vaccination_summary(spark, sf))


@query
def province_cases_top(spark, sf):
    return reports.province_cases_top(listed_provinces(spark, sf))


@query
def cfr_ranking(spark, sf):
    return reports.cfr_ranking(summary(spark, sf))


@query
def top_coverage(spark, sf):
    return reports.top_by_rate(localities(spark, sf).select("province_name", "doses_per_100"))


# --- unions, routing, quality -----------------------------------------------------
@query
def conformed_dates(spark, sf):
    return serving.dim_date(
        typed(spark, sf), province.clean_province(fx.province_text(spark, sf)),
        timeline.timeline_rows(fx.timeline_text(spark, sf)),
        fx.job_log(spark, sf).select(F.to_date("started_at").alias("full_date")))


@query
def keyword_route(spark, sf):
    routed = routing.route_messages(
        fx.messages(spark, sf), "text", fx.MESSAGE_TEST_RULES, fx.MESSAGE_TEST_DEFAULT)
    return routed.select("conv_id", "turn", "label", "reply")


@query
def keyword_route_counts(spark, sf):
    return routing.route_counts(routing.route_messages(
        fx.messages(spark, sf), "text", fx.MESSAGE_TEST_RULES, fx.MESSAGE_TEST_DEFAULT))


@query
def message_replies(spark, sf):
    """The product's own message rules over every message; each rule has its turns."""
    return routing.route_messages(fx.ruled_messages(spark, sf)).select("conv_id", "turn", "label", "reply")


@query
def chunk_weekly(spark, sf):
    """The weekly form of the trend chart, for a horizon of 90 days and more history."""
    return series.chunk_downsample(
        _continent_days(spark, sf), ["continent"], "full_date", series.downsample_step(90),
        {"new_cases": "mean_new_cases", "new_deaths": "mean_new_deaths"})


@query
def quality_counts(spark, sf):
    return cleaning.quality_counts(fx.raw_daily(spark, sf))


@query
def bad_date_samples(spark, sf):
    return cleaning.bad_date_samples(fx.raw_daily(spark, sf))


@query
def duplicate_keys(spark, sf):
    return audit.duplicate_keys(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def orphan_rows(spark, sf):
    rows = fx.raw_daily(spark, sf).select("id", fn.strip(F.col("iso_code")).alias("iso_code"))
    countries = materialize(typed(spark, sf).select("iso_code").distinct(), "countries")
    return audit.orphan_rows(rows, countries, "iso_code")


# --- whole loads ------------------------------------------------------------------
@query
def load_global(spark, sf):
    store = new_store(spark)
    delivered = landing.land_daily(
        fx.raw_daily(spark, sf).withColumnRenamed("date_raw", "date"), "raw-daily.csv", as_of(), null_words=("",))
    global_daily.extract(store, delivered)
    return global_daily.transform_load(store, as_of()).select(
        "country_id", "country_name", "latest_total_cases", "latest_total_deaths",
        F.col("latest_vaccination_rate").cast("double").alias("latest_vaccination_rate"),
        F.col("trend_7d_cases").cast("double").alias("trend_7d_cases"))


@query
def load_province(spark, sf):
    return province.load(new_store(spark), fx.province_text(spark, sf), as_of()).drop("last_updated")


@query
def load_vaccination(spark, sf):
    loaded = vaccination.load(new_store(spark), fx.locality_text(spark, sf), SNAPSHOT, SOURCE_URL, as_of())
    return loaded.withColumn("doses_per_100", F.col("doses_per_100").cast("double")).drop("last_updated")


@query
def load_timeline(spark, sf):
    loaded = timeline.load(new_store(spark), fx.timeline_text(spark, sf), SOURCE_URL, as_of())
    return loaded.drop("month_id")


@query
def load_global_second(spark, sf):
    """Two deliveries that overlap: three of four rows, then every second one. The fact afterwards."""
    store = new_store(spark)
    rows = fx.raw_daily(spark, sf).withColumnRenamed("date_raw", "date")
    for part in (rows.filter("id % 4 <> 0"), rows.filter("id % 2 = 0")):
        global_daily.extract(store, landing.land_daily(part, "raw-daily.csv", as_of(), null_words=("",)))
        global_daily.transform_load(store, as_of())
    return store.read(global_daily.FACT).join(store.read("dim_country").select("country_id", "iso_code"), "country_id").select(
        "iso_code", "date_id", "new_cases", "new_deaths", "total_cases", "total_deaths", "people_vaccinated",
        F.col("vaccination_rate").cast("double").alias("vaccination_rate"),
        F.col("case_fatality_rate").cast("double").alias("case_fatality_rate"))


@query
def load_province_restated(spark, sf):
    """Two overlapping deliveries with derived daily deaths, then a plain one, which leaves them alone.
    The fact afterwards."""
    store, rows = new_store(spark), fx.province_text(spark, sf)
    day = F.substring("date_raw", 4, 2).cast("int")
    province.load(store, rows.filter(day < 20), as_of(), derive_deaths=True)
    province.load(store, rows.filter(day >= 15), as_of(), derive_deaths=True)
    province.load(store, rows.filter(day == 17), as_of())
    return store.read(province.FACT).join(store.read("dim_province").select("province_id", "province_name"), "province_id").select(
        "province_name", "date_id", "new_cases", "new_deaths", "total_cases", "total_deaths", "recovered", "active_cases")


@query
def load_vaccination_pages(spark, sf):
    """The vaccination load from the pages on."""
    text = html.locality_rows(fx.html_pages(spark, sf)).drop("page_id")
    loaded = vaccination.load(new_store(spark), text, SNAPSHOT, SOURCE_URL, as_of())
    return loaded.withColumn("doses_per_100", F.col("doses_per_100").cast("double")).drop("last_updated")


def _timeline_store(spark, sf) -> TableStore:
    store, pages = new_store(spark), fx.html_pages(spark, sf)
    timeline.load(store, timeline.page_timeline_text(pages), SOURCE_URL, as_of(), timeline.page_province_text(pages))
    return store


@query
def load_timeline_pages(spark, sf):
    """The timeline load from the pages on: the fact."""
    return _timeline_store(spark, sf).read(timeline.FACT).drop("month_id")


@query
def load_timeline_provinces(spark, sf):
    """The timeline load from the pages on: the province list."""
    return _timeline_store(spark, sf).read("agg_province_cases").drop("last_updated")


@query
def serving_refresh(spark, sf):
    """The serving tables built anew from the stored fact."""
    store = new_store(spark)
    delivered = landing.land_daily(
        fx.raw_daily(spark, sf).withColumnRenamed("date_raw", "date"), "raw-daily.csv", as_of(), null_words=("",))
    global_daily.extract(store, delivered)
    global_daily.transform_load(store, as_of())
    store.replace("agg_daily_global", store.read("agg_daily_global").filter("false"))
    global_daily.refresh_serving(store, as_of())
    return store.read("agg_daily_global")


@query
def job_log_runs(spark, sf):
    """What two loads, one of them refused, leave in the run log (without its times and ids)."""
    store = new_store(spark)
    rows = fx.raw_daily(spark, sf).withColumnRenamed("date_raw", "date")
    global_daily.extract(store, landing.land_daily(rows, "raw-daily.csv", as_of(), null_words=("",)))
    global_daily.transform_load(store, as_of())
    try:
        global_daily.extract(store, landing.land_daily(rows.withColumn("iso_code", F.lit("iso_code")), "bad.csv", as_of()))
    except ValueError:
        pass
    return JobLog(spark, store.root).read().select("job_name", "status", "rows_processed", "error_message")


@query
def schema_evolve_store(spark, sf):
    """Older rows written before a column existed, newer ones with it, read through the store."""
    older, recent = first_and_restated(spark, sf)
    old = older.select("iso_code", "full_date", "new_cases")
    new = recent.select("iso_code", "full_date", "new_cases", "total_deaths")
    root = scratch_path(spark, "evolved")
    TableStore(spark, root, {"t": old.schema}, {}).replace("t", old)
    store = TableStore(spark, root, {"t": new.schema}, {"t": {"total_deaths": 0}})
    store.append("t", new)
    return store.read("t")


@query
def scan_tsv_mixed(spark, sf):
    """One folder with files in UTF-16 of both byte orders and in UTF-8, with and without mark."""
    path = scratch_path(spark, "mixed")
    names = {column: header for header, column in PROVINCE_HEADERS.items()}
    rows = fx.province_text(spark, sf).withColumnsRenamed(names)
    day = F.substring(F.col(names["date_raw"]), 4, 2).cast("int") % 5
    marked = [F.col(c).alias("\ufeff" + c if i == 0 else c) for i, c in enumerate(rows.columns)]
    for number, (encoding, columns) in enumerate((
            ("UTF-16", rows.columns), ("UTF-8", rows.columns), ("UTF-8", marked), ("UTF-16LE", rows.columns), ("UTF-16BE", rows.columns))):
        rows.filter(day == number).select(*columns).write.mode("append").option("header", True).option("sep", "\t").option(
            "encoding", encoding).csv(path)
    return delimited.read_tsv(spark, path).select("province_name", "date_raw", "new_cases", "total_cases", "total_deaths")


@query
def polygon_vertex_centre_nested(spark, sf):
    """Polygons of outer and inner rings, as map files have them, to their mean vertices."""
    return place_ops.vertex_centre(place_ops.polygon_vertices(fx.features(spark, sf), "feature_id"))


@query
def scan_csv_quoted(spark, sf):
    """Quoted fields with doubled quotes and line breaks, read split."""
    path = scratch_path(spark, "quoted")
    rows = fx.raw_daily(spark, sf).withColumnRenamed("date_raw", "date").withColumn(
        "location", F.concat("location", F.lit('\n"'), F.col("id").cast("string"), F.lit('",\nx')))
    rows.write.options(header=True, escape='"').csv(path)
    return delimited.read_columns_csv(spark, path)


@query
def schema_evolve_types(spark, sf):
    """Three generations of a table: a narrow number without a second column, a wide one with it, text."""
    older, recent = first_and_restated(spark, sf)
    root, kinds = scratch_path(spark, "types"), ("int", "bigint", "string")
    stages = [older.selectExpr("iso_code", "full_date", "cast(new_cases as int) as new_cases"),
              recent.selectExpr("iso_code", "full_date", "new_cases", "total_deaths"),
              recent.selectExpr("iso_code", "full_date", "concat(new_cases, ' cases') as new_cases", "total_deaths")]
    for rows, kind in zip(stages, kinds):
        store = TableStore(spark, root, {"t": rows.schema}, {"t": {"total_deaths": 0}})
        store.append("t", rows)
    return store.read("t")


def _deliver(store, rows) -> None:
    global_daily.extract(store, landing.land_daily(rows, "raw-daily.csv", as_of(), null_words=("",)))
    global_daily.transform_load(store, as_of())


@query
def serving_incremental(spark, sf):
    """The country summary after the recent days, the older ones, and a restated year in the middle: states of
    the months that a delivery does not touch stay."""
    store = new_store(spark)
    rows = fx.raw_daily(spark, sf).withColumnRenamed("date_raw", "date")
    day = fn.tolerant_date(F.col("date"))
    recent = F.coalesce(day >= F.lit("1997-06-17").cast("date"), F.lit(False))
    for part in (rows.filter(recent), rows.filter(~recent), rows.filter(F.year(day) == 1996)):
        _deliver(store, part)
    named = store.read("agg_country_summary").join(store.read("dim_country").select("country_id", "iso_code"), "country_id")
    return named.select("iso_code", "country_name", "latest_total_cases", "latest_total_deaths",
                        F.col("latest_vaccination_rate").cast("double").alias("latest_vaccination_rate"),
                        F.col("trend_7d_cases").cast("double").alias("trend_7d_cases"))


@query
def province_incremental(spark, sf):
    """Daily deaths derived over deliveries that arrive in the wrong order: the later months, then the earlier
    ones, then the days around a month's end again. The fact afterwards."""
    store, rows = new_store(spark), fx.province_text(spark, sf)
    later = F.substring("date_raw", 1, 2).cast("int") >= 7
    day = F.substring("date_raw", 4, 2).cast("int")
    for part in (rows.filter(later), rows.filter(~later), rows.filter((day >= 29) | (day <= 2))):
        province.load(store, part, as_of(), derive_deaths=True)
    return store.read(province.FACT).join(store.read("dim_province").select("province_id", "province_name"), "province_id").select(
        "province_name", "date_id", "new_cases", "new_deaths", "total_cases", "total_deaths", "recovered", "active_cases")


@query
def quality_counts_load(spark, sf):
    """The accounting of a load, as its writing tasks counted it."""
    store = new_store(spark)
    _deliver(store, fx.raw_daily(spark, sf).withColumnRenamed("date_raw", "date"))
    return global_daily.accounting(store)


@query
def load_guarded(spark, sf):
    """The fact after a load and two writes that its constraints refuse: doubled keys, unknown countries."""
    store = new_store(spark)
    _deliver(store, fx.raw_daily(spark, sf).withColumnRenamed("date_raw", "date"))
    fact = store.read(global_daily.FACT)
    for wrong in (fact.unionByName(fact), fact.withColumn("country_id", F.col("country_id") + 1000)):
        try:
            store.replace(global_daily.FACT, wrong, "month_id", check=store.constraints(global_daily.FACT))
        except ValueError:
            continue
        raise AssertionError("a write against the constraints became current")
    return store.read(global_daily.FACT).join(store.read("dim_country").select("country_id", "iso_code"), "country_id").select(
        "iso_code", "date_id", "new_cases", "new_deaths", "total_cases", "total_deaths", "people_vaccinated",
        F.col("vaccination_rate").cast("double").alias("vaccination_rate"),
        F.col("case_fatality_rate").cast("double").alias("case_fatality_rate"))


@query
def landing_files(spark, sf):
    """Deliveries landed file by file, some of them sent again: the landing table."""
    store, folder = new_store(spark), scratch_path(spark, "deliveries")
    rows = fx.raw_daily(spark, sf).withColumnRenamed("date_raw", "date")
    source = F.col("continent")
    for name in [r[0] for r in rows.select(source).distinct().orderBy(source).collect()]:
        rows.filter(source == name).coalesce(1).write.mode("append").option("header", True).csv(folder)
        global_daily.extract_files(store, [folder], lambda path: landing.land_daily(
            delimited.read_columns_csv(spark, path, order="id", multiline=False), path.rsplit("/", 1)[-1], as_of()))
    return store.read("raw_daily").drop("id", "ingested_at", "source_file")
