"""Named reports over a table store: the read side of the data product.

Each report is a function of the store's tables; ``n`` is its row limit where it has one.
The dashboard's own calculations are reports too, so they run in the cluster plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..fixed_values import DOWNSAMPLE_LAST_STEP
from ..functions import place_key, place_name_key
from ..operators import places, ranking, series
from ..sources.joblog import JobLog
from ..sources.store import TableStore
from . import reports, serving

Report = Callable[..., DataFrame]
REPORTS: dict[str, Report] = {}


def report(f: Report) -> Report:
    REPORTS[f.__name__] = f
    return f


def run(store: TableStore, name: str, n: int | None = None, **options) -> DataFrame:
    if name not in REPORTS:
        raise ValueError(f"no report {name!r}; there are {sorted(REPORTS)}")
    return REPORTS[name](store, n=n, **options) if n is not None else REPORTS[name](store, **options)


def most_rows(name: str, n: int | None) -> int | None:
    """Rows that a report has at most by its own limit; None for reports without one."""
    limited = {"trend_chart": n, "timeline_chart": None, "province_cases_top": "province_cases"}
    single = {"global_kpis": 1, "vaccination_kpis": 1, "latest_timeline_row": 1, "top_versus_rest": 2, "cfr_ranking": 8}
    if name in single:
        return single[name]
    if name == "top_coverage":
        return 8 if n is None else n
    limit = limited.get(name, name)
    return reports.checked(limit, n) if limit in reports.LIMITS else limit if isinstance(limit, int) else None


def _dated(store: TableStore, table: str) -> DataFrame:
    return serving.with_dates(store.read(table), store.read("dim_date"))


def _timeline(store: TableStore, series_name: str | None) -> DataFrame:
    daily = _dated(store, "fact_timeline_daily")
    return daily if series_name is None else daily.filter(F.col("series") == series_name)


@report
def global_kpis(store):
    return reports.global_kpis(store.read("agg_country_summary"))


@report
def top_countries(store, n=None):
    return reports.top_countries(store.read("agg_country_summary"), n)


@report
def global_trend(store, n=None):
    """Newest n days, joined to the calendar after the limit."""
    newest = reports.global_trend(store.read("agg_daily_global"), n)
    return serving.with_dates(newest, store.read("dim_date")).orderBy("full_date").select(
        "full_date", "total_new_cases", "total_new_deaths")


@report
def job_history(store, n=None):
    return reports.job_history(JobLog(store.spark, store.root).read(), n)


@report
def vaccination_kpis(store):
    return reports.vaccination_kpis(store.read("agg_vaccination_summary"))


@report
def top_provinces(store, n=None):
    return reports.top_provinces(store.read("agg_vaccination_summary"), n)


@report
def vaccination_trend(store, n=None):
    return reports.vaccination_trend(_dated(store, "fact_vaccination"), n)


@report
def latest_timeline_row(store, series_name=None):
    return reports.latest_timeline_row(_timeline(store, series_name), store.read("agg_province_cases"))


@report
def timeline_trend(store, n=None, series_name=None):
    return reports.timeline_trend(_timeline(store, series_name), n)


@report
def province_cases_top(store, n=None):
    return reports.province_cases_top(store.read("agg_province_cases"), n)


# --- what the dashboard computes from them ----------------------------------------
@report
def cfr_ranking(store):
    return reports.cfr_ranking(store.read("agg_country_summary"))


@report
def top_versus_rest(store):
    return ranking.top_n_versus_rest(store.read("agg_country_summary"), "latest_total_cases", "country_name")


@report
def trend_chart(store, n=None):
    """Daily totals in chunks of one, seven or thirty rows: the newest n days, all days without n."""
    if n is None:
        daily, step = _dated(store, "agg_daily_global"), DOWNSAMPLE_LAST_STEP
    else:
        daily, step = global_trend(store, n), series.downsample_step(n)
    return series.chunk_downsample(
        daily.withColumn("place", F.lit("all")), ["place"], "full_date", step,
        {"total_new_cases": "mean_new_cases", "total_new_deaths": "mean_new_deaths"}).drop("place")


@report
def timeline_chart(store, n=None):
    """Every series in chunks of thirty rows: all days, or the newest n of each series."""
    daily = _timeline(store, None)
    if n is not None:
        daily = series.newest_rows_per_series(daily, ["series"], "full_date", n)
    return series.chunk_downsample(
        daily, ["series"], "full_date", DOWNSAMPLE_LAST_STEP,
        {"new_cases": "mean_new_cases", "new_deaths": "mean_new_deaths"},
        {"total_cases": "total_cases", "total_deaths": "total_deaths"})


@report
def top_coverage(store, n=8):
    return reports.top_by_rate(store.read("agg_vaccination_summary"), "doses_per_100", n)


@report
def coverage_classes(store):
    return ranking.five_classes(store.read("agg_vaccination_summary"), "doses_per_100")


@report
def map_points(store):
    """Provinces with their coordinates; a province without coordinates is left out."""
    rows = store.read("agg_vaccination_summary").withColumn("name_key", place_name_key(F.col("province_name")))
    return places.lookup_places(rows, places.keyed_coordinates(store.spark), "name_key", "_n")


def map_features(store: TableStore, features: DataFrame, name: str = "NAME_1") -> DataFrame:
    """Map features (with their polygons) and the province row of the same place, if any."""
    keyed = features.withColumn("place_key", place_key(F.col(name)))
    rows = store.read("agg_vaccination_summary").withColumn("place_key", place_key(F.col("province_name")))
    return places.lookup_places(keyed, rows, "place_key", "province_id", "left")
