"""Jobs from the command line and the reports over what they stored."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caselake.__main__ import main
from caselake.plans import global_daily, portal
from caselake.sources.store import TableStore

PAGE = """<table><tr><td>x</td></tr></table>
<table><tr><th>Name</th><th>Cases</th><th>Deaths</th><th>New</th></tr>
<tr><td>Long An</td><td>1.000</td><td>10</td><td>1</td></tr><tr><td>Cả nước</td><td>2.000</td><td>9</td><td>1</td></tr></table>
<table><tr><th>Locality</th><th>Population</th><th>Doses distributed</th><th>Doses administered</th></tr>
<tr><td>Long An province</td><td>1,000</td><td>900</td><td>500</td></tr>
<tr><td>Hà Nội</td><td>4,000</td><td>900</td><td>400</td></tr><tr><td>Nowhere</td><td>10</td><td>9</td><td>1</td></tr></table>
<table><tr><th>d</th><th>a</th><th>b</th><th>c</th><th>e</th></tr><tr><td colspan=5>2021</td></tr>
<tr><td>2021-01-01</td><td></td><td></td><td>5</td><td>1</td></tr>
<tr><td>2021-01-02</td><td></td><td></td><td>9</td><td>1</td></tr></table>"""


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    header = "iso_code,continent,location,date,new_cases,new_deaths,total_cases,total_deaths,people_vaccinated,population,extra"
    lines = [f"{c},Asia,Land {c},2021-01-{d:02d},{n * d}.0,1.0,{n * d * d}.0,{d}.0,{d}.0,100.0,z"
             for c, n in (("AAA", 2), ("BBB", 3)) for d in range(1, 29)]
    lines += ["OWID_WRL,,World,2021-01-28,1,1,1,1,1,1,z", "CCC,Asia,Land CCC,2019-01-01,1,1,1,1,1,1,z",
              "AAA,Asia,Land AAA,2021-01-28,7,1,5000,1,,100,z"]
    (root / "daily.csv").write_text("\n".join([header, *lines]) + "\n")
    (root / "province.tsv").write_bytes((
        "Tỉnh\tTổng số ca lây nhiễm\tSố ca lây nhiễm mới\tTổng số ca tử vong\tNgày\n"
        "Long An\t2.96\t10\t0\t01-25-2021\n").encode("utf-16"))
    spark.createDataFrame([(1, PAGE)], "page_id bigint, html string").write.parquet(str(root / "pages"))
    lake = str(root / "store")
    main(["extract_global", "--store", lake, "--input", str(root / "missing.csv"), str(root / "daily.csv"), "--days", "400"])
    main(["transform_global", "--store", lake])
    main(["refresh_serving", "--store", lake])
    main(["load_province", "--store", lake, "--input", str(root / "province.tsv")])
    main(["load_vaccination", "--store", lake, "--input", str(root / "pages"), "--snapshot", "2021-02-01"])
    main(["load_timeline", "--store", lake, "--input", str(root / "pages")])
    return TableStore(spark, lake)


def rows(store, name, *columns, **options):
    return [tuple(r[c] for c in columns) for r in portal.run(store, name, **options).collect()]


def test_landing_keeps_recent_days_as_text(filled):
    raw = filled.read("raw_daily")
    assert raw.count() == 58 and raw.filter("location = 'Land CCC'").isEmpty()
    counts = global_daily.accounting(filled).first()
    assert (counts.landed_rows, counts.left_out_rows) == (58, 1)
    row = raw.filter("iso_code = 'AAA' and date_raw = '2021-01-03'").first()
    assert (row.new_cases, row.source_file) == ("6.0", "daily.csv") and row.ingested_at is not None


def test_global_reports(filled):
    assert rows(filled, "global_kpis", "country_count", "total_cases", "total_deaths") == [(2, 7352, 29)]
    assert rows(filled, "top_countries", "country_name", "latest_total_cases", "latest_vaccination_rate", n=1) == [
        ("Land AAA", 5000, 27.0)]
    trend = rows(filled, "global_trend", "full_date", "total_new_cases", n=2)
    assert trend == [(dt.date(2021, 1, 27), 135), (dt.date(2021, 1, 28), 91)]
    chart = rows(filled, "trend_chart", "first_day", "n_days", n=14)
    assert len(chart) == 14 and all(n == 1 for _, n in chart)
    assert [n for _, n in rows(filled, "trend_chart", "chunk_no", "n_days", n=100)] == [7, 7, 7, 7]
    assert rows(filled, "cfr_ranking", "country_name") == [("Land BBB",), ("Land AAA",)]
    assert dict(rows(filled, "top_versus_rest", "part", "value")) == {"top": 7352, "rest": 0}


def test_province_reports(filled):
    assert rows(filled, "vaccination_kpis", "province_count", "doses_administered", "doses_per_100") == [(3, 901, 17.98)]
    assert rows(filled, "top_provinces", "province_name", n=1) == [("Long An",)]
    assert rows(filled, "vaccination_trend", "full_date", "doses_administered") == [(dt.date(2021, 2, 1), 901)]
    assert rows(filled, "province_cases_top", "province_name", "cfr") == [("Long An", 1.0)]
    assert rows(filled, "latest_timeline_row", "latest_date", "new_cases", "province_count") == [
        (dt.date(2021, 1, 2), 4, 1)]
    assert rows(filled, "timeline_trend", "full_date", "new_cases", series_name="1") == [
        (dt.date(2021, 1, 1), 0), (dt.date(2021, 1, 2), 4)]
    assert rows(filled, "timeline_chart", "mean_new_cases", "total_cases") == [(2, 9)]
    assert rows(filled, "top_coverage", "province_name", n=2) == [("Long An",), ("Hà Nội",)]
    assert dict(rows(filled, "coverage_classes", "province_name", "class_no")) == {
        "Long An": 1, "Hà Nội": 5, "Nowhere": 5}
    assert {n for (n,) in rows(filled, "map_points", "province_name")} == {"Long An", "Hà Nội"}


def test_map_features(spark, filled):
    features = spark.createDataFrame([("Long An", 1), ("Huế", 2)], "NAME_1 string, f int")
    got = {r.NAME_1: r.doses_administered for r in portal.map_features(filled, features).collect()}
    assert got == {"Long An": 500, "Huế": None}


def test_job_history_lists_every_run(filled):
    jobs = rows(filled, "job_history", "job_name", "status")
    assert [name for name, _ in jobs] == [
        "load_timeline", "load_vaccination", "load_province_daily", "load_global_daily", "extract_global_daily"]
    assert {status for _, status in jobs} == {"success"}


def test_report_comes_out_whole(spark, filled, tmp_path, capsys):
    """A report without a limit of its own is written, not printed; charts take all days."""
    dates = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(4000)]
    lake = TableStore(spark, str(tmp_path / "long"))
    lake.replace("dim_date", spark.createDataFrame([(int(d.strftime("%Y%m%d")), d) for d in dates], "date_id int, full_date date"))
    lake.replace("fact_timeline_daily", spark.createDataFrame(
        [("s", int(d.strftime("%Y%m%d")), i, 0, 1, 0, "u", d.year * 100 + d.month) for i, d in enumerate(dates)],
        "series string, date_id int, total_cases bigint, total_deaths bigint, new_cases bigint, new_deaths bigint, "
        "source_url string, month_id int"))
    lake.replace("agg_daily_global", spark.createDataFrame(
        [(int(d.strftime("%Y%m%d")), 1, 1) for d in dates], "date_id int, total_new_cases bigint, total_new_deaths bigint"))
    for name in ("timeline_chart", "trend_chart"):
        main(["report", "--store", lake.root, "--name", name, "--output", str(tmp_path / name)])
        out = spark.read.parquet(str(tmp_path / name))
        assert out.count() == 134 and out.agg({"n_days": "sum"}).first()[0] == 4000
    with pytest.raises(SystemExit, match="--output"):
        main(["report", "--store", lake.root, "--name", "timeline_chart"])
    assert sum(n for (n,) in rows(lake, "timeline_chart", "n_days", n=50)) == 50
    main(["report", "--store", lake.root, "--name", "global_trend", "--n", "150"])
    assert capsys.readouterr().out.count("2010-") == 150


def test_every_coordinate_name_is_found(spark):
    """Each name of the coordinate table, written as it is there, finds a point."""
    from caselake.fixed_values import PLACE_COORDINATES
    from caselake.functions import place_name_key
    from caselake.operators import places

    named = spark.createDataFrame([(n,) for n in [*PLACE_COORDINATES, "Ho Chi Minh City"]], "name string")
    found = places.lookup_places(named.withColumn("name_key", place_name_key(F.col("name"))),
                                 places.keyed_coordinates(spark), "name_key", "_n")
    assert found.count() == named.count()


def test_unknown_report_and_bad_limit(filled):
    with pytest.raises(ValueError):
        portal.run(filled, "nothing")
    with pytest.raises(ValueError):
        portal.run(filled, "top_countries", 101)


def test_reply_job(capsys, filled):
    main(["reply", "--store", filled.root, "--message", "tôi khó thở"])
    assert "115" in capsys.readouterr().out
    main(["report", "--store", filled.root, "--name", "top_countries", "--n", "2"])
    assert "Land BBB" in capsys.readouterr().out
