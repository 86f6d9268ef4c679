"""The four loads end to end: re-runs, restated rows, shared dimensions, failures."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from caselake.operators.audit import duplicate_keys, orphan_rows
from caselake.functions import place_name_key
from caselake.operators.keys import with_new_keys
from caselake.operators.places import keyed_coordinates, lookup_places
from caselake.operators.ranking import five_classes
from caselake.plans import global_daily, province, reports, timeline, vaccination
from caselake.schemas import REFERENCES, SCHEMAS, UNIQUE_KEYS
from caselake.sources import landing
from caselake.session import shared_dir
from caselake.sources.joblog import JobLog


def as_of():
    return F.lit("2024-01-01").cast("timestamp")


RAW = "id bigint, iso_code string, continent string, location string, date string, new_cases string, " \
      "new_deaths string, total_cases string, total_deaths string, people_vaccinated string, population string"


def delivery(spark, *rows):
    return landing.land_daily(spark.createDataFrame(list(rows), RAW), "test.csv", as_of())


def day(i, code, date, new, total, vaccinated="10"):
    return (i, code, "Asia", f"Land {code}", date, new, "1", total, "2", vaccinated, "200")


def test_global_load_twice_and_restated(spark, store):
    rows = [day(1, "AAA", "2021-01-01", "5", "5"), day(2, "AAA", "2021-01-02", "-3", "8"),
            day(3, "BBB", "2020-12-31", "4", "100", None), day(4, "OWID_WRL", "2021-01-02", "9", "9"),
            day(5, "AAA", "2021-01-02", "6", "11", None)]
    global_daily.extract(store, delivery(spark, *rows))
    first = global_daily.transform_load(store, as_of()).orderBy("country_name").collect()
    assert [(r.country_name, r.latest_total_cases, r.latest_vaccination_rate) for r in first] == [
        ("Land AAA", 11, 5), ("Land BBB", 100, None)]
    ids = {r.iso_code: r.country_id for r in store.read("dim_country").collect()}

    assert global_daily.transform_load(store, as_of()).count() == 2  # a re-run changes nothing
    assert store.read("fact_global_daily").count() == 3

    global_daily.extract(store, delivery(
        spark, day(1, "AAA", "2021-01-02", "1", "20"), day(2, "CCC", "2021-01-03", "1", "1")))
    global_daily.transform_load(store, as_of())
    kept = {r.iso_code: r.country_id for r in store.read("dim_country").collect()}
    assert {c: kept[c] for c in ids} == ids and kept["CCC"] == 3  # keys are stable
    fact = {(r.country_id, r.date_id): r.total_cases for r in store.read("fact_global_daily").collect()}
    assert fact == {(ids["AAA"], 20210101): 5, (ids["AAA"], 20210102): 20, (ids["BBB"], 20201231): 100, (3, 20210103): 1}
    top = reports.top_countries(store.read("agg_country_summary"), 1).first()
    assert (top.country_name, top.latest_total_cases) == ("Land BBB", 100)
    daily = store.read("agg_daily_global")
    before = sorted(map(str, daily.collect()))
    global_daily.refresh_serving(store, as_of())
    assert sorted(map(str, store.read("agg_daily_global").collect())) == before
    assert global_daily.accounting(store).first().landed_rows == 2
    for row in daily.collect():
        assert row.total_new_cases >= 0


def test_failed_load_is_logged(spark, store):
    global_daily.extract(store, delivery(spark, day(1, "OWID_WRL", "2021-01-01", "5", "5")))
    with pytest.raises(ValueError, match="no valid row"):
        global_daily.transform_load(store, as_of())
    with pytest.raises(ValueError):
        timeline.load(store, spark.createDataFrame([("s", "Month 1", "1", "1")], "series string, date_text string, "
                      "total_cases_text string, total_deaths_text string"), "u", as_of())
    log = reports.job_history(JobLog(spark, store.root).read())
    assert [(r.job_name, r.status) for r in log.collect()] == [
        ("load_timeline", "failed"), ("load_global_daily", "failed"), ("extract_global_daily", "success")]


def test_provinces_shared_by_two_loads(spark, store):
    daily = spark.createDataFrame(
        [("Long An", "1", "2.96", "3", "01-25-2021"), ("Long An", "2", "2.98", "3", "01-26-2021"),
         ("Hà Nội", "5", "7", "0", "01-25-2021"), (None, "5", "7", "0", "01-25-2021"), ("Huế", "5", "7", "0", "bad")],
        "province_name string, new_cases string, total_cases string, total_deaths string, date_raw string")
    summary = province.load(store, daily, as_of())
    assert {r.province_name: r.latest_total_cases for r in summary.collect()} == {"Long An": 2980, "Hà Nội": 7}
    ids = {r.province_name: r.province_id for r in store.read("dim_province").collect()}

    text = spark.createDataFrame(
        [("Long An province", "1,000", "900", "500", None), ("Cần Thơ", "2,000", "-", "100", "5.00"),
         ("Total", "—", "1", "1", "1")],
        "province_name string, population string, doses_distributed string, doses_administered string, "
        "doses_per_100 string")
    loaded = vaccination.load(store, text, dt.date(2021, 2, 1), "https://example.org", as_of()).collect()
    assert {r.province_name: float(r.doses_per_100) for r in loaded} == {"Long An": 50.0, "Cần Thơ": 5.0}
    dim = {r.province_name: (r.province_id, r.population) for r in store.read("dim_province").collect()}
    assert dim["Long An"] == (ids["Long An"], 1000) and dim["Hà Nội"][0] == ids["Hà Nội"] and dim["Cần Thơ"][0] == 3
    vaccination.load(store, text, dt.date(2021, 2, 1), "https://example.org", as_of())
    province.load(store, daily, as_of())
    again = {r.province_name: (r.province_id, r.population) for r in store.read("dim_province").collect()}
    assert again == dim  # no duplicates, populations kept
    assert {r.date_id for r in store.read("dim_date").collect()} == {20210125, 20210126, 20210201}
    for table, names in UNIQUE_KEYS.items():
        assert duplicate_keys(store.read(table), names).isEmpty(), table
    for table, key, dimension in REFERENCES:
        assert orphan_rows(store.read(table), store.read(dimension), key).isEmpty(), (table, key)


def test_daily_deaths_of_provinces(spark):
    text = spark.createDataFrame(
        [("A", "1", "5", d, f"01-{i:02d}-2021") for i, d in enumerate(["3", "7", "6", "9"], 1)],
        "province_name string, new_cases string, total_cases string, total_deaths string, date_raw string")
    names = spark.createDataFrame([("A", 1)], "province_name string, province_id int")
    rows = province.clean_province(text)
    fact = province.province_fact(rows, names)
    assert "new_deaths" not in fact.columns
    derived = province.with_daily_deaths(fact, fact.withColumn("new_deaths", F.lit(0).cast("bigint")).filter("false"))
    assert [r.new_deaths for r in derived.orderBy("date_id").collect()] == [0, 4, 0, 3]


def test_province_deliveries_one_after_the_other(spark, store):
    """Daily deaths count from the stored day before a delivery, change after a restated day, and a plain
    delivery leaves them and the measures it does not have alone."""
    def delivery(*rows):
        return spark.createDataFrame([("A", "1", str(5 + int(d)), d, f"01-{i:02d}-2021") for i, d in rows],
                                     "province_name string, new_cases string, total_cases string, total_deaths string, date_raw string")

    def deaths():
        return [r.new_deaths for r in store.read(province.FACT).orderBy("date_id").collect()]

    province.load(store, delivery((1, "3"), (2, "7")), as_of(), derive_deaths=True)
    assert deaths() == [0, 4]
    province.load(store, delivery((3, "9")), as_of(), derive_deaths=True)
    assert deaths() == [0, 4, 2]
    province.load(store, delivery((2, "5")), as_of(), derive_deaths=True)
    assert deaths() == [0, 2, 4]
    province.load(store, delivery((2, "5"), (4, "9")), as_of())
    assert deaths() == [0, 2, 4, 0]
    row = store.read(province.FACT).filter("date_id = 20210104").first()
    assert (row.recovered, row.active_cases, row.total_deaths) == (0, 0, 9)


def test_last_row_of_a_day_counts_where_the_order_is_known(spark):
    text = spark.createDataFrame([(1, "A", "1", "9", "0", "01-01-2021"), (2, "A", "1", "5", "0", "01-01-2021")],
                                 "id long, province_name string, new_cases string, total_cases string, total_deaths string, date_raw string")
    assert province.clean_province(text).first().total_cases == 5
    assert province.clean_province(text.drop("id")).first().total_cases == 9


def test_dimension_step_reads_stored_attributes_and_leaves_no_scratch(spark, store, tmp_path):
    rows = [day(1, "AAA", "2021-01-01", "5", "5"), day(2, "BBB", "2021-01-02", "3", "8")]
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    for _ in range(2):
        global_daily.extract(store, delivery(spark, *rows))
        global_daily.transform_load(store, as_of())
    left = set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before
    assert not [n for n in left if "-run-" in n]
    incoming = spark.range(1).selectExpr("'CCC' as iso_code", "'x' as country_name", "'y' as continent", "1L as population")
    text = with_new_keys(store.read("dim_country"), incoming, "iso_code", "country_id")._jdf.queryExecution().toString()
    assert "Range (0, 1" not in text and "caselake-keys" in text  # the delivery itself is not read again


def test_timeline_with_province_list(spark, store):
    text = spark.createDataFrame(
        [("vn", "2021-01-01", "100", "1"), ("vn", "2021-01-02", "1.150[2]", "3"), ("vn", "Month 2", "", "")],
        "series string, date_text string, total_cases_text string, total_deaths_text string")
    listed = spark.createDataFrame(
        [("Hà Nội[1]", "1.000", "10", "n.a."), ("Cả nước (x)", "9.999", "99", "9"), ("", "1", "1", "1")],
        "province_name string, total_cases string, total_deaths string, new_cases string")
    fact = timeline.load(store, text, "https://example.org", as_of(), listed)
    assert {(r.date_id, r.new_cases, r.new_deaths) for r in fact.collect()} == {(20210101, 0, 0), (20210102, 1050, 2)}
    top = reports.province_cases_top(store.read("agg_province_cases")).collect()
    assert [(r.province_name, r.total_cases, r.cfr) for r in top] == [("Hà Nội", 1000, 1.0)]
    daily = fact.join(store.read("dim_date").select("date_id", "full_date"), "date_id")
    row = reports.latest_timeline_row(daily, store.read("agg_province_cases")).first()
    assert (row.latest_date, row.cfr, row.province_count) == (dt.date(2021, 1, 2), 0.26, 1)


def test_every_table_of_the_model_is_declared():
    assert len(SCHEMAS) == 19


def test_golden_values_worked_out_by_hand(spark, store):
    """Five localities: 1,000 + 2,000 + 4,000 + 500 + 2,500 = 10,000 people, 18,150 doses given."""
    rows = spark.createDataFrame(
        [("Long An province", "1,000", "2,600", "2,500", "250.00"), ("Hà Nội", "2,000", "4,500", "4,000", None),
         ("Ho Chi Minh City", "4,000", "9,000", "8,000", "200.00%"), ("Huế", "500", "-", "650", "130.00"),
         ("Cần Thơ", f"2,500{chr(160)}", "3,100", "3,000", None), ("Total", "—", "1", "1", "1")],
        "province_name string, population string, doses_distributed string, doses_administered string, doses_per_100 string")
    summary = vaccination.load(store, rows, dt.date(2022, 1, 31), "https://example.org", as_of())
    kpi = reports.vaccination_kpis(summary).first()
    assert (kpi.province_count, kpi.population, kpi.doses_distributed, kpi.doses_administered) == (5, 10000, 19200, 18150)
    # weighted 18,150 / 10,000; unweighted (250 + 200 + 200 + 130 + 120) / 5
    assert (kpi.doses_per_100, kpi.avg_doses_per_100) == (181.5, 180.0)
    assert [r.province_name for r in reports.top_provinces(summary, 3).collect()] == ["Ho Chi Minh City", "Hà Nội", "Cần Thơ"]
    assert [float(r.doses_per_100) for r in reports.top_by_rate(summary).collect()] == [250.0, 200.0, 200.0, 130.0, 120.0]
    # shares of 250: 1, .8, .8, .52, .48 against the cuts .82, .64, .46, .28
    counts = {r.class_no: r["count"] for r in five_classes(summary, "doses_per_100").groupBy("class_no").count().collect()}
    assert counts == {1: 1, 2: 2, 3: 2}
    keyed = summary.withColumn("name_key", place_name_key(F.col("province_name")))
    found = {r.province_name for r in lookup_places(keyed, keyed_coordinates(spark), "name_key", "_n").collect()}
    assert {"Long An", "Ho Chi Minh City"} <= found


def test_refresh_of_touched_months_equals_the_rebuild(spark, store):
    for rows in ([day(i, "AAA", f"2021-0{1 + i % 3}-0{1 + i % 9}", str(i), str(i)) for i in range(1, 28)],
                 [day(1, "AAA", "2021-02-03", "70", "9"), day(2, "BBB", "2021-04-01", "5", "5")]):
        global_daily.extract(store, delivery(spark, *rows))
        global_daily.transform_load(store, as_of())
    tables = ("agg_daily_global", "agg_country_summary")
    got = [sorted(map(str, store.read(t).collect())) for t in tables]
    global_daily.refresh_serving(store, as_of())
    assert got == [sorted(map(str, store.read(t).collect())) for t in tables]


def _spied(store, monkeypatch, name):
    """The parts of a table that are opened, as lists; None is the whole table."""
    opened, read = [], type(store).read
    monkeypatch.setattr(type(store), "read", lambda self, table, parts=None: (
        opened.append(parts) if table == name else None, read(self, table, parts))[1])
    return opened


def test_states_equal_the_rebuild_over_random_deliveries(spark, store, monkeypatch):
    """Each delivery touches a few days of some months, old ones too; the summary from the states is the
    one of the whole fact, and of the fact only touched months are opened."""
    import random

    draw = random.Random(11)
    for n in range(5):
        months = draw.sample(["2020-11", "2020-12", "2021-01", "2021-02", "2021-03"], 2)
        rows = [day(i, draw.choice(["AAA", "BBB", "CCC"]), f"{draw.choice(months)}-{draw.randint(1, 28):02d}", draw.choice(["", "5", "70", "3"]),
                    str(draw.randint(1, 99)), draw.choice(["10", "20", None])) for i in range(40)]
        global_daily.extract(store, delivery(spark, *rows))
        opened = _spied(store, monkeypatch, global_daily.FACT)
        global_daily.transform_load(store, as_of())
        monkeypatch.undo()
        wanted = {int(m.replace("-", "")) for m in months}
        assert n == 0 or (opened and all(parts is not None and set(parts) <= wanted for parts in opened))
        got = sorted(map(str, store.read("agg_country_summary").collect()))
        from caselake.plans import serving
        whole = serving.country_summary(store.read(global_daily.FACT), store.read("dim_country"), as_of())
        assert got == sorted(map(str, whole.select(*store.read("agg_country_summary").columns).withColumn(
            "trend_7d_cases", F.col("trend_7d_cases").cast("decimal(18,2)")).collect()))


def test_province_states_equal_the_rebuild(spark, store, monkeypatch):
    """Deaths per day over deliveries in any order equal those of one delivery; only touched months are opened."""
    import random

    from caselake.plans import serving
    from caselake.sources.store import TableStore

    draw, deaths = random.Random(5), 0
    days = [dt.date(2021, 1, 20) + dt.timedelta(days=3 * i) for i in range(25)]
    rows = []
    for name in ("A", "B"):
        for d in days:
            deaths += draw.randint(0, 4)
            rows.append((name, "1", str(deaths), str(deaths), d.strftime("%m-%d-%Y")))
    kind = "province_name string, new_cases string, total_cases string, total_deaths string, date_raw string"
    parts = [rows[i::7] for i in (3, 0, 6, 1, 5, 2, 4)]
    for n, part in enumerate([*parts, rows[4:6]]):
        opened = _spied(store, monkeypatch, province.FACT)
        province.load(store, spark.createDataFrame(part, kind), as_of(), derive_deaths=True)
        monkeypatch.undo()
        assert n == 0 or all(parts is not None for parts in opened)
    once = TableStore(spark, store.root + "-once")
    province.load(once, spark.createDataFrame(rows, kind), as_of(), derive_deaths=True)
    for table in (province.FACT, "agg_province_summary", "agg_daily_province", province.STATE):
        assert sorted(map(str, store.read(table).collect())) == sorted(map(str, once.read(table).collect())), table
    summary = serving.province_summary(store.read(province.FACT), store.read("dim_province"), as_of())
    assert sorted(map(str, summary.select(*store.read("agg_province_summary").columns).collect())) == sorted(
        map(str, store.read("agg_province_summary").collect()))


def test_accounting_comes_from_the_writing_tasks(spark, store):
    rows = [day(1, "AAA", "2021-01-01", "5", "5"), day(2, "AAA", "2021-01-01", "6", "5"), day(3, "OWID_X", "2021-01-01", "1", "1"),
            day(4, "iso_code", "date", "1", "1"), day(5, "BBB", "31-31-2021", "1", "1"), day(6, None, "2021-01-01", "1", "1"),
            day(7, "BBB", "soon", "1", "1"), day(8, "BBB", "2021-01-02", "1", "1")]
    global_daily.extract(store, delivery(spark, *rows))
    counted = global_daily.accounting(store).first()  # nothing is loaded yet: counted anew
    global_daily.transform_load(store, as_of())
    assert global_daily.accounting(store).first() == counted
    assert counted.asDict() == {"landed_rows": 8, "aggregate_rows": 2, "header_rows": 1, "bad_date_rows": 2, "duplicate_rows": 1,
                                "kept_rows": 2, "left_out_rows": 0}
    plan = global_daily.accounting(store)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Exchange" not in plan
    assert set(global_daily.bad_dates(store)) <= {"5 BBB 31-31-2021", "7 BBB soon"} and global_daily.bad_dates(store)
    global_daily.extract(store, delivery(spark, *[day(i, "AAA", f"2021-01-{i:02d}", "1", "1") for i in range(1, 11)]), days=3)
    global_daily.transform_load(store, as_of())
    row = global_daily.accounting(store).first()
    assert (row.landed_rows, row.left_out_rows, row.kept_rows) == (4, 6, 4)


def test_a_load_against_the_constraints_is_refused(spark, store, monkeypatch):
    from caselake.plans import serving

    global_daily.extract(store, delivery(spark, day(1, "AAA", "2021-01-01", "5", "5")))
    global_daily.transform_load(store, as_of())
    before = {t: store.folders(t) for t in (global_daily.FACT, "dim_country")}
    made = serving.global_fact
    for change, message in ((lambda f: f.unionByName(f), "share the key"),
                            (lambda f: f.withColumn("country_id", F.lit(77)), "77 is not in dim_country"),
                            (lambda f: f.withColumn("date_id", F.lit(20300101)), "not in dim_date")):
        monkeypatch.setattr(serving, "global_fact", lambda clean, countries: change(made(clean, countries)))
        with pytest.raises(ValueError, match=message):
            global_daily.transform_load(store, as_of())
        monkeypatch.undo()
        assert store.folders(global_daily.FACT) == before[global_daily.FACT]
    assert {r.status for r in JobLog(spark, store.root).read().collect()} == {"success", "failed"}


def test_deliveries_are_landed_once(spark, store, tmp_path):
    lines = "iso_code,continent,location,date,new_cases,new_deaths,total_cases,total_deaths,people_vaccinated,population\n"
    (tmp_path / "a.csv").write_text(lines + "AAA,Asia,A,2021-01-01,1,1,1,1,1,9\n")
    (tmp_path / "b.csv").write_text(lines + "AAA,Asia,A,2021-01-02,2,1,1,1,1,9\n")
    assert global_daily.extract_files(store, [str(tmp_path)]) == ["a.csv", "b.csv"]
    assert global_daily.extract_files(store, [str(tmp_path)]) == []
    (tmp_path / "a.csv").write_text(lines + "AAA,Asia,A,2021-01-01,70,1,1,1,1,9\nBBB,Asia,B,2021-01-01,3,1,1,1,1,9\n")
    (tmp_path / "0.csv").write_text(lines + "CCC,Asia,C,2021-01-01,4,1,1,1,1,9\n")
    assert global_daily.extract_files(store, [str(tmp_path)]) == ["0.csv", "a.csv"]
    landed = store.read("raw_daily")
    assert sorted((r.iso_code, r.new_cases, r.source_file) for r in landed.collect()) == [
        ("AAA", "1", "a.csv"), ("AAA", "2", "b.csv"), ("AAA", "70", "a.csv"), ("BBB", "3", "a.csv"), ("CCC", "4", "0.csv")]
    global_daily.transform_load(store, as_of())
    fact = {(r.date_id, r.new_cases) for r in store.read(global_daily.FACT).collect()}
    assert {(20210101, 70), (20210102, 2), (20210101, 3), (20210101, 4)} == fact  # the file sent again wins
    (tmp_path / "c.csv").write_text(lines)
    with pytest.raises(ValueError, match="no row"):
        global_daily.extract_files(store, [str(tmp_path)])
    assert store.read("raw_daily").count() == 5


def test_vaccination_load_writes_its_snapshot(spark, store, tmp_path):
    rows = spark.createDataFrame([("Long An province", "1,000", "2,600", "2,500", "250.00")],
                                 "province_name string, population string, doses_distributed string, doses_administered string, doses_per_100 string")
    vaccination.load(store, rows, dt.date(2022, 1, 31), "https://example.org", as_of(), str(tmp_path / "snapshot"))
    [file] = [p for p in (tmp_path / "snapshot").iterdir() if p.suffix == ".csv"]
    assert file.read_text("utf-8-sig").splitlines()[1] == "Long An,1000,2600,2500,250.0,https://example.org,2022-01-31"


def test_columns_that_changed_their_type_stay_readable(spark, tmp_path):
    from caselake.sources.store import TableStore

    for kind in ("k int, v int", "k int, v bigint, w string", "k int, v string, w string"):
        schema = spark.createDataFrame([], kind).schema
        store = TableStore(spark, str(tmp_path / "t"), {"t": schema}, {"t": {"w": "none"}})
        store.append("t", spark.createDataFrame([(1, "9", "x")], "k int, v string, w string").selectExpr(
            *[f"cast({c} as {k}) as {c}" for c, k in spark.createDataFrame([], kind).dtypes]))
    assert sorted(tuple(r) for r in store.read("t").collect()) == [(1, "9", "none"), (1, "9", "x"), (1, "9", "x")]
