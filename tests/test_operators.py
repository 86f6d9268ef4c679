"""Operators against brute force, with one key holding a third of all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caselake.operators import audit, clean, keys, latest, merge, places, ranking, routing, series
from caselake.plans import reports, serving

DAY0 = dt.date(2021, 1, 1)


def hot_rows(n=3000, seed=3):
    """(id, code, day, value): code 'HOT' has over a third of the rows, many copies per day."""
    pick = random.Random(seed)
    return [
        (i, "HOT" if pick.random() < 0.4 else f"C{pick.randrange(40)}",
         DAY0 + dt.timedelta(days=pick.randrange(60)), pick.choice([None, *range(50)]))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def rows():
    return hot_rows()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, code string, day date, value bigint").repartition(6)


def test_keep_last(frame, rows):
    want = {}
    for i, code, day, value in sorted(rows):
        want[code, day] = (i, value)
    got = clean.keep_last(frame, ["code", "day"], [F.col("id").desc()]).collect()
    assert {(r.code, r.day): (r.id, r.value) for r in got} == want and len(got) == len(want)


def test_latest_row_and_latest_known_value(frame, rows):
    unique = clean.keep_last(frame, ["code", "day"], [F.col("id").desc()]).persist()
    table = {}
    for i, code, day, value in sorted(rows):
        table[code, day] = value
    newest, known = {}, {}
    for (code, day), value in sorted(table.items(), key=lambda e: e[0][1]):
        newest[code] = (day, value)
        if value is not None:
            known[code] = (day, value)
    got = latest.latest_row_per_key(unique, "code", "day", ["value"]).collect()
    assert {r.code: (r.day, r.value) for r in got} == newest
    got = latest.latest_known_value(unique, "code", "day", "value").collect()
    assert {r.code: (r.day, r.value) for r in got} == known
    assert newest != known  # the two meanings of "latest" differ on this data
    got = latest.last_non_null(unique, "code", "day", ["value"]).collect()
    assert {r.code: r.value for r in got} == {c: known.get(c, (None, None))[1] for c in newest}
    unique.unpersist()


def test_last_non_null_per_column(spark):
    df = spark.createDataFrame(
        [("A", DAY0, "old", 1), ("A", DAY0 + dt.timedelta(1), None, 2), ("B", DAY0, None, None)],
        "k string, day date, name string, n int")
    got = {r.k: (r.name, r.n) for r in latest.last_non_null(df, "k", "day", ["name", "n"]).collect()}
    assert got == {"A": ("old", 2), "B": (None, None)}


def test_number_keys_dense_stable_and_offset(spark):
    names = spark.createDataFrame([(f"key {i}",) for i in range(700)], "name string")
    first = {r.name: r.key_id for r in keys.number_keys(names, "name", "key_id").collect()}
    assert sorted(first.values()) == list(range(1, 701))
    again = {r.name: r.key_id for r in keys.number_keys(names.repartition(5), "name", "key_id").collect()}
    assert again == first


def test_with_new_keys(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (5, "c", "z")], "id int, name string, v string")
    new = spark.createDataFrame([("b", "Y"), ("d", "w"), ("e", "u")], "name string, v string")
    got = {r.name: (r.id, r.v) for r in keys.with_new_keys(old, new, "name", "id").collect()}
    assert got["a"] == (1, "x") and got["b"] == (2, "Y") and got["c"] == (5, "z")
    assert {got["d"][0], got["e"][0]} == {6, 7}
    empty = old.filter("false")
    assert {r.id for r in keys.with_new_keys(empty, new, "name", "id").collect()} == {1, 2, 3}


def test_upsert_is_idempotent_and_whole(spark, frame):
    base = clean.keep_last(frame, ["code", "day"], [F.col("id").asc()]).select("code", "day", "value").persist()
    delta = base.sample(0.3, seed=1).withColumn("value", F.lit(99).cast("bigint")).persist()
    once = merge.upsert(base, delta, ["code", "day"])
    twice = merge.upsert(once, delta, ["code", "day"])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.count() == base.count() and once.filter("value = 99").count() == delta.count()
    assert audit.duplicate_keys(once, ["code", "day"]).isEmpty()


def test_upsert_columns(spark):
    target = spark.createDataFrame([(1, 10, 7), (2, 20, 8)], "k int, a bigint, b bigint")
    source = spark.createDataFrame([(2, None), (3, 30)], "k int, a bigint")
    got = {r.k: (r.a, r.b) for r in merge.upsert_columns(target, source, ["k"], ["a"], {"b": 0}).collect()}
    assert got == {1: (10, 7), 2: (None, 8), 3: (30, 0)}


def test_insert_if_absent_first_writer_wins(spark):
    target = spark.createDataFrame([(1, "kept")], "k int, v string")
    source = spark.createDataFrame([(1, "late", 1), (2, "second", 2), (2, "first", 1)], "k int, v string, at int")
    got = merge.insert_if_absent(target, source, ["k"], [F.col("at").asc()])
    assert {r.k: r.v for r in got.collect()} == {1: "kept", 2: "first"}


def test_evolve_adds_columns_and_widens(spark):
    old = spark.createDataFrame([(1, 5)], "k int, n int")
    new = spark.createDataFrame([(2, 6, 7)], "k int, n bigint, extra bigint")
    df = merge.evolve(old, new, {"extra": 0})
    assert dict(df.dtypes)["n"] == "bigint"
    assert {tuple(r) for r in df.collect()} == {(1, 5, 0), (2, 6, 7)}


def test_rolling_sums_edges(spark):
    newest = DAY0 + dt.timedelta(days=30)
    df = spark.createDataFrame([("A", newest - dt.timedelta(days=d), 10**d if d < 15 else 5) for d in range(16)],
                               "k string, day date, n bigint")
    row = series.rolling_sums(df, "k", "day", "n", F.lit(newest)).first()
    assert row.cases_last7 == 1111111 and row.cases_prev7 == 11111110000000


def test_cumulative_to_daily(spark, frame):
    df = spark.createDataFrame(
        [("s", DAY0 + dt.timedelta(days=d), t) for d, t in [(0, 5), (1, 9), (2, 7), (2, 8), (4, 20)]],
        "s string, day date, total bigint")
    got = series.cumulative_to_daily(df, ["s"], "day", {"total": "new"}).orderBy("day").collect()
    assert [(r.total, r.new) for r in got] == [(5, 0), (9, 4), (8, 0), (20, 12)]
    steady = df.withColumn("total", F.datediff("day", F.lit(DAY0)).cast("bigint") * 10)
    total = series.cumulative_to_daily(steady, ["s"], "day", {"total": "new"}).agg(F.sum("new")).first()[0]
    assert total == 40  # last minus first


def test_chunks(spark):
    df = spark.createDataFrame(
        [("s", DAY0 + dt.timedelta(days=2 * d), v, d) for d, v in enumerate([1, 2, None, 4, 1])],
        "s string, day date, v bigint, total int")
    got = series.chunk_downsample(df, ["s"], "day", 2, {"v": "m"}, {"total": "last"}).orderBy("chunk_no").collect()
    assert [(r.m, r.last, r.n_days) for r in got] == [(2, 1, 2), (2, 3, 2), (1, 4, 1)]
    assert got[0].label == "2021-01-01 - 2021-01-03" and got[2].label == "2021-01-09"
    assert [series.downsample_step(d) for d in (30, 45, 46, 120, 121, 2000)] == [1, 1, 7, 7, 30, 30]


def test_newest_rows_come_back_ascending(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "day int")
    assert [r.day for r in series.newest_rows(df, "day", 3).collect()] == [7, 8, 9]


def test_top_n_versus_rest(spark):
    df = spark.createDataFrame([(f"n{i:02d}", v) for i, v in enumerate([5, 9, None, 1, 1, 1, 8, 3])], "n string, v bigint")
    got = {r.part: r.value for r in ranking.top_n_versus_rest(df, "v", "n").collect()}
    assert got == {"top": 26, "rest": 2}
    negative = df.withColumn("v", F.when(F.col("v") == 3, -50).otherwise(F.col("v")).cast("bigint"))
    assert {r.part: r.value for r in ranking.top_n_versus_rest(negative, "v", "n").collect()}["rest"] == 0


def test_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", None), ("d", 9)], "n string, v int")
    got = [(r.n, r["rank"]) for r in ranking.rank_top(df, F.col("v"), "n", 3).orderBy("rank").collect()]
    assert got == [("d", 1), ("a", 2), ("b", 3)]


def test_five_classes(spark):
    df = spark.createDataFrame([(0.0,), (None,), (100.0,), (82.0,), (64.0,), (46.0,), (28.0,), (27.9,)], "v double")
    got = {r.v: r.class_no for r in ranking.five_classes(df, "v").collect()}
    assert got == {0.0: 5, None: 5, 100.0: 1, 82.0: 1, 64.0: 2, 46.0: 3, 28.0: 4, 27.9: 5}
    small = spark.createDataFrame([(0.5,), (0.0,)], "v double")
    assert {r.v: r.ratio for r in ranking.five_classes(small, "v").collect()} == {0.5: 0.5, 0.0: 0.0}


def test_share_of_max(spark):
    df = spark.createDataFrame([(4,), (None,), (2,)], "v bigint")
    assert sorted(r.share for r in ranking.share_of_max(df, "v").collect()) == [0.0, 0.5, 1.0]
    assert ranking.share_of_max(df.filter("v is null"), "v").first().share == 0.0


def test_vertex_centre_and_nested_polygons(spark):
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]]
    point = [[(9.0, 9.0)]]
    other = [[(10.0, 10.0), (12.0, 10.0), (12.0, 12.0), (10.0, 12.0)], [(11.0, 11.0)]]
    kind = "id int, polygons array<array<array<struct<lon: double, lat: double>>>>"
    df = spark.createDataFrame([(1, [point, square, other])], kind)
    row = places.vertex_centre(places.polygon_vertices(df, "id"), "id").first()
    assert (row.ring_id, row.n_vertices, row.lon, row.lat) == (1, 4, 1.0, 1.0)  # first of the longest, no holes


def test_place_lookup(spark):
    known = places.coordinates(spark).withColumn("n", F.lit(1))
    assert known.count() == 63
    rows = spark.createDataFrame([("ha noi",), ("nowhere",)], "name_key string")
    got = places.lookup_places(rows, known, "name_key", "n").collect()
    assert [(r.name_key, r.lon) for r in got] == [("ha noi", 105.85)]
    twice = spark.createDataFrame([("ha noi", 1), ("ha noi", 2)], "name_key string, at int")
    assert places.lookup_places(rows, twice.withColumn("v", F.col("at")), "name_key", "at", "left").collect()[0] is not None


def test_routing(spark):
    texts = ["Tôi bị KHÓ THỞ và sốt", "có triệu chứng gì", "phòng bệnh và test", "Xét nghiệm ở đâu", "dương tính rồi",
             "xin chào", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    routed = routing.route_messages(df)
    assert [r.label for r in routed.orderBy("i").collect()] == [
        "emergency", "symptoms", "prevention", "testing", "isolation", "default", "default"]
    assert all(r.reply for r in routed.collect())
    assert {r.label: r.n_messages for r in routing.route_counts(routed).collect()}["default"] == 2


def test_audits(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "k int, c string")
    assert [tuple(r) for r in audit.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    dim = spark.createDataFrame([("a",)], "c string")
    assert [r.k for r in audit.orphan_rows(df, dim, "c").collect()] == [2]


def test_quality_counts_against_brute_force(spark):
    raw = [(1, "VNM", "2021-01-01"), (2, "VNM", "01/01/2021"), (3, " VNM ", "2021-01-01"), (4, "iso_code", "date"),
           (5, "OWID_WRL", "2021-01-01"), (6, None, "2021-01-01"), (7, "USA", "n/a"), (8, "USA", None)]
    df = spark.createDataFrame(raw, "id bigint, iso_code string, date_raw string")
    row = clean.quality_counts(df).first().asDict()
    assert row == {"landed_rows": 8, "aggregate_rows": 2, "header_rows": 1, "bad_date_rows": 2, "duplicate_rows": 2,
                   "kept_rows": 1}
    assert [r.id for r in clean.bad_date_samples(df, 1).collect()] == [7]


def test_summary_in_one_pass_equals_summary_of_the_fact(spark, sf_dir):
    from caselake.checks import fixtures as fx
    from caselake.session import materialize

    rows = materialize(clean.clean_daily(fx.raw_daily(spark, sf_dir)), "rows")
    countries = materialize(
        keys.number_keys(serving.country_attributes(rows), "iso_code", "country_id"), "countries")
    fact = materialize(serving.global_fact(rows, countries), "fact")
    columns = ["country_name", "latest_total_cases", "latest_total_deaths", "latest_vaccination_rate", "trend_7d_cases"]
    one = serving.country_summary_from_clean(rows, rows.agg(F.max("full_date")).scalar()).select(*columns)
    two = serving.country_summary(fact, countries, F.current_timestamp()).select(*columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_renamed_country_keeps_one_row_with_the_last_name(spark):
    rows = spark.createDataFrame([
        ("CZE", "Czech Republic", DAY0, 5, 50, 1, 40.0), ("CZE", "Czechia", DAY0 + dt.timedelta(1), 7, 57, 2, None)],
        "iso_code string, location string, full_date date, new_cases bigint, total_cases bigint, total_deaths bigint, "
        "vaccination_rate double")
    got = serving.country_summary_from_clean(rows, F.lit(DAY0 + dt.timedelta(1))).collect()
    assert [(r.country_name, r.latest_total_cases, r.latest_vaccination_rate) for r in got] == [("Czechia", 57, 40.0)]


@pytest.mark.parametrize("report,limits", list(reports.LIMITS.items()))
def test_report_limits(report, limits):
    default, low, high = limits
    assert reports.checked(report, None) == default
    assert reports.checked(report, low) == low and reports.checked(report, high) == high
    for bad in (low - 1, high + 1, "5", True):
        with pytest.raises(ValueError):
            reports.checked(report, bad)
