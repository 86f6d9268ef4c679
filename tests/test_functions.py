"""Edge cases of every column function on literal rows."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from caselake import functions as fn
from caselake.functions.ratios import mean_of_rates

NBSP = "\u00a0"


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_strip_takes_non_breaking_space(spark):
    assert apply(spark, fn.strip, [f"{NBSP} a b\t{NBSP}", "", None]) == ["a b", "", None]


def test_tolerant_date(spark):
    got = apply(spark, fn.tolerant_date, [
        "2021-03-05", " 2021-03-05 ", "25/03/2021", "n/a", "", None, "2021-13-01", "31/02/2021", "2021-3-5", "2021",
        "5/3/2021", "2021-03-05 00:00:00", "2021-03-05T10:00", "2021-03-05T10:00:01.5+07:00", "2021-03-05 noon", "5/3/21"])
    day = dt.date(2021, 3, 5)
    assert got == [day, day, dt.date(2021, 3, 25), None, None, None, None, None, day, None, day, day, day, day, None, None]


def test_strict_date_fails_the_run(spark):
    assert apply(spark, fn.strict_date, ["2021-03-05"]) == [dt.date(2021, 3, 5)]
    with pytest.raises(PySparkException):
        apply(spark, fn.strict_date, ["2021-03-05", "bad"])


def test_province_date(spark):
    got = apply(spark, fn.province_date, ["03-25-2021", "3-5-2021", "25-03-2021", "x", None])
    assert got == [dt.date(2021, 3, 25), dt.date(2021, 3, 5), None, None, None]


def test_timeline_date(spark):
    got = apply(spark, fn.timeline_date, ["2021-03-05", "March 2021", "2021-03-05[1]", " 2021-03-05", "2021-02-30"])
    assert got == [dt.date(2021, 3, 5), None, None, dt.date(2021, 3, 5), None]


def test_date_id_round_trip(spark):
    days = [dt.date(1999, 12, 31), dt.date(2024, 2, 29), None]
    assert apply(spark, fn.date_id, days, "date") == [19991231, 20240229, None]
    assert apply(spark, lambda c: fn.date_from_id(fn.date_id(c)), days, "date") == days


def test_date_attributes_use_the_iso_week(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 3),), (dt.date(2020, 12, 31),)], "d date")
    rows = df.select(*fn.date_attributes(F.col("d"))).orderBy("date_id").collect()
    assert [(r.date_id, r.year, r.month, r.week, r.quarter) for r in rows] == [
        (20201231, 2020, 12, 53, 4), (20210103, 2021, 1, 53, 1)]


def test_tolerant_numbers(spark):
    values = ["12", "12.0", "-3", "+4", " 5 ", ".5", "1e3", "12d", "inf", "NaN", "abc", "", None, "9007199254740993"]
    assert apply(spark, fn.tolerant_count, values) == [
        12, 12, -3, 4, 5, 0, 1000, None, None, None, None, None, None, 9007199254740993]
    assert apply(spark, fn.tolerant_number, ["1.5", "12d", "inf", None]) == [1.5, None, None, None]


def test_dotted_thousands(spark):
    got = apply(spark, fn.dotted_thousands, [
        "2.96", "10", "31.07", "1.234.567", "1.234.5", "5.0", "0.5", "", None, "  7 ", "12.3456", "x"])
    assert got == [2960, 10, 31070, 1234567, 1234500, 5000, 500, 0, 0, 7, 123456, None]


def test_clean_integer_text(spark):
    got = apply(spark, fn.clean_integer_text, [
        "1,803,950", f"580{NBSP}140", "12.9", "-12.9", "53%", "-", "—", "nan", " ", None, "n.a."])
    assert got == [1803950, 580140, 12, -12, 53, None, None, None, None, None, None]


def test_clean_decimal_text(spark):
    got = apply(spark, fn.clean_decimal_text, ["223.21", "1,005.125%", "-", None, "x", "-0.001", "-2.345"])
    assert got == [223.21, 1005.13, None, None, None, 0.0, -2.35]


def test_first_digit_run(spark):
    got = apply(spark, fn.first_digit_run, ["9.114[3]", "n.a.", "—", "", None, "about 1.234 (+5)", f"12{NBSP}345"])
    assert got == [9114, None, None, None, None, 1234, 12]


def test_clamp_keeps_null(spark):
    assert apply(spark, fn.clamp_negative, [-5, 0, 3, None], "bigint") == [0, 0, 3, None]


def test_percent(spark):
    df = spark.createDataFrame(
        [(1, 3), (1, 8), (-1, 8), (0, 5), (5, 0), (0, 0), (None, 5), (5, None), (201, 20000)], "a bigint, b bigint")
    got = [r[0] for r in df.select(fn.percent(F.col("a"), F.col("b"))).collect()]
    assert got == [33.33, 12.5, -12.5, 0.0, None, None, None, None, 1.01]  # 1.005 goes up


def test_percent_of_sums_beyond_bigint(spark):
    df = spark.createDataFrame([(2 * 10**18, 4 * 10**18), (5, 0)], "a bigint, b bigint")
    assert [r[0] for r in df.select(fn.percent_of_sums(F.col("a"), F.col("b"))).collect()] == [50.0, None]


def test_guarded_trend(spark):
    df = spark.createDataFrame([(150, 100), (50, 100), (5, 0), (None, 10), (5, None)], "r bigint, b bigint")
    assert [r[0] for r in df.select(fn.guarded_trend(F.col("r"), F.col("b"))).collect()] == [
        50.0, -50.0, None, None, None]


def test_fill_ratio(spark):
    df = spark.createDataFrame([(9.5, 1, 2), (None, 1, 2), (None, 0, 2), (None, 1, 0), (None, None, 2)],
                               "p double, a bigint, b bigint")
    got = [r[0] for r in df.select(fn.fill_ratio(F.col("p"), F.col("a"), F.col("b"))).collect()]
    assert got == [9.5, 50.0, None, None, None]


def test_mean_of_rates_ignores_nulls(spark):
    df = spark.createDataFrame([(1.01,), (1.02,), (None,)], "r double")
    assert df.agg(mean_of_rates(F.col("r"))).first()[0] == 1.02  # 1.015, half up
    assert df.filter("r is null").agg(mean_of_rates(F.col("r"))).first()[0] is None


def test_clean_place_name(spark):
    got = apply(spark, fn.clean_place_name, [
        f"Hà{NBSP} Nội [5][12]", "Cả nước (tổng)", "  x  ", "[1]", None, "a" * 300])
    assert got == ["Hà Nội", "Cả nước", "x", "", None, "a" * 300]


def test_drop_province_suffix(spark):
    assert apply(spark, fn.drop_province_suffix, ["Long An province", f"{NBSP}Hue ", None]) == ["Long An", "Hue", None]


def test_place_key(spark):
    import unicodedata

    names = ["Ho Chi Minh City", "Hồ Chí Minh", "HoChiMinhCity", "Thừa Thiên-Huế Province", "ĐẮK LẮK", "Bà Rịa–Vũng Tàu",
             unicodedata.normalize("NFD", "Đắk Nông"), f"Hà Nội{NBSP}City", None]
    assert apply(spark, fn.place_key, names) == [
        "hochiminh", "hochiminh", "hochiminh", "thuathienhue", "daklak", "bariavungtau", "daknong", "hanoi", None]
    assert apply(spark, fn.place_name_key, ["Bà Rịa-Vũng Tàu province", "Hà Nội"]) == ["ba ria-vung tau", "ha noi"]


def test_null_words(spark):
    assert apply(spark, fn.null_if_missing_word, ["NA", "nan", " ", "0", "Nam", None]) == [
        None, None, None, "0", "Nam", None]


def test_floor_div(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (8, 2), (2**60 + 1, 2)], "a bigint, b bigint")
    assert [r[0] for r in df.select(fn.floor_div(F.col("a"), F.col("b"))).collect()] == [3, -4, 4, 2**59]


def test_percent_and_rounding_against_decimals(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    pick = random.Random(11)
    pairs = [(pick.randrange(-10**pick.randrange(1, 12), 10**pick.randrange(1, 12)), pick.randrange(0, 10**pick.randrange(1, 10)))
             for _ in range(2000)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    cent = Decimal("0.01")
    for r in df.select("a", "b", fn.percent(F.col("a"), F.col("b")).alias("p"),
                       fn.percent_of_sums(F.col("a"), F.col("b")).alias("q")).collect():
        want = None if r.b == 0 else float((Decimal(r.a) * 100 / Decimal(r.b)).quantize(cent, ROUND_HALF_UP))
        assert r.p == r.q == want, r


def test_dotted_thousands_round_trip(spark):
    import random

    pick = random.Random(5)
    values = [pick.randrange(0, 10**pick.randrange(1, 7)) for _ in range(1000)]
    texts = []
    for v in values:
        whole, rest = divmod(v, 1000)
        texts.append(f"{whole}.{f'{rest:03d}'.rstrip('0') or '0'}" if whole else str(v))
    assert apply(spark, fn.dotted_thousands, texts) == values
