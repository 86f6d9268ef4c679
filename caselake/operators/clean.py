"""Cleaning of the landed daily rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import AGGREGATE_PREFIX, DAILY_MEASURES, HEADER_ECHO
from ..functions import clamp_negative, percent, strip, tolerant_count, tolerant_date


def is_aggregate_code(code: Column) -> Column:
    """No code, a code of a continent or the world: not a country row."""
    return code.isNull() | code.startswith(AGGREGATE_PREFIX)


def drop_aggregate_rows(raw: DataFrame) -> DataFrame:
    """Country rows only, code trimmed; header lines that were landed as data go too."""
    code = strip(F.col("iso_code"))
    trimmed = raw.withColumn("iso_code", code)
    return trimmed.filter(~is_aggregate_code(F.col("iso_code")) & (F.col("iso_code") != HEADER_ECHO))


def typed_daily(raw: DataFrame) -> DataFrame:
    """Country rows with a valid date, text turned into date and whole numbers. Narrow:
    one pass, no shuffle, duplicates still in."""
    typed = drop_aggregate_rows(raw).select(
        "id", "iso_code", "continent", "location",
        tolerant_date(F.col("date_raw")).alias("full_date"),
        *[tolerant_count(F.col(m)).alias(m) for m in DAILY_MEASURES],
    )
    return typed.filter(F.col("full_date").isNotNull())


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key in ``order``. The rank filter is applied before the shuffle as
    well (each task sends one row per key), so a key with a third of all rows is harmless."""
    newest_first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(newest_first)).filter(F.col("_rn") == 1).drop("_rn")


def deduplicate(typed: DataFrame) -> DataFrame:
    """One row per (code, date): the one landed last (highest id)."""
    return keep_last(typed, ["iso_code", "full_date"], [F.col("id").desc()])


def with_measures(clean: DataFrame) -> DataFrame:
    """Derived rates, then negative daily counts set to zero."""
    return clean.withColumns({
        "vaccination_rate": percent(F.col("people_vaccinated"), F.col("population")),
        "case_fatality_rate": percent(F.col("total_deaths"), F.col("total_cases")),
        "new_cases": clamp_negative(F.col("new_cases")),
        "new_deaths": clamp_negative(F.col("new_deaths")),
    })


def clean_daily(raw: DataFrame) -> DataFrame:
    """Landed text -> one typed row per (country code, date) with derived rates."""
    return with_measures(deduplicate(typed_daily(raw)))


def flag_rows(raw: DataFrame) -> DataFrame:
    """Each landed row with its fate: aggregate, header, bad_date or valid."""
    code = strip(F.col("iso_code"))
    day = tolerant_date(F.col("date_raw"))
    return raw.select("*", code.alias("code"), day.alias("full_date")).withColumn(
        "fate",
        F.when(is_aggregate_code(F.col("code")), "aggregate")
        .when(F.col("code") == HEADER_ECHO, "header")
        .when(F.col("full_date").isNull(), "bad_date")
        .otherwise("valid"),
    )


#: Samples of bad dates that a landing notes.
SAMPLES = 5


def fate_metrics() -> dict[str, Column]:
    """Aggregates over flagged rows that the tasks which write them can take on the way: rows by fate, and the
    bad date with the smallest id in each of five hash classes of ids."""
    def rows(fate: str) -> Column:
        return F.count(F.when(F.col("fate") == fate, 1))

    def sample(i: int) -> Column:
        text = F.concat_ws(" ", F.col("id").cast("string"), "code", "date_raw")
        wanted = (F.col("fate") == "bad_date") & (F.pmod(F.xxhash64("id"), F.lit(SAMPLES)) == i)
        return F.min_by(F.when(wanted, text), F.when(wanted, F.col("id")))

    return {"landed_rows": F.count(F.lit(1)), "aggregate_rows": rows("aggregate"), "header_rows": rows("header"),
            "bad_date_rows": rows("bad_date"), "valid_rows": rows("valid"), "bad_date_samples": F.array(*[sample(i) for i in range(SAMPLES)])}


def quality_counts(raw: DataFrame) -> DataFrame:
    """One row of counts: landed, aggregate, header, bad dates, duplicates, kept.

    Rows are counted per (fate, code, date) first - a partial aggregate before the shuffle -
    so distinct keys cost no extra exchange and no key is gathered whole."""
    valid = F.col("fate") == "valid"
    per_key = flag_rows(raw).groupBy(
        "fate", F.when(valid, F.col("code")).alias("code"), F.when(valid, F.col("full_date")).alias("full_date")
    ).agg(F.count(F.lit(1)).alias("n"))

    def rows(fate: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("fate") == fate, F.col("n"))), F.lit(0)).cast("bigint")

    kept = F.count(F.when(valid, 1))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("landed_rows"),
        rows("aggregate").alias("aggregate_rows"),
        rows("header").alias("header_rows"),
        rows("bad_date").alias("bad_date_rows"),
        (rows("valid") - kept).alias("duplicate_rows"),
        kept.alias("kept_rows"),
    )


def bad_date_samples(raw: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows (by id) whose date does not parse."""
    return flag_rows(raw).filter(F.col("fate") == "bad_date").select(
        "id", F.col("code").alias("iso_code"), "date_raw").orderBy("id").limit(n)


def check_clean(clean: DataFrame) -> None:
    """Refuse a load whose cleaning left nothing (one short job)."""
    if clean.isEmpty():
        raise ValueError("no valid row left after cleaning; the landing table was probably loaded wrongly")
