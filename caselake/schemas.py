"""Table schemas of the three tiers (landing, star, serving)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RATE = T.DecimalType(18, 2)
_TYPES = {
    "int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "date": T.DateType(),
    "time": T.TimestampType(), "rate": RATE,
    "days": T.ArrayType(T.StructType([T.StructField("date_id", T.IntegerType()), T.StructField("new_cases", T.LongType())])),
}


def _table(columns: str) -> T.StructType:
    fields = (column.split(":") for column in columns.split())
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


SCHEMAS: dict[str, T.StructType] = {
    # landing: text as delivered, with provenance
    "raw_daily": _table(
        "id:long iso_code:string continent:string location:string date_raw:string new_cases:string "
        "new_deaths:string total_cases:string total_deaths:string people_vaccinated:string "
        "population:string ingested_at:time source_file:string"),
    "raw_vaccination": _table(
        "province_name:string population:long doses_distributed:long doses_administered:long "
        "doses_per_100:rate snapshot_date:date source_url:string ingested_at:time"),
    "raw_province_cases": _table(
        "province_name:string total_cases:long total_deaths:long new_cases:long source_url:string "
        "ingested_at:time"),
    # star
    "dim_country": _table("country_id:int iso_code:string country_name:string continent:string population:long"),
    "dim_province": _table("province_id:int province_name:string region:string population:long"),
    "dim_date": _table("date_id:int full_date:date year:int month:int week:int quarter:int"),
    "fact_global_daily": _table(
        "country_id:int date_id:int new_cases:long new_deaths:long total_cases:long total_deaths:long "
        "people_vaccinated:long vaccination_rate:rate case_fatality_rate:rate month_id:int"),
    "fact_province_daily": _table(
        "province_id:int date_id:int new_cases:long new_deaths:long total_cases:long total_deaths:long "
        "recovered:long active_cases:long month_id:int"),
    "fact_vaccination": _table(
        "province_id:int date_id:int population:long doses_distributed:long doses_administered:long "
        "doses_per_100:rate month_id:int"),
    "fact_timeline_daily": _table(
        "series:string date_id:int total_cases:long total_deaths:long new_cases:long new_deaths:long "
        "source_url:string month_id:int"),
    # what the serving tables need of each place and month, so that a load reads the months it touches only
    "state_country_monthly": _table(
        "country_id:int month_id:int newest_date_id:int total_cases:long total_deaths:long rate_date_id:int "
        "vaccination_rate:rate days:days"),
    "state_province_monthly": _table(
        "province_id:int month_id:int newest_date_id:int new_cases:long total_cases:long total_deaths:long "
        "active_cases:long first_date_id:int first_new_cases:long first_total_cases:long first_total_deaths:long "
        "first_new_deaths:long"),
    # serving
    "agg_country_summary": _table(
        "country_id:int country_name:string latest_total_cases:long latest_total_deaths:long "
        "latest_vaccination_rate:rate trend_7d_cases:rate last_updated:time"),
    "agg_province_summary": _table(
        "province_id:int province_name:string latest_total_cases:long latest_total_deaths:long "
        "latest_new_cases:long active_cases:long last_updated:time"),
    "agg_daily_global": _table("date_id:int total_new_cases:long total_new_deaths:long"),
    "agg_daily_province": _table("date_id:int total_new_cases:long total_new_deaths:long"),
    "agg_vaccination_summary": _table(
        "province_id:int province_name:string population:long doses_distributed:long "
        "doses_administered:long doses_per_100:rate last_updated:time"),
    "agg_province_cases": _table(
        "province_name:string total_cases:long total_deaths:long new_cases:long last_updated:time"),
    # monitoring
    "job_log": _table(
        "job_id:long job_name:string status:string rows_processed:long started_at:time finished_at:time "
        "error_message:string"),
}

# Values of columns in rows that were written, or are delivered, without them.
DEFAULTS: dict[str, dict] = {
    "fact_province_daily": {"new_deaths": 0, "recovered": 0, "active_cases": 0},
}

# Column groups that must be unique / must exist in a dimension (the loads enforce them, audits look them up).
UNIQUE_KEYS = {
    "dim_country": ["iso_code"],
    "dim_province": ["province_name"],
    "dim_date": ["date_id"],
    "fact_global_daily": ["country_id", "date_id"],
    "fact_province_daily": ["province_id", "date_id"],
    "fact_vaccination": ["province_id", "date_id"],
    "fact_timeline_daily": ["series", "date_id"],
}
REFERENCES = [
    ("fact_global_daily", "country_id", "dim_country"),
    ("fact_global_daily", "date_id", "dim_date"),
    ("fact_province_daily", "province_id", "dim_province"),
    ("fact_province_daily", "date_id", "dim_date"),
    ("fact_vaccination", "province_id", "dim_province"),
    ("fact_vaccination", "date_id", "dim_date"),
    ("fact_timeline_daily", "date_id", "dim_date"),
]


def one_row(spark: SparkSession, table: str, **values) -> DataFrame:
    """A single literal row of a table, without a detour through Python workers."""
    return conform(spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]), SCHEMAS[table])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows of a schema, in a form the optimizer sees as empty and prunes around."""
    return conform(spark.range(1).filter(F.lit(False)), schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to the table's columns; a missing column becomes null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
