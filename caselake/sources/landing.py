"""Landing of the daily source: recent days only, all text, with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..fixed_values import DAILY_COLUMNS, DAYS_TO_KEEP, HEADER_ECHO, NULL_WORDS
from ..functions import null_if_missing_word


def recent_days(df: DataFrame, date_column: str = "date", days: int = DAYS_TO_KEEP) -> DataFrame:
    """Rows whose date is at most ``days`` days before the newest date in the data.

    The newest date is a scalar subquery over the date column alone, not a join."""
    newest = df.agg(F.max(date_column)).scalar()
    return df.filter(F.col(date_column) >= F.date_sub(newest, days))


def land_daily(df: DataFrame, source_file: str, ingested_at: Column | None = None,
               null_words=tuple(NULL_WORDS)) -> DataFrame:
    """Every value as text or null, plus the file name and the given load time. ``df`` has an ``id``
    that grows in the order of delivery: of rows with one key the last one counts."""
    if "id" not in df.columns:
        raise ValueError("a landing needs an id that gives the order of its rows")

    def text(name: str) -> Column:
        return null_if_missing_word(F.col(name).cast("string"), null_words)

    columns = [text(c).alias("date_raw" if c == "date" else c) for c in DAILY_COLUMNS]
    return df.select(
        "id", *columns,
        (ingested_at if ingested_at is not None else F.lit(None).cast("timestamp")).alias("ingested_at"),
        F.lit(source_file).alias("source_file"),
    )


def check_landing(df: DataFrame) -> None:
    """Refuse an empty delivery and one whose code column holds header words only. Meant for landed
    rows: a good delivery is cleared by the first row that carries a code, one short job."""
    if not df.filter(F.col("iso_code").isNull() | (F.col("iso_code") != HEADER_ECHO)).isEmpty():
        return
    if df.isEmpty():
        raise ValueError("the delivery has no row")
    raise ValueError("the code column holds only header words; the file was read wrongly")


def file_states(spark: SparkSession, paths) -> list[tuple[str, str, int, int]]:
    """(path, name, length, time of change) of the files among ``paths`` and in the folders among them."""
    found = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(where)
        for s in [status] if status.isFile() else fs.listStatus(where):
            if s.isFile() and s.getPath().getName()[0] not in "._" and s.getLen() > 0:
                found.append((s.getPath().toString(), s.getPath().getName(), s.getLen(), s.getModificationTime()))
    return sorted(found)
