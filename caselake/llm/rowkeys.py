"""A key for each row of a stored table that no packing of files into tasks changes.

A number that follows the order of a scan depends on how Spark packs files into tasks, and that on the
cores there are at that moment; two scans of one table may differ. The key here is the row's place in
its file and a hash of the file's path, as one decimal, so it joins, groups and sorts like a number."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselake.session import materialize

KEY_TYPE = "decimal(38,0)"


def row_key() -> Column:
    """File hash of 62 bits times 10^13 plus the row's index in the file: two files of a table share a hash
    with a probability of about (number of files)^2 / 2^63, and no file has 10^13 rows."""
    file = F.shiftrightunsigned(F.xxhash64("_metadata.file_path"), 2).cast("decimal(19,0)")
    return (file * F.lit(10 ** 13).cast("decimal(14,0)") + F.col("_metadata.row_index")).cast(KEY_TYPE)


def stored(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` itself if its rows have a place in Parquet files (a table as read, filtered or projected),
    else a copy in the shared folder."""
    try:
        docs.select(row_key())
    except AnalysisException:
        return materialize(docs, label)
    return docs


def with_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` (from ``stored``) with its row key in a further column."""
    return docs.select("*", row_key().alias(name))


def required(docs: DataFrame) -> DataFrame:
    """``docs``, or an error if its rows have no place in files: for steps that match rows with an earlier result
    about the same table."""
    try:
        docs.select(row_key())
    except AnalysisException as error:
        raise ValueError("a stored Parquet table is needed, the one that the earlier step read") from error
    return docs
