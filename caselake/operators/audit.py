"""The constraints that Parquet does not enforce: looked up in a table, or enforced before a write counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def orphan_rows(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact rows whose key is set but has no dimension row."""
    return fact.filter(F.col(key).isNotNull()).join(dim.select(key), key, "left_anti")


def refuse_violations(name: str, rows: DataFrame, unique: list[str] | None, references: dict[tuple[str, str], DataFrame]) -> None:
    """An error if ``rows`` repeat a unique key or refer to a row that is not there. ``references``:
    (key, dimension's name) -> dimension. One aggregate by key and one anti join per reference, each ended by
    its first finding."""
    if unique and (found := duplicate_keys(rows, unique).first()):
        raise ValueError(f"{name}: {found.row_count} rows share the key {tuple(found)[:-1]} of {', '.join(unique)}")
    for (key, dim_name), dim in references.items():
        if found := orphan_rows(rows, dim, key).select(key).first():
            raise ValueError(f"{name}: {key} {found[0]} is not in {dim_name}")
