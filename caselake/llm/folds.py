"""Labelled rows and folds shared by the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselake.llm import bloom


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def training_labels(labels: DataFrame, label: str, parts: int, held: int, id_col: str = "doc_id") -> DataFrame:
    """(label_id, label) of the rows that may be learnt from: one row per id, null labels and ids
    left out; of contradicting rows the largest label counts."""
    return labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).filter(
        remainder(id_col, parts) != held).groupBy(F.col(id_col).alias("label_id")).agg(
        F.max(F.col(label).cast("int")).alias("label"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` (with ``doc_id``) that have a label. A Bloom filter of the labelled ids keeps
    the other texts from moving; the join after it is exact."""
    _, possible = bloom.apart(docs, "doc_id", labels, "label_id", "labels")
    return possible.join(labels, F.col("doc_id") == F.col("label_id")).drop("label_id")


def share(id_col: str, salt: str, fraction: float) -> Column:
    """True for about ``fraction`` of all ids, the same ones on every run."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(1_000_000)) < int(min(1.0, fraction) * 1_000_000)
