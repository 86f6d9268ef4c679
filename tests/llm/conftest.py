import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from caselake.session import materialize  # noqa: E402

LONG = " ".join(f"w{i % 5000}x{i}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(30))

#: Nulls, empty and very long texts, ties, repeated rows; extra columns with names the operators use.
ODD = [
    (1, "one  two\tthree four five six seven"), (2, "one two three four five six seven"), (3, None), (4, ""), (5, " \n\t "),
    (6, LONG), (7, LONG + " tail"), (8, PASSAGE), (9, "before it " + PASSAGE + " after it"), (9, "before it " + PASSAGE + " after it"),
    (10, PASSAGE + " " + PASSAGE), (None, "a row without id and some words"), (None, PASSAGE), (11, "é" * 5000), (12, "…\u00a0…"),
    (13, "a@b.co and c@d.example.org, 10.0.0.1 or 999.1.1.1.1; 4111 1111-1111 1111, +1 (555) 010-9999 user: jane99 @handle1"),
    (14, "a@b.c@d.e 1.2.3 1.2.3.4.5 00000000000000.1.1.1 4111111111111112 +12 +1234567 https://me:pw1@host.example/x"),
    (15, "short"), (16, "short"), (17, "SHORT one"), (18, "short ONE"),
]
CLASHING = ("kept boolean, row_no long, spans string, label int, size long, node long, root long, n long, top double, "
            "score double, chunk long, ids string, __x string")


def rows_as_table(spark, rows, name, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        df = df.selectExpr("*", "'en' as lang", "cast(null as string) as source", "length(text) as n_chars", *[
            f"cast(null as {field.split()[1]}) as {field.split()[0]}" for field in CLASHING.split(", ")])
    return materialize(df, name)


@pytest.fixture(scope="session")
def odd(spark):
    return rows_as_table(spark, ODD, "odd")


@pytest.fixture(scope="session")
def empty(spark):
    return rows_as_table(spark, [], "empty")


@pytest.fixture(scope="session")
def small(spark):
    """The smallest given documents as a table and as rows."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
