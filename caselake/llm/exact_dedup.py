"""Exact dedup: a two-pass Bloom filter finds possibly repeated hashes; only those rows shuffle.

Pass 1 counts the filter's bits: a bit stays only where two or more rows set it. Pass 2 asks the
filter about each row. A row with a cleared bit is the only one with its text and passes straight
through; the others are grouped by the full SHA-256. The filter's false hits cost a shuffled row
each and change no result. All of it runs on narrow rows (id and hash); texts are hashed in the
scan and never move.

Defined cases: a null text counts as empty. Of equal texts the row with the smallest doc_id
stays, null ids last; rows repeated with the same id are rows like others, exactly one of a group
stays. An empty table gives an empty result. Other columns, whatever their names, are not read
by ``mark_copies`` and come back unchanged from ``drop_copies``. Rows are told apart by their place in the
table's files (``rowkeys``), so it does not matter how two scans are split into tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.llm import bloom, rowkeys
from caselake.session import materialize

def normalized(text: str) -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16,
                max_blocks: int = bloom.MAX_BLOCKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, row_no.

    ``row_no`` is the row's key in the stored table; it tells rows apart that share an id."""
    docs = rowkeys.stored(docs, "op1-docs")
    keys = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(normalized(text_col), 256).alias("text_sha256"),
        rowkeys.row_key().alias("row_no")), "op1-keys")
    n_blocks = bloom.blocks_for(keys.count(), bits_per_row, max_blocks)
    repeated = materialize(bloom.build(keys, "text_sha256", n_blocks, at_least=2), "op1-filter")
    asked = bloom.ask(keys, "text_sha256", n_blocks, repeated)
    single = asked.filter("not possible").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", "row_no")
    possible = asked.filter("possible").drop("possible")
    # Fixed-width buffers (no structs) keep this a hash aggregate with partial sums in each task.
    smallest = possible.groupBy("text_sha256", "doc_id").agg(
        F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("n"))
    groups = smallest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    keeper = smallest.withColumnsRenamed({"doc_id": "of_id", "text_sha256": "of_sha"})
    chosen = groups.join(keeper, (F.col("text_sha256") == F.col("of_sha")) & F.col("keep_id").eqNullSafe(F.col("of_id"))) \
        .select("text_sha256", "keep_id", "group_size", "first_row")
    grouped = possible.join(chosen, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("first_row")).alias("kept"),
        "text_sha256", "row_no")
    return single.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later copies, with its own columns. A table that is not stored is stored
    first: its rows are matched by their place in its files."""
    docs = rowkeys.stored(docs, "op1-docs")
    marks = mark_copies(docs, id_col, text_col)
    gone = materialize(marks.filter("not kept").select(F.col("doc_id").alias("__id"), F.col("row_no").alias("__row")), "op1-gone")
    numbered = rowkeys.with_key(docs, "__row_no")
    sure, possible = bloom.apart(numbered, "__row_no", gone, "__row", "op1-gone")
    kept = possible.join(gone, (F.col("__row_no") == F.col("__row")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
    return sure.unionByName(kept).drop("__row_no")
