"""Blocked Bloom filters as tables: one row per block of 256 bits, four lanes of 64.

A key sets one bit in each lane of one block, so asking costs one broadcast lookup. A row has 40
bytes and ``MAX_BLOCKS`` bounds the rows: broadcasting a filter moves at most 20 MB, whatever the
number of keys. With more keys than that the filter lets more rows pass; the exact step after it
keeps the result right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselake.session import materialize

BLOCK_BITS = 256
LANES = 4
MAX_BLOCKS = 1 << 19


def blocks_for(keys: int, bits_per_key: int = 16, most: int = MAX_BLOCKS) -> int:
    return max(1, min(most, -(-keys * bits_per_key // BLOCK_BITS)))


def addressed(rows: DataFrame, key: str, n_blocks: int, mark: str = "__") -> DataFrame:
    """Adds the key's block and its bit in each lane, names begin with ``mark``."""
    second = F.xxhash64(key, F.lit(1))
    bits = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int").alias(f"{mark}bit{i}") for i in range(LANES)]
    return rows.select("*", F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int").alias(f"{mark}block"), *bits)


def build(keys: DataFrame, key: str, n_blocks: int, at_least: int = 1) -> DataFrame:
    """The filter: per block the bits that ``at_least`` rows set. Bits are counted with partial
    sums in each task, so a key of many rows sends one row per task and bit."""
    slots = addressed(keys.select(key), key, n_blocks).select("__block", F.explode(F.array(*[
        (F.lit(64 * i) + F.col(f"__bit{i}")).cast("int") for i in range(LANES)])).alias("__slot"))
    counted = slots.groupBy("__block", "__slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
    lanes = [F.expr(f"bit_or(if(__slot div 64 = {i}, shiftleft(1L, cast(__slot % 64 as int)), 0L))").alias(f"__lane{i}")
             for i in range(LANES)]
    return counted.groupBy("__block").agg(*lanes)


def ask(rows: DataFrame, key: str, n_blocks: int, built: DataFrame, answer: str = "possible") -> DataFrame:
    """``rows`` with a boolean: false is certain. A null key is never in the filter. Columns of the rows may
    have any names but the answer's."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in rows.columns if c != key):
        mark += "_"
    lanes = built.select(*[F.col(c).alias(c.replace("__", mark)) for c in built.columns])
    asked = addressed(rows, key, n_blocks, mark).join(F.broadcast(lanes), f"{mark}block", "left")
    hit: Column = F.col(key).isNotNull()
    for i in range(LANES):
        hit = hit & F.expr(f"coalesce({mark}lane{i} & shiftleft(1L, {mark}bit{i}), 0L) != 0L")
    return asked.select(*rows.columns, hit.alias(answer))


def apart(rows: DataFrame, key: str, stored: DataFrame, stored_key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key is certainly not in ``stored``, and those that may be: only the latter need a
    join, so only they move. ``stored`` is a stored table; rows with a null key are never in it."""
    n_blocks = blocks_for(stored.count())
    built = materialize(build(stored, stored_key, n_blocks), f"{label}-filter")
    answer = "possible"
    while answer in rows.columns:
        answer = f"_{answer}"
    asked = ask(rows, key, n_blocks, built, answer)
    return asked.filter(~F.col(answer)).drop(answer), asked.filter(answer).drop(answer)
