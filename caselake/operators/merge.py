"""Keyed writes expressed as joins: upsert, partial upsert, insert-if-absent, evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .clean import keep_last


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows replace target rows with the same key; other rows stay. ``source`` holds
    one row per key. The planner broadcasts the source's keys when they are few, and the
    target is then not shuffled."""
    kept = target.join(source.select(*keys), keys, "left_anti")
    return kept.unionByName(source.select(*target.columns))


def upsert_columns(target: DataFrame, source: DataFrame, keys: list[str], update: list[str],
                   defaults: dict | None = None) -> DataFrame:
    """Existing keys get only the ``update`` columns (nulls included); new keys get the
    source row, with ``defaults`` where the source has no such column. Keys are not null,
    so plain equality serves and sides already partitioned by the key are not moved again."""
    defaults = defaults or {}
    others = [c for c in target.columns if c not in keys and c not in update]
    t = target.withColumn("_in_target", F.lit(True)).alias("t")
    s = source.withColumn("_in_source", F.lit(True)).alias("s")
    joined = t.join(s, keys, "full_outer")

    def fresh(c: str):
        kind = target.schema[c].dataType
        return F.col(f"s.{c}").cast(kind) if c in source.columns else F.lit(defaults.get(c)).cast(kind)

    columns = [F.col(k).cast(target.schema[k].dataType).alias(k) for k in keys]
    columns += [F.when(F.col("_in_source"), F.col(f"s.{c}").cast(target.schema[c].dataType)).otherwise(
        F.col(f"t.{c}")).alias(c) for c in update]
    columns += [F.when(F.col("_in_target"), F.col(f"t.{c}")).otherwise(fresh(c)).alias(c) for c in others]
    return joined.select(*columns).select(*target.columns)


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str], order=None) -> DataFrame:
    """Add source rows whose key the target lacks; the first source row per key wins
    (``order`` says which is first; without it rows of one key must be equal)."""
    source = keep_last(source, keys, order) if order else source.dropDuplicates(keys)
    new = source.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def evolve(old: DataFrame, new: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Stack rows of an older and a newer schema: a column the old rows lack is added with
    its default, and both sides take the newer (wider) type."""
    defaults = defaults or {}
    present = set(old.columns)
    for field in new.schema.fields:
        if field.name not in present:
            old = old.withColumn(field.name, F.lit(defaults.get(field.name)).cast(field.dataType))
        else:
            old = old.withColumn(field.name, F.col(field.name).cast(field.dataType))
    return old.unionByName(new, allowMissingColumns=True)
