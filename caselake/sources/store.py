"""Named Parquet tables below one root folder.

A table is a list of data folders. Every write goes to new folders; a small list file, written last
under the next number, makes them current in one step. A reader opens the folders of the newest list,
so it never sees half of a write, a failed write leaves the old list in force, and no folder is ever
overwritten, which object stores allow as well. Facts are split by month: a merge writes the months it
touches and lists the others where they are. One writer per table at a time.

Each folder's entry says with which columns and types it was written. A reader opens a folder with its own
types and casts to the declared ones, so a column that was widened later (say from a number to text) stays
readable. Constraints (``constraints``) are tested on the written folders before they become current.

``KEEP`` newest lists and what they name are kept; older folders are removed after a write."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..operators import audit
from ..operators.merge import upsert, upsert_columns
from ..schemas import DEFAULTS, REFERENCES, SCHEMAS, UNIQUE_KEYS, conform, empty

KEEP = 3
_PART = "part"


def parts_of(rows: DataFrame, partition_by: str) -> list:
    """The parts that rows belong to, few and bounded by the calendar."""
    return [row[0] for row in rows.select(partition_by).distinct().collect()]


class TableStore:
    def __init__(self, spark: SparkSession, root: str, schemas: dict | None = None, defaults: dict | None = None):
        """``defaults``: per table, the value of a column in rows written before the column existed."""
        self.spark, self.root = spark, root
        self.schemas = SCHEMAS if schemas is None else schemas
        self.defaults = DEFAULTS if defaults is None else defaults

    # --- lists ------------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, *parts))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, where = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(name, "_lists") if n.endswith(".json") and n[:-5].isdigit())

    def _list(self, name: str, number: int) -> dict:
        stream = self._fs().open(self._path(name, "_lists", f"{number:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _newest(self, name: str) -> dict | None:
        numbers = self._numbers(name)
        return self._list(name, numbers[-1]) if numbers else None

    def _publish(self, name: str, folders: list[dict], notes: dict | None) -> None:
        """Write the next list under a name of its own and rename it: the step that counts."""
        fs = self._fs()
        number = (self._numbers(name) or [0])[-1] + 1
        final, draft = self._path(name, "_lists", f"{number:08d}.json"), self._path(name, "_lists", f"{uuid.uuid4().hex}.draft")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"folders": folders, "notes": notes or {}}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"another writer changed {name}")
        self._remove_old(name)

    def _remove_old(self, name: str) -> None:
        fs, numbers = self._fs(), self._numbers(name)
        if len(numbers) <= KEEP:
            return
        top = lambda lists: {f["path"].split("/")[0] for x in lists for f in x["folders"]}
        old = [self._list(name, n) for n in numbers[:-KEEP]]
        kept = top(self._list(name, n) for n in numbers[-KEEP:])
        for folder in top(old) - kept:
            fs.delete(self._path(name, folder), True)
        for n in numbers[:-KEEP]:
            fs.delete(self._path(name, "_lists", f"{n:08d}.json"), False)

    # --- reading ----------------------------------------------------------------
    def exists(self, name: str) -> bool:
        return bool(self._numbers(name))

    def notes(self, name: str) -> dict:
        """What the writer of the current rows noted about them."""
        return (self._newest(name) or {}).get("notes", {})

    def folders(self, name: str) -> list[dict]:
        return (self._newest(name) or {"folders": []})["folders"]

    def read(self, name: str, parts: list | None = None) -> DataFrame:
        """The table with its declared schema, or only some of its parts (the others' files are not
        opened). An unwritten table reads as empty. A column that a folder was written without has
        its default there; nulls that were delivered stay null."""
        wanted = None if parts is None else {str(p) for p in parts}
        return self._opened(name, [f for f in self.folders(name) if wanted is None or f["part"] in wanted])

    def _opened(self, name: str, folders: list[dict]) -> DataFrame:
        schema, defaults = self.schemas[name], self.defaults.get(name, {})
        declared = {f.name: f.dataType.simpleString() for f in schema.fields}
        groups: dict[tuple, list[str]] = {}
        for f in folders:
            lacking = tuple(c for c in defaults if c not in f["columns"])
            stored = tuple(sorted((c, kind) for c, kind in f.get("types", {}).items() if declared.get(c, kind) != kind))
            groups.setdefault((lacking, stored), []).append(os.path.join(self.root, name, f["path"]))
        out = None
        for (lacking, stored), paths in groups.items():
            own = T.StructType([T.StructField(f.name, T.DataType.fromDDL(dict(stored)[f.name]) if f.name in dict(stored) else f.dataType)
                                for f in schema.fields])
            rows = self.spark.read.schema(own).parquet(*paths)
            changed = {c: F.col(c).cast(schema[c].dataType) for c, _ in stored} | {
                c: F.lit(defaults[c]).cast(schema[c].dataType) for c in lacking}
            rows = rows.withColumns(changed) if changed else rows
            out = rows if out is None else out.unionByName(rows)
        return empty(self.spark, schema) if out is None else out

    def constraints(self, name: str):
        """A check for ``replace`` and ``merge``: refuses written rows of the table that repeat a unique key or
        refer to no row of a dimension. A merge writes all rows of the touched parts, and a key stays in its
        part, so rows elsewhere need no look."""
        def check(rows: DataFrame) -> None:
            audit.refuse_violations(name, rows, UNIQUE_KEYS.get(name), {
                (key, dim): self.read(dim) for fact, key, dim in REFERENCES if fact == name})

        return check

    # --- writing ----------------------------------------------------------------
    def _written(self, name: str, df: DataFrame, partition_by: str | None, sort_by, metrics: dict | None = None) -> tuple[list[dict], dict]:
        """New folders with the rows, not yet current, and what was counted while they were written: ``rows``
        and the aggregates of ``metrics``."""
        if partition_by:
            # One right-sized set of files per part; adaptive execution splits a hot month and joins
            # small ones, where a plain repartition would leave one huge task.
            df = df.hint("rebalance", partition_by)
        if sort_by:
            df = df.sortWithinPartitions(*([partition_by] if partition_by else []), *sort_by)
        # Counted in the writing tasks themselves: a retried shuffle stage cannot count twice.
        counted = Observation()
        entry = {"columns": df.columns, "types": dict(df.dtypes)}
        df = df.observe(counted, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in (metrics or {}).items()])
        df = df.select(*entry["columns"])
        folder = f"v-{uuid.uuid4().hex}"
        writer = (df.withColumn(_PART, F.col(partition_by)).write.partitionBy(_PART) if partition_by else df.write)
        writer.parquet(os.path.join(self.root, name, folder))
        if not partition_by:
            return [{"path": folder, "part": None, **entry}], counted.get
        found = [n for n in self._names(name, folder) if n.startswith(f"{_PART}=")]
        return [{"path": f"{folder}/{n}", "part": n[len(_PART) + 1:], **entry} for n in found], counted.get

    def replace(self, name: str, df: DataFrame, partition_by: str | None = None, sort_by=(), notes: dict | None = None,
                check=None, metrics: dict | None = None) -> int:
        """New rows instead of the current ones; returns how many. ``check`` gets the written rows before
        they become current and may refuse them by an error. ``metrics``: aggregates over the columns of ``df`` that
        the writing tasks take on the way; they are noted with the table."""
        extra = [F.col(c) for c in df.columns if c not in self.schemas[name].names] if metrics else []
        folders, counted = self._written_of(name, df, extra, partition_by, sort_by, metrics)
        if check is not None:
            check(self._opened(name, folders))
        self._publish(name, folders, (notes or {}) | {k: _plain(counted[k]) for k in metrics or {}})
        return counted["rows"]

    def _written_of(self, name, df, extra, partition_by, sort_by, metrics):
        if not extra:
            return self._written(name, conform(df, self.schemas[name]), partition_by, sort_by, metrics)
        # Columns that only the metrics need are observed, not written.
        counted = Observation()
        seen = df.observe(counted, *[c.alias(k) for k, c in metrics.items()])
        folders, rows = self._written(name, conform(seen, self.schemas[name]), partition_by, sort_by)
        return folders, rows | counted.get

    def replace_parts(self, name: str, df: DataFrame, partition_by: str, parts: list, sort_by=()) -> int:
        """New rows instead of the current ones of some parts; the other parts stay where they are."""
        if not parts:
            return 0
        folders, counted = self._written(name, conform(df, self.schemas[name]), partition_by, sort_by)
        gone = {str(p) for p in parts}
        self._publish(name, [f for f in self.folders(name) if f["part"] not in gone] + folders, None)
        return counted["rows"]

    def append(self, name: str, df: DataFrame, notes: dict | None = None, check=None) -> int:
        """Add rows; earlier ones stay in the folders (and with the columns) they were written with."""
        folders, counted = self._written(name, conform(df, self.schemas[name]), None, ())
        if check is not None:
            check(self._opened(name, folders))
        self._publish(name, self.folders(name) + folders, notes)
        return counted["rows"]

    def merge(self, name: str, updates: DataFrame, keys: list[str], partition_by: str, sort_by=(),
              update: list[str] | None = None, touched: list | None = None, check=None, notes: dict | None = None) -> int:
        """Insert new keys and overwrite existing ones in the months the updates touch; returns the rows
        of those months. ``update``: only these columns of existing rows change; others of new rows take
        the table's defaults.

        The touched months (integers of the calendar) come to the driver and select the folders to
        read; a caller that knows them gives them. A key must not move to another month (the month
        follows from the date in the key). ``check`` gets the written rows of the touched months before they
        become current."""
        touched = parts_of(updates, partition_by) if touched is None else touched
        if not touched:
            return 0
        current = self.read(name, touched)
        if update is None:
            merged = upsert(current, conform(updates, self.schemas[name]), keys)
        else:
            merged = upsert_columns(current, updates, keys, update, self.defaults.get(name, {}))
        folders, counted = self._written(name, merged, partition_by, sort_by)
        if check is not None:
            check(self._opened(name, folders))
        parts = {str(p) for p in touched}
        self._publish(name, [f for f in self.folders(name) if f["part"] not in parts] + folders, notes)
        return counted["rows"]


def _plain(value):
    """An observed value as JSON has it."""
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value
