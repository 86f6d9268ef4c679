"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def build_session(app: str = "caselake", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """Session with UTC time, ANSI errors and adaptive execution.

    ``shuffle_partitions`` stays unset on a cluster: adaptive execution then starts from
    the cluster's own number and merges small partitions at run time."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        # Beyond 8000 bytes HotSpot does not compile a method; such stages run faster as smaller pieces.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in
    ``spark.checkpoint.dir``. Only a session whose tasks run in its own process may fall back to a
    temporary one (``local-cluster`` has executors of their own)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; a cluster run needs a shared folder")
    path = tempfile.mkdtemp(prefix="caselake-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_RUN: ContextVar[str | None] = ContextVar("caselake_run", default=None)


@contextmanager
def scratch_run(spark: SparkSession):
    """Intermediate tables of the block go to one folder that is removed when the block ends, well or
    badly. What the block returns must not read them: loads return stored tables."""
    folder = os.path.join(shared_dir(spark), f"caselake-run-{uuid.uuid4().hex}")
    token = _RUN.set(folder)
    try:
        yield
    finally:
        _RUN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the run's or the shared folder; never reused, so no run reads another's rows."""
    return os.path.join(_RUN.get() or shared_dir(spark), f"caselake-{label}-{uuid.uuid4().hex}")


def materialize(df, label: str):
    """Write once to the shared folder and read back. Later plans start from these files,
    so a lost executor costs a re-read, and the planner knows the table's true size when it
    chooses between a broadcast and a shuffle join."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
