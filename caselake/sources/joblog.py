"""Run log: a row when a run starts and one when it ends, well or badly."""

from __future__ import annotations

import os
import random
import time
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..fixed_values import JOB_STATUSES
from ..schemas import SCHEMAS, empty, one_row
from ..session import scratch_run


def new_id() -> int:
    """Time in microseconds and ten random bits: later runs have larger ids, and two runs that start in
    the same microsecond hardly ever share one. No look at the log is needed."""
    return (time.time_ns() // 1000 << 10) | random.getrandbits(10)


class JobLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.path = os.path.join(root, "job_log")

    def append(self, job_name: str, status: str, rows: int, started_at: datetime,
               finished_at: datetime | None, error: str | None = None, job_id: int | None = None) -> None:
        if status not in JOB_STATUSES:
            raise ValueError(f"status must be one of {JOB_STATUSES}")
        one_row(
            self.spark, "job_log", job_id=new_id() if job_id is None else job_id, job_name=job_name, status=status,
            rows_processed=rows, started_at=started_at, finished_at=finished_at, error_message=error,
        ).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """One row per run: its end, or its start while it has none (or never got one)."""
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop_path):
            return empty(self.spark, SCHEMAS["job_log"])
        rows = self.spark.read.schema(SCHEMAS["job_log"]).parquet(self.path)
        last = Window.partitionBy("job_id").orderBy(F.col("finished_at").desc_nulls_last())
        return rows.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") == 1).drop("_rn")

    @contextmanager
    def run(self, job_name: str):
        """Log the block: ``with log.run("load") as done: done(rows)``. A raised error is logged with its
        message and raised again. Intermediate tables of the block are removed when it ends."""
        started, job_id = datetime.now(timezone.utc), new_id()
        self.append(job_name, "running", 0, started, None, None, job_id)
        counted = {"rows": 0}
        try:
            with scratch_run(self.spark):
                yield lambda rows: counted.update(rows=rows)
        except Exception as error:
            self.append(job_name, "failed", 0, started, datetime.now(timezone.utc), str(error), job_id)
            raise
        self.append(job_name, "success", counted["rows"], started, datetime.now(timezone.utc), None, job_id)
