"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes (insert, delete, revise) becomes signed rows: what a document counted before with
a minus, what it counts now with a plus. Their sums per group are the batch's delta, which is added to
the totals; nothing is counted anew. What a document counted before is taken from the ledger, so a
delete or a revision cannot take off more than was put in.

Layout below ``root`` (any path Spark can write):
  changes/<batch>/bucket=<n>   the batch's last change per document and version (the ledger's newest layer), by a
                               hash bucket of the document: a batch reads the buckets of its own documents only
  deltas/<batch>    signed sums per group
  commits/<batch>   one row, written last
A batch counts from the moment its commit exists. Committing it again does nothing, and a commit that
broke off leaves files that the next try overwrites. Batches are applied by one writer at a time.

Defined cases. A change without id or version is left out. Of several changes of one document and
version in a batch the one with the largest ``seq`` counts, of equal ones the largest by op, source,
lang and count. Insert and revise both set the new state (an insert of a known document revises it, a
revision of an unknown one inserts it); delete of an unknown document does nothing; any other op is an
error. Null counts count as 0; null sources and languages are groups of their own. Groups whose
documents are all gone stay out of the totals. Other columns are not read."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.session import scratch_path

OPS = ["insert", "delete", "revise"]
_STATE = "doc_id long, version string, op string, source string, lang string, n_tokens long, batch_no long, bucket int"
#: Hash buckets of the ledger.
BUCKETS = 64
_DELTA = "source string, lang string, version string, n_docs long, n_tokens long"


class TokenRollup:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, part: str, batch: str = "") -> str:
        return f"{self.root}/{part}/{batch}".rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def batches(self) -> list[str]:
        """Committed batches in their order; one small row each."""
        if not self._exists(self._path("commits")):
            return []
        rows = self.spark.read.schema("batch string, batch_no long").parquet(self._path("commits", "*"))
        return [r.batch for r in rows.orderBy("batch_no").collect()]

    def _read(self, part: str, schema: str) -> DataFrame:
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], schema)
        paths = [self._path(part, b) for b in done]
        if part != "changes":
            return self.spark.read.schema(schema).parquet(*paths)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in paths])

    def state(self, buckets: list[int] | None = None) -> DataFrame:
        """(doc_id, version, source, lang, n_tokens) of the documents that count now, or of those in some
        buckets; files of the others are not opened."""
        layers = self._read("changes", _STATE)
        layers = layers if buckets is None else layers.filter(F.col("bucket").isin(buckets))
        newest = layers.groupBy("doc_id", "version").agg(F.max("batch_no").alias("newest")).withColumnsRenamed(
            {"doc_id": "d", "version": "v"})
        return layers.join(newest, (F.col("doc_id") == F.col("d")) & (F.col("version") == F.col("v"))
                           & (F.col("batch_no") == F.col("newest"))).filter("op <> 'delete'").select(
            "doc_id", "version", "source", "lang", "n_tokens")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; False if it was committed before. ``changes`` has doc_id, version, op, source,
        lang, n_tokens, seq."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        done = self.batches()
        if batch in done:
            return False
        number = len(done)
        rows = changes.filter("doc_id is not null and version is not null").select(
            F.col("doc_id").cast("long"), F.col("version").cast("string"),
            F.expr("if(op in ('insert', 'delete', 'revise'), op, raise_error(concat('unknown op: ', coalesce(op, 'null'))))")
            .cast("string").alias("op"),
            F.col("source").cast("string"), F.col("lang").cast("string"),
            F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), F.col("seq").cast("long"))
        last = rows.groupBy("doc_id", "version").agg(
            F.max(F.struct("seq", "op", "source", "lang", "n_tokens")).alias("last")).select(
            "doc_id", "version", "last.op", "last.source", "last.lang", "last.n_tokens", F.lit(number).cast("long").alias("batch_no"),
            F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        last.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path("changes", batch))
        new = self.spark.read.schema(_STATE).parquet(self._path("changes", batch))
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]
        before = self.state(buckets).join(new.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
        signed = new.filter("op <> 'delete'").select("source", "lang", "version", "n_tokens", F.lit(1).alias("sign")).unionByName(
            before.select("source", "lang", "version", "n_tokens", F.lit(-1).alias("sign")))
        delta = signed.groupBy("source", "lang", "version").agg(
            F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        delta.filter("n_docs <> 0 or n_tokens <> 0").write.mode("overwrite").parquet(self._path("deltas", batch))
        self.spark.createDataFrame([(batch, number)], "batch string, batch_no long").coalesce(1).write.mode(
            "overwrite").parquet(self._path("commits", batch))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens): the sum of all committed deltas."""
        return self._read("deltas", _DELTA).groupBy("source", "lang", "version").agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0")


def scratch(spark: SparkSession) -> TokenRollup:
    """A rollup in a new folder of the shared scratch space."""
    return TokenRollup(spark, scratch_path(spark, "rollup"))


def counted(docs: DataFrame, patterns: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, version, n_tokens): matches of each version's pattern in each whole text."""
    counts = F.array(*[F.struct(F.lit(version).alias("version"), F.regexp_count(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(pattern)).cast("long").alias("n_tokens"))
        for version, pattern in patterns.items()])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "source", "lang", F.explode(counts).alias("c")).select(
        "doc_id", "source", "lang", "c.version", "c.n_tokens")
