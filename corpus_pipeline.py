"""Corpus pipeline: the stages that turn raw documents into clean, tokenized ones."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from caselake.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from caselake.llm.textwords import bounded_batches
from caselake.session import materialize

# In every stage: texts are whole; a null or empty text has no words; rows are told apart by their place
# in the stored table, so null and repeated ids are rows like others; further columns come back as they
# were, whatever their names; an empty table gives an empty one.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go. Labels without an id or a value are not learnt from; without labels
    of both classes the score is the same for all and none goes. Null and empty texts stay."""
    bounded_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays, null ids last; of rows that share id and text exactly
    one. A null text equals an empty one."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more the one with the smallest id stays, null ids
    last. Texts without words are linked with none and stay."""
    bounded_batches(spark)
    return ngram_join.drop_near_copies(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; a document that is mostly such passages goes. Items without words
    mark nothing; documents without words stay."""
    bounded_batches(spark)
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.remove_spans(docs, found)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers) and their decoded text, one row per document; none
    and empty for a text without words. Other columns are not read."""
    bounded_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_benchmark_passages),
    ("bpe", tokenize),
]

#: Language models and tokens have no SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
