"""Document quality from pairwise preferences (Bradley-Terry).

A document is described by surface features (lengths, shares of character classes, repetition). A
pair is a labelled good and a labelled bad document; the model says that the good one is preferred
with probability sigmoid(score difference), so the weights are learnt by logistic loss on feature
differences. The threshold is a quantile of the scores of all training rows: the share of bad ones
among them lies below it.

Features are computed for every whole text in one scan; what is joined with labels and kept for
the threshold are rows of a few numbers. The weights are fitted on the driver on at most about
``sample_rows`` rows of each class (drawn evenly by a hash of the id) and ``pairs`` pairs of them.

Defined cases: null and empty texts have all features 0 and are scored like others. Without rows of
both classes every score is the share of good training rows (0.5 without any). Null labels and ids
are no training rows. Rows with the same id are scored each."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.llm import folds
from caselake.llm.textwords import LETTERS, UNSPACED, Words, buffers, mix, slices
from caselake.session import materialize

SAMPLE_ROWS = 20_000
PAIRS = 200_000
FEATURES = ["log_bytes", "upper", "digit", "other", "bang", "bar", "mark", "space", "comma_stop", "line", "word_bytes",
            "word_spread", "distinct", "repeat", "distinct_line", "letters_of_word", "capital", "log_words"]


def _classes() -> np.ndarray:
    """Number of the class of each byte: letters and the rest 0."""
    table = np.zeros(256, np.uint8)
    for number, members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|<>{}[]=_\\/",
                                      b"#$%&*@^~+", b" \t", b".,;:'\"-()", b"\r\n"), 1):
        table[list(members)] = number
    return table


_CLASS = _classes()


def _distinct(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct keys of each text, given the index of each text's first key."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    bits = np.uint64(max(1, int(len(counts)).bit_length()))
    packed = np.sort((owner << (np.uint64(64) - bits)) | (keys >> bits))
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    return np.bincount((packed[new] >> (np.uint64(64) - bits)).astype(np.int64), minlength=len(counts))


def features(texts: pa.Array) -> np.ndarray:
    """One row per text, columns as in FEATURES."""
    data, offsets = buffers(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    safe = np.maximum(size, 1)
    classes = _CLASS[data]
    shares = {}
    for number in range(1, 9):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(classes == number, out=total[1:])
        shares[number] = (total[offsets[1:]] - total[offsets[:-1]]) / safe
    words = Words(data, offsets, UNSPACED)
    counts = words.counts()
    some = np.maximum(counts, 1)
    length = (words.ends - words.starts).astype(np.float64)
    def per_text(values):
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[words.first[1:]] - total[words.first[:-1]]
    mean = per_text(length) / some
    spread = np.sqrt(np.maximum(per_text(length ** 2) / some - mean ** 2, 0))
    again = np.zeros(len(length))
    if len(length):
        again[1:] = words.hashes[1:] == words.hashes[:-1]
        first = words.first[:-1]
        again[first[first < len(again)]] = 0
    capital = (words.data[words.starts] >= 0x41) & (words.data[words.starts] <= 0x5A) if len(length) else length
    pure = Words(data, offsets, LETTERS, hashed=False)
    letter_bytes = (pure.ends - pure.starts).astype(np.float64)
    total = np.concatenate([[0.0], np.cumsum(letter_bytes)])
    letters = (total[pure.first[1:]] - total[pure.first[:-1]]) / np.maximum(per_text(length), 1)
    lines = np.arange(256, dtype=np.uint8)
    lines[[0x0A, 0x0D]] = 0
    lines[0] = 1
    by_line = Words(data, offsets, lines)
    line_counts = np.maximum(by_line.counts(), 1)
    columns = [np.log1p(size), shares[1], shares[2], 1 - sum(shares.values()), shares[3], shares[4], shares[5], shares[6],
               shares[7], np.log1p(line_counts) / np.log1p(safe), mean, spread, _distinct(words.hashes, words.first) / some,
               per_text(again) / some, _distinct(by_line.hashes, by_line.first) / line_counts, letters,
               per_text(capital) / some, np.log1p(counts)]
    out = np.column_stack(columns) if n else np.zeros((0, len(FEATURES)))
    out[size == 0] = 0
    return out


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of rows (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = features(part.column("text"))
                flat = pa.array(rows.astype(np.float32).ravel())
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, features array<float>")


def fit(good: np.ndarray, bad: np.ndarray, pairs: int, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights that make good documents win their pairs: logistic loss on feature differences,
    Newton's method. The pairs are drawn with a fixed seed."""
    draw = np.random.default_rng(7)
    x = good[draw.integers(0, len(good), pairs)] - bad[draw.integers(0, len(bad), pairs)]
    w = np.zeros(x.shape[1])
    penalty = ridge * len(x) * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (1 - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def widened(rows: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and their squares, both kept within bounds so that no single odd text
    outweighs the rest."""
    z = np.clip((rows - centre) / scale, -6, 6)
    return np.hstack([z, z ** 2 / 6])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
          parts: int = 5, held: int = 0, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS,
          pairs: int = PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, preference (the raw score).
    ``score`` is the logistic curve through ``threshold`` at the quantile."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(described(texts), "op3-features")
    train = materialize(folds.training_labels(labels, label, parts, held).join(
        rows, F.col("label_id") == F.col("doc_id")).select("doc_id", "label", "features"), "op3-train")
    counts = dict(train.groupBy("label").count().collect())
    total, good = sum(counts.values()), counts.get(1, 0)
    held_out = (folds.remainder("doc_id", parts) == held).alias("held_out")
    if not good or good == total:
        value = good / total if total else 0.5
        return rows.select("doc_id", held_out, F.lit(value).alias("score"), F.lit(int(value >= threshold)).alias("predicted"),
                           F.lit(0.0).alias("preference"))
    drawn = F.when(F.col("label") == 1, folds.share("doc_id", "draw", sample_rows / good)).otherwise(
        folds.share("doc_id", "draw", sample_rows / (total - good)))
    sample = train.filter(drawn).select("label", "features").toPandas()
    x, y = np.stack(sample["features"].to_numpy()).astype(float), sample["label"].to_numpy()
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    wide = widened(x, centre, scale)
    w = fit(wide[y == 1], wide[y == 0], pairs) if 0 < y.sum() < len(y) else np.zeros(wide.shape[1])

    def run(batches):
        for batch in batches:
            flat = batch.column(batch.schema.get_field_index("features"))
            x = np.asarray(flat.flatten()).reshape(len(flat), -1).astype(float)
            raw = widened(x, centre, scale) @ w if len(x) else np.zeros(0)
            rest = [c for c in batch.schema.names if c != "features"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in rest] + [pa.array(raw)],
                                             [*rest, "preference"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = train.mapInArrow(run, f"doc_id {kind}, label int, preference double").agg(
        F.percentile_approx("preference", F.lit((total - good) / total), F.lit(100_000))).first()[0]
    value = 1 / (1 + F.exp(-(F.col("preference") - float(cut)) - math.log(threshold / (1 - threshold))))
    return rows.mapInArrow(run, f"doc_id {kind}, preference double").select(
        "doc_id", held_out, F.when(F.col("preference") >= float(cut), F.greatest(value, F.lit(threshold))).otherwise(
            F.least(value, F.lit(math.nextafter(threshold, 0)))).alias("score"),
        (F.col("preference") >= float(cut)).cast("int").alias("predicted"), "preference")
