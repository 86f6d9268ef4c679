"""Toxicity from two class-conditional Kneser-Ney models.

A word is read as bytes with a space before and after it; the models predict each byte from the
five before it. Toxic and ordinary rows have their own counts at that order; below it both back
off to the same Kneser-Ney continuation counts (orders 4 and 2, then uniform), so an expression
that is rare in one class is smoothed by what both classes share. A word's evidence is its
log-likelihood ratio, toxic against ordinary, divided by its length (plus a constant that tempers
very short words). Its onset is the ratio of its first six bytes alone: the bytes after a telling stem
are often rare, and what the models say of them is mostly chance. A document has the length-normalised
ratio of its whole text, its strongest and third strongest word, the positive part of the ratio, the
share of strong words, its strongest and third strongest onset, how many onsets exceed 2, 3 and 4 nats and
how many words it has (as logarithms, so the curve can weigh onsets against the length). A logistic
curve through these, fitted on labelled rows the counts have not seen, gives the score.

Counts come from all labelled training rows. The model is a stored table of all sequences and
contexts and grows with them. Its most frequent entries, ``held`` at most, are broadcast with their whole keys (16 bytes each): words all of whose
sequences are among them are done where they are read. If the table is larger than that, the other
words leave as (row, word, count); the distinct ones are cut into sequences that meet the whole table
in shuffle joins by key, are summed per word, and go back to their rows. Every entry counts either way.

The curve is cross-fitted: at most about ``calibration_rows`` rows of each class, drawn evenly by a
hash of the id, get their evidence from the counts of all training rows outside their own fold (of
``FOLDS``). All other texts get theirs from the counts of all training rows. These ``FOLDS`` + 1 models are
columns of one table, made in one pass over the counts.

Defined cases: null and empty texts and texts without words have evidence 0 and are scored by the
curve like others. Without rows of both classes every score is the share of toxic training rows
(0 without any). Null labels and ids are no training rows. Rows with the same id are scored each.
Words: runs of digits, letters in lower case, and anything beyond ASCII."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.llm import bloom, folds, rowkeys
from caselake.llm.textwords import LETTERS, Words, buffers, release, slices
from caselake.session import materialize

ORDER = 6
DISCOUNT = 0.75
CALIBRATION_ROWS = 20_000
FOLDS = 3
HELD = 1 << 21
_SHORT = 3
_STRONG = 0.3
#: An onset counts above each of these log-likelihood ratios.
_ONSETS = (2, 3, 4)
EVIDENCE = ["mean", "top", "third", "positive", "strong", "onset", "onset_third", *(f"onsets{x}" for x in _ONSETS), "size"]
#: Suffix of the columns of each model: the counts of all rows, and of all but one fold's.
MODELS = ["", *(f"_but_{f}" for f in range(FOLDS))]
_SUMS = ["ratio", "length", "positive", "strong", *(f"onsets{x}" for x in _ONSETS)]


def _words(texts: pa.Array) -> Words:
    data, offsets = buffers(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    return Words(data, offsets, LETTERS)


def grams(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six-byte sequences of the chosen words as numbers, and where each word's sequences begin (one
    more at the end). A word of m bytes has m + 1, the last one ends in the space after it."""
    starts, size = words.starts[chosen], words.ends[chosen] - words.starts[chosen]
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    place = places(at)
    starts, size = np.repeat(starts, size + 1), np.repeat(size, size + 1)
    # Room for the bytes before the first word and after the last.
    data = np.concatenate([np.zeros(ORDER, np.uint8), LETTERS[words.data], np.zeros(ORDER, np.uint8)])
    out = np.zeros(len(place), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        offset = place - back
        byte = np.where((offset >= 0) & (offset < size), data[starts + offset + ORDER], 0x20)
        out = (out << np.uint64(8)) | byte.astype(np.uint64)
    return out, at


def places(at: np.ndarray) -> np.ndarray:
    """Place of each sequence within its word, from where the words' sequences begin."""
    return np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))


def _distinct(words: Words):
    """One place of each distinct word, each word's number among them, and how often it occurs."""
    _, chosen, number, counts = np.unique(words.hashes, return_index=True, return_inverse=True, return_counts=True)
    return chosen, number, counts


def _counted(rows: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary), the counts with the suffixes MODELS, over all rows of (label, fold, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                toxic = np.asarray(part.column("label").fill_null(0)) > 0
                fold = np.asarray(part.column("fold"))
                for label, f in itertools.product((True, False), range(FOLDS)):
                    words = _words(part.column("text").filter(pa.array((toxic == label) & (fold == f))))
                    if not len(words.starts):
                        continue
                    chosen, _, counts = _distinct(words)
                    keys, at = grams(words, chosen)
                    unique, number = np.unique(keys, return_inverse=True)
                    n = np.bincount(number, np.repeat(counts, np.diff(at))).astype(np.int64)
                    zero = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), f, np.int32)), pa.array(unique.astype(np.int64)),
                         pa.array(n if label else zero), pa.array(zero if label else n)],
                        ["fold", "gram", "toxic", "ordinary"])

    found = rows.select("label", "fold", "text").mapInArrow(run, "fold int, gram long, toxic long, ordinary long")
    each = found.groupBy("gram").agg(*(
        F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("toxic", "ordinary")))
    return each.select("gram", *(
        sum((F.col(f"{c}{f}") for f in range(FOLDS) if m != f"_but_{f}"), F.lit(0)).cast("long").alias(f"{c}{m}")
        for m in MODELS for c in ("toxic", "ordinary")))


def _shared(counted: DataFrame, models=("",)) -> DataFrame:
    """(low_key, low): Kneser-Ney probability of a four-byte sequence's last byte after the three
    before it, from how many different sequences it ends, pooled over both classes. Of each model a column."""
    lower = None
    four = counted.select(F.expr("gram & 4294967295").alias("key"), *(F.expr(f"int(toxic{m} + ordinary{m} > 0)").alias(f"n{m}") for m in models))
    four = four.groupBy("key").agg(*(F.sum(f"n{m}").alias(f"n{m}") for m in models))
    two = four.groupBy(F.expr("key & 65535").alias("key")).agg(*(F.sum(F.expr(f"int(n{m} > 0)")).alias(f"n{m}") for m in models))
    for level in (two, four):
        context = Window.partitionBy("context")
        keyed = level.withColumn("context", F.expr("shiftright(key, 8)")).select(
            "*", *(F.sum(f"n{m}").over(context).alias(f"total{m}") for m in models),
            *(F.sum(F.expr(f"int(n{m} > 0)")).over(context).alias(f"kinds{m}") for m in models))
        if lower is None:
            keyed = keyed.select("*", *(F.lit(1 / 256).alias(f"low{m}") for m in models))
        else:
            keyed = keyed.join(lower, F.expr("key & 65535") == F.col("low_key"))
        lower = keyed.select(F.col("key").alias("low_key"), *((
            (F.greatest(F.col(f"n{m}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds{m}") * F.col(f"low{m}"))
            / F.nullif(F.col(f"total{m}"), F.lit(0))).alias(f"low{m}") for m in models))
    return lower


def ratios(counted: DataFrame, models=("",)) -> DataFrame:
    """(kind, key, value, weight): log-likelihood ratio of each seen sequence (kind 0) and of an unseen
    one after each seen context (kind 1). Values and weights have the suffixes ``models``, as the counts do;
    they are null where that model has no such entry."""
    classes = ("toxic", "ordinary")
    keyed = counted.join(_shared(counted, models), F.expr("gram & 4294967295") == F.col("low_key")).withColumn(
        "context", F.expr("shiftright(gram, 8)"))
    context = Window.partitionBy("context")
    # A context has 256 sequences at most.
    keyed = keyed.select("*", (F.row_number().over(context.orderBy("gram")) == 1).alias("leads"), *(
        x for m in models for c in classes for x in (
            F.sum(f"{c}{m}").over(context).alias(f"{c}_total{m}"),
            F.sum((F.col(f"{c}{m}") > 0).cast("long")).over(context).alias(f"{c}_kinds{m}"))))
    keyed = keyed.select("*", *(F.expr(f"if({c}_total{m} > 0, {DISCOUNT}D * {c}_kinds{m} / {c}_total{m}, 1D)").alias(f"{c}_left{m}")
                                for m in models for c in classes))
    seen, unseen = [F.lit(0).alias("kind"), F.col("gram").alias("key")], [F.lit(1).alias("kind"), F.col("context").alias("key")]
    for m in models:
        log = {c: F.ln(F.expr(f"if({c}_total{m} > 0, greatest({c}{m} - {DISCOUNT}D, 0D) / greatest({c}_total{m}, 1L), 0D)"
                              f" + {c}_left{m} * low{m}")) for c in classes}
        for entry, value, weight in ((seen, log["toxic"] - log["ordinary"], f"toxic{m} + ordinary{m}"), (
                unseen, F.ln(f"toxic_left{m}") - F.ln(f"ordinary_left{m}"), f"toxic_total{m} + ordinary_total{m}")):
            entry += [F.when(F.expr(f"{weight} > 0"), value).alias(f"value{m}"), F.expr(f"nullif({weight}, 0L)").alias(f"weight{m}")]
    entries = F.when(F.col("leads"), F.array(F.struct(*seen), F.struct(*unseen))).otherwise(F.array(F.struct(*seen)))
    return keyed.select(F.explode(entries).alias("entry")).select("entry.*")


def model_of(models: DataFrame, name: str) -> DataFrame:
    """(kind, key, value, weight) of one of the models of a stored table."""
    return models.filter(F.col(f"weight{name}").isNotNull()).select(
        "kind", "key", F.col(f"value{name}").alias("value"), F.col(f"weight{name}").alias("weight"))


class Held:
    """Sequences and contexts of a model with their values, by key; ``whole`` if they are all it has."""

    def __init__(self, rows: pa.Table, whole: bool):
        self.whole = whole
        kind, keys, values = (rows.column(c).to_numpy() for c in ("kind", "key", "value"))
        self.tables = []
        for k in (0, 1):
            order = np.flatnonzero(kind == k)
            order = order[np.argsort(keys[order])]
            self.tables.append((keys[order], values[order]))

    def find(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, values = self.tables[kind]
        if not len(have):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return have[at] == keys, values[at]

    def ratios(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ratio and onset of each word, and whether it is known: false if a sequence may be in the table's rest."""
        unique, number = np.unique(keys, return_inverse=True)
        seen, value = self.find(0, unique.astype(np.int64))
        if self.whole:
            known, left = self.find(1, (unique >> np.uint64(8)).astype(np.int64))
            value = np.where(seen, value, np.where(known, left, 0))
            seen = np.ones(len(unique), bool)
        value, begins = value[number], at[:-1]
        return (np.add.reduceat(value, begins), np.add.reduceat(np.where(places(at) < ORDER, value, 0), begins),
                np.logical_and.reduceat(seen[number], begins))


def held(model: DataFrame, most: int) -> Held:
    """The most frequent entries of the stored table ``model``, at most ``most``."""
    bins = model.groupBy("kind", F.floor(8 * F.log2("weight")).alias("bin")).count().collect()
    if sum(r["count"] for r in bins) <= most:
        return Held(model.select("kind", "key", "value").toArrow(), True)
    least, room = math.inf, most
    for r in sorted((r for r in bins if r.kind == 0), key=lambda r: -r.bin):
        room -= r["count"]
        if room < 0:
            break
        least = r.bin
    return Held(model.filter((F.col("kind") == 0) & (F.floor(8 * F.log2("weight")) >= F.lit(float(least)))).select(
        "kind", "key", "value").toArrow(), False)


def word_ratios(words: DataFrame, model: DataFrame) -> DataFrame:
    """(word_no, ratio, onset): a word's sequences, and its first six, summed over the model's table; a sequence
    that was not seen counts as an unseen one of its context, and as 0 after an unseen context."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.set_column(batch.schema.get_field_index("word"), "word",
                                                batch.column("word").cast(pa.large_binary()).view(pa.large_string())), "word"):
                data, offsets = buffers(part.column("word"))
                split = Words(data, offsets, LETTERS, hashed=False)
                keys, at = grams(split, np.arange(len(split.starts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.asarray(part.column("word_no")), np.diff(at))), pa.array(keys.astype(np.int64)),
                     pa.array((keys >> np.uint64(8)).astype(np.int64)), pa.array(places(at) < ORDER)],
                    ["word_no", "gram", "context", "early"])

    cut = words.select("word_no", "word").mapInArrow(run, "word_no long, gram long, context long, early boolean")
    seen = model.filter("kind = 0").select(F.col("key").alias("gram"), F.col("value").alias("seen"))
    left = model.filter("kind = 1").select(F.col("key").alias("context"), F.col("value").alias("left_over"))
    value = F.coalesce("seen", "left_over", F.lit(0.0))
    return cut.join(seen, "gram", "left").join(left, "context", "left").groupBy("word_no").agg(
        F.sum(value).alias("ratio"), F.sum(F.when(F.col("early"), value).otherwise(0.0)).alias("onset"))


def _largest(strength: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The three largest strengths of each text, which owns the words from ``begins`` to ``ends``."""
    # Sorted within each text: texts are a thousand apart, strengths at most a hundred.
    counts, shift = ends - begins, np.arange(len(begins)) * 1000.0
    rank = np.sort(np.repeat(shift, counts) + strength)
    return np.column_stack([np.where(counts > i, rank[np.maximum(ends - 1 - i, begins)] - shift, -np.inf) for i in range(3)])


def _read(docs: DataFrame, broadcast) -> DataFrame:
    """Rows of two sorts: for each text of (key, row_no, text) the sums over its known words and their
    three largest strengths and onsets; (row_no, word, n) for each word of it that is not known."""
    kind = docs.schema["key"].dataType.simpleString()
    names = ["row_no", "key", *_SUMS, "words", "most", "onsets", "word", "n"]

    def run(batches):
        held = broadcast.value
        for batch in batches:
            for part in slices(batch, "text"):
                words, rows = _words(part.column("text")), part.num_rows
                row_no, counts = np.asarray(part.column("row_no")), words.counts()
                filled = np.flatnonzero(counts)
                sums, most = np.zeros((len(_SUMS), rows)), np.full((2, rows, 3), -np.inf)
                chosen, number, _ = _distinct(words)
                if len(filled):
                    keys, at = grams(words, chosen)
                    ratio, onset, known = held.ratios(keys, at)
                    size = np.diff(at).astype(np.float64)
                    strength = np.where(known, np.clip(ratio / (size + _SHORT), -50, 50), -100)[number]
                    onset = np.where(known, np.clip(onset, -50, 50), -100)[number]
                    ratio = np.where(known, ratio, 0)[number]
                    begins, ends = words.first[:-1][filled], words.first[1:][filled]
                    for i, x in enumerate((ratio, size[number], np.maximum(ratio, 0), (strength > _STRONG).astype(float),
                                           *((onset > least).astype(float) for least in _ONSETS))):
                        sums[i, filled] = np.add.reduceat(x, begins)
                    for i, x in enumerate((strength, onset)):
                        most[i, filled] = _largest(x, begins, ends)
                offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * 3)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_no"), part.column("key"), *(pa.array(x) for x in sums), pa.array(counts.astype(np.int64)),
                     *(pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in most), pa.nulls(rows, pa.binary()),
                     pa.nulls(rows, pa.int64())], names)
                if not len(filled) or known.all():
                    continue
                place = np.flatnonzero(~known[number])
                owner = np.searchsorted(words.first, place, "right") - 1
                pairs, n = np.unique(owner * len(chosen) + number[place], return_counts=True)
                owner, word = pairs // len(chosen), chosen[pairs % len(chosen)]
                folded = LETTERS[words.data].tobytes()
                spelt = pa.array([folded[a:b] for a, b in zip(words.starts[word].tolist(), words.ends[word].tolist())], pa.binary())
                none = pa.nulls(len(n), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row_no[owner]), pa.nulls(len(n), part.column("key").type), *[none] * len(_SUMS), pa.nulls(len(n), pa.int64()),
                     *[pa.nulls(len(n), pa.list_(pa.float64()))] * 2, spelt, pa.array(n.astype(np.int64))], names)

    return docs.select("row_no", "key", "text").mapInArrow(
        run, f"row_no long, key {kind}, {', '.join(f'{c} double' for c in _SUMS)}, words long, "
             "most array<double>, onsets array<double>, word binary, n long")


def evidence(docs: DataFrame, model: DataFrame, most: int = HELD) -> DataFrame:
    """``key`` and the columns EVIDENCE for each row of (key, text) under the stored table ``model``."""
    part = held(model, most)
    whole, sent = part.whole, docs.sparkSession.sparkContext.broadcast(part)
    # What collecting and pickling the model took goes back; the driver keeps one copy.
    release()
    rows = _read(docs.withColumn("row_no", F.monotonically_increasing_id()), sent)
    if not whole:
        rows = materialize(rows, "op9-read")
        open_words = rows.filter("word is not null").select("row_no", "word", "n")
        words = materialize(open_words.select("word").distinct().select(
            F.monotonically_increasing_id().alias("word_no"), "word"), "op9-words")
        valued = materialize(words.join(word_ratios(words, model), "word_no").select("word", "ratio", "onset"), "op9-ratios")
        strength = F.expr(f"least(greatest(ratio / (octet_length(word) + 1 + {_SHORT}), -50D), 50D)")
        thrice = lambda c: F.flatten(F.collect_list(F.expr(f"array_repeat({c}, cast(least(n, 3L) as int))")))
        late = open_words.join(valued, "word").withColumn("strength", strength).withColumn(
            "onset", F.expr("least(greatest(onset, -50D), 50D)")).groupBy(F.col("row_no").alias("late_row")).agg(
            F.sum(F.col("ratio") * F.col("n")).alias("late_ratio"),
            F.sum(F.greatest("ratio", F.lit(0.0)) * F.col("n")).alias("late_positive"),
            F.sum(F.when(F.col("strength") > _STRONG, F.col("n")).otherwise(0)).alias("late_strong"),
            *(F.sum(F.when(F.col("onset") > least, F.col("n")).otherwise(0)).alias(f"late_onsets{least}") for least in _ONSETS),
            thrice("strength").alias("late_most"), thrice("onset").alias("late_onsets"))
        # A word that was left open stands among the three with -100, below every real strength.
        rows = rows.filter("word is null").join(late, F.col("row_no") == F.col("late_row"), "left").select(
            "key", "length", "words", *[(F.col(c) + F.coalesce(f"late_{c}", F.lit(0))).alias(c) for c in _SUMS if c != "length"],
            *[F.sort_array(F.concat(c, F.coalesce(f"late_{c}", F.expr("array()").cast("array<double>"))), False).alias(c)
              for c in ("most", "onsets")])
    filled, third = F.col("words") > 0, "cast(least(words, 3L) as int) - 1"
    return rows.select("key", *[F.when(filled, x).otherwise(0.0).alias(c) for c, x in zip(EVIDENCE, (
        F.expr("ratio / nullif(length, 0D)"), F.expr("most[0]"), F.expr(f"most[{third}]"),
        F.expr("positive / nullif(length, 0D)"), F.expr("strong / nullif(words, 0L)"),
        F.expr("onsets[0]"), F.expr(f"onsets[{third}]"), *(F.log1p(f"onsets{least}") for least in _ONSETS),
        F.log1p("words")), strict=True)])


def fitted(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic curve (weights and bias) by Newton's method on standardised columns."""
    centre, scale = rows.mean(0), np.maximum(rows.std(0), 1e-9)
    x = np.column_stack([(rows - centre) / scale, np.ones(len(rows))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * rows.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * centre / scale).sum())


def _scored(texts: DataFrame, labels: DataFrame, label: str, parts: int, held: int, threshold: float,
            calibration_rows: int) -> DataFrame:
    """Rows of (key, doc_id, text) as key, score, predicted and EVIDENCE."""
    train = materialize(folds.training_labels(labels, label, parts, held), "op9-labels")
    counts = dict(train.groupBy("label").count().collect())
    rows = sum(counts.values())
    toxic = counts.get(1, 0)
    if not toxic or toxic == rows:
        return texts.select("key", F.lit(toxic / rows if rows else 0.0).alias("score"),
                            F.lit(int(bool(toxic) and 1 >= threshold)).alias("predicted"),
                            *(F.lit(0.0).alias(c) for c in EVIDENCE))
    learnt = materialize(folds.labelled(texts.select("doc_id", "text"), train).withColumn(
        "fold", F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(FOLDS)).cast("int")), "op9-rows")
    models = materialize(ratios(materialize(_counted(learnt), "op9-counts"), MODELS), "op9-models")
    drawn = F.when(F.col("label") == 1, folds.share("doc_id", "draw", calibration_rows / toxic)).otherwise(
        folds.share("doc_id", "draw", calibration_rows / (rows - toxic)))
    sample = []
    for fold in range(FOLDS):
        chosen = learnt.filter(drawn & (F.col("fold") == fold)).select(F.col("label").alias("key"), "text")
        sample.append(evidence(chosen, model_of(models, f"_but_{fold}")).toPandas())
        release()
    sample = pd.concat(sample)
    w = fitted(sample[EVIDENCE].to_numpy(), sample["key"].to_numpy(float)) if sample["key"].nunique() > 1 \
        else np.array([0.0, 2.0, *[0.0] * (len(EVIDENCE) - 2), math.log(toxic / (rows - toxic))])
    line = sum((F.col(c) * float(x) for c, x in zip(EVIDENCE, w)), F.lit(float(w[-1])))
    return evidence(texts.select("key", "text"), model_of(models, "")).withColumn("score", 1 / (1 + F.exp(-line))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
          parts: int = 3, held: int = 1, threshold: float = 0.7, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted and the columns EVIDENCE.
    Rows whose id's crc32 leaves ``held`` modulo ``parts`` are never learnt from."""
    texts = docs.select(F.col(id_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _scored(texts, labels, label, parts, held, threshold, calibration_rows).withColumnRenamed("key", "doc_id").select(
        "doc_id", (folds.remainder("doc_id", parts) == held).alias("held_out"), "score", "predicted", *EVIDENCE)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
               parts: int = 3, held: int = 1, threshold: float = 0.7, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """``docs`` without the rows predicted toxic. Rows are matched by their place in the files of the table (one
    that is not stored is stored first), so only those that may go are moved."""
    docs = rowkeys.stored(docs, "op9-docs")
    texts = docs.select(rowkeys.row_key().alias("key"), F.col(id_col).alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
    gone = materialize(_scored(texts, labels, label, parts, held, threshold, calibration_rows).filter(
        "predicted = 1").select(F.col("key").alias("__gone")), "op9-gone")
    numbered = rowkeys.with_key(docs, "__key")
    sure, possible = bloom.apart(numbered, "__key", gone, "__gone", "op9-gone")
    return sure.unionByName(possible.join(gone, F.col("__key") == F.col("__gone"), "left_anti")).drop("__key")
