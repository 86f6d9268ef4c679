"""Whitening of embeddings by a covariance that counts each distinct vector once, with its multiplicity.

Entries become whole numbers x = floor(1024 c) + 100000, so equal vectors are found exactly. Rows with one
x are one group: its weight in the fit is its number of rows (or one, ``weighted=False``). Sums S are exact
whole numbers; the covariance is a weighted product of matrices in each task over entries centred
first (n x - S in whole numbers, then divided by n). Each task returns one matrix of dims x dims; these are
added row by row in Spark, and the driver gets the sum alone for the eigenvectors. Each distinct vector
is whitened once and joined back to its rows by the SHA-256 of x.

Size: what moves is one copy of each distinct vector per task, a digest per row, and dims^2 numbers per
task. A vector with a third of all rows is one group of one row; its rows meet it in a join on narrow
rows, which Spark splits. The driver holds dims^2 numbers, and ``MOST_DIMS`` bounds dims.

Defined cases. Null and empty vectors and those with a null, NaN or infinite entry are left out. Null or
repeated ids are rows like others. Vectors of different lengths have no common covariance: an error. An
entry whose x, or a deviation that does not fit into 64 bits is an error. A component without variance
(eigenvalue not above 1e-12 of the largest; all of them for a single distinct vector) has ``whitened``
null, ``explained`` 0, and is left out of ``identity_error``, which is 0 if none is left. An empty table
gives an empty result. Other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.session import materialize

SCALE, SHIFT = 1024, 100000
COMPONENTS = 8
MOST_DIMS = 4096
#: Entries that a task works on at once.
BLOCK = 1 << 19
_LEAST_SHARE = 1e-12


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x, digest of the rows that take part."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    kept = rows.filter(vector.isNotNull() & (F.size(vector) > 0) & finite).select(F.col(id_col).alias("vec_id"), x.alias("x"))
    return kept.select("*", F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256).alias("digest"))


def _blocks(batches):
    """The batches in pieces of at most ``BLOCK`` entries, which bounds a task's matrices."""
    for batch in batches:
        x = batch.column(batch.schema.get_field_index("x"))
        step = max(1, BLOCK // max(1, len(x[0]) if len(x) else 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows and their weights."""
    flat = batch.column(batch.schema.get_field_index("x")).flatten()
    return np.asarray(flat).reshape(batch.num_rows, -1), np.asarray(batch.column(batch.schema.get_field_index("weight")))


def _sums(distinct: DataFrame) -> list[int]:
    """Exact weighted sum of each dimension."""
    def run(batches):
        total = 0
        for batch in _blocks(batches):
            x, w = _matrix(batch)
            if x.size and float(np.abs(x).max()) * float(w.sum()) >= 2.0 ** 62:
                raise OverflowError("the sum of a dimension does not fit into 64 bits")
            total = total + w @ x
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["dim", "s"])

    parts = distinct.select("x", "weight").mapInArrow(run, "dim int, s long")
    return [int(r.s) for r in parts.groupBy("dim").agg(F.sum("s").alias("s")).orderBy("dim").collect()]


def _covariance(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Weighted covariance (divisor n); each task adds one matrix, its rows are added by Spark."""
    s = np.array(sums, np.int64)

    def run(batches):
        total = np.zeros((len(s), len(s)))
        for batch in _blocks(batches):
            x, w = _matrix(batch)
            centred = (n * x - s) / n
            total += (centred * w[:, None]).T @ centred
        rows = pa.array(total.ravel())
        offsets = pa.array(np.arange(len(s) + 1, dtype=np.int32) * len(s))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s), dtype=np.int32)), pa.ListArray.from_arrays(offsets, rows)],
                                         ["dim", "row"])

    def added(key, table):
        rows = table.column("row").combine_chunks().flatten()
        total = np.asarray(rows).reshape(table.num_rows, -1).sum(0)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([total], pa.list_(pa.float64()))})

    parts = distinct.select("x", "weight").mapInArrow(run, "dim int, row array<double>")
    summed = parts.groupBy("dim").applyInArrow(added, "dim int, row array<double>")
    return np.array([r.row for r in summed.orderBy("dim").collect()]) / n


def eigen(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues, falling, their unit eigenvectors as rows, and the trace."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][:most]
    chosen = vectors[:, order].T
    # Either sign is right; the largest entry is made positive so that a rerun gives the same.
    signs = np.sign(chosen[np.arange(len(order)), np.abs(chosen).argmax(1)])
    return values[order], chosen * signs[:, None], float(np.trace(covariance))


def _whitened(distinct: DataFrame, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """digest, weight, deviation and the whitened components of each distinct vector."""
    s, usable = np.array(sums, np.int64), values > max(values[0], 0) * _LEAST_SHARE
    scaled = np.zeros_like(vectors)
    scaled[usable] = vectors[usable] / np.sqrt(values[usable])[:, None]

    def run(batches):
        for batch in _blocks(batches):
            x, w = _matrix(batch)
            apart = n * x - s
            most = float(np.abs(apart).max()) if apart.size else 0.0
            if most * most * len(s) < 2.0 ** 62:
                deviation = (apart * apart).sum(1)
            else:  # Python's whole numbers; Arrow refuses what does not fit into 64 bits
                deviation = [sum(v * v for v in row) for row in apart.tolist()]
            out = (apart / n) @ scaled.T
            mask = np.broadcast_to(~usable, out.shape).ravel()
            flat = pa.array(out.ravel(), pa.float64(), mask=mask)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("digest")), pa.array(w), pa.array(deviation, pa.int64()),
                 pa.ListArray.from_arrays(offsets, flat)], ["digest", "weight", "deviation", "whitened"])

    return distinct.select("digest", "x", "weight").mapInArrow(run, "digest string, weight long, deviation long, whitened array<double>")


def _identity_error(whitened: DataFrame, n: int, used: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance, centred first, minus the identity."""
    if not used:
        return 0.0
    value = [F.get("whitened", i) for i in range(used)]
    means = list(whitened.agg(*[(F.sum(F.col("weight") * v) / n).alias(f"m{i}") for i, v in enumerate(value)]).first())
    pairs = [(i, j) for i in range(used) for j in range(i, used)]
    products = whitened.agg(*[(F.sum(F.col("weight") * (value[i] - means[i]) * (value[j] - means[j])) / n).alias(f"c{i}_{j}")
                              for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(products, pairs))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           weighted: bool = True) -> DataFrame:
    """One row per remaining row and component: vec_id, component (from 1), n (fit rows), deviation (sum of
    (n x - S)^2, exact), whitened, explained (share of the variance), identity_error."""
    vectors = valid_vectors(rows, id_col, vector_col)
    counted = vectors.groupBy("x", "digest").agg(F.count(F.lit(1)).alias("rows"))
    distinct = materialize(counted.select("x", "digest", F.col("rows").alias("weight") if weighted else F.lit(1).cast("long").alias("weight")),
                           "whitening-distinct")
    n, least, most = distinct.agg(F.sum("weight"), F.min(F.size("x")), F.max(F.size("x"))).first()
    narrow = vectors.select("vec_id", "digest")
    if n is None:
        return narrow.select("vec_id", F.lit(0).alias("component"), *[F.lit(0).cast(kind).alias(c) for c, kind in (
            ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    if least != most or most > MOST_DIMS:
        raise ValueError(f"vectors need one length of at most {MOST_DIMS}; found {least} to {most}")
    sums = _sums(distinct)
    values, chosen, trace = eigen(_covariance(distinct, n, sums), components)
    done = materialize(_whitened(distinct, n, sums, values, chosen), "whitening-done")
    used = int((values > max(values[0], 0) * _LEAST_SHARE).sum())
    error = _identity_error(done, n, used)
    share = F.array(*[F.lit(float(v / trace) if i < used else 0.0) for i, v in enumerate(values)])
    joined = narrow.join(done, "digest").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return joined.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                         F.get(share, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
