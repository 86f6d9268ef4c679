"""Jaccard join on word n-grams with Bayesian candidate pruning.

1. Documents with the same set of n-grams form a class; its smallest id stands for it from here.
2. MinHash values of a representative are cut into bands; representatives that share a band are
   candidates. Bands only link each member with the smallest one (a star), and the components of
   these links are clusters: every pair that shares a band lies inside one cluster.
3. A cluster is worked on in blocks of bounded size, one task per pair of blocks. Candidate pairs
   compare their MinHash values step by step; after each step a pair is dropped if the posterior
   probability (uniform prior) that its similarity reaches the threshold is below ``tolerance``.
   The pairs left are compared exactly on their whole sets. Pairs never become rows: a task returns
   each document's number of links and a spanning forest of them.
4. Components of the forests are the groups of near-duplicates.

Loss, for independent MinHash values: a pair at exactly the threshold 0.8 shares no band with
probability (1 - 0.8^4)^24 = 3.2e-6. ``tolerance`` bounds a posterior, not the loss of true links; that
is a binomial sum (``lost``): at the default a pair at 0.8 is dropped with probability below 4e-8 at each
step and 1.4e-7 over all steps, a more similar one more rarely. Pairs that are reported are exact.

Scale: what moves are 24 narrow rows per representative (a Bloom filter of the other documents keeps
them where they are), the texts of documents in a cluster, and their sets, made where the text has met its
place, once for each block of their cluster. A cluster larger than a block is split over tasks; counting links
inside it compares its blocks pairwise, which the result (links per document) asks for.

Words: runs of digits, A-Z in lower case, a-z and everything from 0x80 on. A text with fewer words
than ``n`` has one n-gram of all its words. Null texts and texts without words have no n-grams, no
links, and are groups of their own. Every row is a document of its own: one without an id, and one whose id
stands in an earlier row, is compared like the others under a number that is larger than all ids, and
comes back with its own id; its group has the smallest id of the others, or its own. Rows are matched by
their place in the files of the table (``rowkeys``); one that is not stored is stored first. An empty
table gives an empty result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.llm import bloom, rowkeys
from caselake.llm.components import components
from caselake.llm.textwords import LETTERS, mix, release, sequence_hashes, slices, words_of
from caselake.session import materialize

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
TOLERANCE = 3e-8
#: A block holds about so many documents and n-grams at most.
BLOCK, BLOCK_GRAMS = 512, 1 << 20
_KEYS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32)
_XOR, _ODD = _KEYS[:BANDS * ROWS], _KEYS[BANDS * ROWS:] | np.uint32(1)


def shingle_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, and where each text's begin (one more at the end)."""
    words = words_of(texts, LETTERS)
    counts = words.counts()
    grams = sequence_hashes(words.hashes, n)
    full = np.maximum(counts - n + 1, 0)
    owner = np.repeat(np.arange(len(counts)), full)
    at = np.concatenate([[0], np.cumsum(full)])
    keys = grams[words.first[:-1][owner] + np.arange(at[-1]) - at[:-1][owner]]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        alone = np.array([mix(np.bitwise_xor.reduce(words.hashes[words.first[i]:words.first[i + 1]]
                              * mix(np.arange(1, counts[i] + 1, dtype=np.uint64)), keepdims=True))[0] for i in short])
        owner, keys = np.concatenate([owner, short]), np.concatenate([keys, alone])
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    owner, keys = owner[new], keys[new]
    return keys, np.searchsorted(owner, np.arange(len(counts) + 1))


def minhashes(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of BANDS * ROWS values per set that is not empty."""
    begins = first[:-1]
    out = np.empty((len(begins), BANDS * ROWS), np.uint32)
    small = (keys >> np.uint64(32)).astype(np.uint32) ^ keys.astype(np.uint32)
    for i in range(BANDS * ROWS):
        v = (small ^ _XOR[i]) * _ODD[i]
        v ^= v >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(v, begins)
    return out


def _described(docs: DataFrame, n: int) -> DataFrame:
    """row_no, doc_id, size, two hashes of the set and the band hashes of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys, first = shingle_sets(part.column("text"), n)
                size = np.diff(first)
                filled = np.flatnonzero(size)
                rows = part.num_rows
                sets, bands = np.zeros((rows, 2), np.uint64), np.zeros((rows, BANDS), np.uint64)
                if len(filled):
                    begins = first[:-1][filled]
                    sets[filled] = np.column_stack([np.add.reduceat(keys, begins), np.add.reduceat(mix(keys), begins)])
                    values = minhashes(keys, np.append(begins, first[-1])).astype(np.uint64)
                    for b in range(BANDS):
                        own = values[:, b * ROWS:(b + 1) * ROWS]
                        bands[filled, b] = sequence_hashes(
                            np.column_stack([own, np.full((len(own), 1), b)]).ravel().astype(np.uint64), ROWS + 1)[::ROWS + 1]
                offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_no"), part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(sets[:, 0].view(np.int64)),
                     pa.array(sets[:, 1].view(np.int64)),
                     pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64)))],
                    ["row_no", "doc_id", "size", "set_a", "set_b", "bands"])

    return docs.mapInArrow(run, f"row_no {rowkeys.KEY_TYPE}, doc_id {kind}, size long, set_a long, set_b long, bands array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with the set of each text as bytes instead of the text."""
    others = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys, first = shingle_sets(part.column("text"), n)
                data = pa.py_buffer(keys.tobytes())
                offsets = pa.py_buffer((first * 8).astype(np.int64).tobytes())
                packed = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, offsets, data])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), packed.cast(pa.binary())], [*others, "grams"])

    return docs.mapInArrow(run, f"{fields}, grams binary")


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer, the posterior probability of a similarity of at
    least ``threshold`` is below ``tolerance``. Uniform prior: the posterior after m of n matches is
    Beta(m + 1, n - m + 1), whose upper tail is a binomial sum."""
    def tail(m, n):
        return sum(math.comb(n + 1, k) * threshold ** k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    steps = range(16, BANDS * ROWS + 1, 16)
    return [(n, next(m for m in range(n + 1) if tail(m, n) >= tolerance)) for n in steps]


def lost(needed: list[tuple[int, int]], similarity: float) -> float:
    """Probability that the steps drop a pair of this similarity (independent MinHash values)."""
    left, done, gone = {0: 1.0}, 0, 0.0
    for n, least in needed:
        after: dict[int, float] = {}
        for m, p in left.items():
            for k in range(n - done + 1):
                after[m + k] = after.get(m + k, 0.0) + p * math.comb(n - done, k) * similarity ** k * (1 - similarity) ** (n - done - k)
        gone += sum(p for m, p in after.items() if m < least)
        left, done = {m: p for m, p in after.items() if m >= least}, n
    return gone


class _Side:
    """Documents of one block: sets, sizes, MinHash values."""

    def __init__(self, rows: pa.Table):
        self.ids = np.asarray(rows.column("doc_id"))
        self.weight = np.asarray(rows.column("copies"))
        packed = rows.column("grams").combine_chunks().cast(pa.large_binary())
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in packed]
        self.size = np.array([len(x) for x in raw])
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.keys = np.concatenate(raw)
        self.values = minhashes(self.keys, self.first)


def _compare(x: _Side, y: _Side, same: bool, threshold: float, needed) -> tuple:
    """Exact links between two blocks, as index arrays."""
    left, right = [], []
    vocabulary, codes = np.unique(np.concatenate([x.keys, y.keys]), return_inverse=True)
    of_x, of_y = codes[:len(x.keys)], codes[len(x.keys):]
    marked = np.zeros(len(vocabulary), bool)
    for i in range(len(x.ids)):
        others = np.arange(i + 1 if same else 0, len(y.ids))
        others = others[np.minimum(x.size[i], y.size[others]) >= threshold * np.maximum(x.size[i], y.size[others])]
        done, matches = 0, np.zeros(len(others), np.int64)
        for n, least in needed:
            if not len(others):
                break
            matches += (y.values[others, done:n] == x.values[i, done:n]).sum(1)
            stay = matches >= least
            others, matches, done = others[stay], matches[stay], n
        if not len(others):
            continue
        own = of_x[x.first[i]:x.first[i + 1]]
        marked[own] = True
        size = y.size[others]
        at = np.concatenate([[0], np.cumsum(size)])
        places = np.repeat(y.first[others] - at[:-1], size) + np.arange(at[-1])
        common = np.add.reduceat(marked[of_y[places]].astype(np.int64), at[:-1])
        marked[own] = False
        # J >= t as whole numbers where t is a fraction of thousandths.
        t = round(threshold * 1000)
        hit = others[common * 1000 >= t * (x.size[i] + size - common)]
        left.append(np.full(len(hit), i))
        right.append(hit)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) of a spanning forest of the links."""
    up: dict = {}

    def find(v):
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for u, v in zip(a.tolist(), b.tolist()):
        u, v = find(u), find(v)
        if u != v:
            up[max(u, v)] = min(u, v)
    return [(v, find(v)) for v in list(up) if find(v) != v]


def _blocks_compared(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Per pair of blocks: (doc_id, links) and (doc_id, root) rows."""
    needed = least_matches(threshold, tolerance)

    def run(rows: pa.Table) -> pa.Table:
        release()  # what the blocks before have left
        side = np.asarray(rows.column("block"))
        numbers = np.unique(side)
        x = _Side(rows.filter(pa.array(side == numbers[0])))
        if len(numbers) > 1:
            y, same = _Side(rows.filter(pa.array(side == numbers[1]))), False
        else:
            y, same = x, True
        first = rows.column("first_block")[0].as_py()
        if same and first != rows.column("second_block")[0].as_py():
            a = b = np.zeros(0, np.int64)  # the other block is empty
        else:
            a, b = _compare(x, y, same, threshold, needed)
        ids, counts = np.concatenate([x.ids, y.ids]), np.zeros(len(x.ids) + len(y.ids), np.int64)
        np.add.at(counts, a, y.weight[b])
        np.add.at(counts, b + len(x.ids), x.weight[a])
        linked = counts > 0
        forest = _forest(x.ids[a], y.ids[b])
        nodes = np.array([v for v, _ in forest], np.int64)
        roots = np.array([r for _, r in forest], np.int64)
        return pa.table({
            "doc_id": np.concatenate([ids[linked], nodes]),
            "links": np.concatenate([counts[linked], np.zeros(len(nodes), np.int64)]),
            "root": pa.array(np.concatenate([np.zeros(linked.sum(), np.int64), roots]),
                             mask=np.concatenate([np.ones(linked.sum(), bool), np.zeros(len(nodes), bool)]))})

    return members.groupBy("cluster", "first_block", "second_block").applyInArrow(run, "doc_id long, links long, root long")


_LAST = (1 << 63) - 1


def _odd_rows(rows: DataFrame) -> DataFrame:
    """Rows without an id and those whose id stands in an earlier row: odd_row, odd_id and a number of its own
    for each, counted down from the largest, which stands in for the id."""
    again = rows.filter("doc_id is not null").groupBy(F.col("doc_id").alias("again_id")).agg(
        F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = rows.join(again, F.col("doc_id") == F.col("again_id")).filter("row_no <> first_row").select("row_no", "doc_id")
    # Stored at once: the numbers are given in one pass and only read from then on.
    return materialize(rows.filter("doc_id is null").select("row_no", "doc_id").unionByName(later).select(
        F.col("row_no").alias("odd_row"), F.col("doc_id").alias("odd_id"), (F.lit(_LAST) - F.monotonically_increasing_id()).alias("stand_in")),
        "op10-odd")


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, tolerance: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Per row of the stored table ``docs``: row_no, doc_id, class_id, copy_id (numbers that may stand in for ids), n_copies,
    n_links; and the rows that numbers stand in for."""
    if n > 1 and BANDS * ROWS % 16:
        raise ValueError("MinHash values are compared in steps of 16")
    texts = docs.select(rowkeys.row_key().alias("row_no"), F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
    rows = materialize(_described(texts, n), "op10-rows")
    odd = _odd_rows(rows)
    if not odd.isEmpty():
        rows = materialize(rows.join(odd, F.col("row_no") == F.col("odd_row"), "left").withColumn(
            "doc_id", F.coalesce("stand_in", "doc_id")).drop("odd_row", "odd_id", "stand_in"), "op10-rows")
    filled = rows.filter("size > 0")
    classes = materialize(filled.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies")), "op10-classes")
    members = materialize(filled.select("row_no", "doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select(
        "row_no", "doc_id", "copy_id", "n_copies"), "op10-members")
    stands = members.filter("doc_id = copy_id").select(F.col("doc_id").alias("stand"), "n_copies")
    sized = filled.select("doc_id", "row_no", "size")
    # Most documents stand for themselves: only those that may be copies of others meet the table of copies.
    copies = members.filter("doc_id <> copy_id").select(F.col("doc_id").alias("copy"))
    sure, possible = bloom.apart(filled.select("doc_id", "bands"), "doc_id", copies, "copy", "op10-copies")
    banded = sure.unionByName(possible.join(copies, F.col("doc_id") == F.col("copy"), "left_anti")).select(
        "doc_id", F.explode("bands").alias("band"))
    smallest = banded.groupBy("band").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("in_band")).filter(
        "in_band > 1").drop("in_band")
    stars = banded.join(smallest, "band").filter("doc_id <> least").select(
        F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    clusters = components(stars, "op10-clusters")
    clusters = clusters.join(sized, F.col("node") == F.col("doc_id")).drop("doc_id")
    sizes = clusters.groupBy("root").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "root").select("node", "row_no", F.col("root").alias("cluster"), "blocks")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = materialize(placed.join(stands, F.col("node") == F.col("stand")).drop("stand"), "op10-placed")
    _, clustered = bloom.apart(texts, "row_no", placed, "row_no", "op10-clustered")
    of_placed = clustered.select("row_no", "text").join(placed, "row_no").select(
        "cluster", "blocks", "block", F.col("node").alias("doc_id"), F.col("n_copies").alias("copies"), "text")
    sent = _sets(of_placed, n).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("first_block"), F.greatest("block", "other").alias("second_block"),
        "block", "doc_id", "copies", "grams")
    found = materialize(_blocks_compared(sent, threshold, tolerance), "op10-links")
    links = found.filter("root is null").groupBy(F.col("doc_id").alias("linked")).agg(F.sum("links").alias("links"))
    groups = components(found.filter("root is not null").select(F.col("doc_id").alias("a"), F.col("root").alias("b")),
                        "op10-groups")
    named = members.join(groups, F.col("copy_id") == F.col("node"), "left").join(
        links, F.col("copy_id") == F.col("linked"), "left").select(
        "row_no", "doc_id", F.coalesce("root", "copy_id").alias("class_id"), "copy_id", "n_copies",
        (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    empty = rows.filter("size = 0").select(
        "row_no", "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"),
        F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return named.unionByName(empty), odd


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD,
                tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id of its group of linked documents), copy_id
    (smallest id with the same n-grams), n_copies (documents with the same n-grams, itself included),
    n_links (other documents with a similarity of at least ``threshold``, equal ones included)."""
    found, odd = _classes(rowkeys.stored(docs, "op10-docs"), id_col, text_col, n, threshold, tolerance, block)
    found = found.drop("row_no")
    if odd.isEmpty():
        return found
    for c in ("doc_id", "class_id", "copy_id"):
        own = odd.select(F.col("stand_in").alias("__stand"), F.col("odd_id").alias("__own"))
        found = found.join(own, F.col(c) == F.col("__stand"), "left").withColumn(
            c, F.when(F.col("__stand").isNotNull(), F.col("__own")).otherwise(F.col(c))).drop("__stand", "__own")
    return found


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD,
                     tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id, or one of them if none has an id."""
    docs = rowkeys.stored(docs, "op10-docs")
    found, _ = _classes(docs, id_col, text_col, n, threshold, tolerance, block)
    gone = materialize(found.filter("doc_id <> class_id").select(F.col("row_no").alias("__gone")), "op10-gone")
    sure, possible = bloom.apart(rowkeys.with_key(docs, "__key"), "__key", gone, "__gone", "op10-gone")
    return sure.unionByName(possible.join(gone, F.col("__key") == F.col("__gone"), "left_anti")).drop("__key")
