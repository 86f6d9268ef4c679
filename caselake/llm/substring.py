"""Substring dedup with prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document. A word goes when a window covers it whose
word sequence also starts earlier (smaller doc_id, or earlier in the same document).

0. Whole copies: a document with the same words as one with a smaller id loses all of them (if it has
   a window at all) and adds nothing to the index; narrow hashes of whole documents find these.
1. Which suffixes matter: each window is anchored at its K-word sequence with the smallest hash, a
   choice that depends on the window's words alone, so equal windows have equal anchors. Only
   suffixes that begin at an anchor are indexed, about one word in seven. Anchor sequences are
   counted over the whole corpus; those seen once cannot belong to a repeat and a Bloom filter of
   the others lets only suffixes pass that may matter.
2. Prefix partitions: a suffix travels with the words of its windows. Suffixes with equal words fold
   into one with the earliest place before anything is grouped, so a passage that a third of all
   documents share is one row per task. The others are dealt out by their first K words; a prefix
   with more than ``prefix_rows`` distinct suffixes is lengthened to the whole window, at which
   length all that share it are equal and fold by a minimum.
3. Subtrees: a partition is a suffix tree kept as sorted suffixes with the lengths of their common
   prefixes; a node of depth d is a run of neighbours that share d words. As a window may begin up
   to WINDOW - K words before its anchor, the words to the left are a second such tree read
   backwards. Suffixes that meet in the node of depth WINDOW - o and in the left node of depth o
   hold the same window; of each such node only the earliest place stays. Nodes that deep with two
   or more places are the maximal repeats.
4. The places go back to the suffixes that were folded, then to documents, as runs of windows.

Texts move only for documents that lose words. Words are compared by 64-bit hashes. Words: runs of
anything but space and 0x09 to 0x0D, unchanged. Null texts have no words; a null doc_id counts as
larger than every other. Rows with one doc_id are separate documents that start at equal places, so
none of them removes the other's window at the same start. Rows are matched by their place in the files
of the table (``rowkeys``); one that is not stored is stored first."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.llm import bloom, rowkeys
from caselake.llm.textwords import UNSPACED, Words, buffers, mix, sequence_hashes, slices, words_of
from caselake.session import materialize

WINDOW, K = 20, 8
SPAN = WINDOW - K + 1
PREFIX_ROWS = 1 << 16
#: The anchors' filter has at most so many 64-bit words: 32 MB.
MAX_FILTER_WORDS = 1 << 22
_PLACE_BITS = 40
_LAST = (1 << 63) - 1


class Runs:
    """Windows of some texts, as runs that share an anchor: ``start`` (first window's word), ``windows``
    (how many), ``anchor`` (word where the anchor begins), ``owner`` (text), ``key`` (anchor's hash)."""

    def __init__(self, words: Words):
        empty = np.zeros(0, np.int64)
        self.start = self.windows = self.anchor = self.owner = empty
        self.key = np.zeros(0, np.uint64)
        if len(words.hashes) < WINDOW:
            return
        grams = sequence_hashes(words.hashes, K)
        m = len(grams) - SPAN + 1
        least = grams.copy()
        width = 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:m], least[SPAN - width:SPAN - width + m])
        anchor = np.zeros(m, np.int64)
        for j in range(SPAN - 1, -1, -1):
            np.copyto(anchor, j, where=grams[j:j + m] == least)
        anchor += np.arange(m)
        room = np.maximum(words.counts() - WINDOW + 1, 0)
        owner = np.repeat(np.arange(len(room)), room)
        if not len(owner):
            return
        begin = np.concatenate([[0], np.cumsum(room)])
        window = words.first[:-1][owner] + np.arange(len(owner)) - begin[owner]
        anchor = anchor[window]
        new = np.ones(len(window), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        self.start, self.anchor, self.owner = window[at], anchor[at], owner[at]
        self.windows = np.diff(np.append(at, len(window)))
        self.key = grams[self.anchor]


def _anchor_counts(docs: DataFrame) -> DataFrame:
    """(key): anchors that occur at least twice."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys, counts = np.unique(Runs(words_of(part.column("text"), UNSPACED)).key, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.minimum(counts, 2).astype(np.int32))], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n int").groupBy("key").agg(
        F.sum("n").alias("n")).filter("n > 1").select("key")


def _probe(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    bits = (np.uint64(1) << ((keys >> np.uint64(40)) & np.uint64(63))) | (
        np.uint64(1) << ((keys >> np.uint64(46)) & np.uint64(63)))
    return (keys & np.uint64(words - 1)).astype(np.int64), bits


def _filter(repeated: DataFrame) -> np.ndarray:
    """Bloom filter with two bits per anchor in one of at most MAX_FILTER_WORDS words."""
    words, keys = 1024, repeated.count()
    while words < MAX_FILTER_WORDS and words * 64 < keys * 16:
        words *= 2
    bit = "shiftleft(1L, cast(shiftrightunsigned(key, {}) & 63 as int))"
    rows = repeated.groupBy(F.col("key").bitwiseAND(words - 1).alias("word")).agg(
        F.expr(f"bit_or({bit.format(40)} | {bit.format(46)})").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _places(doc: np.ndarray, word: np.ndarray) -> pa.Array:
    """doc_id * 2**40 + word, as decimal(38,0) made from its 128 bits."""
    low = (doc.astype(np.uint64) << np.uint64(_PLACE_BITS)) | word.astype(np.uint64)
    high = doc >> np.int64(64 - _PLACE_BITS)
    data = np.column_stack([low, high.view(np.uint64)]).tobytes()
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(doc), [None, pa.py_buffer(data)])


def _unplaced(places: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(places.buffers()[1], np.uint64)[2 * places.offset:2 * (places.offset + len(places))].reshape(-1, 2)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    doc = (raw[:, 0] >> np.uint64(_PLACE_BITS)) | (raw[:, 1] << np.uint64(64 - _PLACE_BITS))
    return doc.view(np.int64), (raw[:, 0] & mask).astype(np.int64)


def _suffixes(docs: DataFrame, bits) -> DataFrame:
    """Anchored suffixes that may repeat: row_no, place of the first window, windows, key, off (words
    from the first window's start to the anchor), words."""

    def run(batches):
        table = bits.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), UNSPACED)
                runs = Runs(words)
                where, mask = _probe(runs.key, len(table))
                at = np.flatnonzero((table[where] & mask) == mask)
                if not len(at):
                    continue
                start, windows, owner = runs.start[at], runs.windows[at], runs.owner[at]
                ids = np.asarray(part.column("doc_id").fill_null(_LAST))[owner]
                begin, end = words.starts[start], words.ends[start + windows + WINDOW - 2]
                offsets = np.concatenate([[0], np.cumsum(end - begin)])
                place = np.repeat(begin - offsets[:-1], end - begin) + np.arange(offsets[-1])
                data = words.data[place]
                data[(data >= 0x09) & (data <= 0x0D)] = 0x20
                text = pa.Array.from_buffers(pa.large_binary(), len(at), [
                    None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([
                    part.column("row_no").take(pa.array(owner)), _places(ids, start - words.first[:-1][owner]),
                    pa.array(windows.astype(np.int32)), pa.array(runs.key[at].view(np.int64)),
                    pa.array((runs.anchor[at] - start).astype(np.int32)), text.cast(pa.binary())],
                    ["row_no", "place", "windows", "key", "off", "words"])

    return docs.mapInArrow(run, "row_no decimal(38,0), place decimal(38,0), windows int, key long, off int, words binary")


def _node(order: np.ndarray, columns: list[np.ndarray], group: np.ndarray) -> list[np.ndarray]:
    """For depth 0, 1, ... the node of each suffix in the tree over ``columns``, given the sorted order."""
    shared = group[order][1:] == group[order][:-1]
    nodes = []
    for column in [None, *columns]:
        if column is not None:
            sorted_column = column[order]
            shared = shared & (sorted_column[1:] == sorted_column[:-1])
        node = np.zeros(len(order), np.int64)
        node[order[1:]] = np.cumsum(~shared)
        nodes.append(node)
    return nodes


def earliest(words: Words, off: np.ndarray, key: np.ndarray, doc: np.ndarray, word: np.ndarray):
    """For each suffix (its words, anchor offset, prefix, place of its first window) and window the
    earliest place in the window's node, as two arrays with SPAN columns."""
    n = len(off)
    counts, first = words.counts(), words.first[:-1]
    hashes = np.append(words.hashes, np.uint64(0))

    def column(step):
        at = off + step
        return np.where((at >= 0) & (at < counts), hashes[np.minimum(first + np.clip(at, 0, None), len(hashes) - 1)], 0)

    right = [column(t) for t in range(K, WINDOW)]
    left = [column(-1 - t) for t in range(SPAN - 1)]
    forward = _node(np.lexsort([*right[::-1], key]), right, key)
    backward = _node(np.lexsort([*left[::-1], key]), left, key)
    docs, places = np.tile(doc[:, None], SPAN), np.tile(word[:, None], SPAN) + np.arange(SPAN)
    windows = counts - WINDOW + 1
    for o in range(SPAN):
        j = off - o
        rows = np.flatnonzero((j >= 0) & (j < windows))
        if not len(rows):
            continue
        at = j[rows]
        node = forward[SPAN - 1 - o][rows] * np.int64(n + 1) + backward[o][rows]
        own_doc, own_place = doc[rows], word[rows] + at
        order = np.lexsort((own_place, own_doc, node))
        new = np.ones(len(rows), bool)
        new[1:] = node[order][1:] != node[order][:-1]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        docs[rows[order], at[order]], places[rows[order], at[order]] = own_doc[head], own_place[head]
    return docs, places


#: A folded suffix' earliest place and the windows (bits) that begin nowhere earlier than there.
_FOUND = "fold_a long, fold_b long, first_place decimal(38,0), owned int"


def _subtrees(folded: DataFrame) -> DataFrame:
    """Windows that folded suffixes own, for those that have something to remove. Rows
    of one prefix are neighbours; whole prefixes are gathered into trees of some 100,000 suffixes."""

    def solve(rows: pa.Table):
        rows = rows.combine_chunks()
        column = lambda c: rows.column(c).chunk(0) if rows.num_rows else rows.column(c).combine_chunks()
        data = column("words").cast(pa.large_binary())
        words = words_of(data.view(pa.large_string()), UNSPACED)
        off = np.asarray(column("off")).astype(np.int64)
        doc, word = _unplaced(column("place"))
        docs, places = earliest(words, off, np.asarray(column("key")), doc, word)
        windows = words.counts() - WINDOW + 1
        used = np.arange(SPAN) < windows[:, None]
        earlier = ((docs != doc[:, None]) | (places != word[:, None] + np.arange(SPAN))) & used
        keep = earlier.any(1) | (np.asarray(column("n")) > 1)
        owned = ((used & ~earlier) << np.arange(SPAN)).sum(1).astype(np.int32)
        chosen = pa.array(keep)
        return pa.RecordBatch.from_arrays(
            [column("fold_a").filter(chosen), column("fold_b").filter(chosen), column("place").filter(chosen),
             pa.array(owned[keep])], ["fold_a", "fold_b", "first_place", "owned"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 100_000:
                table = pa.Table.from_batches(held).combine_chunks()
                keys = np.asarray(table.column("key").chunk(0))
                cut = int(np.searchsorted(keys, keys[-1], "left"))
                if cut:
                    yield solve(table.slice(0, cut))
                    table = table.slice(cut)
                held, rows = table.to_batches(), table.num_rows
        if rows:
            yield solve(pa.Table.from_batches(held))

    return folded.repartition("key").sortWithinPartitions("key").mapInArrow(run, _FOUND)


def _whole_windows(folded: DataFrame) -> DataFrame:
    """The same for prefixes that are too common: each window is its own prefix of WINDOW words."""

    def run(batches):
        for batch in batches:
            words = words_of(batch.column("words").cast(pa.large_binary()).view(pa.large_string()), UNSPACED)
            windows = np.maximum(words.counts() - WINDOW + 1, 0)
            owner = np.repeat(np.arange(len(windows)), windows)
            j = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = words.first[:-1][owner] + j
            doc, word = _unplaced(batch.column("place"))
            a = sequence_hashes(words.hashes, WINDOW)[at]
            b = sequence_hashes(mix(words.hashes), WINDOW)[at]
            take = lambda c: batch.column(c).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [take("fold_a"), take("fold_b"), take("n"), pa.array(j.astype(np.int32)), pa.array(a.view(np.int64)),
                 pa.array(b.view(np.int64)), _places(doc[owner], word[owner] + j)],
                ["fold_a", "fold_b", "n", "j", "window_a", "window_b", "place"])

    rows = folded.select("fold_a", "fold_b", "n", "words", "place").mapInArrow(
        run, "fold_a long, fold_b long, n long, j int, window_a long, window_b long, place decimal(38,0)")
    least = rows.groupBy("window_a", "window_b").agg(F.min("place").alias("first"))
    return rows.join(least, ["window_a", "window_b"]).groupBy("fold_a", "fold_b").agg(
        F.min("place").alias("first_place"),
        F.sum(F.expr("if(place = first, shiftleft(1, j), 0)")).cast("int").alias("owned"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(rowkeys.row_key().alias("row_no"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))


def _whole_copies(narrow: DataFrame) -> DataFrame:
    """(row_no, doc_id, n_words) of the rows whose words, WINDOW or more, are those of a row with a smaller id."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), UNSPACED)
                counts = words.counts()
                at = np.flatnonzero(counts >= WINDOW)
                if not len(at):
                    continue
                place = (np.arange(len(words.hashes)) - np.repeat(words.first[:-1], counts)).astype(np.uint64)
                chosen = pa.array(at)
                a, b = (np.add.reduceat(mix(words.hashes + place * factor), words.first[:-1][counts > 0])[
                    np.cumsum(counts > 0)[at] - 1].view(np.int64)
                    for factor in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_no").take(chosen), part.column("doc_id").take(chosen), pa.array(counts[at]),
                     pa.array(a), pa.array(b)], ["row_no", "doc_id", "n_words", "a", "b"])

    rows = materialize(narrow.mapInArrow(run, "row_no decimal(38,0), doc_id long, n_words long, a long, b long"), "op8-whole")
    place = F.coalesce("doc_id", F.lit(_LAST))
    first = rows.groupBy("a", "b", "n_words").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return materialize(rows.join(first, ["a", "b", "n_words"]).filter(place > F.col("first")).select(
        "row_no", "doc_id", "n_words"), "op8-copies")


def _without(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows that are no whole copies. Those that the filter cannot tell are few and stored."""
    sure, possible = bloom.apart(rows, "row_no", copies, "row_no", "op8-copies")
    return sure.unionByName(materialize(possible.join(copies.select("row_no"), "row_no", "left_anti").select(
        *rows.columns), "op8-unsure"))


def repeats(narrow: DataFrame, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """(row_no, windows) of rows (row_no, doc_id, text): for each row that loses words, the starts of its
    windows that begin earlier elsewhere, as structs of a word number and a bit mask of the windows from
    there on."""
    bits = narrow.sparkSession.sparkContext.broadcast(_filter(materialize(_anchor_counts(narrow), "op8-anchors")))
    hashed = _suffixes(narrow, bits).withColumns({
        "fold_a": F.xxhash64("key", "off", "words"), "fold_b": F.xxhash64("words", F.lit(8), "off")})
    suffixes = materialize(hashed, "op8-suffixes")
    folded = suffixes.groupBy("key", "off", "fold_a", "fold_b", "words").agg(
        F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    common = materialize(suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(
        F.col("rows") > prefix_rows).select(F.col("key").alias("common")), "op8-common")
    if common.isEmpty():
        found = _subtrees(folded)
    else:
        of_common = F.col("key") == F.col("common")
        found = _subtrees(folded.join(common, of_common, "left_anti")).unionByName(
            _whole_windows(folded.join(common, of_common, "left_semi")))
    own = suffixes.select("row_no", "place", "windows", F.col("fold_a").alias("a"), F.col("fold_b").alias("b"))
    marked = own.join(found, (F.col("a") == F.col("fold_a")) & (F.col("b") == F.col("fold_b"))).select(
        "row_no", F.expr(f"cast(place % {1 << _PLACE_BITS} as long)").alias("start"),
        F.expr("(shiftleft(1, windows) - 1) & ~if(place = first_place, owned, 0)").alias("mask")).filter("mask <> 0")
    return marked.groupBy("row_no").agg(F.collect_list(F.struct("start", "mask")).alias("windows"))


def _removed(words: int, windows: list) -> np.ndarray:
    """Which of a document's words a marked window covers."""
    edge = np.zeros(words + 1, np.int64)
    for w in windows:
        for j in range(SPAN):
            if w["mask"] >> j & 1:
                edge[w["start"] + j] += 1
                edge[w["start"] + j + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def _joined(text: str | None, windows) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept ones joined by one space."""
    words = (text or "").encode().split()
    if not windows:
        return len(words), 0, b" ".join(words)
    gone = _removed(len(words), windows)
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def _digests(rows: DataFrame, windows: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                marks = part.column(part.schema.get_field_index("windows")).to_pylist() if windows else [None] * part.num_rows
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                done = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in map(_joined, texts, marks)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("row_no")), part.column(part.schema.get_field_index("doc_id")),
                     pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                     pa.array([d[2] for d in done], pa.string())],
                    ["row_no", "doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "row_no decimal(38,0), doc_id long, n_words long, n_removed long, kept_sha256 string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256. Rows that lose nothing are
    digested in the scan; a Bloom filter of the others' numbers keeps their texts from moving."""
    docs = rowkeys.stored(docs, "op8-docs")
    narrow = _numbered(docs, id_col, text_col)
    copies = _whole_copies(narrow)
    indexed = _without(narrow, copies)
    marks = materialize(repeats(indexed, prefix_rows), "op8-marks")
    unmarked, possible = bloom.apart(indexed, "row_no", marks, "row_no", "op8-marks")
    cut = _digests(possible.join(marks.withColumnRenamed("row_no", "marked"),
                                 F.col("row_no") == F.col("marked"), "left").drop("marked"), True)
    gone = copies.select("row_no", "doc_id", "n_words", F.col("n_words").alias("n_removed"),
                         F.sha2(F.lit(""), 256).alias("kept_sha256"))
    return _digests(unmarked, False).unionByName(cut).unionByName(gone).drop("row_no")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """``docs`` with texts less their repeated words; what is left of a changed text is joined by single
    spaces. Rows that lose nothing come back unchanged."""
    docs = rowkeys.stored(docs, "op8-docs")
    narrow = _numbered(docs, id_col, text_col)
    copies = _whole_copies(narrow)
    marks = repeats(_without(narrow, copies), prefix_rows).withColumn("copy", F.lit(False)).unionByName(copies.select(
        "row_no", F.lit(True).alias("copy")), allowMissingColumns=True)
    marks = materialize(marks.withColumnsRenamed({"row_no": "__marked", "windows": "__windows", "copy": "__copy"}), "op8-marks")
    numbered = rowkeys.with_key(docs, "__row_no")
    unmarked, possible = bloom.apart(numbered, "__row_no", marks, "__marked", "op8-marks")
    joined = possible.join(marks, F.col("__row_no") == F.col("__marked"), "left").drop("__row_no", "__marked")
    schema = docs.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                marks = part.column(part.schema.get_field_index("__windows")).to_pylist()
                copies = part.column(part.schema.get_field_index("__copy")).to_pylist()
                if any(marks) or any(copies):
                    texts = ["" if c else _joined(t, w)[2].decode() if w else t
                             for t, w, c in zip(part.column(at).to_pylist(), marks, copies)]
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part.select(schema.names)

    return unmarked.drop("__row_no").unionByName(joined.mapInArrow(run, schema))
