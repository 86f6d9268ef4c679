"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built from the items' normalised words. Each document's words stream through it;
the automaton's state and the length matched so far name every item window that ends at the
current word. A window is ``n`` consecutive words of an item; an item with fewer words (but not
none) is one window. Before that, words are coded by the items' vocabulary in numpy, and only
stretches whose neighbouring words are neighbours in some item reach the automaton: a window
cannot lie anywhere else, so nothing is lost.

Size: items are taken in blocks of at most ``block_words`` words, so each automaton that is sent
to the executors is bounded; each block is matched against all documents and the rows of one
document are merged afterwards.

Defined cases: null texts have no words; null items and items without words are left out; a null
item_id counts for hits but not in the list of items; repeated items count as one if they share an
id. Documents repeated with one id stay separate rows. Empty tables work. Words between two
separators may be of any length."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.llm import bloom, rowkeys
from caselake.llm.textwords import LETTERS, Words, buffers, slices, words_of
from caselake.session import materialize

WINDOW_WORDS = 10
BLOCK_WORDS = 1_000_000


class SuffixAutomaton:
    """All word sequences of some items; every window's state knows the items that hold it."""

    def __init__(self, items: list[tuple[object, list[int]]], n: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.windows: dict[int, dict[int, set]] = {}
        for item, words in items:
            size = min(n, len(words))
            for end, state, _ in self.stream(words):
                if end + 1 >= size:
                    while self.length[self.link[state]] >= size:
                        state = self.link[state]
                    self.windows.setdefault(state, {}).setdefault(size, set()).add(item)

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, known, word)
        new = self._state(self.length[last] + 1)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at == -1:
            self.link[new] = 0
        else:
            to = self.next[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, to, word)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, at: int, old: int, word: int) -> int:
        """A state for the shorter sequences of ``old`` that also occur elsewhere."""
        new = self._state(self.length[at] + 1)
        self.next[new] = dict(self.next[old])
        self.link[new], self.link[old] = self.link[old], new
        while at != -1 and self.next[at].get(word) == old:
            self.next[at][word] = new
            at = self.link[at]
        return new

    def stream(self, words):
        """For each word its position, the state after it and the longest matching length."""
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            to = self.next[state].get(word)
            state, matched = (to, matched + 1) if to is not None else (0, 0)
            yield i, state, matched

    def hits(self, words):
        """(start, end, items) of every window inside ``words``."""
        for i, state, matched in self.stream(words):
            while state > 0:
                for size, items in self.windows.get(state, {}).items():
                    if size <= matched:
                        yield i + 1 - size, i + 1, items
                state = self.link[state]
                matched = self.length[state]


class Matcher:
    """The automaton with the vocabulary and the word pairs that select what it has to see."""

    def __init__(self, items: list[tuple[object, str]], n: int):
        found = words_of(pa.array([text for _, text in items], pa.large_string()), LETTERS)
        self.vocabulary, codes = np.unique(found.hashes, return_inverse=True)
        codes = codes.astype(np.int64) + 1
        lists = [codes[a:b] for a, b in zip(found.first[:-1], found.first[1:])]
        self.shortest = min([n, *(len(x) for x in lists if len(x))])
        inside = np.ones(max(0, len(codes) - 1), bool)
        borders = found.first[1:-1]
        inside[borders[(borders > 0) & (borders < len(codes))] - 1] = False
        self.pairs = np.unique((codes[:-1] * self._base() + codes[1:])[inside])
        self.automaton = SuffixAutomaton(
            [(item, x.tolist()) for (item, _), x in zip(items, lists) if len(x)], n)

    def _base(self) -> int:
        return len(self.vocabulary) + 1

    def spans(self, words: Words):
        """Per text with hits: its index, merged word intervals and item ids."""
        if not len(self.vocabulary) or not len(words.hashes):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        codes = np.where(self.vocabulary[at] == words.hashes, at + 1, 0)
        linked = np.zeros(len(codes), bool)  # the word continues the stretch of the word before
        if len(self.pairs):
            keys = codes[:-1] * self._base() + codes[1:]
            place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            linked[1:] = self.pairs[place] == keys
        first = words.first[:-1]
        linked[first[first < len(codes)]] = False
        begins = np.flatnonzero(~linked)
        ends = np.append(begins[1:], len(codes))
        fit = (ends - begins >= self.shortest) & (codes[begins] > 0)
        found: dict[int, list] = defaultdict(list)
        owner = np.searchsorted(words.first, begins[fit], "right") - 1
        for begin, end, text in zip(begins[fit].tolist(), ends[fit].tolist(), owner.tolist()):
            base = begin - int(words.first[text])
            found[text].extend((base + a, base + b, items)
                               for a, b, items in self.automaton.hits(codes[begin:end].tolist()))
        for text, hits in found.items():
            if hits:
                items = set().union(*(x[2] for x in hits))
                yield text, merged([x[:2] for x in hits]), items


def merged(intervals) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """The items in lists of bounded size; only one list at a time is on the driver."""
    words = F.size(F.split(F.lower(F.col(text_col)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    items = benchmark.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"), words.alias("n")).distinct()
    running = Window.orderBy(F.col("item_id").asc_nulls_last(), "text").rowsBetween(Window.unboundedPreceding, -1)
    items = items.withColumn("block", F.floor(
        F.coalesce(F.sum("n").over(running), F.lit(0)) / block_words).cast("int"))
    last = items.agg(F.max("block")).first()[0]
    for block in range(0 if last is None else last + 1):
        yield [(r.item_id, r.text) for r in items.filter(F.col("block") == block).select("item_id", "text").collect()]


_SPANS = "array<struct<start:int,end:int>>"


def _scan(docs: DataFrame, items: list[tuple[object, str]], n: int, id_type: str) -> DataFrame:
    """One row per row of docs: row_no, doc_id, n_words, spans, items."""
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(items, n))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), LETTERS)
                rows = part.num_rows
                spans, held = [[] for _ in range(rows)], [[] for _ in range(rows)]
                for text, intervals, names in matcher.value.spans(words):
                    spans[text] = [{"start": a, "end": b} for a, b in intervals]
                    held[text] = sorted((str(x) for x in names if x is not None))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_no"), part.column("doc_id"), pa.array(words.counts(), pa.int64()),
                     pa.array(spans, span_type), pa.array(held, pa.list_(pa.string()))],
                    names=["row_no", "doc_id", "n_words", "spans", "items"])

    return docs.mapInArrow(run, f"row_no {rowkeys.KEY_TYPE}, doc_id {id_type}, n_words long, spans {_SPANS}, items array<string>")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", n: int = WINDOW_WORDS,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (merged word intervals), n_hit, items
    (ids as sorted strings), row_no."""
    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = rowkeys.stored(docs, "op7-docs").select(rowkeys.row_key().alias("row_no"), F.col(id_col).alias("doc_id"),
                         F.col(text_col).cast("string").alias("text"))
    scans = [_scan(narrow, items, n, id_type) for items in item_blocks(benchmark, item_col, item_text, block_words)]
    if not scans:
        scans = [_scan(narrow, [], n, id_type)]
    found = scans[0]
    if len(scans) > 1:
        for more in scans[1:]:
            found = found.unionByName(more.filter(F.size("spans") > 0))
        found = found.groupBy("row_no", "doc_id").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        # Intervals of several blocks may overlap: an interval's new words begin where the furthest
        # end before it lies.
        found = found.withColumn("spans", F.expr(
            "aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (done, s) -> "
            "if(size(done) > 0 and s.start <= element_at(done, -1).end, "
            "concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start as start, "
            "greatest(element_at(done, -1).end, s.end) as end))), concat(done, array(s))))"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]))
    return found.withColumn("n_hit", hit)


def remove_spans(docs: DataFrame, found: DataFrame, text_col: str = "text", max_words: int = 0,
                 max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without spans of more than ``max_words`` hit words (0: every span goes) and without
    documents whose hit words are more than ``max_coverage`` of all. ``found`` is ``find(docs, ...)``;
    ``docs`` is the stored table that was searched: rows are matched by their place in its files.
    Documents without hits come back unchanged, byte for byte."""
    hits = materialize(found.filter("n_hit > 0").select(
        F.col("row_no").alias("__row"), F.col("spans").alias("__spans"),
        (F.col("n_hit") > F.col("n_words") * max_coverage).alias("__covered")), "op7-hits")
    numbered = rowkeys.with_key(rowkeys.required(docs), "__row_no")
    clean, possible = bloom.apart(numbered, "__row_no", hits, "__row", "op7-hits")
    joined = possible.join(hits, F.col("__row_no") == F.col("__row"), "left")
    joined = joined.filter("not coalesce(__covered, false)").drop("__row_no", "__row", "__covered")
    schema = docs.schema
    names = schema.names

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                spans = part.column(part.schema.get_field_index("__spans")).to_pylist()
                if any(spans):
                    texts = part.column(at).to_pylist()
                    for i, intervals in enumerate(spans):
                        long = [(s["start"], s["end"]) for s in intervals or () if s["end"] - s["start"] > max_words]
                        if long:
                            texts[i] = without(texts[i], long)
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part.select(names)

    return clean.drop("__row_no").unionByName(joined.mapInArrow(run, schema))


def without(text: str, intervals: list[tuple[int, int]]) -> str:
    """The text less the words of the intervals and what stands between them."""
    data, offsets = buffers(pa.array([text], pa.large_string()))
    words = Words(data, offsets, LETTERS, hashed=False)
    raw, kept, at = data.tobytes(), [], 0
    for a, b in intervals:
        kept.append(raw[at:int(words.starts[a])])
        at = int(words.ends[b - 1])
    return b"".join([*kept, raw[at:]]).decode()
