"""Phrase collocations, counted in counting quotient filters.

1. Words are counted per language. A word's id comes from a 64-bit hash of language and word that is
   checked to tell every frequent word from all others (else another seed is taken), so nothing is
   confused. Only words with ``min_count`` occurrences can be part of a candidate; up to ``most_words``
   of them get dense ids by their rank, which is the only thing that is broadcast (8 bytes a word). With
   more words the hashes themselves are the ids and nothing is broadcast.
2. Each task packs runs of two and three ids into one number, permutes it invertibly and keeps a counting
   quotient filter: sorted numbers whose leading bits (shard and quotient) are stored as run lengths and
   whose remaining bits are stored in full, so the filter is compact and loses nothing.
3. A filter is cut at shard borders. Spark brings the pieces of one shard together, where sorted filters
   are merged and counts added. A shard is a range of permuted numbers: a phrase, however frequent, is
   one entry per piece, and shards are even. Phrases below ``min_count`` end here.
4. Words and part counts are joined to the phrases left; scores are exact decimals. The first ``top`` of
   each language are cut per hash bucket of the language before they meet.

Words: A-Z in lower case, runs of anything but space and tab within pieces that end at ``.,;:!?`` and
0x0A to 0x0D. Null texts are empty, a null language is ``und``. Equal texts count each. Ties follow score,
count, phrase (bytes). An empty table gives an empty result. Only the two columns are read. Texts are worked on in
slices; one that is longer than a slice is a slice of its own."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.llm.textwords import Words, buffers, mix, slices
from caselake.session import materialize

MIN_COUNT, TOP = 10, 2000
#: Words that may get dense ids: 2^24 words are a broadcast of 128 MB.
MOST_WORDS = 1 << 24
#: Phrases that a task gathers before it writes a filter; phrases (all occurrences) of one shard.
GATHERED, SHARD = 1 << 21, 1 << 21
#: Hash buckets in which a language's best are cut first.
_BUCKETS = 64


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    # 0x00 is a letter like others; the code of the space is free for it.
    table[0x00] = 0x20
    table[[0x20, 0x09, *b".,;:!?\n\v\f\r"]] = 0
    return table


_WORD = _table()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_CUT = np.zeros(256, bool)
_CUT[list(b".,;:!?\n\v\f\r")] = True


class Pieces:
    """The words of some texts: ``found`` (places), ``ids`` (hash of language and word) and ``follows``
    (the word before stands in the same piece)."""

    def __init__(self, part: pa.RecordBatch, seed: int):
        self.data, offsets = buffers(part.column(part.schema.get_field_index("text")))
        self.found = found = Words(self.data, offsets, _WORD)
        langs = part.column(part.schema.get_field_index("lang")).dictionary_encode()
        salts = np.array([_lang_hash(x, seed) for x in langs.dictionary.to_pylist()], np.uint64)
        self.langs, self.lang_of = langs.dictionary, np.repeat(np.asarray(langs.indices), found.counts())
        self.ids = mix(found.hashes ^ salts[self.lang_of]) if len(found.hashes) else found.hashes
        cuts = np.concatenate([[0], np.cumsum(_CUT[self.data])])[found.starts]
        self.follows = np.zeros(len(cuts), bool)
        self.follows[1:] = cuts[1:] == cuts[:-1]
        first = found.first[:-1]
        self.follows[first[first < len(cuts)]] = False

    def words(self, at: np.ndarray) -> pa.Array:
        """The words at these numbers, lower-cased."""
        starts, sizes = self.found.starts[at], (self.found.ends - self.found.starts)[at]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(_FOLD[self.data[places]].tobytes()))


def _lang_hash(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{lang}".encode(), digest_size=8).digest(), "big")


def _word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, id, n."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                pieces = Pieces(part, seed)
                ids, at, n = np.unique(pieces.ids, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pieces.langs.take(pa.array(pieces.lang_of[at])).cast(pa.string()), pieces.words(at).cast(pa.string()),
                     pa.array(ids.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "word", "id", "n"])

    return docs.mapInArrow(run, "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, min_count: int, seeds: int = 8) -> tuple[DataFrame, int]:
    """All words with their counts, and the seed whose ids tell each frequent word from all others."""
    for seed in range(seeds):
        words = materialize(_word_counts(docs, seed), "phrases-words")
        same = words.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("most"))
        if same.filter(f"most >= {min_count} and (words > 1 or id = 0)").isEmpty():
            return words, seed
    raise RuntimeError(f"no seed of {seeds} tells all words apart")


# --- the filter -------------------------------------------------------------------
_ODD = [(np.uint64(a), np.uint64(pow(a, -1, 1 << 64))) for a in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def stir(x: np.ndarray, width: int) -> np.ndarray:
    """A permutation of the numbers of ``width`` bits."""
    half = np.uint64((width + 1) // 2)
    for odd, _ in _ODD:
        x = x ^ (x >> half)
        x = (x * odd) & _mask(width)
    return x ^ (x >> half)


def unstir(x: np.ndarray, width: int) -> np.ndarray:
    half = np.uint64((width + 1) // 2)
    x = x ^ (x >> half)
    for _, inverse in reversed(_ODD):
        x = (x * inverse) & _mask(width)
        x = x ^ (x >> half)
    return x


def _salt(lanes: list[np.ndarray], width: int):
    """What the further lanes add to the first, so that it is even as well."""
    out = np.zeros(len(lanes[0]), np.uint64)
    for lane in lanes[1:]:
        out = mix(out ^ lane)
    return out >> np.uint64(64 - width) if width < 64 else out


class Layout:
    """How ids become lanes of at most 64 bits: one lane for small ids, two, or three for 64-bit ids."""

    def __init__(self, n_words: int, most_words: int, shards: int):
        self.dense = n_words <= most_words
        self.bits = max(1, n_words.bit_length()) if self.dense else 64
        self.widths = [3 * self.bits] if 3 * self.bits <= 63 else [self.bits, 2 * self.bits] if self.bits <= 31 else [64] * 3
        self.shard_bits = min(self.widths[0], max(0, (shards - 1).bit_length()))

    def packed(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Permuted lanes of phrases; a third id of 0 says that there are two words."""
        b = np.uint64(self.bits)
        lanes = [[(ids[0] << (b + b)) | (ids[1] << b) | ids[2]], [ids[0], (ids[1] << b) | ids[2]], ids][len(self.widths) - 1] \
            if self.bits < 64 else list(ids)
        return [stir(lanes[0] ^ _salt(lanes, self.widths[0]), self.widths[0]), *lanes[1:]]

    def unpacked(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        first = unstir(lanes[0], self.widths[0]) ^ _salt(lanes, self.widths[0])
        b, m = np.uint64(self.bits), _mask(self.bits)
        if len(lanes) == 1:
            return [first >> (b + b), (first >> b) & m, first & m]
        return [first, lanes[1] >> b, lanes[1] & m] if len(lanes) == 2 else [first, *lanes[1:]]


def _added_up(lanes: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted lanes, each phrase once with its count. The stable sort merges runs that are sorted already."""
    order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
    lanes = [lane[order] for lane in lanes]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([lane[1:] != lane[:-1] for lane in lanes])
    at = np.flatnonzero(new)
    return [lane[at] for lane in lanes], np.add.reduceat(counts[order], at) if len(at) else counts


def _as_bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-width // 8)]).tobytes()


def _from_bytes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :-(-width // 8)] = np.frombuffer(data, np.uint8).reshape(n, -1) if width else 0
    return out.view("<u8").ravel().astype(np.uint64)


_PIECE = ["shard", "n", "runs", "remainders", "others", "counts", "large"]
_PIECE_SCHEMA = "shard int, n int, runs binary, remainders binary, others binary, counts binary, large binary"


def filter_pieces(lanes: list[np.ndarray], counts: np.ndarray, layout: Layout) -> list[dict]:
    """A filter (sorted, each phrase once) cut at shard borders. Per piece: run lengths by quotient, the rest
    of the first lane, the other lanes, counts in bytes with the larger ones (from 255) aside."""
    rest = layout.widths[0] - layout.shard_bits
    shard = lanes[0] >> np.uint64(rest) if layout.shard_bits else np.zeros(len(lanes[0]), np.uint64)
    borders = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        if a == b:
            continue
        width = rest - _quotient_bits(b - a, rest)
        quotients = ((lanes[0][a:b] & _mask(rest)) >> np.uint64(width)).astype(np.int64) if width < 64 else np.zeros(b - a, np.int64)
        runs = np.bincount(quotients, minlength=1 << (rest - width))
        out.append({
            "shard": int(shard[a]), "n": b - a, "runs": runs.astype(np.uint8 if runs.max() < 256 else np.uint32).tobytes(),
            "remainders": _as_bytes(lanes[0][a:b] & _mask(width), width) if width else b"",
            "others": b"".join(_as_bytes(lane[a:b], w) for lane, w in zip(lanes[1:], layout.widths[1:])),
            "counts": np.minimum(counts[a:b], 255).astype(np.uint8).tobytes(), "large": counts[a:b][counts[a:b] >= 255].tobytes()})
    return out


def _quotient_bits(n: int, rest: int) -> int:
    return min(rest, n.bit_length() - 1)


def opened(piece: dict, layout: Layout) -> tuple[list[np.ndarray], np.ndarray]:
    """Lanes and counts of a piece, as they went in."""
    n, rest = piece["n"], layout.widths[0] - layout.shard_bits
    q = _quotient_bits(n, rest)
    width = rest - q
    runs = np.frombuffer(piece["runs"], np.uint8 if len(piece["runs"]) == 1 << q else np.uint32)
    first = _from_bytes(piece["remainders"], n, width) if width else np.zeros(n, np.uint64)
    if q:
        first |= np.repeat(np.arange(1 << q, dtype=np.uint64), runs) << np.uint64(width)
    if layout.shard_bits:
        first |= np.uint64(piece["shard"]) << np.uint64(rest)
    others, at = [], 0
    for w in layout.widths[1:]:
        size = n * -(-w // 8)
        others.append(_from_bytes(piece["others"][at:at + size], n, w))
        at += size
    counts = np.frombuffer(piece["counts"], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(piece["large"], np.int64)
    return [first, *others], counts


def _filters(docs: DataFrame, seed: int, layout: Layout, table, gathered: int) -> DataFrame:
    """Each task's filters in pieces."""
    arrow = pa.schema([("shard", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in _PIECE[2:])])

    def phrases(part):
        pieces = Pieces(part, seed)
        ids = pieces.ids
        known = np.ones(len(ids), bool)
        if layout.dense and len(ids):
            at = np.minimum(np.searchsorted(table.value, ids), max(0, len(table.value) - 1))
            known = table.value[at] == ids if len(table.value) else ~known
            ids = (at + 1).astype(np.uint64)
        pair = np.flatnonzero(known[:-1] & known[1:] & pieces.follows[1:])
        three = pair[:-1][np.diff(pair) == 1]
        none = np.zeros(len(pair), np.uint64)
        return layout.packed([np.concatenate([ids[pair], ids[three]]), np.concatenate([ids[pair + 1], ids[three + 1]]),
                              np.concatenate([none, ids[three + 2]])])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                lanes = phrases(part)
                held.append(_added_up(lanes, np.ones(len(lanes[0]), np.int64)))
                size += len(held[-1][1])
                if size > gathered:
                    yield from out(held)
                    held, size = [], 0
        yield from out(held)

    def out(held):
        if held:
            lanes, counts = _added_up([np.concatenate(x) for x in zip(*(lanes for lanes, _ in held))], np.concatenate([c for _, c in held]))
            pieces = filter_pieces(lanes, counts, layout)
            for at in range(0, len(pieces), 256):
                yield pa.RecordBatch.from_pylist(pieces[at:at + 256], arrow)

    return docs.mapInArrow(run, _PIECE_SCHEMA)


def phrase_counts(docs: DataFrame, words: DataFrame, seed: int, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS,
                  shard: int = SHARD, gathered: int = GATHERED) -> DataFrame:
    """id1, id2, id3 (null for two words), f of the phrases with at least ``min_count`` occurrences."""
    frequent = words.filter(F.col("n") >= min_count)
    n_words, total = frequent.agg(F.count(F.lit(1)), F.sum("n")).first()
    layout = Layout(n_words, most_words, -(-2 * (total or 0) // shard))
    table = None
    if layout.dense:
        ids = frequent.select("id").toArrow().column("id")
        table = docs.sparkSession.sparkContext.broadcast(np.sort(np.asarray(ids).astype(np.int64).view(np.uint64)))
    arrow = pa.schema([(c, pa.int64()) for c in ("id1", "id2", "id3", "f")])

    def merged(key, rows):
        parts = [opened(piece, layout) for piece in rows.to_pylist()]
        lanes, counts = _added_up([np.concatenate(x) for x in zip(*(lanes for lanes, _ in parts))], np.concatenate([c for _, c in parts]))
        often = counts >= min_count
        ids = layout.unpacked([lane[often] for lane in lanes])
        two = ids[2] == 0
        if layout.dense:
            ids = [table.value[(i - np.uint64(1)).astype(np.int64) % max(1, len(table.value))] for i in ids]
        columns = [pa.array(ids[0].view(np.int64)), pa.array(ids[1].view(np.int64)), pa.array(ids[2].view(np.int64), mask=two),
                   pa.array(counts[often])]
        return pa.Table.from_arrays(columns, schema=arrow)

    pieces = _filters(docs, seed, layout, table, gathered)
    return pieces.groupBy("shard").applyInArrow(merged, "id1 long, id2 long, id3 long, f long")


# --- scores -----------------------------------------------------------------------
def _score(a: str, left: str, right: str) -> str:
    """Whole part of 1,000,000 a^2 / (l r), exact in decimals of 38 digits."""
    number = "cast({} as decimal(15,0))".format
    return f"((cast(1000000 as decimal(7,0)) * {number(a)} * {number(a)}) div ({number(left)} * {number(right)}))"


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
         overlap_percent: int = 50, most_words: int = MOST_WORDS, shard: int = SHARD, gathered: int = GATHERED) -> DataFrame:
    """The best phrases of two and three words of each language: lang, rank, phrase, a (its count), l and r
    (counts of the parts at the cut that scores lowest), n (words of the language), score. A phrase goes
    if a longer candidate holds it and has at least ``overlap_percent`` of its count."""
    docs = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    words, seed = word_table(docs, min_count)
    found = materialize(phrase_counts(docs, words, seed, min_count, most_words, shard, gathered), "phrases-counts")
    frequent = words.filter(F.col("n") >= min_count)

    def word(i: int) -> DataFrame:
        named = frequent.select(F.col("id").alias(f"id{i}"), F.col("word").alias(f"word{i}"), F.col("n").alias(f"n{i}"), "lang")
        return named if i == 1 else named.drop("lang")

    pairs = found.filter("id3 is null").select("id1", "id2", F.col("f").alias("a"))
    threes = found.filter("id3 is not null").select("id1", "id2", "id3", F.col("f").alias("a"))
    longest = threes.select("id1", "id2", "a").unionByName(threes.select(F.col("id2").alias("id1"), F.col("id3").alias("id2"), "a")) \
        .groupBy("id1", "id2").agg(F.max("a").alias("longest"))
    two = pairs.join(longest, ["id1", "id2"], "left").filter(
        f"longest is null or 100 * longest < {int(overlap_percent)} * a").join(word(1), "id1").join(word(2), "id2").select(
        "lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"),
        F.expr(_score("a", "n1", "n2")).alias("score"))
    cut = threes.join(pairs.withColumnRenamed("a", "first_two"), ["id1", "id2"]).join(
        pairs.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("a").alias("last_two")), ["id2", "id3"]).join(
        word(1), "id1").join(word(2).drop("n2"), "id2").join(word(3), "id3").withColumns({
            "score1": F.expr(_score("a", "n1", "last_two")), "score2": F.expr(_score("a", "first_two", "n3"))})
    later = F.col("score2") < F.col("score1")
    three = cut.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
                       F.when(later, F.col("first_two")).otherwise(F.col("n1")).alias("l"),
                       F.when(later, F.col("n3")).otherwise(F.col("last_two")).alias("r"), F.least("score1", "score2").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    scored = two.unionByName(three).withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(_BUCKETS)))
    best = scored.withColumn("in_bucket", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(
        F.col("in_bucket") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(
        F.col("rank") <= top)
    totals = words.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("n"))
    return ranked.join(totals, F.col("lang") == F.col("of_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
