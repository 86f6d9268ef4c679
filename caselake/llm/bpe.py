"""BPE encoding and decoding through a table of distinct words.

1. Texts are split at ASCII white space into words, in chunks of bounded size. A chunk becomes its
   distinct words, most frequent first, and each text a list of positions in them.
2. The distinct words go, packed, to the partition that their hash names. There each distinct word
   of the corpus is encoded once, however many chunks hold it; the ids go back to the chunks.
3. Texts get their ids by position. Decoding joins each distinct word's ids with the id-to-piece table
   and puts the pieces together by position as well. ``decode`` does the same for any table of ids.

Cutting at white space changes nothing for a tokenizer whose pre-tokenizer drops white space and whose
normaliser treats each run of it as one space (this is checked against whole texts in the tests).
Special tokens in a text are encoded as such, as the tokenizers library does by default.

What moves: each chunk's distinct words once there and once back, and the position lists (entropy
coded, about a quarter of the text's bytes). Texts never move. A partition of words holds the corpus'
distinct words divided by ``partitions``; a chunk has at most CHUNK_BYTES of text or one longer text.
The tokenizer file is read by the driver and broadcast (its size is fixed).

Defined cases: null texts count as empty and have no tokens; rows with one id are encoded each; other
columns are not read; empty tables work. ``docs`` is a stored table: it is scanned twice, and a chunk
whose two scans differ ends the run with an error instead of a wrong result."""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.llm.textwords import UNSPACED, release, slices, words_of

CHUNK_BYTES = 8 << 20
_GATHER_WORDS = 1 << 18


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2**32 as compressed byte planes, behind a count of planes."""
    values = values.astype("<u4")
    planes = values.view(np.uint8).reshape(-1, 4).T
    used = 4 if len(values) and values.max() >> 24 else 3 if len(values) and values.max() >> 16 else 2
    return bytes([used]) + pa.compress(planes[:used].tobytes(), codec="zstd", asbytes=True) + len(values).to_bytes(8, "little")


def _unpacked(data: bytes) -> np.ndarray:
    used, n = data[0], int.from_bytes(data[-8:], "little")
    raw = np.frombuffer(pa.decompress(data[1:-8], used * n, codec="zstd", asbytes=True), np.uint8).reshape(used, n)
    out = np.zeros((n, 4), np.uint8)
    out[:, :used] = raw.T
    return out.view("<u4").ravel()


class Chunk:
    """Distinct words of some texts and each text's positions in them."""

    def __init__(self, texts: pa.Array, partitions: int):
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        flat = split.flatten()
        owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
        filled = np.asarray(pc.binary_length(flat)) > 0
        self.counts = np.bincount(owner[filled], minlength=len(texts))
        coded = flat.filter(pa.array(filled)).dictionary_encode()
        codes = np.asarray(coded.indices)
        order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.positions = rank[codes]
        self.words = coded.dictionary.take(pa.array(order))
        hashes = words_of(self.words, UNSPACED).hashes
        self.partition = (hashes % np.uint64(partitions)).astype(np.int64)
        self.check = zlib.crc32(np.bitwise_xor.reduce(hashes, initial=np.uint64(len(hashes))).tobytes()
                                + hashes[-1:].tobytes())


_FIELDS = "chunk long, part int, check long, a binary, b binary"


def _chunks(docs: DataFrame, partitions: int, chunk_bytes: int, texts: bool) -> DataFrame:
    """One row per chunk with its texts, or one per chunk and partition with its words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", chunk_bytes):
                chunk = Chunk(part.column("text"), partitions)
                if texts:
                    ids = part.column("doc_id")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.array([-1], pa.int32()), pa.array([chunk.check]),
                         pa.array([_packed(chunk.positions)], pa.binary()), pa.array([_packed(chunk.partition)], pa.binary()),
                         pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                         pa.array([chunk.counts.tolist()], pa.list_(pa.int64()))],
                        ["chunk", "part", "check", "a", "b", "doc_ids", "counts"])
                else:
                    order = np.argsort(chunk.partition, kind="stable")
                    parts, begins = np.unique(chunk.partition[order], return_index=True)
                    words = chunk.words.take(pa.array(order))
                    ends = np.append(begins[1:], len(order))
                    blobs = [pa.compress(" ".join(words.slice(a, b - a).to_pylist()).encode(), codec="zstd", asbytes=True)
                             for a, b in zip(begins.tolist(), ends.tolist())]
                    sizes = [sum(pc.binary_length(words.slice(a, b - a)).to_pylist()) + b - a - 1
                             for a, b in zip(begins.tolist(), ends.tolist())]
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * n, pa.int64()), pa.array(parts.astype(np.int32)),
                         pa.array([chunk.check] * n, pa.int64()), pa.array(blobs, pa.binary()),
                         pa.array([s.to_bytes(8, "little") for s in sizes], pa.binary())],
                        ["chunk", "part", "check", "a", "b"])
                number += 1

    fields = f"{_FIELDS}, doc_ids array<{kind}>, counts array<long>" if texts else _FIELDS
    return docs.mapInArrow(run, fields)


#: Words whose ids a task keeps; beyond that it begins anew.
_KNOWN_WORDS = 1 << 16


def _encoded(words: DataFrame, tokenizer) -> DataFrame:
    """The words' ids instead of the words: ``a`` ids, ``b`` how many each word has."""

    def run(batches):
        from tokenizers import Tokenizer

        encoder, known = Tokenizer.from_str(tokenizer.value), {}
        encoder.no_truncation()
        encoder.no_padding()
        # One thread per task, as Spark counts them; threads of the library would each keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            ids, counts = [], []
            if len(known) > _KNOWN_WORDS:
                known.clear()
            for blob, size in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                own = pa.decompress(blob, int.from_bytes(size, "little"), codec="zstd", asbytes=True).decode().split(" ")
                new = [w for w in dict.fromkeys(own) if w not in known]
                for start in range(0, len(new), 4096):
                    some = new[start:start + 4096]
                    for w, e in zip(some, encoder.encode_batch(some, add_special_tokens=False)):
                        known[w] = np.array(e.ids, "<u4").tobytes()
                found = [known[w] for w in own]
                ids.append(_packed(np.frombuffer(b"".join(found), "<u4")))
                counts.append(_packed(np.array([len(x) >> 2 for x in found])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), batch.column("part"), batch.column("check"),
                 pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["chunk", "part", "check", "a", "b"])
            release()

    return words.repartition("part").mapInArrow(run, _FIELDS)


def _spelled(offsets: np.ndarray, parts: pa.Array) -> pa.Array:
    """Runs of ``parts`` between the offsets, each joined by single spaces."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets.astype(np.int64)), parts), pa.scalar(" ", pa.large_string()))


def _put_together(rows: pa.Table, pieces: pa.Array):
    """(doc_id, n_tokens, ids, text) of one chunk's texts."""
    part = np.asarray(rows.column("part"))
    own = int(np.flatnonzero(part == -1)[0])
    if len(set(rows.column("check").to_pylist())) > 1:
        raise RuntimeError("a chunk differs between two scans; the input has to be a stored table")
    a, b = rows.column("a"), rows.column("b")
    partition = _unpacked(b[own].as_py())
    # The words came back by partition, within it in their own order.
    back = np.flatnonzero(part >= 0)
    back = back[np.argsort(part[back])].tolist()
    slot = np.empty(len(partition), np.int64)
    slot[np.argsort(partition, kind="stable")] = np.arange(len(partition))
    positions = slot[_unpacked(a[own].as_py())]
    none = [np.zeros(0, "<u4")]
    size = np.concatenate([_unpacked(b[i].as_py()) for i in back] or none).astype(np.int64)
    ids = np.concatenate([_unpacked(a[i].as_py()) for i in back] or none)
    start = np.concatenate([[0], np.cumsum(size)])
    # The id-to-piece join, once for each distinct word.
    spelled = _spelled(start, pieces.take(pa.array(ids.astype(np.int64))))
    doc_ids = rows.column("doc_ids")[own].values
    counts = np.asarray(rows.column("counts")[own].values)
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        begin = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + _GATHER_WORDS, "right")))
        place = positions[begin:int(ends[to - 1])]
        place_of = np.repeat(np.arange(to - at), counts[at:to])
        some = size[place] > 0
        place, place_of = place[some], place_of[some]
        n = size[place]
        tokens = np.bincount(place_of, weights=n, minlength=to - at).astype(np.int64)
        index = np.repeat(start[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        flat = ids[index].astype("<u4")
        offsets = np.concatenate([[0], np.cumsum(tokens)]) * 4
        words = np.concatenate([[0], np.cumsum(np.bincount(place_of, minlength=to - at))])
        yield pa.RecordBatch.from_arrays(
            [doc_ids.slice(at, to - at), pa.array(tokens),
             pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()),
                                                               pa.py_buffer(flat.tobytes())]).cast(pa.binary()),
             _spelled(words, spelled.take(pa.array(place))).cast(pa.string())],
            ["doc_id", "n_tokens", "ids", "decoded"])
        at = to
    release()


def pieces_of(tokenizer_json: str) -> list[str]:
    """Piece of each id, special tokens included."""
    parsed = json.loads(tokenizer_json)
    table = dict(parsed["model"]["vocab"])
    table.update({t["content"]: t["id"] for t in parsed["added_tokens"]})
    out = [""] * (max(table.values()) + 1)
    for piece, number in table.items():
        out[number] = piece
    return out


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           partitions: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers as
    bytes), decoded (the ids' pieces joined by single spaces, as the tokenizer's decoder does)."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    if json.loads(tokenizer.value).get("decoder") is not None:
        raise ValueError("only tokenizers without a decoder of their own are put together word by word")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = spark.sparkContext.broadcast(pa.array(pieces_of(tokenizer.value), pa.large_string()))
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _chunks(narrow, partitions, chunk_bytes, True)
    ids = _encoded(_chunks(narrow, partitions, chunk_bytes, False), tokenizer)
    none = {c: F.lit(None).cast(texts.schema[c].dataType) for c in ("doc_ids", "counts")}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_put_together(rows.combine_chunks(), pieces.value),
                                     schema=pa.schema([("doc_id", rows.schema.field("doc_ids").type.value_type),
                                                       ("n_tokens", pa.int64()), ("ids", pa.binary()),
                                                       ("decoded", pa.string())]))

    return texts.unionByName(ids.withColumns(none)).groupBy("chunk").applyInArrow(
        run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def decode(ids: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of rows with an array of ids: a join with the id-to-piece table, which has one
    row per id of the tokenizer. Ids that the tokenizer lacks have no piece, as in the library; a null
    or empty array gives an empty text. Rows with one id are decoded each."""
    spark = ids.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        pieces = pieces_of(f.read())
    table = spark.createDataFrame(list(enumerate(pieces)), "piece_id long, piece string")
    rows = ids.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"),
                      F.col(ids_col).alias("ids"))
    rows = rows.select("row_no", "doc_id", F.posexplode_outer("ids").alias("at", "piece_id"))
    joined = rows.join(F.broadcast(table), "piece_id", "left")
    return joined.groupBy("row_no", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))), lambda x: x["piece"]), " ").alias("decoded")).drop("row_no")
