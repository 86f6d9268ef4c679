"""Words of many texts at once: byte positions and 64-bit hashes in numpy, no Python per word.

A text is UTF-8; a byte table says which bytes belong to words and how they are folded. Both
tables keep every byte from 0x80 on, so characters beyond ASCII are never cut."""

from __future__ import annotations

import ctypes
import ctypes.util

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes, which bounds a task's arrays.
SLICE_BYTES = 1 << 20
_SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (public finaliser of splitmix64)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def _letters() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A:
            table[b] = b
        elif 0x41 <= b <= 0x5A:
            table[b] = b + 32
    return table


def _unspaced() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


#: Words are runs of digits, A-Z folded to a-z, and everything from 0x80 on.
LETTERS = _letters()
#: Words are runs of anything but space and 0x09 to 0x0D; the zero byte is kept by ``is_word``.
UNSPACED = _unspaced()
_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, _SEGMENT + 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key]


class Words:
    """Words of some texts: ``starts`` and ``ends`` in ``data`` (bytes), ``first`` (index of each
    text's first word, one more at the end) and ``hashes``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True):
        self.data, self.offsets = data, offsets
        inside = table != 0
        if table is UNSPACED:
            inside = inside.copy()
            inside[0] = True
        mask = inside[data]
        n = len(data)
        edges = offsets[(offsets > 0) & (offsets < n)]
        before = np.zeros(n, bool)
        before[1:] = mask[:-1]
        before[edges] = False
        after = np.zeros(n, bool)
        after[:-1] = mask[1:]
        after[edges - 1] = False
        self.starts = np.flatnonzero(mask & ~before)
        self.ends = np.flatnonzero(mask & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash(table) if hashed else None

    def _hash(self, table: np.ndarray) -> np.ndarray:
        """Polynomial hash of each word, from prefix sums over segments that end between words."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + _SEGMENT, "right")))
            begin, end = self.starts[at:to] - base, self.ends[at:to] - base
            size = int(end[-1])
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_CODE[table[self.data[base:base + size]]] * _power(_BASE, size)[:size], out=sums[1:])
            out[at:to] = (sums[end] - sums[begin]) * _power(_INVERSE, size)[begin]
            at = to
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values (also across texts; callers drop those)."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j:j + m]
    return mix(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, table: np.ndarray, hashed: bool = True) -> Words:
    return Words(*buffers(texts), table, hashed)


_LIBC = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6", use_errno=True)


def release() -> None:
    """Give freed memory back to the system. A Python worker lives as long as its executor and would otherwise
    keep what the largest batch of any stage took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: Rows that Spark hands to a Python worker at once, where the session does not say.
BATCH_ROWS = 1000


def bounded_batches(spark) -> None:
    """Let Spark send texts in smaller batches than its default of 10,000 rows, which both the executor and its
    Python workers hold several times. A session that chose a number of its own keeps it."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES):
    """The batch in runs of rows with about ``limit`` bytes of text each; a longer text is alone."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(text_col)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()
