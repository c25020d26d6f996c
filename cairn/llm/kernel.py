"""Vectorised text kernels over Arrow buffers: no Python loop touches a word or a character.

Words are runs of ASCII letters, digits and bytes of non-ASCII characters, lower-cased. A word's
hash is a polynomial of its bytes modulo 2**64 (prefix sums times inverse powers), then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a kernel works on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch, where the session has Spark's default: a batch of long texts is large.
BATCH_ROWS = 2000

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_N = np.uint64(0xD6E8FEB86659FD93)
_WORD = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _WORD[_c] = True
_WORD[128:] = True
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, base in enumerate((_P, _PINV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _pow[k] = np.cumprod(x)
    return _pow[0][:n], _pow[1][:n]


def frugal(spark) -> None:
    """Smaller Arrow batches for this session, unless it has its own setting: two workers of an executor
    and the JVM hold a few batches each."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def without(df, *names: str):
    """``df`` less its columns of these names: an input column named as a result's gives way to it."""
    low = {n.lower() for n in names}
    return df.drop(*[df[c] for c in df.columns if c.lower() in low])


def aside(df, *names: str):
    """(``df`` with its columns of these names renamed, a function that gives a result the columns of ``df`` back)."""
    low = {n.lower() for n in names}
    new = [f"{c}__kept" if c.lower() in low else c for c in df.columns]
    names_ = df.columns
    return df.toDF(*new), lambda out: out.select(*new).toDF(*names_)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task would hold it."""
    if len(_pow[0]) > 2 * CHUNK_BYTES:
        _pow[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def text_buffer(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if lower:
        col = pc.utf8_lower(col)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), np.int64)
        group = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
            yield b.slice(int(s), int(e - s))
    give_back()


class Words:
    """Words of a column of texts: ``hash``, ``doc`` (row number), ``start``/``end`` (byte positions
    in ``data``) and ``first`` (number of the first word of each row, with one more at the end)."""

    def __init__(self, col: pa.Array):
        self.data, self.offsets = text_buffer(col)
        n = len(self.data)
        inside = _WORD[self.data]
        edge = np.empty(n + 1, bool)
        if n:
            edge[0], edge[n] = inside[0], inside[-1]
            np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
            # a word never runs across two texts
            cut = self.offsets[1:-1]
            cut = np.unique(cut[(cut > 0) & (cut < n)])
            both = cut[inside[cut] & inside[cut - 1]]
            at = np.flatnonzero(edge)
            if len(both):
                at = np.sort(np.concatenate([at, both, both]))
        else:
            at = np.zeros(0, np.int64)
        self.start, self.end = at[0::2], at[1::2]
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of the first word) of every run of n words inside one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hash[:m].copy()
        for k in range(1, n):
            h *= _N
            h += self.hash[k : k + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(h[at]), at


def distinct_per_doc(doc: np.ndarray, h: np.ndarray, bits: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, the upper ``bits`` of the hash), sorted by both. At most 2**(64-bits) rows."""
    key = (doc.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits))
    key.sort()
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key >> np.uint64(bits)).astype(np.int64), key & np.uint64((1 << bits) - 1)
