"""Vectorised text primitives that work straight on Arrow string buffers.

Texts are handled as UTF-8 bytes.  A batch of texts is one byte array with offsets; words, word hashes and
n-gram hashes come from whole-array numpy operations, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _c_library():
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed from now on: arrays of 1 MB or more are mapped on their own
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        return libc
    except (OSError, AttributeError):  # another C library
        return None


_libc = _c_library()


def give_back() -> None:
    """Return freed memory to the system: a worker waits idle for its next task, beside others that need the memory."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 2**64)
#: Random byte values of the polynomial hash; made from a fixed seed so that every worker has the same ones.
_VALUES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words `[^\x20\x09-\x0D]+`
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        out = np.empty(size, dtype=U64)
        out[0] = 1
        filled = 1
        while filled < size:
            step = U64(pow(base, filled, 2**64))
            with np.errstate(over="ignore"):
                out[filled : 2 * filled] = out[:filled] * step
            filled *= 2
        _powers[name] = have = out
    return have


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, max_bytes: int, max_docs: int = 1 << 30):
    """Cut a batch into runs of documents of about ``max_bytes``; a longer document is a run of its own, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), i + max_docs, n)
        yield i, j
        i = j


def gathered(batches, size: int):
    """Join the small batches that arrive into ones of about ``size`` bytes, so that runs of documents do not depend on how
    many rows a batch brings."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)
    del held
    give_back()


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans from ``start`` to ``end`` of an array of integers."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(U64) + U64(1)) * _power_table("up", _BASE, n + 1)[:n], out=sums[1:])
        return mix((sums[end] - sums[start]) * _power_table("down", _BASE_INV, n + 1)[start] + (end - start).astype(U64) * U64(_MULT))


class Words:
    """The words of a run of documents: 64-bit hashes, document index, start and end byte."""

    __slots__ = ("_inverse", "_sums", "doc", "end", "hash", "n_docs", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.n_docs = len(offsets) - 1
        low = LOWER[data]
        inside = table[low]
        n = len(low)
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < n]
        begin[edges] = inside[edges]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        last = offsets[1:] - 1
        last = last[(last >= 0) & (np.diff(offsets) > 0)]
        stop[last] = inside[last]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        with np.errstate(over="ignore"):
            powers = _power_table("up", _BASE, n + 1)
            sums = np.zeros(n + 1, dtype=U64)
            np.cumsum(_VALUES[low] * powers[:n], out=sums[1:])
            inverse = _power_table("down", _BASE_INV, n + 1)
        self._sums, self._inverse = sums, inverse
        self.hash = self._spans(self.end)

    def _spans(self, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sums[end] - self._sums[self.start]) * self._inverse[self.start] + (end - self.start).astype(U64) * U64(_MULT))

    def prefix(self, k: int) -> np.ndarray:
        """Hashes of the words' first ``k`` bytes (of the whole word, if shorter), unlike any word's own hash."""
        return mix(self._spans(np.minimum(self.end, self.start + k)) ^ U64(0x5BD1E995 + k))

    def __len__(self) -> int:
        return len(self.hash)

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def ngrams(self, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, document, first word index) of every n-gram; a document of fewer words, but not none, gives one."""
        h, d = self.hash, self.doc
        m = len(h)
        if m == 0:
            z = np.zeros(0, np.int64)
            return np.zeros(0, U64), z, z
        out = []
        with np.errstate(over="ignore"):
            if m >= n:
                at = np.flatnonzero(d[: m - n + 1] == d[n - 1 :])
                acc = np.zeros(len(at), dtype=U64)
                for k in range(n):
                    acc = mix(acc * U64(_MULT) + h[at + k])
                out.append((mix(acc ^ U64(n)), d[at], at))
            if whole_if_short:
                counts = self.per_doc()
                short = np.flatnonzero((counts > 0) & (counts < n))
                if len(short):
                    first = np.concatenate([[0], np.cumsum(counts)[:-1]])[short]
                    acc = np.zeros(len(short), dtype=U64)
                    for k in range(n):
                        has = counts[short] > k
                        acc[has] = mix(acc[has] * U64(_MULT) + h[first[has] + k])
                    out.append((mix(acc ^ (U64(0xABCD) + counts[short].astype(U64))), short, first))
        if not out:
            z = np.zeros(0, np.int64)
            return np.zeros(0, U64), z, z
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def words_of(column, table: np.ndarray, max_bytes: int = 1_000_000, max_docs: int = 1 << 30):
    """Yield (i, j, Words) for runs of documents of a batch."""
    data, offsets = text_bytes(column)
    for i, j in pieces(offsets, max_bytes, max_docs):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table)


def int64s(column) -> np.ndarray:
    """A column of integers as numpy; nulls become -2**63."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.int64()), -(2**63)).to_numpy(zero_copy_only=False)


def id_column(values: np.ndarray) -> pa.Array:
    """Back from ``int64s``."""
    return pa.array(values, pa.int64(), mask=values == -(2**63))
