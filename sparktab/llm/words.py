"""Words of UTF-8 text as numpy arrays: spans, 64-bit word hashes and k-gram hashes.

All functions work on one buffer that holds several texts end to end. Delimiters are
ASCII, so the bytes of a multi-byte character never split a word. Memory: a few bytes
per byte of the buffer for the spans; hashing goes through it in slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SLICE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _table(delimiters: set[int]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(delimiters)] = False
    return out


#: Words are runs of anything but space, tab, LF, VT, FF and CR.
SPACED = _table({0x20, *range(0x09, 0x0E)})
#: Words are runs of digits, a-z and everything beyond ASCII; lower-case first.
ALNUM = _table({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        base, size = 0x5851F42D4C957F2D, max(n, 2 * _SLICE)
        _POWERS[:] = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets of a string or binary column (null: empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one more entry: the total)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal bytes have equal hashes. Spans must ascend and not overlap."""
    return beginnings(data, starts, ends, ())[0]


def beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """A row of hashes of the whole spans, and one for each size with those of their first bytes (all, if fewer)."""
    out = np.empty((1 + len(sizes), len(starts)), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, low + _SLICE, side="right")))
        high = int(ends[upto - 1])
        power, inverse = _powers(high - low + 1)
        total = np.empty(high - low + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data[low:high]] * power[: high - low], out=total[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        for row, stop in enumerate([e, *[np.minimum(e, s + size) for size in sizes]]):
            out[row, at:upto] = (total[stop] - total[s]) * inverse[s] + (stop - s).astype(np.uint64) * _ODD
        at = upto
    return mix(out)


def grams(word_hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each position on, for every position that has k words after it in the buffer."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((0xD1342543DE82EF95 + 2 * seed * 0x2545F4914F6CDD1D) & ((1 << 64) - 1))
    out = np.full(n, np.uint64(k + seed), np.uint64)
    for j in range(k):
        out = out * base + word_hashes[j : j + n]
    return mix(out)


def within(first_word: np.ndarray, k: int) -> np.ndarray:
    """Positions at which k words of one text start, for k-grams over the whole buffer."""
    total = int(first_word[-1])
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    for back in range(1, k):
        at = first_word[1:] - back
        at = at[(at >= np.maximum(first_word[:-1], 0)) & (at >= 0) & (at < n)]
        ok[at] = False
    return np.flatnonzero(ok)


def text_of(first_word: np.ndarray) -> np.ndarray:
    """Index of the text of every word."""
    return np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))


def covered(n_words: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for each word that lies in one of the ranges [start, end)."""
    change = np.zeros(n_words + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def narrow(values: np.ndarray) -> bytes:
    """Unsigned values in bytes, least significant planes first, with as many planes as the largest needs."""
    values = np.ascontiguousarray(values, dtype="<u8")
    most = int(values.max()) if len(values) else 0
    width = max(1, (most.bit_length() + 7) // 8)
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def widen(raw: bytes, n: int) -> np.ndarray:
    """What narrow() wrote, as unsigned 64-bit values."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<u8")
