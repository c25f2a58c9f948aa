"""Words of whole Arrow text columns by NumPy: byte classes, spans, hashes and exact comparison, without a Python object a word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONG = 1_024  # bytes from which on a word is hashed and compared by itself
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: A-Z in lower case, every other byte as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def table(chars: bytes) -> np.ndarray:
    """For each byte whether it is one of ``chars``."""
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: What parts words: space, and tab to carriage return.
BLANK = table(b"\x20\x09\x0a\x0b\x0c\x0d")


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column: row i is bytes[offsets[i] : offsets[i + 1]]. Null is empty. The bytes are Arrow's own."""
    col = pc.fill_null(col, "") if col.null_count else col
    wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def padded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with eight zeros behind them, and the eight bytes from each place on as one number."""
    x = np.zeros(len(data) + 8, np.uint8)
    x[: len(data)] = data
    return x, np.ndarray((len(data) + 1,), "<u8", x, strides=(1,))


def counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often the mask holds in each row, by prefix sums."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return np.diff(sums[offsets])


def spans(data: np.ndarray, offsets: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of bytes that aren't in ``stop``; a run ends with its row."""
    word = ~stop[data]
    first, last = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[first], after[last] = False, False
    starts = np.flatnonzero(word & ~before)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, np.flatnonzero(word & ~after) + 1, row


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C2
    h = (h ^ (h >> np.uint64(29))) * _C1
    return h ^ (h >> np.uint64(32))


def hashes(x: np.ndarray, lanes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time. ``x`` and ``lanes`` are from ``padded``."""
    size = ends - starts
    h = mixed(size.astype(np.uint64) * _C1 + np.uint64(seed))
    at, k = np.flatnonzero(size <= LONG), 0
    while len(at):
        left = size[at] - k
        h[at] = mixed((h[at] ^ (lanes[starts[at] + k] & _MASKS[np.minimum(left, 8)])) * _C2)
        at, k = at[left > 8], k + 8
    for i in np.flatnonzero(size > LONG):
        own = hashlib.blake2b(x[starts[i] : ends[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest()
        h[i] = np.uint64(int.from_bytes(own, "little"))
    return h


def equal(x: np.ndarray, lanes: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the words a and b, each (starts, ends), have the same bytes."""
    size = a[1] - a[0]
    out = size == b[1] - b[0]
    at, k = np.flatnonzero(out & (size <= LONG)), 0
    while len(at):
        left = size[at] - k
        same = ((lanes[a[0][at] + k] ^ lanes[b[0][at] + k]) & _MASKS[np.minimum(left, 8)]) == 0
        out[at[~same]] = False
        at, k = at[same & (left > 8)], k + 8
    for i in np.flatnonzero(out & (size > LONG)):
        out[i] = np.array_equal(x[a[0][i] : a[1][i]], x[b[0][i] : b[1][i]])
    return out


def gathered(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow binary column."""
    size = ends - starts
    to = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    data = x[np.repeat(starts - to[:-1], size) + np.arange(to[-1])] if len(size) else x[:0]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(data))])
