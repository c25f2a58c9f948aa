"""Words and word shingles of texts as 64-bit fingerprints, in array operations over whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 19  # bytes hashed at once, which bounds the work arrays
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BACK = pow(_BASE, -1, 1 << 64)

# A-Z in lower case; bytes that part words as 32. Words are what stands between \x20 and \x09-\x0D.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads differences over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        full = lambda c: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, c, np.uint64)]))
        _powers = full(_BASE), full(_BACK)
    return _powers


def _hash_words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and fingerprint of each word in x, which begins and ends with a space."""
    in_word = x != 32
    edge = np.flatnonzero(in_word[1:] != in_word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    up, back = _power(len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of all texts in a row, and where each text's begin (one more at the end)."""
    hashes, number = [], []
    part: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal part, held
        x = np.frombuffer(b" " + b" ".join(t for _, t in part) + b" ", np.uint8)
        start, h = _hash_words(x)
        begins = np.cumsum([1] + [len(t) + 1 for _, t in part])[:-1]
        hashes.append(h)
        number.append(np.array([i for i, _ in part])[np.searchsorted(begins, start, "right") - 1])
        part, held = [], 0

    for i, t in enumerate(texts):
        t = t.translate(_FOLD)
        while len(t) > PIECE and (cut := t.find(b" ", PIECE)) >= 0:
            part.append((i, t[:cut]))
            flush()
            t = t[cut:]
        part.append((i, t))
        held += len(t)
        if held > PIECE:
            flush()
    if part:
        flush()
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    n = np.concatenate(number) if number else np.zeros(0, np.int64)
    return h, np.searchsorted(n, np.arange(len(texts) + 1))


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of each run of ``size`` words; of all of them if they are fewer, none if there is none."""
    n = len(words)
    size = min(size, n)
    if not n:
        return words
    h = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        h = mix(h * np.uint64(_BASE) + words[j : n - size + 1 + j])
    return h


def shingle_sets(texts: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct fingerprints of its word runs."""
    words, at = words_of(texts)
    whole = runs(words, size) if len(words) >= size else words[:0]
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        yield np.unique(whole[a : b - size + 1] if b - a >= size else runs(words[a:b], size))


def batches_of(column, limit: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of an Arrow string column as UTF-8 (null: empty), in parts of about ``limit`` bytes; each with its first index."""
    import pyarrow as pa

    column = column.cast(pa.binary())
    part, first, held = [], 0, 0
    for i, t in enumerate(column):
        part.append(t.as_py() or b"")
        held += len(part[-1])
        if held >= limit:
            yield first, part
            part, first, held = [], i + 1, 0
    if part:
        yield first, part
