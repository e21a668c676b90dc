"""Vectorised word and shingle hashing of UTF-8 texts with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after A-Z become a-z.
Hashes have 64 bits: a polynomial over a word's bytes, mixed, then a polynomial over five mixed words, mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Powers that a worker keeps: of batches of a megabyte and a text beyond.
KEPT_POWERS = 1 << 21
_POWERS: list = [np.ones(1, U), np.ones(1, U)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
COEF = [U(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; those of a usual batch are kept, a very long text's are not."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(1 << (n - 1).bit_length(), U(b))
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= KEPT_POWERS:
        _POWERS[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every input bit moves every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the number of words of each text."""
    joined = b" ".join(t or b"" for t in texts) + b" "
    data = _LOWER[np.frombuffer(joined, np.uint8)]
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    ends_of_text = np.cumsum(lengths + 1)
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) == 0:
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    up, down = _powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U)))
    h = (total[ends] - total[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(U) * U(0x2545F4914F6CDD1D))
    which = np.searchsorted(ends_of_text, starts, side="right")
    return h, np.bincount(which, minlength=len(texts))


def shingle_sets(texts: list[bytes | None], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts one after another, their number by text, words' hashes, words by text).

    Each text's hashes are sorted. A text of fewer than ``size`` words has one shingle, the
    whole sequence; a text without words has none.
    """
    h, n = word_hashes(texts)
    begin = np.concatenate(([0], np.cumsum(n)))
    m = len(h)
    acc = np.zeros(m, U)
    for k in range(size):
        part = h[k:] * COEF[k] if k < m else np.zeros(0, U)
        acc[: m - k if k < m else 0] += part
    full = np.maximum(n - size + 1, 0)
    doc = np.repeat(np.arange(len(texts)), full)
    first = np.repeat(begin[:-1], full) + (np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full))
    values = mix(acc[first])
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.array([sum(int(h[begin[i] + k]) * int(COEF[k]) for k in range(n[i])) + int(n[i]) & (2**64 - 1) for i in short], U)
        values, doc = np.concatenate((values, mix(extra))), np.concatenate((doc, short))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    if len(values):
        new = np.concatenate(([True], (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])))
        values, doc = values[new], doc[new]
    return values, np.bincount(doc, minlength=len(texts)), h, n


def batches(column, most_bytes: int = 1 << 20):
    """Slices (begin, end) of an Arrow string column, each of about ``most_bytes`` unless one text alone is longer."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, s in enumerate(size):
        if total and total + s > most_bytes:
            yield begin, i
            begin, total = i, 0
        total += int(s) + 1
    if begin < len(size):
        yield begin, len(size)
