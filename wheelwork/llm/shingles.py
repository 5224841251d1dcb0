r"""Hashed word shingles of whole texts, in numpy.

Words are runs of bytes other than ``\x20\x09-\x0D`` with A-Z lower-cased. A shingle is
a 48-bit hash of k words in a row (of all words, where a text has fewer than k). Two
different shingles of one pair of texts meet by chance once in some 10**9 pairs.
"""

from __future__ import annotations

import functools

import numpy as np

WHITE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(32 if b in WHITE else b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at once: some 50 MB of arrays.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (each input bit reaches each output bit)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _chunk_powers(base: int) -> np.ndarray:
    return _accumulated(base, CHUNK + 1)


def _accumulated(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those of a chunk (8 MB for each base) are kept, longer ones made anew."""
    return _chunk_powers(base)[:n] if n <= CHUNK + 1 else _accumulated(base, n)


def stretch_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of stretches of a byte buffer, before the last mixing."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buf)), out=sums[1:])
    return (sums[end] - sums[start]) * powers(pow(BASE, -1, 1 << 64), len(buf) + 1)[start]


def _word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in a buffer whose white space is all blanks."""
    word = np.concatenate(([False], buf != 32, [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[0::2], edge[1::2]
    return starts, mix(stretch_hashes(buf, starts, ends))


def shingle_sets(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all texts' shingle sets, and the sets one after the other, each sorted."""
    sizes, sets = np.zeros(len(texts), np.int64), []
    factors = [np.uint64(x) for x in (mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1))]
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or b"") < CHUNK):
            size += len(texts[hi] or b"") + 1
            hi += 1
        data = b" ".join(t or b"" for t in texts[lo:hi]).translate(_LOWER)
        if data:
            starts, words = _word_hashes(np.frombuffer(data, np.uint8))
            begins = np.cumsum([0, *(len(t or b"") + 1 for t in texts[lo:hi])])
            at = np.searchsorted(starts, begins)
            n = len(words) - k + 1
            rows = sum((words[j : j + n] * factors[j] for j in range(k)), np.uint64(0)) if n > 0 else words[:0]
            rows = mix(rows) >> np.uint64(16) if n > 0 else rows
            for i in range(hi - lo):
                a, b = int(at[i]), int(at[i + 1])
                if b - a >= k:
                    own = np.unique(rows[a : b - k + 1])
                elif b > a:
                    short = words[a:b] * np.array(factors[: b - a])
                    own = mix(short.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)) >> np.uint64(16)
                else:
                    continue
                sizes[lo + i] = len(own)
                sets.append(own)
        lo = hi
    return sizes, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def set_digests(sizes: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, whatever the order; 0 for empty sets."""
    out = []
    full = np.flatnonzero(sizes)
    begins = np.concatenate(([0], np.cumsum(sizes[full])[:-1])).astype(np.int64)
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        d = np.zeros(len(sizes), np.uint64)
        if len(full):
            d[full] = np.add.reduceat(mix(sets + np.uint64(salt)), begins)
        out.append(d)
    return out[0], out[1]
