"""Words and shingles of many texts at once, as numpy hashes.

The texts of a batch are laid end to end as bytes; one running sum of random
byte values times powers of an odd number gives the hash of any stretch as a
difference, so words need no Python objects.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Of a second hash that has nothing to do with the first.
_BYTE_2 = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE_2 = 0xA24BAED4963EE407
_INVERSE_2 = pow(_BASE_2, -1, 1 << 64)
_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[[0, 9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}
SHINGLE = 5
_MULTIPLIERS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        done = 1
        step = base
        while done < size:  # double what is there
            have[done : 2 * done] = have[:done] * np.uint64(step)
            done, step = 2 * done, step * step % (1 << 64)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stretches(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """Hashes of the stretches of bytes ``[begins, ends)``; ``second``: by another hash."""
    byte, base, inverse = (_BYTE_2, _BASE_2, _INVERSE_2) if second else (_BYTE, _BASE, _INVERSE)
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(byte[data] * _power_table(base, n), out=total[1:])
    return mix((total[ends] - total[begins]) * _power_table(inverse, n)[begins])


def slices(texts: list[str], chars: int = 400_000):
    """Runs of texts with about ``chars`` characters, each a (first, last) pair; a longer text stands alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def words(texts: list[str], with_lengths: bool = False) -> tuple:
    """Hashes of all words (between ASCII white space, as they are) and, per text, where its words begin; one entry more than texts.

    ``with_lengths`` adds the words' lengths in bytes.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
    gap = _SEPARATES[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    hashes = stretches(data, starts, ends)
    begins = np.concatenate([[0], np.cumsum(np.array([len(p) + 1 for p in parts], dtype=np.int64))])
    at = np.searchsorted(starts, begins)
    return (hashes, at, ends - starts) if with_lengths else (hashes, at)


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, in order, and per text where its shingles begin.

    A text with fewer words has one shingle of all its words, one without words none.
    """
    hashes, at = words(texts)
    counts = np.diff(at)
    out_counts = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(out_counts)])
    if not begins[-1]:
        return np.zeros(0, dtype=np.uint64), begins
    first = np.repeat(at[:-1] - begins[:-1], out_counts) + np.arange(begins[-1])
    padded = np.concatenate([hashes, np.zeros(size, dtype=np.uint64)])
    left = np.repeat(at[1:], out_counts) - first
    short = left < size
    out = np.zeros(begins[-1], dtype=np.uint64)
    for j in range(size):
        part = padded[first + j] * _MULTIPLIERS[j % len(_MULTIPLIERS)]
        if short.any():
            part[left <= j] = 0
        out += part
        out = (out << np.uint64(7)) | (out >> np.uint64(57))
    return mix(out), begins
