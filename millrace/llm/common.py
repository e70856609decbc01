"""What the operators of this subpackage share: intermediate tables (from the library) and word hashes."""

from __future__ import annotations

import numpy as np

from millrace.operators.ranks import positions
from millrace.storage import shared_folder, written

__all__ = ["mix", "positions", "shared_folder", "shingle_hashes", "word_hashes", "written"]


_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x += _STEP
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A fixed random 64-bit value for each byte.
_BYTES = mix(np.arange(256, dtype=np.uint64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x5851F42D4C957F2D
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            size = 1 << (n - 1).bit_length()
            _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE, dtype=np.uint64)])
            _INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)])
    return _POWERS, _INVERSES


#: Bytes that are hashed at a time; a word may be longer.
_BLOCK = 1 << 20


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 bytes; words are parted by ASCII white space."""
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = np.r_[True, _SPACE[raw], True]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")))
        low, high = int(starts[at]), int(ends[upto - 1])
        power, inverse = _powers(high - low + 1)
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTES[raw[low:high]] * power[: high - low], out=total[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = upto
    return out


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words make one shingle."""
    if not len(words):
        return words
    size = min(n, len(words))
    count = len(words) - size + 1
    h = np.full(count, size, dtype=np.uint64)
    for i in range(size):
        h = mix(h ^ words[i : i + count])
    return np.unique(h)
