"""Word shingles as 64-bit hashes, vectorised over the bytes of one text."""

from __future__ import annotations

import numpy as np

#: An odd base, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept, and doubled when a longer text comes."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        full = np.full(size, base, np.uint64)
        full[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(full)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(codes: np.ndarray, base: int = BASE) -> np.ndarray:
    """H with H[j] - H[i] = base^i times the hash of codes[i:j]."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(base, len(codes)), out=out[1:])
    return out


def inverse(base: int = BASE) -> int:
    return pow(base, -1, 1 << 64)


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word, in order; words end at the bytes x20 and x09 to x0D."""
    codes = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~_SPACE[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    sums = prefix_hashes(codes)
    return mix((sums[end] - sums[begin]) * powers(inverse(), len(codes) + 1)[begin] + (end - begin).astype(np.uint64))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words of the ASCII-lower-cased text; fewer words make one run."""
    hashes = word_hashes(text.lower())
    if not len(hashes):
        return hashes
    n = max(len(hashes) - words + 1, 1)
    out = np.full(n, min(len(hashes), words), np.uint64)
    for k in range(min(words, len(hashes))):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n])
    return np.unique(out)
