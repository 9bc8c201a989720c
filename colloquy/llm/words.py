"""Word and shingle hashes of many texts at once, as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  Hashes are 64 bits: a random value
per byte, weighted by powers of an odd constant modulo 2**64, then mixed.  They are the same
in every process, so equal words get equal hashes on every executor."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All but ASCII letters, digits and the bytes of other characters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of them."""
    return _powers(1 << max(16, int(size - 1).bit_length()))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running sums H, so that a slice [s, e) hashes to (H[e] - H[s]) * inverse**s."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def slice_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a batch of texts; those of text i are ``first[i]:first[i + 1]``."""

    buf: np.ndarray
    base: np.ndarray  # where each text starts in buf
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: list[bytes], lower: bool = False, space: np.ndarray = _SPACE) -> Words:
    """``space``: by byte value, whether it parts words; the line feed must."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = _LOWER[buf]
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=base[1:])
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[1:] = ~space[buf]
    edge = np.diff(inside)
    start = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    first = np.searchsorted(start, base)
    return Words(buf, base, start, end, first, slice_hash(prefix_hash(buf), start, end))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether these all lie in one text."""
    n = len(w.hash)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _U(0xD6E8FEB86659FD93)
        h[: max(0, n - j)] += w.hash[j:]
    left = np.repeat(w.first[1:], w.count) - np.arange(n)
    return mix(h + _U(k)), left >= k


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than k words has its whole
    sequence as one shingle, a text without words none."""
    h, whole = windows(w, k)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            short = _U(0)
            for x in w.hash[a:b]:
                short = _U((int(short) * 0xD6E8FEB86659FD93 + int(x)) % (1 << 64))
            out.append(mix(np.array([short], np.uint64) + _U(b - a)))
        else:
            out.append(h[:0])
    return out
