"""Hashes of words and word shingles for a whole batch of texts at once, in numpy.

A word is a run of bytes outside `[\\x20\\x09-\\x0D]`, with A-Z lower-cased. Its 64-bit hash is a polynomial over random
byte values, finished by a mixing function; whole batches are hashed by one cumulative sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import text_bytes

BLOCK = 1 << 20
_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_FACTORS = _RNG.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        inverse = pow(_BASE, -1, 2**64)
        for name, x in (("up", _BASE), ("down", inverse)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Places to cut the bytes into blocks, none inside a word."""
    cuts, at = [0], 0
    while len(data) - at > BLOCK:
        end = at + BLOCK
        space = np.flatnonzero(_SPACE[data[at:end]])
        text = int(offsets[np.searchsorted(offsets, end, side="right") - 1])
        end = max(text, at + int(space[-1]) + 1 if len(space) else at)
        if end <= at:
            after = np.flatnonzero(_SPACE[data[at + BLOCK :]])
            later = offsets[np.searchsorted(offsets, at, side="right") :]
            end = min(int(later[0]) if len(later) else len(data), at + BLOCK + int(after[0]) + 1 if len(after) else len(data))
        cuts.append(end)
        at = end
    return [*cuts, len(data)] if cuts[-1] < len(data) or len(cuts) == 1 else cuts


def word_spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes; edges: offsets of texts, over which no word runs."""
    gap = _SPACE[data]
    begins, ends = ~gap, ~gap
    begins[1:] &= gap[:-1]
    ends[:-1] &= gap[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    begins[inner] |= ~gap[inner]
    ends[inner - 1] |= ~gap[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the offsets of each text's words."""
    data, offsets = text_bytes(texts)
    cuts, hashes, starts = _cuts(data, offsets), [], []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = data[lo:hi]
        if not len(part):
            continue
        edges = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")] - lo
        begin, end = word_spans(part, edges)
        hashes.append(hash_spans(_LOWER[part] if lower else part, begin, end))
        starts.append(begin + lo)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets)


def hash_spans(part: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_VALUE[part] * up[: len(part)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(_BASE))


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each text, in order; a shorter text with words gives one, of all its words."""
    n, counts = len(hashes), np.diff(offsets)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    padded = np.concatenate([hashes, np.zeros(size - 1, np.uint64)])
    last = np.repeat(offsets[1:], counts)  # of each word, the end of its text
    total = np.zeros(n, np.uint64)
    for k in range(size):
        word = padded[k : k + n] * _FACTORS[k]
        total += np.where(np.arange(k, n + k) < last, word, np.uint64(k + 1))
    keep = np.arange(n) + size <= last
    keep[offsets[:-1][(counts > 0) & (counts < size)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return mix(total[keep]), kept[offsets]
