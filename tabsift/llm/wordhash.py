"""Vectorised word and shingle hashing over Arrow text batches (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD1342543DE82EF95)
#: Bytes that are hashed at once: temporary arrays of eight bytes a byte stay small.
CHUNK_BYTES = 1 << 20

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_up = powers(BASE, CHUNK_BYTES + 1)
_down = powers(np.uint64(pow(int(BASE), -1, 1 << 64)), CHUNK_BYTES + 1)


def chunks(texts: pa.Array):
    """(first row, bytes, row offsets) of runs of rows of about CHUNK_BYTES; a longer text is a run of its own. Null counts as empty."""
    array = texts.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, A-Z lowered, and the word count of each row. Words are runs of other bytes than 0x20 and 0x09-0x0D."""
    rows = len(offsets) - 1
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.zeros(rows, dtype=np.int64)
    inside = ~_space[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)       # a row's first byte starts a word even if the byte before is one of a word
    fresh[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~fresh[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) & ~fresh[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = (_up, _down) if len(data) < len(_up) else (powers(BASE, len(data) + 1), powers(np.uint64(pow(int(BASE), -1, 1 << 64)), len(data) + 1))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((_lower[data].astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64)))
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * STEP)
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of ``size`` words, and how many each row has. A row of fewer words, but not none, has its whole sequence as one."""
    starts = np.concatenate(([0], np.cumsum(counts)))
    if not len(words):
        return np.empty(0, dtype=np.uint64), np.zeros(len(counts), dtype=np.int64)
    own = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    full = np.zeros(len(words), dtype=np.uint64)
    weight = powers(STEP, size)
    row = np.repeat(np.arange(len(counts)), counts)
    left = starts[row + 1] - np.arange(len(words))    # words of the row from here on
    for j in range(size):
        part = words[j:] * weight[j]
        full[:len(words) - j] += np.where(left[:len(words) - j] > j, part, np.uint64(0))
    first = np.arange(len(words)) == starts[row]
    keep = (left >= size) | (first & (counts[row] < size))
    return mix(full[keep] + np.minimum(left[keep], size).astype(np.uint64)), own


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes sorted, without repeats, and how many are left."""
    ends = np.cumsum(counts)
    parts = [np.unique(hashes[e - c:e]) for c, e in zip(counts, ends)]
    return (np.concatenate(parts) if parts else hashes), np.array([len(p) for p in parts], dtype=np.int64)
