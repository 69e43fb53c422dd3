"""Numpy helpers for Arrow text columns: documents stay one byte buffer with offsets, never Python objects per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
#: Places of a word up to which bytes have random numbers of their own; beyond, place and byte are mixed.
NEAR = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Separators of the word pattern [^\x20\x09-\x0D]+
WHITE = byte_set((0x20, 0x20), (0x09, 0x0D))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, int64 offsets (n + 1) and null flags of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    nulls = np.asarray(column.is_null())
    if nulls.any():
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), nulls
    return raw[offs[0] : offs[-1]], offs - offs[0], nulls


def blocks(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes; a row larger than that is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise and wrapping."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word of the texts in data, in order, and the words before each text (n + 1).

    Each byte at each place of a word has a number of its own, and a word's hash mixes their sum: no arithmetic of the text,
    such as words of many equal blocks, makes two words meet but by chance.
    """
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    number = np.arange(len(data))
    place = number - np.maximum.accumulate(np.where(begin, number, 0))
    low = LOWER[data]
    values = _NUMBERS[(np.minimum(place, NEAR) << 8) | low]
    far = np.flatnonzero(place >= NEAR)
    values[far] = mix(values[far] + place[far].astype(np.uint64) * np.uint64(MULTIPLIER))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    hashed = mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashed, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashed: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, one after the other, and the shingles before each text.

    A text of fewer than k words, but at least one, is one shingle of all its words; a text without words has none.
    """
    counts = np.diff(before)
    rolled = np.zeros(max(0, len(hashed) - k + 1), np.uint64)
    factor = 1
    for j in range(k):
        factor = factor * 0x9FB21C651E98DF25 % (1 << 64) | 1
        rolled += hashed[j : j + len(rolled)] * np.uint64(factor)
    rolled = mix(rolled)
    parts, sizes = [], np.zeros(len(counts) + 1, np.int64)
    for i, n in enumerate(counts.tolist()):
        if n >= k:
            low = before[i]
            part = np.sort(rolled[low : low + n - k + 1])
            if len(part) > 1:
                part = part[np.r_[True, part[1:] != part[:-1]]]
        elif n:
            total = np.uint64(n)
            for x in hashed[before[i] : before[i + 1]]:
                total = mix(np.array([total * np.uint64(MULTIPLIER) + x], np.uint64))[0]
            part = np.array([total], np.uint64)
        else:
            continue
        parts.append(part)
        sizes[i + 1] = len(part)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(sizes)


np.seterr(over="ignore")
_NUMBERS = mix(mix(np.arange((NEAR + 1) << 8, dtype=np.uint64) * np.uint64(MULTIPLIER) + np.uint64(0x2545F4914F6CDD1D)))
