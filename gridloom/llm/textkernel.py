"""Vectorised word and n-gram hashing over Arrow string buffers: numpy inside tasks, no loop over words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One random 64-bit value for each byte value.
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)

#: Bytes of text handled at once: bounds the scratch arrays to some tens of MB.
SLICE_BYTES = 1 << 20


#: What a worker remembers from task to task, to be emptied when it turns to work of another kind.
MEMORIES: list[Callable[[], None]] = []


def release(keep: bool = False) -> None:
    """At a task's end: empty memories (unless the next task is likely to need them) and give freed pages back.

    Workers live on between stages; without this each keeps the largest size that any stage has needed.
    """
    if not keep:
        for forget in MEMORIES:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes each; a longer document has a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(stop, n)
        start = stop


def separators(chars: bytes) -> np.ndarray:
    """Table of 256 flags: which bytes end a word."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: What separates terms: all ASCII but letters and digits.
NOT_TERM = separators(bytes(i for i in range(128) if not chr(i).isalnum()))
NEWLINE = separators(b"\n")


def spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of all words, the index of each document's first word (one more at the end), and the word bytes' mask."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64), np.zeros(0, bool)
    solid = ~sep[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[first[1:] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets).astype(np.int64), solid


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, lower: bool = False, sep: np.ndarray = _SEP, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words, and the index of each document's first word (one more at the end).

    For each byte length in `prefixes` an array more: hashes of the words cut to that length (0 where not longer).
    """
    if lower:
        data = _LOWER[data]
    starts, length, bounds, solid = spans(data, offsets, sep)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds, *[np.zeros(0, np.uint64) for _ in prefixes]
    power = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
    at = np.flatnonzero(solid)
    first_at = np.cumsum(length) - length
    place = np.arange(len(at)) - np.repeat(first_at, length)
    value = _BYTE[data[at]] * power[place]
    salt = np.uint64(0xD6E8FEB86659FD93)
    sums = np.add.reduceat(value, first_at)
    cut = []
    for n in prefixes:
        part = np.add.reduceat(np.where(place < n, value, np.uint64(0)), first_at)
        cut.append(np.where(length > n, mix(part + np.uint64((n * int(salt) + 1) % 2**64)), np.uint64(0)))
    return mix(sums + length.astype(np.uint64) * salt), bounds, *cut


_COEF = np.random.default_rng(77).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; places whose k words leave a document are the caller's to skip."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * _COEF[j]
    return mix(total + np.uint64(k))


def places(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and document index of each n-gram of k words that lies within one document."""
    count = np.maximum(np.diff(bounds) - k + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    start = np.repeat(bounds[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return start, doc
