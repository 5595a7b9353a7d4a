"""Vectorised text hashing over Arrow buffers.

Texts are handled as UTF-8 bytes, a block of documents at a time: words, their 64-bit hashes and word shingles come
from array operations, without a Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = 0x9E3779B97F4A7C15
_PRIME_INV = pow(_PRIME, -1, 2**64)
_ORDER = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Word bytes: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD_BYTES[_a:_b] = True
#: Token bytes: all but ASCII white space and control characters.
TOKEN_BYTES = np.arange(256) > 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_PRIME, _PRIME_INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and the offsets of its values; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last document + 1, bytes, offsets) of about BLOCK_BYTES each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes of a kind, none over a document's end; and offsets of each document's runs."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes; equal bytes hash equally wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and offsets of each document's words."""
    starts, ends, at = word_bounds(data, offsets, kind)
    return run_hashes(data, starts, ends), at


def grams(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words within a document, and offsets of each document's runs."""
    count = np.maximum(np.diff(at) - n + 1, 0)
    to = np.zeros(len(at), np.int64)
    np.cumsum(count, out=to[1:])
    if to[-1] == 0:
        return np.zeros(0, np.uint64), to
    full = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        full += words[j : len(words) - n + 1 + j] * _ORDER[j]
    doc = np.repeat(np.arange(len(count)), count)
    return mix(full[np.arange(to[-1]) - to[doc] + at[:-1][doc]]), to


def shingles(words: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Per document its shingles of n words with repeats; one of all its words if it has fewer, none without words."""
    hashes, to = grams(words, at, n)
    out = []
    for i in range(len(at) - 1):
        k = at[i + 1] - at[i]
        if k >= n:
            out.append(hashes[to[i] : to[i + 1]])
        elif k:
            out.append(mix((words[at[i] : at[i + 1]] * _ORDER[:k]).sum(keepdims=True) + np.uint64(k)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory that it is done with back to the system: a worker idles beside others' tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another libc
