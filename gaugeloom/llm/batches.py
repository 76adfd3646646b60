"""Texts of an Arrow batch as one byte buffer, and vectorised word hashes over it."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
CHUNK = 1 << 20
U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20_240_601)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


class giving_back:
    """A function of batches after which a worker gives freed memory back to the system: it lives on for tasks of other stages,
    while the allocators would keep what the largest batch took."""

    def __init__(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> None:
        self.run = run

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from self.run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with about `limit` bytes of text: (slice, UTF-8 bytes, offsets)."""
    column = batch.column(text)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit changes half of the output bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n + 1, CHUNK + 1)
            cls.up = np.cumprod(np.concatenate([np.ones(1, U), np.full(size, U(_BASE))]))
            cls.down = np.cumprod(np.concatenate([np.ones(1, U), np.full(size, U(_INVERSE))]))
        return cls.up, cls.down


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of bytes for which is_word holds, and how many each text has.
    A word ends with its text."""
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0] - 1
    ends[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by prefix sums of a polynomial over random byte values."""
    up, down = _Powers.to(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(_STEP))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of `width` words, and how many it has.  A text with fewer words, but
    not none, has one shingle."""
    n = len(words)
    factors = mix(np.arange(1, width + 1, dtype=U) * U(_STEP)) | U(1)
    whole = np.zeros(max(0, n - width + 1), U)
    for j in range(width):
        whole += words[j : j + len(whole)] * factors[j]
    whole = mix(whole)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out = np.empty(int(made.sum()), U)
    to = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    at = np.arange(len(out)) - np.repeat(to[:-1], made) + np.repeat(first, made)
    long = np.repeat(counts >= width, made)
    out[long] = whole[at[long]]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        few = words[first[i] : first[i] + counts[i]]
        out[to[i]] = mix(np.array([(int(np.sum(few * factors[: len(few)], dtype=U)) + len(few) * _STEP) % (1 << 64)], U))[0]
    return out, made


def byte_table(excluded: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(excluded)] = False
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
