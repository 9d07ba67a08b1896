"""Vectorised word and shingle hashing shared by the text operators.

A word is a maximal run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
return; as UTF-8 never uses those bytes inside a longer character this equals ``[^\\x20\\x09-\\x0D]+`` over
code points. Hashes depend only on a word's bytes: they agree between processes, machines and runs.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _hash_piece(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(inside))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, U64)
    power, inverse = _grown(max(1 << 16, len(b)))
    total = np.zeros(len(b) + 1, U64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    return mix64((total[last] - total[first]) * inverse[first] + (last - first).astype(U64))


def hash_words(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 ``data``, in order. Long texts go by pieces that end between words, so
    the memory beside the result is bounded (a single longer word excepted)."""
    if len(data) <= _CHUNK:
        return _hash_piece(data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and data[end] not in b"\t\n\v\f\r ":
            end += 1
        parts.append(_hash_piece(data[at:end]))
        at = end
    return np.concatenate(parts)


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return (text or "").encode("utf-8", "replace").lower()


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, in order; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return np.empty(0, U64)
    k = min(width, n)
    h = np.zeros(n - k + 1, U64)
    for j in range(k):
        h = h * U64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j]
        h ^= h >> U64(29)
    return mix64(h + U64(k))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries need not


def release() -> None:
    """Gives memory that the allocators hold free back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def frugal(work):
    """``work`` over Arrow batches, with free memory given back after each batch and at the end: Python workers live
    on beside the next stages, on the memory of the same executor."""

    def run(batches):
        def each():
            for batch in batches:
                yield batch
                del batch
                release()

        yield from work(each())
        release()

    return run
