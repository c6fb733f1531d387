"""Vectorised word splitting and hashing over Arrow string buffers.

A word is a maximal run of bytes outside space and 0x09-0x0D, which in UTF-8
is the same as a run of characters outside them. All hashes are pure functions
of the bytes, so every executor names equal words and n-grams alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = 0xDA942042E4DD58B5
_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of some documents: ``hash`` of each, byte ``start`` and ``end``,
    and ``first`` (document i has words first[i] to first[i+1])."""

    __slots__ = ("data", "start", "end", "first", "hash", "doc_bytes")

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.fill_null("") if texts.null_count else texts
        texts = texts if pa.types.is_large_string(texts.type) else texts.cast(pa.large_string())
        buffers = texts.buffers()
        at = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(buffers[2], dtype=np.uint8)[at[0] : at[-1]] if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
        at = at - at[0]
        if lower:
            data = _LOWER[data]
        inside = ~_SPACE[data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = at[:-1][at[:-1] < len(data)]
        starts[edges] |= inside[edges]
        edges = at[1:][at[1:] > 0] - 1
        ends[edges] |= inside[edges]
        self.data, self.doc_bytes = data, at
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        power, inverse = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
        size = (self.end - self.start).astype(U)
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + size * U(0x9E3779B97F4A7C15))

    def __len__(self) -> int:
        return len(self.first) - 1


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= U(_GRAM)
        out += hashes[j : n + j]
    return mix(out + U(k))


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` text bytes each (one row at least), so that temporaries stay bounded."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def planes(x: np.ndarray) -> bytes:
    """Byte planes of an integer array: equal high bytes lie together, so the shuffle codec shrinks them."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(raw, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()
