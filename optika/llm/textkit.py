"""Vectorised word and hash kernels over Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D (the class
``[^\\x20\\x09-\\x0D]+``); these bytes never occur inside a multi-byte UTF-8
sequence, so the kernels work on raw bytes without decoding.  Everything is
numpy on whole chunks: no Python-level loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BLOCK = 1 << 18
#: Odd multiplier of the word-sequence polynomial.
SEQUENCE_BASE = _U(0xD6E8FEB86659FD93)
#: Another one, for a second hash that is independent of the first.
SECOND_BASE = _U(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _TABLES or len(_TABLES["up"]) < n:
        _TABLES["up"], _TABLES["down"] = _powers(_BASE, n + 1), _powers(_BASE_INVERSE, n + 1)
    return _TABLES["up"], _TABLES["down"]


@dataclass
class Words:
    """The words of a chunk of texts: byte spans and, per text, the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # texts + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        i, n = 0, len(self.starts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + _BLOCK, "right")))
            at = int(self.starts[i])
            part = self.data[at : int(self.ends[j - 1])]
            up, down = _tables(max(len(part), _BLOCK))
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODES[part] * up[: len(part)], out=sums[1:])
            s, e = self.starts[i:j] - at, self.ends[i:j] - at
            out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            i = j
        return mix(out)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (n + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    """Finds the words of each text of a string column; ``lower`` lower-cases A-Z."""
    data, offs = buffers(column)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offs))


def sequence_hashes(h: np.ndarray, k: int, base: np.uint64 = SEQUENCE_BASE) -> np.ndarray:
    """Hashes of all runs of k elements of h (len(h) - k + 1 of them), in log2(k) passes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n, out, size = len(h), None, 0
    power, width, bit = h, 1, k
    while bit:
        if bit & 1:
            if out is None:
                out, size = power, width
            else:
                m = n - size - width + 1
                out, size = out[:m] + power[size : size + m] * _U(pow(int(base), size, 2**64)), size + width
        bit >>= 1
        if bit:
            m = n - 2 * width + 1
            power = power[:m] + power[width : width + m] * _U(pow(int(base), width, 2**64))
            width *= 2
    return mix(out[: n - k + 1])


def valid_runs(bounds: np.ndarray, k: int) -> np.ndarray:
    """Start positions of the runs of k words that lie inside one text."""
    n = np.maximum(np.diff(bounds) - k + 1, 0)
    total = int(n.sum())
    return np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a chunk's texts have about ``most_bytes``; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        _, offs = buffers(texts)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most_bytes, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
