"""Vectorised words and word n-grams of Arrow string columns.

A word is a maximal run of bytes other than ASCII white space (tab, line feed,
vertical tab, form feed, carriage return, space), as ``bytes.split()`` has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    n = int(n)
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        steps = np.full(size, base, U64)
        steps[0] = 1
        known = _POWERS[base] = np.cumprod(steps, dtype=U64)
    return known[:n]


def forget() -> None:
    """Drops long tables of powers, which a very long text needed."""
    for base in [b for b, known in _POWERS.items() if len(known) > 1 << 20]:
        del _POWERS[base]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@dataclass
class Words:
    """Words of all documents of a column; those of document d are first[d]..first[d+1]-1."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), self.counts)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null counts as empty) and its offsets, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = column.type in (pa.large_string(), pa.large_binary())
    if not wide and column.type not in (pa.string(), pa.binary()):
        column, wide = column.cast(pa.large_string()), True
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split(column: pa.Array | pa.ChunkedArray) -> Words:
    data, offsets = text_buffers(column)
    n = len(data)
    solid = np.ones(n + 1, bool)
    solid[:n] = ~SPACE[data]
    solid[n] = False
    opens, closes = solid.copy(), solid[:n].copy()
    opens[1:] &= ~solid[:-1]  # a word starts after white space ...
    edges = offsets[1:-1]
    opens[edges] = solid[edges]  # ... or with its document
    closes &= ~solid[1:]
    ends = edges[edges > 0]
    closes[ends - 1] = solid[ends - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def word_hashes(words: Words) -> np.ndarray:
    n = len(words.data)
    sums = np.zeros(n + 1, U64)
    terms = words.data.astype(U64)
    terms += U64(1)
    terms *= powers(_BYTE_BASE, n)
    np.cumsum(terms, out=sums[1:])
    return mix((sums[words.end] - sums[words.start]) * powers(inverse(_BYTE_BASE), n + 1)[words.start])


def gram_hashes(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each n-gram that lies within a document, and the n-gram's hash."""
    k = len(hashes)
    if k < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    sums = np.zeros(k + 1, U64)
    np.cumsum(hashes * powers(_WORD_BASE, k), out=sums[1:])
    at = np.flatnonzero(docs[: k - n + 1] == docs[n - 1 :])
    return at, mix((sums[at + n] - sums[at]) * powers(inverse(_WORD_BASE), k)[at])


def pieces(batch: pa.RecordBatch, column: str, most: int = (1 << 20) - 4096) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text; a longer document is a slice of its own."""
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
