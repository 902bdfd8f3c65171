"""Operator 3: token ids in sorted string tables.

A table holds documents' token ids under their identifiers. It is a run of blocks
of ascending keys. In a block each key is stored as the length that it shares with
the one before, and the rest; every 16th key is whole, and the block ends with
these restart points. After the blocks come a Bloom filter of all keys, an index
(each block's last key, place and length) and a footer that says where these are.
A lookup reads the footer, asks the filter, finds the block by binary search in
the index, the restart point by binary search in the block, and scans 16 keys at
most.

Keys are a byte for the kind and the identifier: an integer as eight bytes, in
an order that keeps the integers', and text as UTF-8. Values are a flag (0 for a
null text), the number of tokens, and the token ids as 16-bit numbers, or 32-bit
ones where the vocabulary is larger than 65,536.

Shards are ranges of identifiers, so that a reader knows the shard from the
identifier; where a range holds more than ``shard_bytes`` it makes several shards.

Defined results: null identifiers have a key of their own kind, before all
others; several documents of the same key are all kept, in the order of their
texts, and a lookup returns them all. A null text is distinguished from an empty
one; both have no tokens. Extra columns are not looked at. Without rows there is
no shard.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import buckets, steady, text_bytes
from .packing import RANKS, encoding

MAGIC = b"GLSST\x01"
BLOCK, RESTART, BITS_PER_KEY, PROBES = 32 << 10, 16, 10, 7
SHARD_BYTES, RANGE_BYTES = 32 << 20, 32 << 20
_FOOTER = struct.Struct("<QQQQQB6s")


def key_of(identifier: int | str | None) -> bytes:
    if identifier is None:
        return b"\x00"
    if isinstance(identifier, int):
        return b"\x01" + (identifier + (1 << 63)).to_bytes(8, "big")
    return b"\x02" + identifier.encode()


def identifier_of(key: bytes) -> int | str | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63) if key[0] == 1 else key[1:].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom(keys: list[bytes]) -> bytes:
    size = max(64, len(keys) * BITS_PER_KEY + 7 >> 3 << 3)
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    bits = np.zeros(size, np.uint8)
    for i in range(PROBES):
        bits[((h + np.uint64(i) * step) % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Writer:
    """Builds a table from ascending keys."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.out, self.size, self.index, self.keys = [], 0, [], []
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.length, self.last, self.count = [], [], 0, b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.count % RESTART:
            n = 0
            while n < min(len(key), len(self.last)) and key[n] == self.last[n]:
                n += 1
        else:
            n = 0
            self.restarts.append(self.length)
        entry = _varint(n) + _varint(len(key) - n) + _varint(len(value)) + key[n:] + value
        self.block.append(entry)
        self.length += len(entry)
        self.last, self.count = key, self.count + 1
        self.keys.append(key)
        if self.length >= BLOCK:
            self._close()

    def _close(self) -> None:
        if self.count:
            data = b"".join(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
            self.index.append((self.last, self.size, len(data)))
            self.out.append(data)
            self.size += len(data)
        self._open()

    def finish(self) -> bytes:
        self._close()
        bloom = _bloom(self.keys)
        index = b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index)
        footer = _FOOTER.pack(self.size, len(bloom), self.size + len(bloom), len(index), len(self.keys), self.width, MAGIC)
        return b"".join([*self.out, bloom, index, footer])


class Reader:
    """Looks identifiers up in a table's bytes, or in a memory map of its file."""

    def __init__(self, data: bytes | memoryview) -> None:
        self.data = memoryview(data)
        bloom, n, index, m, self.count, self.width, magic = _FOOTER.unpack(self.data[-_FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a sorted string table")
        self.bits = np.frombuffer(self.data, np.uint8, n, bloom)
        self.last, self.blocks = [], []
        at, end = index, index + m
        while at < end:
            k, at = _read_varint(self.data, at)
            self.last.append(bytes(self.data[at : at + k]))
            a, at = _read_varint(self.data, at + k)
            n, at = _read_varint(self.data, at)
            self.blocks.append((a, n))

    def maybe(self, key: bytes) -> bool:
        h, mask = xxhash.xxh3_64_intdigest(key), (1 << 64) - 1
        step, size = h >> 32 | 1, len(self.bits) * 8
        return all(self.bits[(p := ((h + i * step) & mask) % size) >> 3] >> (p & 7) & 1 for i in range(PROBES))

    def _entries(self, block: int, start: int) -> Iterator[tuple[bytes, memoryview]]:
        a, n = self.blocks[block]
        count = struct.unpack_from("<I", self.data, a + n - 4)[0]
        at, end, key = a + start, a + n - 4 - 4 * count, b""
        while at < end:
            shared, at = _read_varint(self.data, at)
            rest, at = _read_varint(self.data, at)
            size, at = _read_varint(self.data, at)
            key = key[:shared] + bytes(self.data[at : at + rest])
            yield key, self.data[at + rest : at + rest + size]
            at += rest + size

    def _restart(self, block: int, key: bytes) -> int:
        """The last restart point whose key is less than `key`, or the first."""
        a, n = self.blocks[block]
        count = struct.unpack_from("<I", self.data, a + n - 4)[0]
        points = struct.unpack_from(f"<{count}I", self.data, a + n - 4 - 4 * count)
        k = bisect_left(points, key, key=lambda p: next(self._entries(block, p))[0])
        return points[max(0, k - 1)]

    def get(self, identifier: int | str | None) -> list[np.ndarray | None]:
        """The token ids of all documents with an identifier, None for null texts; empty if there is none."""
        key, out = key_of(identifier), []
        if not self.maybe(key):
            return out
        block = bisect_left(self.last, key)
        first = True
        while block < len(self.blocks):
            for k, value in self._entries(block, self._restart(block, key) if first else 0):
                if k > key:
                    return out
                if k == key:
                    out.append(self.value(value))
            block, first = block + 1, False
        return out

    def value(self, value: memoryview) -> np.ndarray | None:
        n, at = _read_varint(value, 1)
        return np.frombuffer(value, f"<u{self.width}", n, at) if value[0] else None

    def items(self) -> Iterator[tuple[int | str | None, np.ndarray | None]]:
        for block in range(len(self.blocks)):
            for key, value in self._entries(block, 0):
                yield identifier_of(key), self.value(value)


def encoded(tokens: list[int] | None, width: int) -> bytes:
    return b"\x00\x00" if tokens is None else b"\x01" + _varint(len(tokens)) + np.array(tokens, f"<u{width}").tobytes()


_SHARD = pa.schema([("shard", pa.string()), ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()), ("n_docs", pa.int64()), ("n_blocks", pa.int32()), ("n_tokens", pa.int64()), ("data", pa.binary())])
SHARD = "shard string, first_doc_id long, last_doc_id long, n_docs long, n_blocks int, n_tokens long, data binary"


def _write(path: str, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in the order of their identifiers: a shard's row whenever it is full, and at the end."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoding(path)
        width = 2 if model.n_vocab <= 1 << 16 else 4
        here, number = TaskContext.get().partitionId(), 0
        table, tokens, first, last = Writer(width), 0, None, None

        def close() -> pa.RecordBatch:
            n, data = len(table.keys), table.finish()
            return pa.RecordBatch.from_pylist([{"shard": f"{here:06d}-{number:04d}", "first_doc_id": first, "last_doc_id": last, "n_docs": n, "n_blocks": len(table.index), "n_tokens": tokens, "data": data}], schema=_SHARD)

        for batch in batches:
            texts = batch.column("text")
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                if table.size + table.length >= shard_bytes:
                    yield close()
                    table, tokens, number = Writer(width), 0, number + 1
                first = doc if not table.keys else first
                last, text = doc, texts[i].as_py()
                ids = None if text is None else model.encode_ordinary(text)
                table.add(key_of(doc), encoded(ids, width))
                tokens += len(ids or ())
        if table.keys:
            yield close()

    return write


def shards(docs: DataFrame, range_bytes: int = RANGE_BYTES, shard_bytes: int = SHARD_BYTES, path: str = RANKS) -> DataFrame:
    """SHARD rows: data is a whole table. shard is named by its range and its number within."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    steady(docs.sparkSession)
    n = buckets(text_bytes(rows), range_bytes)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # many documents of one identifier may be in several ranges
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first()).mapInArrow(_write(path, shard_bytes), SHARD)
