"""What the operators share: sizes, shared tables, and packed columns of integers."""

from __future__ import annotations

import ctypes
import functools
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

U64 = np.uint64
#: Bytes of a side up to which it is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Bytes that go to a Python worker in a batch, where the session has no bound of its own.
BATCH_BYTES = 2 << 20
_CUTS: list[str] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def steady(spark: SparkSession) -> None:
    """Bounds the batches that Python workers get, by bytes; a bound that the session has stays as it is."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name within the one that the cluster shares.

    spark.checkpoint.dir names that folder. Where the session has none, a temporary
    one is set, but only if all is done on this machine, as in tests.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="glyphlake-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/glyphlake-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and its shuffle files may go."""
    spark = df.sparkSession
    path = shared_dir(spark)
    _CUTS.append(path)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes the tables that cut() wrote in this session; what was made of them can't be read afterwards."""
    while _CUTS:
        remove(spark, _CUTS.pop())


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(docs: DataFrame) -> int:
    """Of all texts, decoded: one look at the column. Sizes of files or estimates of a plan say little about it."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bytes_of(table: DataFrame) -> int:
    """Of the files of a shared table."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets(size: int, each: int) -> int:
    """How many buckets to spread so many bytes on."""
    return max(1, math.ceil(size / each))


def small(df: DataFrame, size: int) -> DataFrame:
    """df to be broadcast, if it has few bytes."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def identity(docs: DataFrame) -> "F.Column":
    """A document's hash: rows with the same doc_id and text are the same document.

    Where documents are dropped or edited, they are told apart by doc_id too, so a collision matters only between documents of the same (or no) doc_id.
    """
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("\x00null")))


@functools.cache
def _libc():
    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "malloc_trim") else None


def release() -> None:
    """Gives back the memory that a worker no longer uses; workers live on after their tasks."""
    from . import words

    words.forget()
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def lean(f: Callable) -> Callable:
    """f, after which memory is given back. A generator may be that of a group's batches."""
    if f.__code__.co_flags & 0x20:  # a generator

        def generator(batches):
            yield from f(batches)
            release()

        generator.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
        return generator

    def function(*args):
        try:
            return f(*args)
        finally:
            release()

    # Spark counts the arguments
    return {1: lambda a: function(a), 2: lambda a, b: function(a, b), 3: lambda a, b, c: function(a, b, c)}[f.__code__.co_argcount]


@functools.cache
def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@functools.cache
def _unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def planes(a: np.ndarray) -> bytes:
    """Unsigned integers byte plane by byte plane, lowest first, as many as the largest needs."""
    a = np.ascontiguousarray(a, U64)
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(buffer: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    width = buffer[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(buffer, np.uint8, width * n, at + 1).reshape(width, n).T
    return out.view(U64).reshape(-1), at + 1 + width * n


def pack(sorted_keys: np.ndarray | None, owners: np.ndarray, names: list[np.ndarray], *columns: np.ndarray) -> bytes:
    """Rows as bytes: owners as places among those of the names that they use (as they are, if there are no names), ascending keys as differences."""
    n, m = len(owners), 0
    if names:
        used = np.zeros(len(names[0]), bool)
        used[owners] = True
        owners = (np.cumsum(used) - 1)[owners]
        names = [x[used] for x in names]
        m = len(names[0])
    out = [np.array([n, m], U64).tobytes(), *map(planes, names), planes(owners.astype(U64))]
    if sorted_keys is not None:
        out += [sorted_keys[:1].astype(U64).tobytes() if n else b"\0" * 8, planes(np.diff(sorted_keys, prepend=sorted_keys[:1]))]
    return _packer().compress(b"".join(out + [planes(c) for c in columns]))


def unpack(blob: bytes | memoryview, keyed: bool, columns: int, named: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The names' columns; and owners' places, then keys if there are any, then the columns."""
    b = memoryview(_unpacker().decompress(blob))
    n, m = (int(x) for x in np.frombuffer(b, U64, 2))
    at, names = 16, []
    for _ in range(named):
        name, at = unplanes(b, at, m)
        names.append(name)
    places, at = unplanes(b, at, n)
    out = [places.astype(np.int64)]
    if keyed:
        first = np.frombuffer(b, U64, 1, at)
        steps, at = unplanes(b, at + 8, n)
        out.append(first + np.cumsum(steps, dtype=U64) if n else steps)
    for _ in range(columns):
        column, at = unplanes(b, at, n)
        out.append(column)
    return names, out


def unpack_all(blobs, keyed: bool, columns: int, named: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of several blobs: the names, one behind the other, and the rows, whose owners are places among them."""
    names: list[list[np.ndarray]] = [[np.zeros(0, U64)] for _ in range(named)]
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], *([np.zeros(0, U64)] for _ in range(keyed + columns))]
    before = 0
    for b in blobs:
        found, rows = unpack(b if isinstance(b, (bytes, memoryview)) else b.as_buffer(), keyed, columns, named)
        for x, y in zip(names, found):
            x.append(y)
        rows[0] = rows[0] + before
        before += len(found[0]) if named else 0
        for x, y in zip(parts, rows):
            x.append(y)
    return [np.concatenate(x) for x in names], [np.concatenate(x) for x in parts]


def distinct(names: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each of several rows of columns its number among the distinct ones, and these in ascending order of the first column."""
    order = np.lexsort(names[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in names:
        new[1:] |= x[order][1:] != x[order][:-1]
    number = np.zeros(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, [x[order][new] for x in names]


def totals(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and each column's sum over each (modulo 2**64)."""
    order = np.argsort(keys, kind="stable")
    at = cuts(keys[order])
    return keys[order][at[:-1]], *(np.add.reduceat(x[order], at[:-1]) if len(keys) else x for x in columns)


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of wanted keys, 0 where there is none; keys ascend."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], values.dtype.type(0))


def cuts(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal values start in an array, and its length."""
    if not len(codes):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]]).astype(np.int64)


def bucket_of(keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The one of n equal ranges that a key of so many bits lies in."""
    return ((keys >> U64(bits - 32)) * U64(n)) >> U64(32)
