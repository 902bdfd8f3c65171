"""Columns in pieces of so many bytes: what a Python worker holds at once doesn't grow with the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes that go to a Python worker in a batch, where the session has no bound of its own.
BATCH = 2 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE = 1 << 20


def steady(spark: SparkSession) -> None:
    """Bounds the batches that Python workers get, by bytes; a bound that the session has stays as it is."""
    if spark.conf.get(_BOUND, None) is None:
        spark.conf.set(_BOUND, str(BATCH))


def cuts(sizes: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Stretches (begin, end) of rows that have so many bytes together at most, or are one row."""
    ends = np.cumsum(sizes, dtype=np.int64)
    at, before = 0, 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, end
        at, before = end, int(ends[end - 1])


def slices(*columns: pa.Array, most: int = PIECE) -> Iterator[tuple[pa.Array, ...]]:
    """Columns of a batch cut alike, by the bytes of the last, which are strings or binary."""
    sizes = pc.fill_null(pc.binary_length(columns[-1]), 0).to_numpy(zero_copy_only=False)
    for begin, end in cuts(sizes, most):
        yield tuple(c.slice(begin, end - begin) for c in columns)


def by_pieces(f: Callable[[pa.Array], pa.Array], texts: pa.Array) -> pa.Array:
    """f of a column, a piece after another."""
    done = [f(piece) for (piece,) in slices(texts)]
    return pa.concat_arrays(done) if done else f(texts)


def rows_by_bytes(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Rows in batches of so many bytes (and 10,000 rows) at most, or of one row."""
    held, bytes_held = [], 0
    for row in rows:
        held.append(row)
        bytes_held += size(row)
        if bytes_held >= most or len(held) >= 10_000:
            yield _batch(held, schema)
            held, bytes_held = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
