"""Operator 1: documents packed into sequences of a fixed number of tokens.

A document's whole multiples of the capacity are sequences of their own; what is
left of each document is an item. Items are dealt to pools by their hashes. Each
pool packs its items by best fit, longest first, and computes lower bounds on the
number of sequences from dual-feasible functions of the lengths (Martello-Toth,
Fekete-Schepers, Carlier-Clautiaux-Moukrim). Where the greatest bound equals the
number of sequences, that number is certified: no packing of the pool has fewer.
Pools with a gap exchange documents: they are dealt to small groups, what a group
holds is packed anew, and its sequences, fullest first, are dealt back to as many
pools of the same size as before. So the room that is left gathers in the last
pool of a group, and the others come to be certified. The exchange is kept if it
takes fewer sequences, or certifies more pools. That goes on, with other groups
each time, until two rounds running bring nothing, or one pool with a gap is left.

Token counts are those of a public byte-level vocabulary, over whole texts.

Defined results: a null or empty text has no tokens: its one row has no bin.
Rows that repeat are packed as often as they are there. Ties in length go by the
key's hash. A null doc_id is packed like others. A very long text takes as many
sequences as it needs. Extra columns are not looked at. Without rows there are no
rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CAPACITY, PER_POOL = 2048, 50_000
#: Pools of a group that exchange documents, on average.
TOGETHER = 2


def encoding(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counts(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(n, pa.int64())], ["doc_id", "uid", "n_tokens"])

    return count


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each item, lengths descending; the number of bins.

    Open bins lie in stacks by the room they have; a bit for each room that any has
    finds the least that is enough.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, n = 0, 0
    bins, offsets = [], []
    for x in lengths:
        enough = bits >> x
        if enough:
            room = x + (enough & -enough).bit_length() - 1
            stack = rooms[room]
            k = stack.pop()
            if not stack:
                bits ^= 1 << room
        else:
            room, k, n = capacity, n, n + 1
        bins.append(k)
        offsets.append(capacity - room)
        rooms[room - x].append(k)
        bits |= 1 << (room - x)
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The greatest of the dual-feasible bounds on the number of bins."""
    if not len(lengths):
        return 0
    x, count = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    best = -(-int((x * count).sum()) // capacity)
    half = np.arange(1, capacity // 2 + 1)[:, None]
    for part in np.array_split(half, max(1, len(half) // 256)):
        if not len(part):
            continue
        mt = np.where(x > capacity - part, capacity, np.where(x < part, 0, x)) @ count
        best = max(best, int(-(-mt.max() // capacity)))
        whole = capacity // part
        ccm = np.where(2 * x > capacity, 2 * (whole - (capacity - x) // part), np.where(2 * x == capacity, whole, 2 * (x // part))) @ count
        best = max(best, int((-(-ccm // (2 * whole[:, 0]))).max()))
    k = np.arange(1, 101)[:, None]
    fs = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity) @ count
    return max(best, int((-(-fs // (k[:, 0] * capacity))).max()))


_STATE = pa.schema([("item", pa.int64()), ("uid", pa.int64()), ("rest", pa.int32()), ("pool", pa.int64()), ("bin", pa.int32()), ("at", pa.int32()), ("pool_bins", pa.int32()), ("pool_bound", pa.int32())])
STATE = "item long, uid long, rest int, pool long, bin int, at int, pool_bins int, pool_bound int"


def _pack(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def state(group: pa.Table, which: np.ndarray, pool: int, bins: np.ndarray, at: np.ndarray) -> pa.Table:
        """Of some rows, which are a pool; its bins are numbered anew."""
        part = group.select(["item", "uid", "rest"]).take(pa.array(which))
        names, bins = np.unique(bins, return_inverse=True)
        bound = lower_bound(part.column("rest").to_numpy(), capacity)
        same = lambda x, kind: pa.array(np.full(len(which), x), kind)
        return pa.table([*part.columns, same(pool, pa.int64()), pa.array(bins, pa.int32()), pa.array(at, pa.int32()), same(len(names), pa.int32()), same(bound, pa.int32())], schema=_STATE)

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rest", "descending"), ("uid", "ascending"), ("item", "ascending")])
        rest = group.column("rest").to_numpy()
        every, at, n = best_fit(rest.tolist(), capacity)
        every, at = np.array(every, np.int64), np.array(at, np.int64)
        names, first = np.unique(group.column("pool").to_numpy(), return_index=True)
        if "pool_bins" not in group.column_names:
            return state(group, np.arange(len(rest)), int(names[0]), every, at)
        before = group.select(["pool_bins", "pool_bound"]).take(pa.array(first))
        gaps = int((before.column("pool_bins").to_numpy() > before.column("pool_bound").to_numpy()).sum())
        fullest = np.argsort(-np.bincount(every, rest, n), kind="stable")
        place = np.zeros(n, np.int64)
        place[fullest] = np.arange(n)
        of = place[every] * len(names) // n  # the pool that a bin is dealt to
        parts = []
        for k, pool in enumerate(names.tolist()):
            which = np.flatnonzero(of == k)
            if len(which):
                parts.append(state(group, which, pool, every[which], at[which]))
        done = pa.concat_tables(parts)
        _, firsts = np.unique(done.column("pool").to_numpy(), return_index=True)
        after = done.select(["pool_bins", "pool_bound"]).take(pa.array(firsts))
        left = int((after.column("pool_bins").to_numpy() > after.column("pool_bound").to_numpy()).sum())
        better = (n, left) < (int(before.column("pool_bins").to_numpy().sum()), gaps)
        return done if better and len(names) > 1 else group.select(_STATE.names).cast(_STATE)

    return pack


def placed(items: DataFrame, capacity: int = CAPACITY, per_pool: int = PER_POOL, rounds: int | None = None) -> DataFrame:
    """STATE for items (item, uid, rest), 0 < rest < capacity. rounds: at most so many, if given."""
    n = items.count()
    dealt = items.withColumn("pool", F.pmod(F.xxhash64("uid", "item"), F.lit(max(1, -(-n // per_pool)))))
    state = C.cut(dealt.groupBy("pool").applyInArrow(_pack(capacity), STATE))
    k, idle, last = 0, 0, None
    while idle < 2 and (rounds is None or k < rounds):
        pools = state.groupBy("pool").agg(F.first("pool_bins").alias("bins"), F.first("pool_bound").alias("bound"))
        now = pools.agg(F.coalesce(F.sum("bins"), F.lit(0)), F.count_if(F.col("bins") > F.col("bound"))).first()
        idle = 0 if last is None or tuple(now) < last else idle + 1
        last = tuple(now)
        if now[1] < 2 or idle == 2:
            break
        group = F.pmod(F.xxhash64("pool", F.lit(k)), F.lit(-(-now[1] // TOGETHER)))
        open_, closed = state.filter("pool_bins > pool_bound"), state.filter("pool_bins = pool_bound")
        state = C.cut(closed.unionByName(open_.withColumn("group", group).groupBy("group").applyInArrow(_pack(capacity), STATE)))
        k += 1
    return state


def packed(docs: DataFrame, capacity: int = CAPACITY, per_pool: int = PER_POOL, rounds: int | None = None, path: str = RANKS) -> DataFrame:
    """One row for each piece of each document.

    doc_id; piece, numbered from 0; token_start and n_tokens, of the piece in the
    document; bin, the sequence, and bin_offset, the piece's place in it; bins and
    bound, of the pool that it was packed in (null for whole sequences).
    """
    C.steady(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long"), C.identity(docs).alias("uid"), "text")
    items = C.cut(keyed.mapInArrow(_counts(path), "doc_id long, uid long, n_tokens long").withColumn("item", F.monotonically_increasing_id()))
    state = placed(items.select("item", "uid", (F.col("n_tokens") % capacity).cast("int").alias("rest")).filter("rest > 0"), capacity, per_pool, rounds)
    joined = items.join(state.drop("uid", "rest"), "item", "left")
    last = F.floor(F.col("n_tokens") / capacity)
    pieces = F.when(F.col("n_tokens") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / capacity)))
    rows = joined.withColumn("piece", F.explode(pieces)).withColumn("whole", F.col("piece") < last)
    name = F.when(F.col("whole"), F.concat(F.lit("d"), "item", F.lit("-"), "piece")).when(F.col("n_tokens") > 0, F.concat(F.lit("p"), "pool", F.lit("-"), "bin"))
    return rows.select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * capacity).alias("token_start"),
        F.when(F.col("whole"), F.lit(capacity)).otherwise(F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("n_tokens"),
        name.alias("bin"),
        F.when(F.col("whole"), F.lit(0)).otherwise(F.col("at")).alias("bin_offset"),
        F.when(~F.col("whole"), F.col("pool_bins")).alias("bins"),
        F.when(~F.col("whole"), F.col("pool_bound")).alias("bound"),
    )
