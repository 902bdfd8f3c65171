"""Operator 6: documents whose word n-gram sets are similar: their classes and links, or all pairs.

The overlaps of all pairs are the product of the document by n-gram incidence
matrix with its transpose. It is never formed as a whole:

1. Column blocks. Each n-gram's incidences meet in the bucket of its hash, in
   packed and difference-coded runs. Of an n-gram that a run has in many rows the
   bucket gets only in how many: the run's list of them meets the sums later, so
   that no bucket holds all rows of a frequent n-gram. Documents with the same set
   count as one row (named by the set's fingerprint). Columns of one row add
   nothing to a product of two rows and are dropped (but for some of copies).
2. Row bound. A pair of similarity t and more overlaps in t times the larger
   size at least. Rows that have fewer columns left than t times their size are
   dropped; so are pairs whose sizes differ by more than the factor t.
3. Row blocks. Of a row's columns, ordered by how many rows they have, any
   partner has one of the first n - ceil(t n) + 1. The rows of such a column are
   brought together in the block named by the least of them (most columns of a
   group of near copies name the same). A large block is cut into tiles.
4. Blocked product. A tile of rows by rows accumulates its overlaps over blocks
   of columns, as dense products of 0/1 blocks (columns of few rows pair by pair),
   and discards the pairs below the bound that their sizes set. Where pairs aren't
   asked for, they end there: what leaves a tile is how many links each row has, in
   the first of the blocks that a pair is in, and what connects the rows.

Every step is exact but for collisions of 80-bit (fingerprints) and 48-bit
(columns) hashes: a document may go only for one with the same 80 bits or a pair
of similar ones, and two columns that collide change an overlap by one. There is
no cap on a column's rows or on a row's partners.

Defined results: a document of fewer than n words has one gram, all its words; a
null or blank text has none, and no partner. Rows of the same doc_id and text
are one document. Documents with equal gram sets, whatever their order or
repeats, are copies (similarity 1), whose least doc_id stands for them in pairs
with others, where a null doc_id comes before all others; links() counts each of
them, and has a row for documents without words too. A class without any doc_id
has the name null, and classes are told apart by their least doc_id only. Very long texts are handled
whole. Extra columns are not looked at. Without rows there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common as C, words as W

U64 = np.uint64
N, THRESHOLD = 3, 0.5
_BITS = 48
#: Incidences in a run; in how many of its rows a column is frequent.
_RUN, _OFTEN = 1_200_000, 16
#: Bytes of text in a bucket.
_BUCKET = 32 << 20
#: Ranges of columns that a bucket's task handles one after another; a run names its rows once for all of them.
PARTS = 8


def least_overlap(n: np.ndarray | int, threshold: float) -> np.ndarray:
    """ceil(threshold * n), safe from rounding."""
    return np.ceil(np.asarray(n) * threshold - 1e-9).astype(np.int64)


# --- 1. column blocks


def gram_sets(words: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, gram) without repeats, by document."""
    of, hashes, counts = words.docs(), W.word_hashes(words), words.counts
    at, grams = W.gram_hashes(hashes, of, n)
    owners = of[at].astype(np.int64)
    for k in range(1, n):  # documents of k words
        docs = np.flatnonzero(counts == k)
        if len(docs):
            pos, short = W.gram_hashes(hashes, of, k)
            mine = np.isin(of[pos], docs)
            owners, grams = np.append(owners, of[pos][mine]), np.append(grams, W.mix(short[mine] + U64(k)))
    order = np.lexsort((grams, owners))
    owners, grams = owners[order], grams[order]
    new = np.ones(len(owners), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (grams[1:] != grams[:-1])
    return owners[new], grams[new]


def packed_run(keys: np.ndarray, owners: np.ndarray, names: list[np.ndarray], bounds: np.ndarray) -> bytes:
    """Rows' names, ascending, and for each range the packed keys, with their rows as places among the names."""
    used = np.zeros(len(names[0]), bool)
    used[owners[bounds[0] : bounds[-1]]] = True
    places = np.cumsum(used) - 1
    frames = [C.pack(keys[a:b], places[owners[a:b]], []) for a, b in zip(bounds[:-1], bounds[1:])]
    head = C.planes(np.diff(names[0][used], prepend=U64(0))) + C.planes(names[1][used])
    return np.array([used.sum(), len(head), *map(len, frames)], U64).tobytes() + head + b"".join(frames)


class Run:
    """What packed_run() packed."""

    def __init__(self, blob: pa.Buffer) -> None:
        self.data = memoryview(blob)
        n, size, *frames = (int(x) for x in np.frombuffer(self.data, U64, 2 + PARTS))
        at, self.names = 8 * (2 + PARTS), []
        self.bounds = np.cumsum([at + size, *frames]).tolist()
        for _ in range(2):
            name, at = C.unplanes(self.data, at, n)
            self.names.append(name)
        self.names[0] = np.cumsum(self.names[0], dtype=U64)

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows' places among the names, and keys."""
        return tuple(C.unpack(self.data[self.bounds[k] : self.bounds[k + 1]], True, 0, 0)[1])


RUNS = "bucket int, name long, run binary, often binary"
_RUNS = pa.schema([("bucket", pa.int32()), ("name", pa.int64()), ("run", pa.binary()), ("often", pa.binary())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_RUNS.types)], schema=_RUNS)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _runs(n: int, n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """To the n buckets columns; to the PARTS * n behind, documents; to the n behind these, lists of frequent columns."""
    homes = n_buckets * PARTS

    def flush(keys: list, owners: list, table: list) -> Iterator[pa.RecordBatch]:
        k, o = np.concatenate(keys), np.concatenate(owners)
        number, names = C.distinct([np.concatenate(x) for x in zip(*table)])
        first = np.zeros(len(number), bool)
        first[np.unique(number, return_index=True)[1]] = True
        mine = first[o]  # of documents with the same set, one is enough
        k, o = k[mine], number[o[mine]]
        order = np.argsort(k)
        k, o = k[order], o[order]
        at = C.cuts(k)
        counts = np.diff(at)
        often = counts >= _OFTEN
        hot = np.repeat(often, counts)
        rows, name = [], 0
        if often.any():
            held = C.pack(k[hot], o[hot], names)
            name = xxhash.xxh3_64_intdigest(held)
            rows.append((n_buckets + homes + name % n_buckets, _signed(name), held, None))
        often_keys, often_counts = k[at[:-1][often]], counts[often].astype(U64)
        k, o = k[~hot], o[~hot]
        edges = np.arange(homes + 1, dtype=U64)
        cold, warm = (np.searchsorted(C.bucket_of(x, _BITS, homes), edges) for x in (k, often_keys))
        for i in range(n_buckets):
            bounds, (c, *_, d) = cold[i * PARTS : (i + 1) * PARTS + 1], warm[i * PARTS : (i + 1) * PARTS + 1]
            if bounds[0] < bounds[-1] or c < d:
                rows.append((i, _signed(name), packed_run(k, o, names, bounds) if bounds[0] < bounds[-1] else None, C.pack(often_keys[c:d], np.zeros(d - c, np.int64), [], often_counts[c:d]) if c < d else None))
        yield _table(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, table, docs, total = [], [], [], 0, 0
        for batch in batches:
            for part in W.pieces(batch, "text"):
                owner, grams = gram_sets(W.split(part.column("text")), n)
                count = np.bincount(owner, minlength=part.num_rows)
                at = np.concatenate([[0], np.cumsum(count)[:-1]])
                some = count > 0
                prints = np.zeros((2, part.num_rows), U64)
                if len(owner):
                    prints[0, some] = W.mix(np.add.reduceat(W.mix(grams), at[some]) + count[some].astype(U64))
                    prints[1, some] = W.mix(np.add.reduceat(W.mix(grams ^ U64(0x5851F42D4C957F2D)), at[some]) + count[some].astype(U64)) >> U64(48)
                rows = np.flatnonzero(some)
                ids = part.column("doc_id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)[rows]
                values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[rows].view(U64)
                uids = part.column("uid").to_numpy(zero_copy_only=False).astype(np.int64)[rows].view(U64)
                home = prints[0, rows] % U64(homes)
                order = np.argsort(home, kind="stable")
                cuts = C.cuts(home[order])
                if len(rows):
                    blobs = []
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        mine = order[a:b]
                        places, names = C.distinct([prints[0, rows[mine]], prints[1, rows[mine]]])
                        blobs.append((n_buckets + int(home[mine[0]]), None, C.pack(None, places, names, count[rows[mine]].astype(U64), known[mine].astype(U64), values[mine], uids[mine]), None))
                    yield _table(blobs)
                keys.append(grams >> U64(64 - _BITS))
                owners.append(owner + docs)
                table.append((prints[0], prints[1]))
                docs += part.num_rows
                total += len(owner)
                if total >= _RUN:
                    yield from flush(keys, owners, table)
                    keys, owners, table, docs, total = [], [], [], 0, 0
        if total:
            yield from flush(keys, owners, table)

    return C.lean(run)


_MET = pa.schema([("home", pa.int32()), ("name", pa.int64()), ("found", pa.binary()), ("row", pa.int64()), ("print", pa.int64()), ("more", pa.int64()), ("size", pa.int32()), ("ids", pa.list_(pa.int64())), ("uids", pa.list_(pa.int64()))])
MET = "home int, name long, found binary, row long, print long, more long, size int, ids array<long>, uids array<long>"


def _met(rows: list[tuple]) -> pa.Table:
    """(home, name, found): the other columns are null."""
    columns = [pa.array([r[i] for r in rows], _MET.types[i]) for i in range(3)]
    return pa.Table.from_arrays([*columns, *(pa.nulls(len(rows), t) for t in _MET.types[3:])], schema=_MET)


def _by_home(names: list[np.ndarray], row: np.ndarray, key: np.ndarray, counts: np.ndarray, homes: int) -> list[tuple]:
    """Incidences by their rows' homes."""
    home = (names[0] % U64(homes)).astype(np.int32)[row]
    order = np.lexsort((key, home))
    home, key, row, counts = home[order], key[order], row[order], counts[order]
    del order
    at = C.cuts(home)
    return [(int(home[a]), None, C.pack(key[a:b], row[a:b], names, counts[a:b].astype(U64))) for a, b in zip(at[:-1], at[1:])]


def _meet(n_buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    homes = n_buckets * PARTS

    def columns(group: pa.Table) -> pa.Table:
        runs = [Run(x.as_buffer()) for x in group.column("run").drop_null()]
        places, names = C.distinct([np.concatenate([np.zeros(0, U64), *(r.names[k] for r in runs)]) for k in range(2)])
        places = places.astype(np.int32)  # of rows, of which a bucket has fewer than incidences
        starts = np.cumsum([0, *(len(r.names[0]) for r in runs)])
        often = group.filter(group.column("often").is_valid())
        parts = [C.unpack(x.as_buffer(), True, 1, 0)[1] for x in often.column("often")]
        of_run = np.repeat(often.column("name").to_numpy().astype(np.int64), [len(x[0]) for x in parts]).view(U64)
        warm, times = (np.concatenate([np.zeros(0, U64), *(x[i] for x in parts)]) for i in (1, 2))
        known, all_times = C.totals(warm, times)
        out: list[list[np.ndarray]] = [[], [], []]
        for part in range(PARTS):
            found = [r.part(part) for r in runs]
            row = np.concatenate([np.zeros(0, np.int32), *(places[s + x] for s, (x, _) in zip(starts, found))])
            key = np.concatenate([np.zeros(0, U64), *(k for _, k in found)])
            order = np.argsort(key)
            at = C.cuts(key[order])
            counts = np.diff(at)
            keep = order[np.repeat(counts.astype(U64) + C.looked_up(known, all_times, key[order][at[:-1]]) > U64(1), counts)]
            key, row = key[keep], row[keep]
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            if len(key):  # rows with the same set are one
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                key, row = key[new], row[new]
            at = C.cuts(key)
            counts, first = np.diff(at), key[at[:-1]]
            whole = counts.astype(U64) + C.looked_up(known, all_times, first)
            all_times = all_times + C.looked_up(first, counts.astype(U64), known)
            keep = np.repeat(whole > U64(1), counts)
            for x, y in zip(out, (row[keep], key[keep], np.repeat(whole.astype(np.int32), counts)[keep])):
                x.append(y)
        row, key, counts = (np.concatenate(x) for x in out)
        del out, runs, found, keep
        rows = _by_home(names, row, key, counts, homes)
        home = of_run % U64(n_buckets)  # each run learns the sums of its frequent columns
        order = np.lexsort((warm, home))
        at = C.cuts(home[order])
        for a, b in zip(at[:-1], at[1:]):
            mine = order[a:b]
            name, owners = np.unique(of_run[mine], return_inverse=True)
            rows.append((homes + int(home[mine[0]]), None, C.pack(warm[mine], owners, [name], C.looked_up(known, all_times, warm[mine]))))
        return _met(rows)

    def documents(runs: pa.ChunkedArray, home: int) -> pa.Table:
        names, (owner, size, known, value, uid) = C.unpack_all(runs, False, 4, 2)
        row, (prints, more) = C.distinct(names)
        row, value = row[owner], value.view(np.int64)
        order = np.lexsort((uid, value, known, row))
        row, size, known, value, uid = (x[order] for x in (row, size, known, value, uid))
        new = np.ones(len(row), bool)  # but for rows that repeat
        new[1:] = (row[1:] != row[:-1]) | (known[1:] != known[:-1]) | (value[1:] != value[:-1]) | (uid[1:] != uid[:-1])
        row, size, known, value, uid = (x[new] for x in (row, size, known, value, uid))
        starts = C.cuts(row)
        ids = pa.array(value, pa.int64(), mask=known == 0)
        lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x) for x in (ids, pa.array(uid.view(np.int64)))]
        first = starts[:-1]
        number = pa.array((home << 32) + np.arange(len(first)))
        empty = [pa.nulls(len(first), t) for t in _MET.types[1:3]]
        return pa.Table.from_arrays([pa.array(np.full(len(first), home), pa.int32()), *empty, number, pa.array(prints.view(np.int64)), pa.array(more.view(np.int64)), pa.array(size[first].astype(np.int32)), *lists], schema=_MET)

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < n_buckets:
            return columns(group)
        if bucket < n_buckets + homes:
            return documents(group.column("run"), bucket - n_buckets)
        return _met([(bucket - n_buckets, n, x.as_py()) for n, x in zip(group.column("name").to_pylist(), group.column("run"))])  # lists pass through

    return C.lean(meet)


def _listed(n_buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Lists of frequent columns with the sums that the buckets found."""

    def listed(group: pa.Table) -> pa.Table:
        has_name = group.column("name").is_valid()
        (runs,), (owner, key, count) = C.unpack_all(group.filter(pc.invert(has_name)).column("found"), True, 1)
        order = np.lexsort((key, runs[owner])) if len(key) else np.zeros(0, np.int64)
        run, key, count = runs[owner[order]] if len(key) else key, key[order], count[order]
        lists, rows, seen = group.filter(has_name), [], set()
        for name, held in zip(lists.column("name").to_pylist(), lists.column("found")):
            if name in seen:  # the same run, of rows that are there twice
                continue
            seen.add(name)
            names, (o, k) = C.unpack(held.as_buffer(), True, 0, 2)
            a, b = np.searchsorted(run, U64(name % (1 << 64)), "left"), np.searchsorted(run, U64(name % (1 << 64)), "right")
            rows += _by_home(names, o, k, C.looked_up(key[a:b], count[a:b], k), n_buckets * PARTS)
        return _met(rows)

    return C.lean(listed)


# --- 2. row bound

_ROW = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("size", pa.int32()), ("copies", pa.int32()), ("prefix", pa.list_(pa.int64())), ("grams", pa.binary())])
ROW = "row long, doc long, size int, copies int, prefix array<long>, grams binary"


def packed_grams(keys: np.ndarray) -> bytes:
    """Ascending keys as the first and the differences."""
    return np.array([len(keys)], U64).tobytes() + keys[:1].tobytes() + C.planes(np.diff(keys, prepend=keys[:1]))


def unpacked_grams(data: pa.Buffer) -> np.ndarray:
    b = memoryview(data)
    n, first = (int(x) for x in np.frombuffer(b, U64, 2))
    return U64(first) + np.cumsum(C.unplanes(b, 16, n)[0], dtype=U64)


def _bounded(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def bounded(group: pa.Table) -> pa.Table:
        docs = group.filter(group.column("row").is_valid())
        sizes = docs.column("size").to_numpy().astype(np.int64)
        of_docs = [docs.column(c).to_numpy().astype(np.int64).view(U64) for c in ("print", "more")]
        names, (owner, key, many) = C.unpack_all(group.column("found").drop_null(), True, 1, 2)
        number, known = C.distinct([np.concatenate(x) for x in zip(of_docs, names)])
        place = np.full(len(known[0]), -1, np.int64)  # of a name, among the documents
        place[number[: len(sizes)]] = np.arange(len(sizes))
        row = place[number[len(sizes) :]][owner]
        order = np.lexsort((key, row))
        row, key, many = row[order], key[order], many[order]
        if len(row):  # a column may come from the lists of several runs
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key, many = row[new], key[new], many[new]
        at = C.cuts(row)
        counts = np.diff(at)
        size = sizes[row[at[:-1]]]
        stays = counts >= least_overlap(size, threshold)
        keep = np.repeat(stays, counts)
        row, key, many, counts, size = row[keep], key[keep], many[keep], counts[stays], size[stays]
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        mine = row[starts[:-1]]
        firsts = docs.column("ids").combine_chunks()
        copies = firsts.value_lengths().take(pa.array(mine)) if len(docs) else pa.nulls(0, pa.int32())
        firsts = firsts.values.take(firsts.offsets[:-1]).take(pa.array(mine)) if len(docs) else pa.nulls(0, pa.int64())
        rare = key[np.lexsort((key, many, row))]
        prefix = size - least_overlap(size, threshold) + 1 - (size - counts)  # those of one row come first
        spans = [slice(a, b) for a, b in zip(starts[:-1], starts[1:])]
        return pa.table(
            {
                "row": docs.column("row").combine_chunks().take(pa.array(mine)) if len(docs) else pa.nulls(0, pa.int64()),
                "doc": firsts,
                "size": pa.array(size, pa.int32()),
                "copies": copies,
                "prefix": pa.array([rare[x][:n].view(np.int64) for x, n in zip(spans, prefix)], pa.list_(pa.int64())),
                "grams": pa.array([packed_grams(key[x]) for x in spans], pa.binary()),
            },
            schema=_ROW,
        )

    return C.lean(bounded)


def incidences(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The documents' table (row, size, ids, uids) and the rows that pass the bound, as shared tables."""
    C.steady(docs.sparkSession)
    b = C.buckets(C.text_bytes(docs), _BUCKET)
    homes = b * PARTS
    docs = docs.select(F.col("doc_id").cast("long"), C.identity(docs).alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    runs = docs.mapInArrow(_runs(n, b), RUNS).repartitionById(2 * b + homes, F.col("bucket"))
    met = C.cut(runs.groupBy("bucket").applyInArrow(_meet(b), MET))
    listed = met.filter(F.col("home") >= homes).groupBy("home").applyInArrow(_listed(b), MET)
    rows = C.cut(met.filter(F.col("home") < homes).unionByName(listed).groupBy("home").applyInArrow(_bounded(threshold), ROW))
    return met.filter("row is not null").select("row", "size", "ids", "uids"), rows


# --- 3, 4. row blocks and their products

TILE, COLUMNS, STRIP = 2048, 4096, 256
#: Rows of a column's pairs that are counted one by one, at once.
_PAIRS = 1 << 20
PAIR = "row_a long, row_b long, doc_a long, doc_b long, overlap int, total int"
LINK = "a long, b long, n long"


def common(n: int, cut: int, of: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many keys rows before the cut share with those behind it; without a cut, all rows with all (right above the diagonal).

    Keys that few rows have are counted pair by pair, the others by products of 0/1 blocks. Rows ascend.
    Counts are integers: floats of 32 bits would stop at 2**24.
    """
    order = np.argsort(keys, kind="stable")
    row, at = of[order], C.cuts(keys[order])
    counts = np.diff(at)
    total = np.zeros((cut or n, n - cut), np.int32)
    few = counts <= n // 16
    for c in np.unique(counts[few & (counts > 1)]):
        first = at[:-1][counts == c]
        x, y = np.triu_indices(c, 1)
        step = max(1, _PAIRS // len(x))
        for i in range(0, len(first), step):
            rows = row[first[i : i + step, None] + np.arange(c)]
            a, b = rows[:, x].ravel(), rows[:, y].ravel()
            if cut:
                across = (a < cut) & (b >= cut)
                a, b = a[across], b[across] - cut
            np.add.at(total.reshape(-1), a * total.shape[1] + b, np.int32(1))
    many = np.flatnonzero(~few & (counts > 1))
    for i in range(0, len(many), COLUMNS):
        cols = many[i : i + COLUMNS]
        number = np.repeat(np.arange(len(cols)), counts[cols])
        places = np.arange(len(number)) + np.repeat(at[cols] - np.cumsum(counts[cols]) + counts[cols], counts[cols])
        block = np.zeros((n, len(cols)), np.float32)
        block[row[places], number] = 1
        np.add(total, block[: cut or n] @ block[cut:].T, out=total, casting="unsafe")
    return total


def strips(sizes: np.ndarray, starts: np.ndarray, grams: np.ndarray, cut: int, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Strips of common(): the first row, the overlaps, and which are of pairs at the threshold."""
    n = len(sizes)
    if n == 2:
        total = np.array([[0, len(np.intersect1d(grams[: starts[1]], grams[starts[1] :], assume_unique=True))]], np.int32)[:, cut:]
    else:
        total = common(n, cut, np.repeat(np.arange(n), np.diff(starts)), grams)
    for i in range(0, len(total), STRIP):
        o = total[i : i + STRIP].astype(np.float64)
        keep = (o > 0) & (o >= threshold * (sizes[i : i + len(o), None] + sizes[cut:] - o) - 1e-9)
        yield i, o, keep if cut else np.triu(keep, i + 1)


def overlaps(sizes: np.ndarray, starts: np.ndarray, grams: np.ndarray, cut: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows at the threshold (on both sides of the cut, if there is one) and their overlaps."""
    out: list[list[np.ndarray]] = [[], [], []]
    for i, o, keep in strips(sizes, starts, grams, cut, threshold):
        a, b = np.nonzero(keep)
        for x, y in zip(out, (a + i, b + cut, o[a, b].astype(np.int64))):
            x.append(y)
    return tuple(np.concatenate(x) for x in out)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's set, after the sets of a and b are joined."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _groups(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, Iterator[tuple[slice, int, np.ndarray, np.ndarray]]]:
    """The rows in order, and their sizes and numbers; of each tile its place, where its second part starts (0: there is one part), and its rows' grams."""
    group = group.sort_by([(c, "ascending") for c in ("block", "tile_a", "tile_b", "part", "row")]).combine_chunks()
    row, size, part, block, ta, tb = (group.column(c).to_numpy().astype(np.int64) for c in ("row", "size", "part", "block", "tile_a", "tile_b"))
    packed = group.column("grams")
    change = np.flatnonzero((block[1:] != block[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])) + 1
    at = np.concatenate([[0], change, [len(row)]])

    def tiles() -> Iterator[tuple[slice, int, np.ndarray, np.ndarray]]:
        for a, b in zip(at[:-1], at[1:]):
            cut = int((part[a:b] == ta[a]).sum()) if ta[a] != tb[a] else 0
            if b - a > 1 and cut < b - a and (cut or ta[a] == tb[a]):
                lists = [unpacked_grams(x.as_buffer()) for x in packed[a:b]]
                yield slice(a, b), cut, np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), np.concatenate(lists)

    return group, size, row, tiles()


def _products(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def products(group: pa.Table) -> pa.Table:
        group, size, row, tiles = _groups(group)
        out: list[list[np.ndarray]] = [[], [], []]
        for rows, cut, starts, grams in tiles:
            found = overlaps(size[rows], starts, grams, cut, threshold)
            for x, y, shift in zip(out, found, (rows.start, rows.start, 0)):
                x.append(y + shift)
        a, b, o = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        a, b = np.where(row[a] < row[b], a, b), np.where(row[a] < row[b], b, a)
        docs = group.column("doc").combine_chunks()
        return pa.table({"row_a": pa.array(row[a]), "row_b": pa.array(row[b]), "doc_a": docs.take(pa.array(a)), "doc_b": docs.take(pa.array(b)), "overlap": pa.array(o.astype(np.int32)), "total": pa.array((size[a] + size[b] - o).astype(np.int32))})

    return C.lean(products)


def _linked(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def linked(group: pa.Table) -> pa.Table:
        group, size, row, tiles = _groups(group)
        copies, block = (group.column(c).to_numpy().astype(np.int64) for c in ("copies", "block"))
        others = group.column("blocks").combine_chunks()
        ends, others = others.offsets.to_numpy(), others.values.to_numpy()
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        for rows, cut, starts, grams in tiles:
            n = rows.stop - rows.start
            before, of = others[ends[rows.start] : ends[rows.stop]], np.repeat(np.arange(n), np.diff(ends[rows.start : rows.stop + 1]))
            earlier = before < block[rows.start]
            seen = common(n, cut, of[earlier], before[earlier]) > 0 if earlier.any() else None
            many, label, weight = np.zeros(n, np.int64), np.arange(n), copies[rows]
            for i, _, keep in strips(size[rows], starts, grams, cut, threshold):
                if seen is not None:  # in a block before this one
                    keep = keep & ~seen[i : i + len(keep)]
                a, b = np.nonzero(keep)
                a, b = a + i, b + cut
                many += np.bincount(a, weight[b], n).astype(np.int64) + np.bincount(b, weight[a], n).astype(np.int64)
                label = joined(label, a, b)
            mine, member = np.flatnonzero(many), np.flatnonzero(label != np.arange(n))
            out[0].append(row[rows][mine])
            out[1].append(many[mine])
            out[2].append(row[rows][label[member]])
            out[3].append(row[rows][member])
        a, many, x, y = (np.concatenate(v) for v in out)
        return pa.table({"a": np.concatenate([a, x]), "b": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(y)]), "n": pa.concat_arrays([pa.array(many), pa.nulls(len(x), pa.int64())])})

    return C.lean(linked)


def _filled(rows: DataFrame, known: list[str]) -> DataFrame:
    """Rows by tile of each block that they are in, in buckets of even size; blocks: all blocks of a row, if that is asked for."""
    rare = rows.select("row", F.explode("prefix").alias("gram"))
    columns = rare.groupBy("gram").agg(F.min("row").alias("block"), F.max("row").alias("last")).filter("block < last")
    blocks = C.cut(rare.join(columns, "gram").select("block", "row").distinct())
    sizes = blocks.groupBy("block").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    places = sizes.agg(F.sum(F.col("rows") * F.col("tiles"))).first()[0] or 0
    placed = blocks.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("block", "row", "part", F.least("part", "other").alias("tile_a"), F.greatest("part", "other").alias("tile_b"))
    n = max(C.buckets(C.bytes_of(rows) * places // max(1, rows.count()), 8 << 20), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("block", "tile_a", "tile_b"), F.lit(n)).cast("int")
    held = rows.select("row", "size", "grams", *(c for c in known if c != "blocks"))
    if "blocks" in known:
        held = held.join(blocks.groupBy("row").agg(F.collect_list("block").alias("blocks")), "row")
    return tiles.join(held, "row").withColumn("bucket", bucket)


def near_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """PAIR rows, row_a < row_b; a pair may be there once for each block that has it."""
    return _filled(rows, ["doc"]).groupBy("bucket").applyInArrow(_products(threshold), PAIR)


def near_links(rows: DataFrame, threshold: float) -> DataFrame:
    """LINK rows, as a shared table. Without b: of a row, how many documents of others are similar, in parts. With b: the rows that similar pairs connect are connected by these.

    Pairs end in their tile, in the first of the blocks that both rows are in, so what leaves it grows as the rows do, not as the pairs.
    """
    return C.cut(_filled(rows, ["copies", "blocks"]).groupBy("bucket").applyInArrow(_linked(threshold), LINK))


def pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, overlap, jaccard, set_a, set_b): copies with the one that stands for them, and similar pairs of those.

    set_a and set_b name the documents' gram sets: a copy has the similar pairs of its set, also where a doc_id is null or of several texts.
    """
    table, rows = incidences(docs, n, threshold)
    a, b = F.col("doc_a"), F.col("doc_b")
    swap = b.isNull() | (b < a)
    near = near_pairs(rows, threshold).distinct()  # rows, not doc_ids, tell pairs apart
    near = near.select(
        *(F.when(swap, y).otherwise(x).alias(name) for x, y, name in ((a, b, "doc_a"), (b, a, "doc_b"))), F.col("overlap").cast("long").alias("overlap"), (F.col("overlap") / F.col("total")).alias("jaccard"),
        *(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name) for x, y, name in (("row_a", "row_b", "set_a"), ("row_b", "row_a", "set_b"))),
    )
    copies = table.filter(F.size("ids") > 1).select(F.col("ids")[0].alias("doc_a"), F.explode(F.slice("ids", F.lit(2), F.size("ids") - 1)).alias("doc_b"), F.col("size").cast("long").alias("overlap"), F.lit(1.0).alias("jaccard"), F.col("row").alias("set_a"), F.col("row").alias("set_b"))
    return near.unionByName(copies)


def all_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, overlap, jaccard) of all pairs: those of `pairs`, brought back to each copy, and the copies among each other."""
    table, rows = incidences(docs, n, threshold)
    near = near_pairs(rows, threshold).select("row_a", "row_b", "overlap", "total").distinct()
    a, b = (table.select(F.col("row").alias(f"row_{x}"), F.col("ids").alias(f"ids_{x}")) for x in "ab")
    near = near.join(a, "row_a").join(b, "row_b").withColumn("a", F.explode("ids_a")).withColumn("b", F.explode("ids_b"))
    swap = F.col("b").isNull() | (F.col("b") < F.col("a"))
    near = near.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("doc_a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("doc_b"), F.col("overlap").cast("long").alias("overlap"), (F.col("overlap") / F.col("total")).alias("jaccard"))
    copies = table.filter(F.size("ids") > 1).select("ids", "size", F.posexplode("ids").alias("at", "doc_a"))
    copies = copies.select("doc_a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("doc_b"), F.col("size").cast("long").alias("overlap"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(copies)


# --- Groups


def components(edges: DataFrame) -> DataFrame:
    """(node, group) for the nodes of undirected edges (a, b): group is the least node that it is connected with."""
    both = C.cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = C.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("group")))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("group").alias("near"))
        hooked = labels.join(around, labels["node"] == around["a"]).select("node", F.col("group").alias("old"), F.least("group", "near").alias("group"))
        root = hooked.select(F.col("node").alias("group"), F.col("group").alias("root"))
        jumped = C.cut(hooked.join(root, "group").select("node", "old", F.least("group", "root").alias("group")))
        moved = jumped.filter("group <> old").limit(1).count()
        labels = jumped.select("node", "group")
        if not moved:
            return labels


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links), a row for each document: the least known doc_id of those that similar pairs connect it with, its own among them, and how many others it is similar to itself, copies among them."""
    table, rows = incidences(docs, n, threshold)
    near = near_links(rows, threshold)
    groups = components(near.filter("b is not null")).withColumnRenamed("node", "row")
    many = near.filter("b is null").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("near"))
    own = table.select("row", "ids", F.array_min("ids").alias("least")).join(groups, "row", "left").join(many, "row", "left")
    classes = own.filter("group is not null").groupBy("group").agg(F.min("least").alias("class_id"))
    whole = own.join(classes, "group", "left").withColumn("class_id", F.when(F.col("group").isNull(), F.col("least")).otherwise(F.col("class_id")))
    found = whole.select(F.explode("ids").alias("doc_id"), "class_id", (F.coalesce("near", F.lit(0)) + F.size("ids") - 1).cast("long").alias("links"))
    # those without a word
    first, space = F.substring("text", 1, 1), " \t\n\x0b\f\r"
    blank = docs.filter(F.col("text").isNull() | first.isin("", *space) & (F.translate("text", space, "") == "")).select(F.col("doc_id").cast("long"), "text").distinct()
    return found.unionByName(blank.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that are similar, directly or through others, to one with a smaller doc_id that stays.

    Rows of the same doc_id and text are one document: they stay or go together.
    """
    table, rows = incidences(docs, n, threshold)
    groups = components(near_links(rows, threshold).filter("b is not null"))
    whole = table.select(F.col("row").alias("node"), F.arrays_zip("ids", "uids").alias("all")).join(groups, "node", "left")
    order = F.struct(F.col("all")[0]["ids"].isNotNull().alias("known"), F.col("all")[0].alias("first"))
    stays = whole.filter("group is not null").groupBy("group").agg(F.min(order).getField("first").alias("stays"))
    gone = whole.filter("group is not null or size(all) > 1").join(stays, "group", "left").select(F.coalesce("stays", F.col("all")[0]).alias("stays"), F.explode("all").alias("one"))
    gone = gone.filter(~F.col("one").eqNullSafe(F.col("stays"))).select(F.col("one.ids").alias("doc"), F.col("one.uids").alias("uid"))
    gone = C.cut(gone)
    key = C.fresh(docs, "__uid")
    own = docs.withColumn(key, C.identity(docs)).alias("a")
    same = (F.col(f"a.{key}") == F.col("b.uid")) & F.col("a.doc_id").cast("long").eqNullSafe(F.col("b.doc"))
    return own.join(C.small(gone, 32 * gone.count()).alias("b"), same, "left_anti").select(docs.columns)
