"""Operator 7: passages that repeat, by a distributed merge sort of suffixes.

A word of a document is *repeated* if it lies in a window of ``width`` words that
occurs earlier, in the order of (doc_id, place). The first occurrence stays.

1. Every window's hash goes, with its document and place, to the bucket of its
   hash, in packed and difference-coded runs. Buckets send back the windows that
   occur more than once, with a signature of the set of places where they do. Of
   a window that a run has often, the bucket gets only how often, and the
   signature's part; the places stay with the run's list, which meets the sums
   later. So no bucket holds all places of a passage that all documents have.
2. Where that set is the preceding window's, moved by a word, sorting the suffix
   there would tell nothing new. The other suffixes are *anchors*. An anchor's
   suffix is needed as far as the windows before the next anchor reach: that is
   the distinguishing prefix that is exchanged, no more (as in distributed string
   merge sort with prefix doubling).
3. Each bucket of documents sorts its anchors' suffixes and front-codes them:
   for each, the length that it shares with its predecessor, and the rest. Of
   equal ones only the first goes on; the others repeat it as a whole. Splitters
   from all runs' heads cut the runs into ranges, by bytes.
4. Each range merges its runs with a loser tree that keeps, for each candidate,
   the prefix length known to be shared with the last winner, and so never
   compares these characters again. The longest earlier factor of each suffix
   follows from the merged order's common prefixes.

Hashes choose what to sort (a window's 48 bits can only let too much through, a
signature's 64 bits would have to collide for a passage to be missed); what
repeats is decided on the words themselves.

Defined results: a null or blank text has no words, so nothing in it repeats.
Rows of the same doc_id and text are one document (they don't repeat each
other, and share its result). A null doc_id comes before all others; documents
of the same doc_id and other texts go by their key's hash. Very long texts are
handled whole, one at a time. Extra columns are not looked at. Without rows there
are no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import common as C, words as W

U64 = np.uint64
WIDTH = 50
_BITS = 48
#: Windows in a run; how often a run has to have a window for the bucket to get only the sum.
_RUN, _OFTEN = 1_000_000, 8
#: Bytes of text in a bucket of documents; of front-coded suffixes in a range; of suffixes in a piece of a run.
_BUCKET, _RANGE, _PIECE = 5 << 20, 32 << 20, 4 << 20
#: Bytes of front-coded suffixes between two that are looked at for the splitters.
_STEP = 256 << 10
_LEAST = -(1 << 63)
_PLACE_BASE = 0x9E3779B97F4A7C15  # odd, modulo 2**64


# --- 1. windows

RUNS = "bucket int, name long, run binary, often binary"
_RUNS = pa.schema([("bucket", pa.int32()), ("name", pa.int64()), ("run", pa.binary()), ("often", pa.binary())])
FOUND = "home int, name long, found binary"
_FOUND = pa.schema([("home", pa.int32()), ("name", pa.int64()), ("found", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def _signatures(uids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of (document, place), to be added up over a window's occurrences; a move by a word multiplies by _PLACE_BASE."""
    top = int(places.max()) + 1 if len(places) else 1
    return W.mix(uids) * W.powers(_PLACE_BASE, top)[places.astype(np.int64)]


def _runs(width: int, n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cold windows and the sums of frequent ones to the n buckets; lists of the frequent ones to the n behind."""

    def flush(keys: list, owners: list, places: list, table: list) -> Iterator[pa.RecordBatch]:
        k, o, p, t = (np.concatenate(x) for x in (keys, owners, places, table))
        order = np.argsort(k)
        k, o, p = k[order], o[order], p[order]
        at = C.cuts(k)
        counts = np.diff(at)
        often = counts >= _OFTEN
        hot = np.repeat(often, counts)
        rows, name, sums = [], 0, np.zeros(0, U64)
        if often.any():
            held = C.pack(k[hot], o[hot], [t], p[hot])
            name = xxhash.xxh3_64_intdigest(held)
            starts = np.concatenate([[0], np.cumsum(counts[often])[:-1]]).astype(np.int64)
            sums = np.add.reduceat(_signatures(t[o[hot]], p[hot]), starts)
            rows.append((n_buckets + name % n_buckets, _signed(name), held, None))
        often_keys, often_counts = k[at[:-1][often]], counts[often].astype(U64)
        k, o, p = k[~hot], o[~hot], p[~hot]
        edges = np.arange(n_buckets + 1, dtype=U64)
        cold, warm = (np.searchsorted(C.bucket_of(x, _BITS, n_buckets), edges) for x in (k, often_keys))
        for i in range(n_buckets):
            (a, b), (c, d) = cold[i : i + 2], warm[i : i + 2]
            if a < b or c < d:
                rows.append((i, _signed(name), C.pack(k[a:b], o[a:b], [t], p[a:b]) if a < b else None, C.pack(often_keys[c:d], np.zeros(d - c, np.int64), [], often_counts[c:d], sums[c:d]) if c < d else None))
        yield from _table(rows, _RUNS).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, places, table, n, docs = [], [], [], [], 0, 0
        for batch in batches:
            for part in W.pieces(batch, "text"):
                words = W.split(part.column("text"))
                of = words.docs()
                at, hashes = W.gram_hashes(W.word_hashes(words), of, width)
                keys.append(hashes >> U64(64 - _BITS))
                owners.append(of[at] + docs)
                places.append((at - words.first[of[at]]).astype(U64))
                table.append(part.column("uid").to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
                docs += part.num_rows
                n += len(at)
                if n >= _RUN:
                    yield from flush(keys, owners, places, table)
                    keys, owners, places, table, n, docs = [], [], [], [], 0, 0
        if n:
            yield from flush(keys, owners, places, table)

    return C.lean(run)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _by_home(uid: np.ndarray, place: np.ndarray, count: np.ndarray, sums: np.ndarray, n: int) -> list[tuple]:
    """FOUND rows of occurrences, by their documents' homes."""
    home = uid.view(np.int64) % n
    order = np.lexsort((place, uid, home))
    home, uid, place, count, sums = (x[order] for x in (home, uid, place, count, sums))
    at, rows = C.cuts(home), []
    for a, b in zip(at[:-1], at[1:]):
        names, owners = np.unique(uid[a:b], return_inverse=True)
        rows.append((int(home[a]), None, C.pack(None, owners, [names], place[a:b], count[a:b], sums[a:b])))
    return rows


def _repeated(n: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def find(group: pa.Table) -> pa.Table:
        (uids,), (owner, key, place) = C.unpack_all(group.column("run").drop_null(), True, 1)
        often = group.filter(group.column("often").is_valid())
        parts = [C.unpack(x.as_buffer(), True, 2, 0)[1] for x in often.column("often")]
        runs = np.repeat(often.column("name").to_numpy().astype(np.int64), [len(x[0]) for x in parts]).astype(np.int64)
        warm, times, sums = (np.concatenate(x) if parts else np.zeros(0, U64) for x in (list(zip(*parts))[1:] if parts else [[]] * 3))
        known, all_times, all_sums = C.totals(warm, times, sums)
        order = np.argsort(key)
        at = C.cuts(key[order])
        counts = np.diff(at)
        many = counts.astype(U64) + C.looked_up(known, all_times, key[order][at[:-1]]) > U64(1)
        keep = order[np.repeat(many, counts)]
        uid, key, place = uids[owner[keep]], key[keep], place[keep]
        order = np.lexsort((place, uid, key))
        key, uid, place = key[order], uid[order], place[order]
        if len(key):  # a document that is there twice counts once
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (uid[1:] != uid[:-1]) | (place[1:] != place[:-1])
            key, uid, place = key[new], uid[new], place[new]
        at = C.cuts(key)
        counts, first = np.diff(at), key[at[:-1]]
        here = np.add.reduceat(_signatures(uid, place), at[:-1]) if len(key) else np.zeros(0, U64)
        whole = counts.astype(U64) + C.looked_up(known, all_times, first)
        total = here + C.looked_up(known, all_sums, first)
        many = whole > U64(1)
        keep = np.repeat(many, counts)
        rows = _by_home(uid[keep], place[keep], np.repeat(whole[many], counts[many]), np.repeat(total[many], counts[many]), n)
        all_times, all_sums = all_times + C.looked_up(first, counts.astype(U64), known), all_sums + C.looked_up(first, here, known)
        home = runs.view(U64) % U64(n)  # each run learns the sums of its frequent windows
        order = np.lexsort((warm, home))
        at = C.cuts(home[order])
        for a, b in zip(at[:-1], at[1:]):
            mine = order[a:b]
            names, owners = np.unique(runs[mine].view(U64), return_inverse=True)
            rows.append((n + int(home[mine[0]]), None, C.pack(warm[mine], owners, [names], C.looked_up(known, all_times, warm[mine]), C.looked_up(known, all_sums, warm[mine]))))
        return _table(rows, _FOUND)

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < n:
            return find(group)
        return pa.table([group.column("bucket"), group.column("name"), group.column("run")], schema=_FOUND)  # lists pass through

    return C.lean(meet)


def _listed(n: int) -> Callable[[pa.Table], pa.Table]:
    """Lists of frequent windows with the sums that the buckets found."""

    def listed(group: pa.Table) -> pa.Table:
        has_name = group.column("name").is_valid()
        (runs,), (owner, key, count, sums) = C.unpack_all(group.filter(pc.invert(has_name)).column("found"), True, 2)
        order = np.lexsort((key, runs[owner])) if len(key) else np.zeros(0, np.int64)
        run, key, count, sums = runs[owner[order]] if len(key) else key, key[order], count[order], sums[order]
        lists, seen, out = group.filter(has_name), set(), [[np.zeros(0, U64)] for _ in range(4)]
        for name, held in zip(lists.column("name").to_pylist(), lists.column("found")):
            if name in seen:  # the same run, of rows that are there twice
                continue
            seen.add(name)
            (uids,), (o, k, p) = C.unpack(held.as_buffer(), True, 1)
            a, b = np.searchsorted(run, U64(name % (1 << 64)), "left"), np.searchsorted(run, U64(name % (1 << 64)), "right")
            for x, y in zip(out, (uids[o], p, C.looked_up(key[a:b], count[a:b], k), C.looked_up(key[a:b], sums[a:b], k))):
                x.append(y)
        return _table(_by_home(*(np.concatenate(x) for x in out), n), _FOUND)

    return C.lean(listed)


# --- 2, 3. anchors, in sorted and front-coded runs


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that are known to share some."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, step = known, 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 4
    high = min(low + step, n)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if low < n and a[low] != b[low] else low + 1


def front_code(suffixes: list[tuple[bytes, int, int, int]]) -> list[tuple[int, bytes, int, int, int]]:
    """Sorted (suffix, doc, uid, place) as (shared with the one before, rest, ...)."""
    out, last = [], b""
    for s, d, u, p in suffixes:
        k = shared(last, s)
        out.append((k, s[k:], d, u, p))
        last = s
    return out


_FRONT = pa.schema([("piece", pa.int64()), ("shared", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("doc", pa.list_(pa.int64())), ("uid", pa.list_(pa.int64())), ("place", pa.list_(pa.int32())), ("heads", pa.list_(pa.binary()))])
FRONT = "piece long, shared array<int>, rest array<binary>, doc array<long>, uid array<long>, place array<int>, heads array<binary>"


def _coded(run: list[tuple[bytes, int, int, int]], name: int, width: int = 0, step: int = 1) -> Iterator[dict]:
    """Of a sorted run, pieces that can each be read alone; with a width, heads of suffixes about `step` bytes apart, from a place that the piece's hash tells."""
    at = 0
    while at < len(run):
        to, size = at, 0
        while to < len(run) and to - at < 4096 and size < _PIECE:
            size += len(run[to][0])
            to += 1
        k, rest, doc, uid, place = zip(*front_code(run[at:to]))
        heads, passed = [], xxhash.xxh3_64_intdigest(run[at][0]) % step
        for (s, *_), x in zip(run[at:to], rest if width else ()):
            passed += len(x)
            if passed >= step:
                heads.append(head(s, width))
                passed %= step
        yield {"piece": name, "shared": k, "rest": rest, "doc": doc, "uid": uid, "place": place, "heads": heads}
        at = to


def decode(shared_lengths: list[int], rests: list[bytes]) -> list[bytes]:
    out, last = [], b""
    for k, rest in zip(shared_lengths, rests):
        last = last[:k] + rest
        out.append(last)
    return out


def _anchors(width: int, step: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def anchors(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        (uids,), (owner, place, count, sums) = C.unpack_all(found.column("found"), False, 3)
        if not len(owner):
            return _FRONT.empty_table()
        uid = uids[owner]
        order = np.lexsort((place, uid))
        uid, place, count, sums = (x[order] for x in (uid, place, count, sums))
        new = np.ones(len(uid), bool)
        new[1:] = (uid[1:] != uid[:-1]) | (place[1:] != place[:-1])
        uid, place, count, sums = (x[new] for x in (uid, place, count, sums))
        n = len(uid)
        follows = np.zeros(n, bool)  # on the window a word before
        follows[1:] = (uid[1:] == uid[:-1]) & (place[1:] == place[:-1] + U64(1))
        same = follows.copy()
        same[1:] &= (count[1:] == count[:-1]) & (sums[1:] == sums[:-1] * U64(_PLACE_BASE))
        anchor = np.flatnonzero(~same)
        upto = np.append(anchor[1:], n) - 1  # the last window before the next anchor
        begin, stop = place[anchor].astype(np.int64), place[upto].astype(np.int64) + width
        bounds, whose = C.cuts(uid[anchor]), uid[anchor].view(np.int64)
        where = {int(whose[a]): (a, b) for a, b in zip(bounds[:-1], bounds[1:])}
        run, seen = [], set()
        uids, ids, texts = docs.column("uid").to_pylist(), docs.column("doc_id").to_pylist(), docs.column("text")
        for i, u in enumerate(uids):
            d = _LEAST if ids[i] is None else ids[i]
            if u not in where or (d, u) in seen:
                continue
            seen.add((d, u))
            parts = bytes(texts[i].as_buffer()).split()
            text = b"".join(x + b" " for x in parts)  # with its space, a word is no prefix of another
            at = np.zeros(len(parts) + 1, np.int64)
            np.cumsum(np.fromiter((len(x) + 1 for x in parts), np.int64, len(parts)), out=at[1:])
            a, b = where[u]
            inside = stop[a:b] <= len(parts)  # else it is another document's of the same hash
            for p, x, y in zip(begin[a:b][inside].tolist(), at[begin[a:b][inside]].tolist(), at[stop[a:b][inside]].tolist()):
                run.append((text[x:y], d, u, p))
        run.sort()
        kept = [r for r, before in zip(run, [(None,), *run]) if r[0] != before[0]]
        again = [(d, u, p, s.count(b" ")) for (s, d, u, p), before in zip(run, [(None,), *run]) if s == before[0]]
        rows = list(_coded(kept, key[0].as_py(), width, step))
        for at in range(0, len(again), 4096):
            doc, uid, place, words = zip(*again[at : at + 4096])
            rows.append({"piece": -1, "shared": words, "rest": (), "doc": doc, "uid": uid, "place": place, "heads": ()})
        return pa.Table.from_pylist(rows, schema=_FRONT)

    return C.lean(anchors)


def head(suffix: bytes, width: int) -> bytes:
    """The first so many words."""
    return b"".join(x + b" " for x in suffix.split(b" ", width)[:width])


def _ranges(shared_splitters) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts runs at the splitters. A splitter has the least number of words, so equal passages are never parted."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = shared_splitters.value
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                run = list(zip(decode(r["shared"], r["rest"]), r["doc"], r["uid"], r["place"]))
                rows, at = [], 0
                while at < len(run):
                    k = bisect_right(splitters, run[at][0])
                    to = _before(run, splitters[k], at) if k < len(splitters) else len(run)
                    rows += _coded(run[at:to], k)
                    at = to
                yield pa.RecordBatch.from_pylist(rows, schema=_FRONT)

    return C.lean(cut)


def _before(run: list, splitter: bytes, low: int) -> int:
    """Where in a sorted run the suffixes begin that are not less than the splitter."""
    high = len(run)
    while low < high:
        mid = (low + high) // 2
        if run[mid][0] < splitter:
            low = mid + 1
        else:
            high = mid
    return low


# --- 4. merging


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Merges front-coded sorted runs: (run, place in it, prefix shared with the one before, string).

    A loser tree over the runs' next strings. Each carries the length that it shares
    with the last winner: of two, the one that shares more with it is less, without
    looking at a character; only equal ones are compared, from that length on.
    """
    n = 1
    while n < len(runs):
        n *= 2
    text: list[bytes | None] = [None] * n
    known = [0] * n
    at = [0] * n
    for i, (_, rest) in enumerate(runs):
        text[i] = rest[0] if rest else None
    loser = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known length becomes what it shares with the winner."""
        x, y = text[a], text[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        i, j = known[a], known[b]
        if i > j:
            return a, b
        if j > i:
            return b, a
        k = shared(x, y, i)
        if x[k] < y[k] if k < min(len(x), len(y)) else (len(x), a) < (len(y), b):
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= n:
            return node - n
        won, lost = play(build(2 * node), build(2 * node + 1))
        loser[node] = lost
        return won

    top = build(1)
    while text[top] is not None:
        yield top, at[top], known[top], text[top]
        at[top] += 1
        lengths, rest = runs[top]
        if at[top] < len(rest):
            k = lengths[at[top]]  # it shares this with the last winner, its predecessor
            text[top] = text[top][:k] + rest[at[top]]
            known[top] = k
        else:
            text[top] = None
        node = (top + n) // 2
        while node:
            won, lost = play(top, loser[node])
            top, loser[node] = won, lost
            node //= 2


def earlier(lcps: list[int], order: list[tuple]) -> list[int]:
    """For sorted strings, lcps[i] shared by i-1 and i: the longest prefix that each shares with one that is earlier in order."""
    n = len(order)
    best = [0] * n
    for places, step in ((range(n), 1), (range(n - 1, -1, -1), -1)):
        stack: list[tuple[int, int]] = []  # place, shortest common prefix since
        for i in places:
            k = lcps[i] if step == 1 else lcps[i + 1] if i + 1 < n else 0
            while stack and order[stack[-1][0]] >= order[i]:
                k = min(k, stack.pop()[1])
            if stack and k > best[i]:
                best[i] = k
            stack.append((i, k))
    return best


_SPANS = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32())])
SPANS = "doc_id long, uid long, start_word int, end_word int"


def _merged(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, names = [], []
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                runs.append((np.array(r["shared"], np.int32), r["rest"]))
                names.append(tuple(np.array(r[c], np.int64) for c in ("doc", "uid", "place")))
        out: list[tuple] = []
        texts: list[bytes] = []
        lcps: list[int] = []
        order: list[tuple] = []

        def close() -> None:
            """What was merged since a prefix of under `width` words ended."""
            if len(order) > 1:
                for k, s, (d, u, p) in zip(earlier(lcps, order), texts, order):
                    if (n := s.count(b" ", 0, k)) >= width:
                        out.append((None if d == _LEAST else d, u, p, p + n))
            texts.clear(), lcps.clear(), order.clear()

        def given() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_SPANS.types)], schema=_SPANS)
            out.clear()
            return rows

        for run, at, k, s in merge(runs):
            if order and s.count(b" ", 0, k) < width:
                close()
                if len(out) > 10_000:
                    yield given()
            texts.append(s)
            lcps.append(k if order else 0)
            d, u, p = names[run]
            order.append((int(d[at]), int(u[at]), int(p[at])))
        close()
        yield given()

    return C.lean(merged)


def repeated_spans(docs: DataFrame, width: int = WIDTH, per_range: int = 100_000) -> DataFrame:
    """SPANS: maximal stretches of repeated words; end_word is the first beyond."""
    spark = docs.sparkSession
    C.steady(spark)
    n = C.buckets(C.text_bytes(docs), _BUCKET)
    docs = docs.select(F.col("doc_id").cast("long"), C.identity(docs).alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    runs = docs.select("uid", "text").mapInArrow(_runs(width, n), RUNS)
    met = C.cut(runs.repartitionById(2 * n, F.col("bucket")).groupBy("bucket").applyInArrow(_repeated(n), FOUND))
    listed = met.filter(F.col("home") >= n).groupBy("home").applyInArrow(_listed(n), FOUND)
    found = met.filter(F.col("home") < n).unionByName(listed)
    keyed = docs.withColumn("home", F.pmod("uid", F.lit(n)).cast("int"))
    coded = C.cut(keyed.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(_anchors(width, _STEP), FRONT))
    once = coded.filter("piece >= 0")
    size = F.aggregate("rest", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    total = once.agg(F.sum(F.size("shared")).alias("n"), F.sum(F.size("heads")).alias("heads"), F.sum(size).alias("bytes")).first()
    n_ranges = max(1, (total["n"] or 0) // per_range, (total["bytes"] or 0) // _RANGE)
    splitters: list[bytes] = []
    if n_ranges > 1 and total["heads"]:  # regular sampling: 8 heads for each range
        share = min(1.0, 8 * n_ranges / total["heads"])
        sample = once.select(F.explode("heads").alias("head")).filter(F.pmod(F.xxhash64("head"), F.lit(1 << 20)) < share * (1 << 20))
        heads = sorted(bytes(r[0]) for r in sample.toLocalIterator())
        splitters = sorted({heads[len(heads) * k // n_ranges] for k in range(1, n_ranges)}) if heads else []
    ranged = once.mapInArrow(_ranges(spark.sparkContext.broadcast(splitters)), FRONT).withColumn("part", F.col("piece").cast("int"))
    merged = ranged.repartitionById(len(splitters) + 1, F.col("part")).groupBy("part").applyInArrow(_merged(width), SPANS)
    again = coded.filter("piece = -1").select(F.explode(F.arrays_zip("doc", "uid", "place", "shared")).alias("r"))
    again = again.select(F.when(F.col("r.doc") != _LEAST, F.col("r.doc")).alias("doc_id"), F.col("r.uid").alias("uid"), F.col("r.place").alias("start_word"), (F.col("r.place") + F.col("r.shared")).alias("end_word"))
    w = Window.partitionBy("doc_id", "uid").orderBy("start_word", "end_word")
    reached = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = merged.unionByName(again).withColumn("opens", (F.coalesce(reached, F.lit(-1)) < F.col("start_word")).cast("int"))
    numbered = opened.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "uid", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("island")


_WORD = "[^ \\t\\n\\x0B\\f\\r]+[ \\t\\n\\x0B\\f\\r]*"
_LEADING = "^[ \\t\\n\\x0B\\f\\r]*"


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without repeated words. Documents of which no word is left go; those without a repeated word stay as they are.

    n_chars, if there is such a column, follows the text. The other columns stay.
    """
    key, holder, cut_out = C.fresh(docs, "__uid"), C.fresh(docs, "__doc"), C.fresh(docs, "__spans")
    spans = repeated_spans(docs, width).groupBy("doc_id", "uid").agg(F.collect_list(F.struct("start_word", "end_word")).alias(cut_out))
    spans = C.cut(spans.withColumnsRenamed({"uid": key, "doc_id": holder}))
    total = spans.agg(F.count("*").alias("n"), F.sum(F.size(cut_out)).alias("spans")).first()
    own = docs.withColumn(key, C.identity(docs)).alias("a")
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & F.col("a.doc_id").cast("long").eqNullSafe(F.col(f"b.{holder}"))
    joined = own.join(C.small(spans, 64 * total["n"] + 16 * (total["spans"] or 0)).alias("b"), same, "left").select("a.*", cut_out)
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    left = F.filter(words, lambda _, i: ~F.exists(F.col(cut_out), lambda s: (i >= s["start_word"]) & (i < s["end_word"])))
    text = F.when(F.col(cut_out).isNull(), F.col("text")).otherwise(F.concat(F.regexp_extract("text", _LEADING, 0), F.array_join(left, "")))
    edited = joined.withColumn("text", text).filter(F.col(cut_out).isNull() | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        edited = edited.withColumn("n_chars", F.when(F.col(cut_out).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return edited.select(docs.columns)
