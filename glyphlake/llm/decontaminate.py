"""Operator 9: documents that hold passages of a benchmark, by suffix arrays of the documents.

The suffixes of a document begin at its words. Each piece of a table that a task
reads is a shard: its suffixes are sorted by their text (words with one space
between them), and every suffix of every benchmark item is looked up by binary
search. The array is sorted eight bytes at a time, from the first eight on; a
range of suffixes that agree so far is sorted further only if a benchmark suffix
falls within it (the rest of its order would never be looked at). A benchmark
suffix whose first ``min_words`` words are found is then followed, word by word,
as far as it matches.

Nothing is shuffled: a shard needs only the benchmark, which is sent to all tasks
in parts of a bounded size (a pass over the documents for each part).

Defined results: a match is a longest run of words that an item and a document
share, of ``min_words`` words at least; an item of fewer words, but no fewer than
``min_item``, matches as a whole; a shorter one never does. Case counts. Null and
blank texts, of either side, match nothing. Rows of the same doc_id and text each
give their matches. Of a document's and an item's longest matches that with the
least place in the item, then in the document, is returned. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C, words as W

U64 = np.uint64
MIN_WORDS, MIN_ITEM = 13, 8
#: Characters of benchmark text that are sent to all tasks at once.
PART = 16_000_000


def joined(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Text with each word followed by one space, and where each word starts in it (and the length)."""
    lengths = words.end - words.start
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    out = np.full(at[-1] + 16, 32, np.uint8)  # past the end, spaces
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[: at[-1]][inside] = words.data[~W.SPACE[words.data]]
    return out, at


def eight(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number, in the order of the text; spaces past the end."""
    every = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    return every[np.minimum(at, len(text) - 8)].astype(U64)


@dataclass
class Suffixes:
    """A shard's suffixes; the array is sorted as far as it was asked for."""

    text: np.ndarray
    at: np.ndarray

    def __post_init__(self) -> None:
        key = eight(self.text, self.at[:-1])
        self.array = np.argsort(key)
        self.key = key[self.array]
        self.sorted: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def further(self, low: int, high: int, depth: int) -> np.ndarray:
        """Sorts a range that agrees in `depth` bytes by the next eight, and returns these."""
        if (low, depth) not in self.sorted:
            part = self.array[low:high]
            key = eight(self.text, self.at[part] + depth)
            order = np.argsort(key, kind="stable")
            self.array[low:high] = part[order]
            self.sorted[low, depth] = key[order]
        return self.sorted[low, depth]


def search(shard: Suffixes, text: np.ndarray, at: np.ndarray, until: np.ndarray) -> list[tuple[int, int, int]]:
    """(query, low, high): ranges of the array that agree with text[at:until] as a whole, for those queries that have one."""
    first = eight(text, at)
    low, high = np.searchsorted(shard.key, first, "left"), np.searchsorted(shard.key, first, "right")
    out = []
    for q in np.flatnonzero(high > low):
        a, b, depth, start, stop = int(low[q]), int(high[q]), 8, int(at[q]), int(until[q])
        while a < b and start + depth < stop:
            key = shard.further(a, b, depth)
            left = min(8, stop - start - depth)
            want = 0
            for x in text[start + depth : start + depth + left].tolist():
                want = want << 8 | x
            shift = 8 * (8 - left)
            a, b, depth = a + int(np.searchsorted(key, U64(want << shift), "left")), a + int(np.searchsorted(key, U64((want + 1 << shift) - 1), "right")), depth + left
        if a < b:
            out.append((int(q), a, b))
    return out


class Benchmark:
    """The items' words, and for each suffix that is long enough how much of it has to match."""

    def __init__(self, items: pa.Array, texts: pa.Array, min_words: int, min_item: int) -> None:
        self.items = items.to_pylist()
        words = W.split(texts)
        self.text, self.at = joined(words)
        self.first = words.first
        of, counts = words.docs(), words.counts
        need = np.where(counts >= min_words, min_words, np.where(counts >= min_item, counts, 1 << 40))
        place = np.arange(len(of)) - words.first[of]
        self.suffix = np.flatnonzero(place + need[of] <= counts[of])
        self.item, self.place, self.need = of[self.suffix], place[self.suffix], need[of][self.suffix]
        self.begin, self.until = self.at[self.suffix], self.at[self.suffix + self.need]


def matches(bench: Benchmark, texts: pa.Array | pa.ChunkedArray) -> list[tuple[int, int, int, int, int]]:
    """(document, item, words, place in document, place in item): the longest for each document and item."""
    words = W.split(texts)
    if not len(words.start) or not len(bench.suffix):
        return []
    text, at = joined(words)
    shard = Suffixes(text, at)
    found = search(shard, bench.text, bench.begin, bench.until)
    if not found:
        return []
    of = words.docs()
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for q, a, b in found:
        item, place, need = int(bench.item[q]), int(bench.place[q]), int(bench.need[q])
        mine = bench.text[bench.begin[q] : bench.at[bench.first[item + 1]]]
        for w in shard.array[a:b].tolist():
            doc = int(of[w])
            theirs = text[at[w] : min(at[words.first[doc + 1]], at[w] + len(mine))]
            differ = np.flatnonzero(theirs != mine[: len(theirs)])
            same = theirs[: differ[0]] if len(differ) else theirs
            n = int(np.count_nonzero(same == 32))
            if n < need:
                continue  # it goes on in the next document
            new = (-n, place, w - int(words.first[doc]))
            if (doc, item) not in best or new < best[doc, item]:
                best[doc, item] = new
    return [(d, i, -n, w, p) for (d, i), (n, p, w) in best.items()]


def _parts(benchmark: DataFrame, min_words: int, min_item: int) -> Iterator[Benchmark]:
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").toLocalIterator():
        rows.append(tuple(r))
        size += len(r[1])
        if size >= PART:
            yield Benchmark(pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), min_words, min_item)
            rows, size = [], 0
    if rows:
        yield Benchmark(pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), min_words, min_item)


#: Bytes of text in a shard.
SHARD = 4 << 20


def _find(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("match_words", pa.int32()), ("doc_word", pa.int32()), ("item_word", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            for part in W.pieces(batch, "text", SHARD):
                found = matches(bench, part.column("text"))
                ids = part.column("doc_id").to_pylist()
                rows = [{"doc_id": ids[d], "item_id": bench.items[i], "match_words": n, "doc_word": w, "item_word": p} for d, i, n, w, p in found]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return C.lean(find)


def _clean(shared, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.pieces(batch, text, SHARD):
                keep = np.ones(part.num_rows, bool)
                keep[[m[0] for m in matches(shared.value, part.column(text))]] = False
                yield part if keep.all() else part.filter(pa.array(keep))

    return C.lean(clean)


def locations(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_item: int = MIN_ITEM) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word): each affected document's longest match with each item."""
    spark = docs.sparkSession
    C.steady(spark)
    kind = "doc_id long, item_id long, match_words int, doc_word int, item_word int"
    out = None
    for part in _parts(benchmark, min_words, min_item):
        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_find(spark.sparkContext.broadcast(part)), kind)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], kind) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_item: int = MIN_ITEM) -> DataFrame:
    """docs without those that match an item."""
    C.steady(docs.sparkSession)
    for part in _parts(benchmark, min_words, min_item):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(part), "text"), docs.schema)
    return docs
