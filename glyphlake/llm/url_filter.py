"""Operator 4: URLs held against a list, by a sorted array of digests.

Entries are a URL, a host, or a parent domain, brought to the form that URLs are
held in (see bare), in which they are also given back. The list is
kept as segments, ranges of 64-bit xxHash digests: of each, a file of ascending
digests, one of the strings' places and one of the strings, in the folder that
the cluster shares. Tasks map these files into memory (the workers of a machine
share the pages), look all digests of a batch up by binary search at once, and
confirm each hit on the string itself, so that a collision never matches.

URLs are brought to the task that holds their digests' segment, with all the
entries that they could match, so no task needs more of the list than a segment.
A segment's files are written under another name and moved, so a task that is
run again does no harm.

Defined results: a URL is *blocked* if an entry equals it or is its host or a
parent domain; of several entries the longest counts. A null or empty URL, and one without a host, is not blocked. Entries that
are null or empty are left out; entries that repeat count once. Rows that repeat
have equal results; a very long URL is looked up as any other. Other columns stay
(but those named blocked and entry). Without entries nothing is blocked. Where a
segment's files aren't found, or aren't whole, the job fails: nothing passes unseen.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

U64 = np.uint64
SEED = 42  # as F.xxhash64
SEGMENT_ENTRIES = 4_000_000


def bare(url: Column) -> Column:
    """In lower case, without scheme, credentials, fragment, default port, "www." and a slash at the end."""
    x = F.translate(url, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    x = F.regexp_replace(x, "#.*$", "")
    x = F.regexp_replace(x, "^[a-z][a-z0-9+.-]*://", "")
    x = F.regexp_replace(x, "^[^/@]*@", "")
    x = F.regexp_replace(x, "^www[.]", "")
    x = F.regexp_replace(x, "^([^/?:]*):(80|443)([/?]|$)", "$1$3")
    return F.regexp_replace(x, "/+$", "")


def host(plain: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(plain, "[/?].*$", ""), ":[0-9]*$", "")


def candidates(plain: Column) -> Column:
    """All entries that a URL could match: itself, its host, and the host's parents of two labels and more."""
    labels = F.split(host(plain), "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.concat(F.array(plain), parents))


def _folder(path: str) -> str:
    """The shared folder as all machines see it, mounted."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"the list is mapped into memory, so {path} must be a mounted folder")
    return unquote(parsed.path)


def _segments(folder: str) -> Callable[[pa.Table], pa.Table]:
    def write(group: pa.Table) -> pa.Table:
        segment = group.column("segment")[0].as_py()
        digests = group.column("digest").to_numpy().astype(np.int64).view(U64)
        entries = [x.as_py().encode() for x in group.column("entry")]
        order = sorted(range(len(entries)), key=lambda i: (digests[i], entries[i]))
        places = np.zeros(len(entries) + 1, np.int64)
        np.cumsum([len(entries[i]) for i in order], out=places[1:])
        os.makedirs(folder, exist_ok=True)
        for kind, data in (("digests", digests[order].tobytes()), ("places", places.tobytes()), ("strings", b"".join(entries[i] for i in order))):
            draft = f"{folder}/{uuid.uuid4().hex}"
            with open(draft, "wb") as file:
                file.write(data)
            os.replace(draft, f"{folder}/{segment:06d}.{kind}")
        return pa.table({"segment": pa.array([segment], pa.int32()), "entries": pa.array([len(entries)], pa.int64())})

    return write


class Segment:
    """A segment's files, mapped into memory."""

    def __init__(self, folder: str, segment: int) -> None:
        stem = f"{folder}/{segment:06d}"
        self.digests = np.memmap(f"{stem}.digests", U64, "r")
        self.places = np.memmap(f"{stem}.places", np.int64, "r")
        self.strings = np.memmap(f"{stem}.strings", np.uint8, "r")

    def find(self, digests: np.ndarray, strings: list[bytes]) -> np.ndarray:
        """Whether each string is an entry."""
        low, high = np.searchsorted(self.digests, digests, "left"), np.searchsorted(self.digests, digests, "right")
        out = np.zeros(len(digests), bool)
        for i in np.flatnonzero(high > low):
            out[i] = any(self.strings[self.places[k] : self.places[k + 1]].tobytes() == strings[i] for k in range(low[i], high[i]))
        return out


def build(entries: DataFrame, per_segment: int = SEGMENT_ENTRIES, plain: bool = False) -> tuple[str, DataFrame, int]:
    """Writes the list of a column `entry` (plain: in bare form already): its folder, its manifest (segment, entries) and the number of ranges."""
    spark = entries.sparkSession
    entry = F.col("entry") if plain else bare(F.col("entry"))
    clean = C.cut(entries.select(entry.alias("entry")).filter("entry is not null and entry <> ''").distinct())
    n = max(1, -(-clean.count() // per_segment))
    folder = _folder(C.shared_dir(spark))
    keyed = clean.withColumn("digest", F.xxhash64("entry")).withColumn("segment", segment_of(n))
    manifest = C.cut(keyed.groupBy("segment").applyInArrow(_segments(folder), "segment int, entries long"))
    return folder, manifest, n


def segment_of(n: int) -> Column:
    """The range of digests, as unsigned numbers."""
    return F.floor((F.shiftrightunsigned("digest", 33) * F.lit(n)) / F.lit(float(1 << 31))).cast("int")


def _probe(folder: str, manifest: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_segments: dict[int, Segment] = {}
        for batch in batches:
            segments = batch.column("segment").to_numpy()
            digests = batch.column("digest").to_numpy().astype(np.int64).view(U64)
            keep = np.zeros(batch.num_rows, bool)
            for s in np.unique(segments).tolist():
                if s not in manifest:  # the list has no entry in this range
                    continue
                if s not in open_segments:
                    open_segments[s] = Segment(folder, s)
                    if len(open_segments[s].digests) != manifest[s]:
                        raise OSError(f"{folder}: segment {s} isn't whole on this machine")
                mine = np.flatnonzero(segments == s)
                texts = [x.encode() for x in batch.column("entry").take(pa.array(mine)).to_pylist()]
                keep[mine] = open_segments[s].find(digests[mine], texts)
            yield batch.select(["url", "entry"]).filter(pa.array(keep))

    return probe


def verdicts(urls: DataFrame, entries: DataFrame, per_segment: int = SEGMENT_ENTRIES, plain: bool = False) -> DataFrame:
    """(url, entry): the entry that blocks each distinct URL that is blocked."""
    C.steady(urls.sparkSession)
    folder, manifest, n = build(entries, per_segment, plain)
    known = {r.segment: r.entries for r in manifest.collect()}
    tasks = max(urls.sparkSession.sparkContext.defaultParallelism, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct = urls.select("url").filter("url is not null").repartition(tasks, "url").distinct()  # else few bytes, but much work, come to one task
    probes = distinct.select("url", F.explode(candidates(bare(F.col("url")))).alias("entry")).filter("entry <> ''").withColumn("digest", F.xxhash64("entry")).withColumn("segment", segment_of(n))
    if n > 1:  # with one segment, a URL's candidates may stay where they are
        probes = probes.repartition("segment", F.pmod(F.xxhash64("url"), F.lit(16)))
    hits = probes.mapInArrow(_probe(folder, known), "url string, entry string")
    best = F.max(F.struct(F.char_length("entry").alias("n"), F.col("entry")))
    return hits.groupBy("url").agg(best.getField("entry").alias("entry"))


def filtered(pages: DataFrame, entries: DataFrame, per_segment: int = SEGMENT_ENTRIES, plain: bool = False) -> DataFrame:
    """pages with `blocked` and `entry` (null where not blocked)."""
    key, entry = C.fresh(pages, "__url"), C.fresh(pages, "__entry")
    hits = verdicts(pages, entries, per_segment, plain).select(F.col("url").alias(key), F.col("entry").alias(entry))
    joined = pages.join(hits, pages["url"] == hits[key], "left")
    return joined.select(*[pages[c] for c in pages.columns if c not in ("blocked", "entry")], F.col(entry).isNotNull().alias("blocked"), F.col(entry).alias("entry"))
