"""Operator 2: WARC records that were written in segments, put together again.

A record that is too long is written as a first segment (with its own type and
WARC-Segment-Number 1) and `continuation` records that name the first one's
identifier in WARC-Segment-Origin-ID; the last one has
WARC-Segment-Total-Length. All segments of an origin are brought together, put in
the order of their numbers and joined; the length is held against the total. An
HTTP response's head is parsed, and a body in chunked transfer coding is decoded.

Segments are shuffled by origin and sorted; a task reads them as a stream and
holds one record at a time. Files may be gzipped, as a whole or record by record.

Defined results, in `status`: ``ok``; ``malformed`` (a record of a file whose head
has no length, or a length or segment number that is none, or that the file ends
in: what follows the next record's head is read on); ``missing segment`` (no first
one, a gap in the numbers, or no last one, where the record says that it is
segmented); ``length mismatch`` (the total length is another); ``bad chunk`` (the
chunked framing breaks off or isn't such); ``other coding`` (a transfer coding
besides chunked, gzip and deflate, or one that can't be undone, is left on the
body). The body is then null, for ``bad chunk`` what was decoded before, for
``other coding`` what is left after the codings behind it. Segments that are there
twice count once, the first by their content. A record that isn't segmented is its
own origin; several of the same identifier are as many records, of which exact
repeats count once. A continuation without a number is a ``missing segment`` of its
own. Content that is null is empty. Segments of no identifier are left alone: each
is its own record, with a null identifier. A very long record is held whole, by
the task that puts it together. Extra columns are not looked at. Without rows
there are no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common as C

SEGMENT, CHUNK = 1024, 700
RECORDS = "record_id string, type string, target_uri string, segment int, origin_id string, total_length long, content binary, malformed boolean"
_RECORDS = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("segment", pa.int32()), ("origin_id", pa.string()), ("total_length", pa.int64()), ("content", pa.binary()), ("malformed", pa.bool_())])
WHOLE = "record_id string, target_uri string, n_segments int, http_status int, content_type string, body binary, status string"
_WHOLE = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("n_segments", pa.int32()), ("http_status", pa.int32()), ("content_type", pa.string()), ("body", pa.binary()), ("status", pa.string())])
_HEAD = re.compile(rb"WARC/[0-9]+[.][0-9]+\r\n")


def inflated(data: bytes) -> bytes:
    """A gzipped file's content, member by member, as far as it goes; another one as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out) if out else data


def _number(text: bytes | str | None, most: int) -> int | None:
    """A number of digits up to a greatest one; None for anything else."""
    return int(text) if text is not None and re.fullmatch(rb"[0-9]{1,19}" if isinstance(text, bytes) else "[0-9]{1,19}", text) and int(text) <= most else None


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file. One that can't be read is `malformed`; reading goes on at the next head."""
    data = inflated(data)
    at = 0
    while (found := _HEAD.search(data, at)) is not None:
        begin = found.start()
        head = data.find(b"\r\n\r\n", begin)
        lines = data[begin : head if head >= 0 else found.end()].split(b"\r\n")[1:]
        fields = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (line.partition(b":") for line in lines)}
        size = _number(fields.get(b"content-length"), 1 << 40)
        out = {
            "record_id": fields.get(b"warc-record-id"),
            "type": fields.get(b"warc-type"),
            "target_uri": fields.get(b"warc-target-uri"),
            "segment": _number(fields.get(b"warc-segment-number"), (1 << 31) - 1),
            "origin_id": fields.get(b"warc-segment-origin-id"),
            "total_length": _number(fields.get(b"warc-segment-total-length"), (1 << 63) - 1),
            "content": None,
            "malformed": False,
        }
        numbers = (("segment", b"warc-segment-number"), ("total_length", b"warc-segment-total-length"))
        if head < 0 or size is None or head + 4 + size > len(data) or any(out[k] is None and name in fields for k, name in numbers):
            yield out | {"malformed": True}
            at = found.end()
        else:
            at = head + 4 + size
            yield out | {"content": data[head + 4 : at]}


def record(fields: dict[str, str | int], content: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "Content-Length": len(content)}.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + content + b"\r\n\r\n"


def chunked(body: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (min(size, len(body) - a), body[a : a + size]) for a in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def segmented(identifier: str, uri: str, body: bytes, segment: int, chunk: int) -> bytes:
    """A response in chunked coding, as the records of its segments."""
    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body, chunk)
    parts = [content[a : a + segment] for a in range(0, len(content), segment)]
    if len(parts) == 1:
        return record({"WARC-Type": "response", "WARC-Record-ID": identifier, "WARC-Target-URI": uri}, content)
    out = [record({"WARC-Type": "response", "WARC-Record-ID": identifier, "WARC-Target-URI": uri, "WARC-Segment-Number": 1}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        fields = {"WARC-Type": "continuation", "WARC-Record-ID": f"{identifier[:-1]}/{k}>", "WARC-Target-URI": uri, "WARC-Segment-Number": k, "WARC-Segment-Origin-ID": identifier}
        out.append(record(fields | ({"WARC-Segment-Total-Length": len(content)} if k == len(parts) else {}), part))
    return b"".join(out)


def dechunk(data: bytes) -> tuple[bytes, bool]:
    """The decoded body and whether the framing was sound. Extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";", 1)[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return b"".join(out), False
        n, begin = int(size, 16), end + 2
        if not n:
            return b"".join(out), True
        if data[begin + n : begin + n + 2] != b"\r\n":
            return b"".join(out), False
        out.append(data[begin : begin + n])
        at = begin + n + 2


def codings(lines: list[bytes]) -> list[bytes]:
    """The transfer codings of a head's lines, in the order they were applied; a header given twice is one list."""
    values = [v for k, _, v in (line.partition(b":") for line in lines) if k.strip().lower() == b"transfer-encoding"]
    names = [x.split(b";")[0].strip().lower() for x in b",".join(values).split(b",")]
    return [x for x in names if x not in (b"", b"identity")]


def undone(body: bytes, coding: bytes) -> bytes | None:
    """What gzip or deflate (with zlib's head or without) was done to; None if it can't be told."""
    for window in {b"gzip": (31,), b"x-gzip": (31,), b"deflate": (15, -15)}.get(coding, ()):
        try:
            stream = zlib.decompressobj(window)
            out = stream.decompress(body) + stream.flush()
            if stream.eof:
                return out
        except zlib.error:
            pass
    return None


def http(content: bytes) -> tuple[int | None, str | None, bytes, str]:
    """Status, content type, body and its status. Content that isn't a response is a body as it is."""
    if not content.startswith(b"HTTP/"):
        return None, None, content, "ok"
    head, _, body = content.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
    code = first.split(b" ")[1:2]
    sound, coded = True, codings(lines)
    if coded[-1:] == [b"chunked"]:
        body, sound = dechunk(body)
        coded.pop()
    while coded and sound and (plain := undone(body, coded[-1])) is not None:
        body = plain
        coded.pop()
    kind = fields.get(b"content-type")
    return _number(code[0] if code else None, (1 << 31) - 1), kind.decode("latin-1") if kind is not None else None, body, "bad chunk" if not sound else "other coding" if coded else "ok"


def _whole(rows: list[dict]) -> dict:
    """The record of an origin's segments, in their order, or of a record without a number."""
    parts, last = [], None
    for r in rows:
        if r["segment"] != last or last is None:
            parts.append(r)
        last = r["segment"]
    first = parts[0]
    out = {"record_id": first["origin"], "target_uri": first["target_uri"], "n_segments": len(parts), "http_status": None, "content_type": None, "body": None, "status": "ok"}
    total = next((r["total_length"] for r in parts if r["total_length"] is not None), None)
    if first["malformed"]:
        return out | {"status": "malformed"}
    if first["segment"] is None and first["continues"]:
        return out | {"status": "missing segment"}
    if first["segment"] is not None and ([r["segment"] for r in parts] != list(range(1, len(parts) + 1)) or total is None):
        return out | {"status": "missing segment"}
    content = b"".join(r["content"] or b"" for r in parts)
    if total is not None and total != len(content):
        return out | {"status": "length mismatch"}
    code, kind, body, status = http(content)
    return out | {"http_status": code, "content_type": kind, "body": body, "status": status}


def _same(r: dict, last: dict) -> bool:
    """Whether a row goes with the one before it: as a segment of its origin, or as a repeat."""
    if r["origin"] is None or r["origin"] != last["origin"]:
        return False
    if r["segment"] is None or last["segment"] is None:
        return r == last
    return True


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for batch in batches:
        done, size = [], 0
        for r in batch.to_pylist():
            if held and not _same(r, held[-1]):
                done.append(_whole(held))
                size += len(done[-1]["body"] or b"")
                held = []
            if not held or r["segment"] is not None:
                held.append(r)
            if size > 16 << 20:
                yield pa.RecordBatch.from_pylist(done, schema=_WHOLE)
                done, size = [], 0
        yield pa.RecordBatch.from_pylist(done, schema=_WHOLE)
    if held:
        yield pa.RecordBatch.from_pylist([_whole(held)], schema=_WHOLE)


def reassembled(records: DataFrame) -> DataFrame:
    """WHOLE rows of RECORDS rows."""
    C.steady(records.sparkSession)
    bad = F.coalesce("malformed", F.lit(False))
    origin = F.when(bad, F.col("record_id")).otherwise(F.coalesce("origin_id", "record_id"))
    rows = records.select(origin.alias("origin"), "target_uri", F.when(~bad, F.col("segment")).alias("segment"), "total_length", F.coalesce("content", F.lit(bytearray())).alias("content"), (F.col("origin_id").isNotNull() & ~bad).alias("continues"), bad.alias("malformed"))
    return rows.repartition("origin").sortWithinPartitions("origin", "segment", "content", "target_uri", "total_length", "continues", "malformed").mapInArrow(_join, WHOLE)


def _records_of(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(column):
                held, size = [], 0
                for r in parse(data.as_buffer().to_pybytes()) if data.is_valid else ():
                    held.append(r)
                    size += len(r["content"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)

    return records


def records(files: DataFrame, column: str = "content") -> DataFrame:
    """RECORDS of WARC files, gzipped or not, as spark.read.format("binaryFile") has them."""
    return files.select(column).mapInArrow(_records_of(column), RECORDS)


def written(pages: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """RECORDS of pages (page_id, url, html), each written as segments in chunked coding and parsed from these bytes.

    A null url or html is empty. Pages of the same or no page_id are told apart by what they hold.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for r in batch.slice(at, 512).to_pylist():
                    html = (r["html"] or "").encode()
                    held = xxhash.xxh3_128_hexdigest((r["url"] or "").encode() + b"\0" + html)
                    name = f"{'none' if r['page_id'] is None else r['page_id']}-{held}"
                    rows += parse(segmented(f"<urn:page:{name}>", r["url"] or "", html, segment, chunk))
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    C.steady(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(write, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, n_segments, status) of pages that went through records and back."""
    whole = reassembled(written(pages))
    page = F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)-[0-9a-f]+>$", 1).try_cast("long")
    return whole.select(page.alias("page_id"), F.col("target_uri").alias("url"), F.col("body").cast("string").alias("html"), "n_segments", "http_status", "status")
