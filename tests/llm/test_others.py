"""Operators 1, 2, 3 and 10."""

import itertools
import random

import numpy as np
import pytest
from conftest import DATA, differences
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from glyphlake.llm import audio as A, packing as P, queries as Q, sstable as T, warc as W

HARD = [(1, "a b c"), (1, "a b c"), (None, "null id"), (2, None), (3, ""), (4, "word " * 20_000), (5, "x" * 50_000), (None, None), (6, "<|endoftext|> é\n\n")]


def frame(spark, rows):
    names = ("uid", "item", "rest", "pool", "bin", "at", "piece", "n_tokens", "range", "shard", "value", "origin")
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in names})


@pytest.mark.parametrize("name", ["op2_warc_reassembly"])
def test_against_sql(spark, name):
    assert differences(Q.QUERIES[name], Q.ORACLE[name], spark, f"{DATA}/sf0.001") == ({}, {})


# --- Packing


def fewest_bins(lengths, capacity):
    """By trying all placements."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [r - lengths[i] * (j == k) for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_bound_never_exceeds_the_fewest(lengths):
    lengths = sorted(lengths, reverse=True)
    fewest = fewest_bins(lengths, 20)
    bins, offsets, n = P.best_fit(lengths, 20)
    assert P.lower_bound(np.array(lengths, int), 20) <= fewest <= n
    taken = {}
    for x, b, a in zip(lengths, bins, offsets):
        assert taken.get(b, 0) == a and a + x <= 20
        taken[b] = a + x


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_best_fit_is_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    rooms = []
    for x in lengths:
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(50 - x)
    assert P.best_fit(lengths, 50)[2] == len(rooms)


def test_exchange_closes_gaps(spark):
    rng = random.Random(2)
    rows = [(i, i * 7919, rng.choice([34, 33, 51, 26, 23, 67])) for i in range(400)]
    items = spark.createDataFrame(rows, "item long, uid long, rest int")
    pools = lambda s: {r.pool: (r.pool_bins, r.pool_bound) for r in s.select("pool", "pool_bins", "pool_bound").distinct().collect()}
    before, after = (pools(P.placed(items, 100, 10, k)) for k in (0, 4))
    assert sum(b for b, _ in after.values()) < sum(b for b, _ in before.values())
    assert sum(b > c for b, c in after.values()) < sum(b > c for b, c in before.values())
    state = P.placed(items, 100, 10, 4).collect()
    assert sorted(r.item for r in state) == list(range(400))
    assert all(b >= c for b, c in after.values())
    for _, group in itertools.groupby(sorted(state, key=lambda r: (r.pool, r.bin, r["at"])), key=lambda r: (r.pool, r.bin)):
        end = 0
        for r in group:
            assert r["at"] == end
            end += r.rest
        assert end <= 100


def test_packed(spark):
    encode = P.encoding().encode_ordinary
    rows = P.packed(frame(spark, HARD), capacity=64, per_pool=3).collect()
    wanted = sorted((i, len(encode(t)) if t else 0) for i, t in HARD if i is not None)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc in {i for i, _ in HARD}:
        assert sum(r.n_tokens for r in by_doc[doc]) == sum(len(encode(t)) for i, t in HARD if i == doc and t)
    assert sum(n for _, n in wanted) + len(encode("null id")) == sum(r.n_tokens for r in rows)
    assert [r.bin for r in by_doc[2] + by_doc[3]] == [None, None]
    assert sorted(r.token_start for r in by_doc[4]) == list(range(0, len(encode(HARD[5][1])), 64))
    bins = {}
    for r in rows:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append((r.bin_offset, r.n_tokens))
    for parts in bins.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 64
    assert P.packed(frame(spark, [])).count() == 0


def test_packing_query(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    encode = P.encoding().encode_ordinary
    found, bins, pools = {}, {}, {}
    for r in Q.op1_best_fit_packing(spark, f"{DATA}/sf0.001").collect():
        assert r.token_start == P.CAPACITY * r.piece and 0 < r.n_tokens <= P.CAPACITY
        found.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
        bins.setdefault(r.bin, []).append((r.bin_offset, r.n_tokens))
        if r.bins is not None:
            pools.setdefault((r.bin.split("-")[0], r.bins, r.bound), []).append((r.bin, r.n_tokens))
    for doc, text in ((r.doc_id, r.text) for r in docs.collect()):
        n = len(encode(text))
        assert sorted(found[doc]) == [(a, min(P.CAPACITY, n - a)) for a in range(0, n, P.CAPACITY)]
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= P.CAPACITY
    assert len({p for p, _, _ in pools}) == len(pools)
    for (_, n, bound), items in pools.items():
        assert n == len({b for b, _ in items}) >= bound >= -(-sum(x for _, x in items) // P.CAPACITY)
        assert bound >= sum(2 * x > P.CAPACITY for _, x in items)  # of these no two go together
        rooms = []  # first fit decreasing is within 11/9 of the fewest, and best fit isn't far from it
        for x in sorted((x for _, x in items), reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else P.CAPACITY) - x)
        assert n == len(rooms)


# --- WARC


@given(st.binary(max_size=300), st.integers(1, 50), st.integers(1, 80))
def test_written_and_read(body, chunk, segment):
    rows = list(W.parse(W.segmented("<urn:x>", "http://x/", body, segment, chunk)))
    whole = W._whole([r | {"origin": r["origin_id"] or r["record_id"]} for r in rows])
    assert (whole["status"], whole["body"], whole["n_segments"]) == ("ok", body, len(rows))


@given(st.binary(max_size=60))
def test_dechunk_never_breaks(data):
    W.dechunk(data)
    W.http(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + data)
    list(W.parse(data))


def test_reassembly_cases(spark):
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"

    def record(rid, n=None, origin=None, total=None, content=b""):
        return (rid, "response", "u", n, origin, total, None if content is None else bytearray(content), False)

    rows = [
        record("a", 1, None, None, head + b"3\r\nab"), record("a3", 3, "a", len(head) + 13, b"\r\n\r\n"), record("a2", 2, "a", None, b"c\r\n0"), record("a2", 2, "a", None, b"c\r\n0"),
        record("b", 1, None, None, b"x"), record("b3", 3, "b", 3, b"y"), record("c", 1, None, None, b"x"), record("c2", 2, "c", 9, b"y"), record("d", None, None, None, head + b"zz"), record("e", None, None, None, b"plain"),
        record("f2", 2, "f", 2, b"y"), record("g", 1, None, None, b"x"), record(None, None, None, None, b"p"), record(None, None, None, None, b"q"), record("h", None, None, None, None),
    ]
    found = {}
    for r in W.reassembled(spark.createDataFrame(rows, W.RECORDS).withColumn("origin", F.lit(1)).withColumn("body", F.lit(1))).collect():
        found.setdefault(r.record_id, []).append((r.status, None if r.body is None else bytes(r.body)))
    ok = len(head) + len(b"3\r\nab") + len(b"c\r\n0") + len(b"\r\n\r\n")
    assert ok == len(head) + 13 and found["a"] == [("ok", b"abc")]
    assert found["b"] == [("missing segment", None)] == found["f"] == found["g"]
    assert found["c"] == [("length mismatch", None)]
    assert found["d"] == [("bad chunk", b"")] and found["e"] == [("ok", b"plain")] and found["h"] == [("ok", b"")]
    assert sorted(found[None]) == [("ok", b"p"), ("ok", b"q")]
    assert W.reassembled(spark.createDataFrame([], W.RECORDS)).count() == 0


def test_page_cases(spark):
    rows = [(1, "u", "h"), (1, "u", "h"), (2, None, None), (None, "v", "x"), (None, "w", ""), (3, "z", "é" * 100_000)]
    found = W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("body", F.lit(1)))
    assert sorted(((r.page_id, r.url, r.html, r.status) for r in found.collect()), key=repr) == sorted([(1, "u", "h", "ok"), (2, "", "", "ok"), (None, "v", "x", "ok"), (None, "w", "", "ok"), (3, "z", "é" * 100_000, "ok")], key=repr)


def test_records_without_numbers(spark):
    head = bytearray(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n")
    rows = [
        ("a", "response", "u", None, None, None, bytearray(b"x")), ("a", "response", "u", None, None, None, bytearray(b"x")), ("a", "response", "u", None, None, None, bytearray(b"y")), ("a", "response", "v", None, None, None, bytearray(b"x")),
        ("b", "response", "u", None, None, None, head + b"1\r\np\r\n0\r\n\r\n"), ("b", "response", "u", None, None, None, head + b"1\r\nq\r\n0\r\n\r\n"),
        ("c", "response", "u", None, None, None, None), ("c", "response", "u", None, None, None, bytearray()), ("c", "response", "u", 1, None, None, bytearray(b"r")), ("c2", "continuation", "u", 2, "c", 2, bytearray(b"s")),
        ("d2", "continuation", "u", None, "d", None, bytearray(b"t")),
    ]
    found = sorted((r.record_id, r.target_uri, r.n_segments, r.status, None if r.body is None else bytes(r.body)) for r in W.reassembled(spark.createDataFrame([(*r, False) for r in rows], W.RECORDS)).collect())
    assert found == [("a", "u", 1, "ok", b"x"), ("a", "u", 1, "ok", b"y"), ("a", "v", 1, "ok", b"x"), ("b", "u", 1, "ok", b"p"), ("b", "u", 1, "ok", b"q"), ("c", "u", 1, "ok", b""), ("c", "u", 2, "ok", b"rs"), ("d", "u", 1, "missing segment", None)]
    pages = spark.createDataFrame([(1, "u", "h"), (1, "u", "h"), (1, "u", "other"), (1, "u", "x" * 1000), (1, "u", "y" * 1000)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.html, r.n_segments) for r in W.round_trip(pages).collect()) == [(1, "h", 1), (1, "other", 1), (1, "x" * 1000, 2), (1, "y" * 1000, 2)]


def test_transfer_codings():
    framed = b"3\r\nabc\r\n0\r\n\r\n"
    of = lambda *values: W.http(b"HTTP/1.1 200 OK\r\n" + b"".join(b"Transfer-Encoding: " + v + b"\r\n" for v in values) + b"\r\n" + framed)[2:]
    assert of(b"Chunked") == of(b"identity, chunked") == of(b"identity", b"chunked") == of(b"chunked", b"identity") == (b"abc", "ok")
    assert of(b"gzip, chunked") == of(b"gzip", b"chunked") == (b"abc", "other coding")
    assert of(b"gzip") == of(b"chunked, gzip") == (framed, "other coding")
    assert of() == (framed, "ok")


def test_undone_codings():
    import gzip
    import zlib

    head = lambda v: b"HTTP/1.1 200 OK\r\nTransfer-Encoding: " + v + b"\r\n\r\n"
    packed = gzip.compress(b"hello")
    assert W.http(head(b"gzip, chunked") + W.chunked(packed, 7))[2:] == (b"hello", "ok")
    assert W.http(head(b"deflate, gzip, chunked") + W.chunked(gzip.compress(zlib.compress(b"hello")), 7))[2:] == (b"hello", "ok")
    assert W.http(head(b"gzip, chunked") + W.chunked(packed[:-3], 7))[2:] == (packed[:-3], "other coding")
    assert W.http(head(b"br, gzip, chunked") + W.chunked(packed, 7))[2:] == (b"hello", "other coding")
    assert W.http(head(b"x-gzip") + packed)[2:] == (b"hello", "ok")


def test_malformed_records(spark, tmp_path):
    import gzip

    good = W.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:good>"}, b"fine")
    bad = [b"WARC/1.1\r\nWARC-Record-ID: <urn:none>\r\n\r\nzz\r\n\r\n", b"WARC/1.1\r\nWARC-Record-ID: <urn:word>\r\nContent-Length: four\r\n\r\n", b"WARC/1.1\r\nWARC-Record-ID: <urn:minus>\r\nContent-Length: -4\r\n\r\n",
           W.record({"WARC-Record-ID": "<urn:segment>", "WARC-Segment-Number": "one"}, b"x"), W.record({"WARC-Record-ID": "<urn:total>", "WARC-Segment-Number": 1, "WARC-Segment-Total-Length": "x"}, b"x")]
    end = b"WARC/1.1\r\nWARC-Record-ID: <urn:cut>\r\nContent-Length: 999\r\n\r\nshort"
    data = b"junk\r\n" + b"".join(b + good.replace(b"good", b"good%d" % i) for i, b in enumerate(bad)) + end
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good.replace(b"good", b"packed")) + gzip.compress(good.replace(b"good", b"more")) + b"\x1f\x8bbroken")
    (tmp_path / "c.warc").write_bytes(b"")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = {r.record_id: (r.status, r.body and bytes(r.body)) for r in W.reassembled(W.records(files)).collect()}
    names = ("none", "word", "minus", "segment", "total", "cut")
    assert found == {f"<urn:{n}>": ("malformed", None) for n in names} | {f"<urn:{n}>": ("ok", b"fine") for n in (*(f"good{i}" for i in range(5)), "packed", "more")}


def test_warc_files(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(W.segmented("<urn:1>", "http://a/", b"one" * 50, 60, 20) + W.segmented("<urn:2>", "http://b/", b"two", 500, 20) + b"WARC/1.1\r\ncut")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r.record_id: r.body and bytes(r.body) for r in W.reassembled(W.records(files)).collect()} == {"<urn:1>": b"one" * 50, "<urn:2>": b"two", None: None}


def test_status_of_segments_with_null_numbers(spark):
    """A table of records without the column of malformed ones' marks filled."""
    rows = [("a", "response", "u", None, None, None, bytearray(b"x"), None)]
    assert [(r.status, bytes(r.body)) for r in W.reassembled(spark.createDataFrame(rows, W.RECORDS)).collect()] == [("ok", b"x")]


# --- Sorted string tables


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1), st.text(max_size=5))), st.integers(1, 200))
def test_table(keys, block):
    before, T.BLOCK = T.BLOCK, block
    try:
        keys = sorted(keys, key=T.key_of)
        table = T.Writer(2)
        for n, k in enumerate(keys):
            table.add(T.key_of(k), T.encoded([n, n], 2))
        reader = T.Reader(table.finish())
        assert [k for k, _ in reader.items()] == keys
        for k in set(keys):
            assert [v.tolist() for v in reader.get(k)] == [[n, n] for n, x in enumerate(keys) if x == k]
        assert all(not reader.get(k) for k in ("absent!", 12345678901) if k not in keys)
    finally:
        T.BLOCK = before


@pytest.mark.parametrize("size", [300, T.SHARD_BYTES])
def test_shards(spark, size):
    encode = P.encoding().encode_ordinary
    rows = T.shards(frame(spark, HARD), shard_bytes=size).collect()
    assert (len(rows) > 1) == (size == 300)
    found = sorted(((k, None if v is None else v.tolist()) for r in rows for k, v in T.Reader(bytes(r.data)).items()), key=repr)
    assert found == sorted(((i, None if t is None else encode(t)) for i, t in HARD), key=repr)
    assert T.shards(frame(spark, [])).count() == 0


def test_one_identifier_in_several_ranges(spark):
    rows = [(7, f"text number {i} " * 40) for i in range(60)] + [(8, "last")]
    tables = T.shards(frame(spark, rows), range_bytes=4000).collect()
    assert len(tables) > 3
    found = [v.tolist() for r in tables if r.first_doc_id <= 7 <= r.last_doc_id for v in T.Reader(bytes(r.data)).get(7)]
    assert sorted(found) == sorted(P.encoding().encode_ordinary(t) for i, t in rows if i == 7)


def test_shards_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    decode = P.encoding().decode
    rows = Q.op3_token_sstable(spark, f"{DATA}/sf0.001").collect()
    readers = [(r, T.Reader(bytes(r.data))) for r in rows]
    for doc, text in docs.items():
        (tokens,) = next(t for r, t in readers if r.first_doc_id <= doc <= r.last_doc_id).get(doc)
        assert decode(tokens.tolist()) == text
    assert sum(len(t.get(-5)) for _, t in readers) == 0


# --- Audio


@pytest.mark.parametrize("rate", [8000, 16000, 16001, 22050, 44100, 48000])
def test_resampling_keeps_a_tone(rate):
    x = np.sin(2 * np.pi * 440 * np.arange(rate) / rate).astype(np.float32)[None]
    y = A.resample(x, rate)
    assert y.shape == (1, 16000)
    assert np.abs(y[0] - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000))[200:-200].max() < 1e-3


def test_resampling_against_direct_sums():
    rng = np.random.default_rng(0)
    for rate in (22050, 30011):
        x = rng.standard_normal((2, 500)).astype(np.float32)
        up, down, base, taps = A._phases(rate, A.RATE)
        size = taps.shape[1]
        y = A.resample(x, rate)
        for n in (0, 1, 50, y.shape[1] - 1):
            block, phase = divmod(n, up)
            first = block * down + base[phase] - size // 2 + 1
            want = sum(taps[phase][k] * (x[1, first + k] if 0 <= first + k < 500 else 0) for k in range(size))
            assert y[1, n] == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(("rate", "tone"), [(96000, 10000), (48000, 9000), (44100, 9500), (22050, 9000)])
def test_no_aliases(rate, tone):
    x = np.sin(2 * np.pi * tone * np.arange(rate) / rate).astype(np.float32)[None]
    assert 20 * np.log10(np.abs(A.resample(x, rate)[0, 200:-200]).max()) < -60


@pytest.mark.parametrize("rate", [8000, 16000, 22050, 44100])
def test_stretches_are_as_the_whole(monkeypatch, rate):
    clips = np.random.default_rng(3).integers(-20000, 20000, (2, rate * 2 + 17)).astype("<i2")
    whole = A.features(clips, rate)
    assert np.allclose(np.concatenate([A.resample(clips, rate, A.RATE, a, a + 777) for a in range(0, A.resampled_length(clips.shape[1], rate), 777)], axis=1), A.resample(clips, rate), atol=2)
    monkeypatch.setattr(A, "STRETCH", 7)
    for a, b in zip(whole, A.features(clips, rate)):
        assert a["segments"] == b["segments"] and a["n_frames"] == b["n_frames"]
        assert np.allclose(A.read_tensors(a["tensors"])[1], A.read_tensors(b["tensors"])[1], atol=1e-3)


def test_bands_and_frames():
    x = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000).astype(np.float32)[None]
    mel = A.log_mel(A.frames(x, A.frame_count(x.shape[1])))
    assert mel.shape == (1, 99, A.BANDS)  # 98 whole frames and one that is filled up
    centre = np.argmax(A.mel_bands()[round(1000 * A.FFT / A.RATE)])
    assert abs(int(mel[0, 40].argmax()) - int(centre)) <= 1
    assert A.frames(np.zeros((1, 10), np.float32), A.frame_count(10)).shape == (1, 1, A.FRAME)


def brute_segments(db, least):
    out, on, begin = [], False, 0
    for i, x in enumerate([*db, -999]):
        if not on and x >= A.RISE_DB:
            on, begin = True, i
        elif on and x < A.FALL_DB:
            on = False
            if i - begin >= least:
                out.append((begin, i))
    return out


@given(st.lists(st.floats(-60, 0), min_size=1, max_size=30))
def test_hysteresis(db):
    top = max(db)
    energy = 10 ** (np.array(db) / 10)
    assert A.active(energy) == brute_segments((10 * np.log10(energy / energy.max())).tolist(), A.LEAST)
    assert A.active(np.zeros(4)) == [] and top <= 0


def test_audio_cases(spark):
    tone = (np.sin(np.arange(8000) / 3) * 20000).astype("<i2")
    tone[3000:6000] = 0
    rows = [(1, bytearray(tone.tobytes()), 16000), (1, bytearray(tone.tobytes()), 16000), (2, None, 16000), (3, bytearray(), 16000), (4, bytearray(b"\x01"), 16000), (5, bytearray(tone.tobytes() + b"\x01"), 8000), (6, bytearray(tone.tobytes()), None), (7, bytearray(tone.tobytes()), 0), (None, bytearray(4), 22050), (8, bytearray(2 * 16000 * 60), 16000)]
    media = spark.createDataFrame(rows, "media_id long, pcm binary, rate int").withColumn("segments", F.lit(1))
    found = {}
    for r in A.audio_features(media).collect():
        found.setdefault(r.media_id, []).append(r)
    assert len(found[1]) == 2 and found[1][0] == found[1][1]
    one = found[1][0]
    assert [(round(s.start_s, 2), round(s.end_s, 2)) for s in one.segments] == [(0.0, 0.19), (0.36, 0.49)]
    times, mel = A.read_tensors(bytes(one.tensors))
    assert mel.shape == (2, A.FRAMES, A.BANDS) and times[0].tolist() == [0.0, 0.32] and times[1].tolist() == [0.32, 0.5]
    assert np.all(mel.reshape(-1, A.BANDS)[one.n_frames :] == np.log(A.FLOOR))
    for i in (2, 3, 4, 6, 7):
        assert (found[i][0].n_windows, found[i][0].segments, found[i][0].tensors) == (0, [], None)
    assert found[5][0].n_windows > 0 and found[None][0].segments == [] and found[8][0].segments == [] and found[8][0].n_windows > 100
    assert A.audio_features(media.limit(0)).count() == 0


def test_audio_query(spark):
    rows = Q.op10_audio_features(spark, f"{DATA}/sf0.001").collect()
    embeddings = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()}
    assert {r.media_id for r in rows} == set(embeddings)
    for r in rows[::25]:  # against direct sums
        n, turn, peak = len(embeddings[r.media_id]), 2 * np.pi / A.SYNTH_RATE, max(abs(y) for y in embeddings[r.media_id])
        pcm = np.concatenate([np.trunc(32000 * (y / peak if abs(y / peak) >= 0.3 else 0) * np.sin(turn * (200 + 50 * (i % 64)) * np.arange(A.SYNTH_STEP))) for i, y in enumerate(embeddings[r.media_id])]) / 32768
        length = -(-len(pcm) * 320 // 441)  # 22050 to 16000
        at = np.arange(length) * 441 / 320
        wide, cut = A.TAPS / 2 * 441 / 320, A.CUTOFF * 320 / 441
        sound = np.zeros(length)
        for i, t in enumerate(at):
            k = np.arange(int(np.floor(t)) - 100, int(np.floor(t)) + 101)
            x = k - t
            half = np.ceil(wide)
            w = np.where(np.abs(x) < half, np.i0(A.KAISER * np.sqrt(np.maximum(0, 1 - (x / half) ** 2))) * np.sinc(cut * x), 0)
            inside = (k >= 0) & (k < len(pcm))
            sound[i] = (w[inside] * pcm[k[inside]]).sum() / w.sum()
        frames = max(1, -(-(length - A.FRAME) // A.HOP) + 1)
        sound = np.append(sound, np.zeros(frames * A.HOP + A.FRAME))
        turn = np.exp(-2j * np.pi * np.outer(np.arange(A.FRAME), np.arange(A.FFT // 2 + 1)) / A.FFT)
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(A.FRAME) / A.FRAME)
        mel = np.array([np.log(np.maximum((np.abs((sound[f * A.HOP : f * A.HOP + A.FRAME] * hann) @ turn) ** 2) @ A.mel_bands(), A.FLOOR)) for f in range(frames)])
        assert r.n_frames == frames
        ours = A.read_tensors(bytes(r.tensors))[1].reshape(-1, A.BANDS)[:frames]
        assert np.allclose(np.exp(ours), np.exp(mel), atol=2e-3 * np.exp(mel).max())
    for r in rows[:20]:  # sound is where elements are loud
        v = np.abs(np.array(embeddings[r.media_id]))
        loud = v / v.max() >= 0.3
        on = np.zeros(len(loud), bool)
        for s in r.segments:
            on[int(s.start_s * 100) : int(np.ceil(s.end_s * 100))] = True
        assert on[np.flatnonzero(v[:60] / v.max() > 0.6)].mean() > 0.8  # behind, no frame begins
        assert A.read_tensors(bytes(r.tensors))[1].shape == (r.n_windows, A.FRAMES, A.BANDS)
    nothing = spark.createDataFrame([(1, None), (2, []), (3, [1.0] * 70)], "vec_id long, embedding array<float>")
    assert [r.n_windows > 0 for r in A.audio_features(A.sounded(nothing)).orderBy("media_id").collect()] == [False, False, True]
