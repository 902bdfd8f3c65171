"""Operator 10: features of audio columns.

Sound (16-bit PCM of any rate) is resampled by a polyphase filter, cut into
overlapping frames of 25 ms every 10 ms, and each frame's power spectrum is summed
in mel bands, of which the logarithm is taken. Speech or sound is where a frame's
energy rises above one threshold and until it falls below a lower one
(hysteresis), both relative to the clip's loudest frame; shorter stretches than
``least`` frames are dropped. The log-mel frames are stored in windows of a fixed
shape, [FRAMES, BANDS], as an Arrow fixed-shape tensor column beside the time at
which each window starts and ends, in Arrow's stream format, which readers map
without a copy.

Everything is done on batches of clips, in numpy, and on stretches of long ones;
there is no shuffle.

Defined results: without sound (null or under two bytes) or a positive rate there
are no windows: `tensors` is null, and `segments` empty. An odd last byte is
ignored. Silence has frames but no segments. The last window is filled with the
logarithm of silence. A very long clip is held as it came and as its features,
what is between for STRETCH frames at a time. Rows that repeat have equal results;
a null identifier is kept; extra columns are not looked at. Without rows there are
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common as C

RATE, FRAME, HOP, FFT, BANDS, FRAMES = 16_000, 400, 160, 512, 40, 32
#: Samples of the slower of the two rates that the resampling filter spans; where it cuts, as a share of that rate's half; its window's shape.
TAPS, CUTOFF, KAISER = 64, 0.92, 9.0
#: Frames that are handled at once; samples of all clips together.
STRETCH, TOGETHER = 4096, 1 << 20
RISE_DB, FALL_DB, LEAST = -20.0, -30.0, 2
FLOOR = np.float32(1e-10)
FEATURES = "media_id long, rate int, n_frames int, n_windows int, segments array<struct<start_s:double,end_s:double>>, tensors binary"
_SEGMENT = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
_FEATURES = pa.schema([("media_id", pa.int64()), ("rate", pa.int32()), ("n_frames", pa.int32()), ("n_windows", pa.int32()), ("segments", pa.list_(_SEGMENT)), ("tensors", pa.binary())])
TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, BANDS))


# --- Polyphase resampling


@lru_cache(maxsize=8)
def _phases(rate: int, to: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """up, down, and for each of the `up` phases its first input sample and its taps: a sinc in a Kaiser window, as long as the slower rate asks for."""
    g = gcd(rate, to)
    up, down = to // g, rate // g
    at = np.arange(up, dtype=np.int64) * down
    base, phase = at // up, (at % up) / up
    slower = min(1.0, to / rate)
    n = 2 * int(np.ceil(TAPS / 2 / slower))
    k = np.arange(n) - n // 2 + 1
    x = k[None, :] - phase[:, None]
    cutoff = CUTOFF * slower
    window = np.i0(KAISER * np.sqrt(np.maximum(0, 1 - (2 * x / n) ** 2))) * (np.abs(x) < n / 2)
    taps = cutoff * np.sinc(cutoff * x) * window
    return up, down, base, (taps / taps.sum(axis=1, keepdims=True)).astype(np.float32)


def resampled_length(n: int, rate: int, to: int = RATE) -> int:
    g = gcd(rate, to)
    return -(-n * (to // g) // (rate // g))


def resample(x: np.ndarray, rate: int, to: int = RATE, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Samples [begin, end) of clips [clip, sample] at another rate; all of them if end is not given."""
    length = resampled_length(x.shape[1], rate, to)
    end = length if end is None else min(end, length)
    if rate == to or not x.shape[1]:
        return x[:, begin:end].astype(np.float32)
    up, down, base, taps = _phases(rate, to)
    n = taps.shape[1]
    first, last = begin // up, -(-end // up)
    blocks = last - first
    low, high = first * down - n // 2 + 1, last * down + n // 2 + 1  # of the input; what lies outside is silence
    pad = np.zeros((x.shape[0], max(high - low, blocks * down + n)), np.float32)
    a, b = max(low, 0), min(high, x.shape[1])
    if a < b:
        pad[:, a - low : b - low] = x[:, a:b]
    out = np.zeros((x.shape[0], blocks, up), np.float32)
    if up <= 1024 and (down + n) * up <= 1 << 20:  # a block of `down` samples gives `up`: one product for all blocks
        matrix = np.zeros((down + n, up), np.float32)
        matrix[base[None, :] + np.arange(n)[:, None], np.arange(up)[None, :]] = taps.T
        views = np.lib.stride_tricks.sliding_window_view(pad, down + n - 1, axis=1)[:, ::down][:, :blocks]
        out = views @ matrix[:-1]
    else:
        views = np.lib.stride_tricks.sliding_window_view(pad, n, axis=1)
        for p in range(up):
            out[:, :, p] = views[:, base[p] + np.arange(blocks) * down] @ taps[p]
    return out.reshape(x.shape[0], -1)[:, begin - first * up : end - first * up]


# --- Log-mel bands and segments


@lru_cache(maxsize=4)
def mel_bands(rate: int = RATE, size: int = FFT, bands: int = BANDS) -> np.ndarray:
    """[size // 2 + 1, bands]: triangles that are even on the mel scale from 20 Hz to half the rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.arange(size // 2 + 1)[:, None] * rate / size
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def frame_count(n: int) -> int:
    """At least one; the last is filled with silence."""
    return max(1, -(-(n - FRAME) // HOP) + 1)


def frames(x: np.ndarray, n: int) -> np.ndarray:
    """[clip, frame, FRAME], so many."""
    pad = np.zeros((x.shape[0], (n - 1) * HOP + FRAME), np.float32)
    pad[:, : min(x.shape[1], pad.shape[1])] = x[:, : pad.shape[1]]
    return np.lib.stride_tricks.sliding_window_view(pad, FRAME, axis=1)[:, ::HOP]


def log_mel(cut: np.ndarray) -> np.ndarray:
    window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
    spectrum = np.fft.rfft(cut * window, FFT, axis=-1)
    power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
    return np.log(np.maximum(power @ mel_bands(), FLOOR))


def active(energy: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches [begin, end) of frames, from where the energy rises to the upper threshold until it is under the lower."""
    top = energy.max(initial=0)
    if top <= FLOOR:
        return []
    level = 10 * np.log10(np.maximum(energy / top, 1e-12))
    turns = np.where(level >= RISE_DB, 1, np.where(level < FALL_DB, -1, 0))
    last = np.maximum.accumulate(np.where(turns != 0, np.arange(len(level)), -1))
    on = np.concatenate([[False], (last >= 0) & (turns[last] == 1), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
    return [(a, b) for a, b in edges.tolist() if b - a >= least]


def tensors(mel: np.ndarray, seconds: float) -> bytes:
    """Windows of log-mel frames with their times, as an Arrow stream."""
    n = -(-len(mel) // FRAMES)
    full = np.full((n * FRAMES, BANDS), np.log(FLOOR), np.float32)
    full[: len(mel)] = mel
    start = np.arange(n) * FRAMES * HOP / RATE
    end = np.minimum(start + FRAMES * HOP / RATE, max(seconds, HOP / RATE))
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, FRAMES, BANDS))
    batch = pa.record_batch([pa.array(start), pa.array(np.maximum(start, end)), column], ["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """([window, 2] times, [window, FRAMES, BANDS]) of what tensors() wrote."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return np.column_stack([table["start_s"], table["end_s"]]), table["log_mel"].chunk(0).to_numpy_ndarray()


def features(clips: np.ndarray, rate: int) -> list[dict]:
    """Of clips (16-bit numbers) of the same length and rate."""
    length = resampled_length(clips.shape[1], rate)
    n = frame_count(length)
    mel, energy = np.empty((len(clips), n, BANDS), np.float32), np.empty((len(clips), n), np.float32)
    for a in range(0, n, STRETCH):
        b = min(a + STRETCH, n)
        sound = resample(clips, rate, RATE, a * HOP, (b - 1) * HOP + FRAME) / np.float32(32768)
        cut = frames(sound, b - a)
        mel[:, a:b], energy[:, a:b] = log_mel(cut), np.einsum("cfs,cfs->cf", cut, cut) / FRAME
    seconds = clips.shape[1] / rate
    step = HOP / RATE
    out = []
    for i in range(len(clips)):
        segments = [{"start_s": a * step, "end_s": min(b * step, seconds)} for a, b in active(energy[i])]
        out.append({"rate": rate, "n_frames": n, "n_windows": -(-n // FRAMES), "segments": segments, "tensors": tensors(mel[i], seconds)})
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("pcm")), 0).to_numpy().astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = at + 1
            while to < batch.num_rows and to - at < 256 and sizes[at : to + 1].sum() <= 8 << 20:
                to += 1
            rows = batch.slice(at, to - at).to_pylist()
            out = [{"media_id": r["media_id"], "rate": r["rate"], "n_frames": 0, "n_windows": 0, "segments": [], "tensors": None} for r in rows]
            alike: dict[tuple[int, int], list[int]] = {}
            for i, r in enumerate(rows):
                if r["pcm"] is not None and len(r["pcm"]) > 1 and (r["rate"] or 0) > 0:
                    alike.setdefault((r["rate"], len(r["pcm"]) // 2), []).append(i)
            for (rate, n), which in alike.items():
                most = max(1, TOGETHER // n)
                for a in range(0, len(which), most):
                    some = which[a : a + most]
                    for i, found in zip(some, features(np.stack([np.frombuffer(rows[i]["pcm"], "<i2", n) for i in some]), rate)):
                        out[i] |= found
            yield pa.RecordBatch.from_pylist(out, schema=_FEATURES)
            at = to


def audio_features(media: DataFrame) -> DataFrame:
    """FEATURES of (media_id, pcm, rate)."""
    C.steady(media.sparkSession)
    return media.selectExpr("cast(media_id as long) media_id", "cast(pcm as binary) pcm", "cast(rate as int) rate").mapInArrow(_features, FEATURES)


# --- Sound for tests and queries: there is no audio table

SYNTH_RATE, SYNTH_STEP = 22_050, 220


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("media_id", pa.int64()), ("pcm", pa.binary()), ("rate", pa.int32())])
    t = np.arange(SYNTH_STEP) / SYNTH_RATE
    for batch in batches:
        pcm = []
        for v in batch.column("embedding"):
            if not v.is_valid or not len(v):
                pcm.append(None)
                continue
            x = np.nan_to_num(v.values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32))
            x = x / max(np.abs(x).max(), np.float32(1e-9))
            x[np.abs(x) < 0.3] = 0
            tones = np.sin(2 * np.pi * (200 + 50 * (np.arange(len(x)) % 64))[:, None] * t).astype(np.float32)
            pcm.append((x[:, None] * tones * 32000).astype("<i2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(pcm, pa.binary()), pa.array([SYNTH_RATE] * batch.num_rows, pa.int32())], schema=schema)


def sounded(embeddings: DataFrame) -> DataFrame:
    """(media_id, pcm, rate): each embedding as a clip of tones of 10 ms, one for each element and as loud; faint ones are silent."""
    C.steady(embeddings.sparkSession)
    return embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_sound, "media_id long, pcm binary, rate int")
