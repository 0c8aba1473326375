"""Media columns: audio features of byte payloads.

A payload is stored as a WAV file (8-bit unsigned mono PCM, 8 kHz) in a table
of media, read back from it and turned into features: polyphase resampling by
3/4 to 6 kHz (windowed-sinc, 16 taps a phase), log-mel energies of 40 ms
windows every 20 ms in 24 bands, and voiced spans from an energy track with
hysteresis.  The features are stored in a second table, as fixed-shape Arrow
tensors (32 frames x 24 bands, half precision; the last one is padded with
zeros) with the time span and voicing of each and the voiced spans, as one
Arrow IPC stream a row, and what a query reports of them is read from there.

Equal payloads give equal tensors, whatever runs they are worked through in:
no sum depends on how many rows a call has.  Resampler taps are multiples of
2**-44 and samples are bytes, and powers and band weights are split into whole
numbers of few bits, so a double holds every sum exactly and the order in which
a processor adds does not matter.  Long payloads are worked through in runs of
frames: memory does not grow with a document beyond its bytes and its features.

Defined cases: null and empty texts have the least payload (one unit of 255s);
equal texts give equal values; columns named like the results are replaced,
others pass; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, cut, given_back

UNIT, FILL = 576, b"\xff"
RATE, UP, DOWN, TAPS = 8000, 3, 4, 16
WINDOW, HOP, FFT, MELS, FRAMES = 240, 120, 256, 24, 32
#: Frames worked on at once.
RUN = 8192


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + FILL * (-len(raw) % UNIT if raw else UNIT)


def wav(samples: bytes) -> bytes:
    """A WAV file of 8-bit unsigned mono samples."""
    pad = b"\0" * (len(samples) % 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(samples) + len(pad), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + pad


def samples_of(media: bytes) -> memoryview:
    """The samples of a WAV file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _resampler() -> np.ndarray:
    """Matrix from 20 neighbouring samples to the 3 outputs of a period of 4; rows sum to 1 by column."""
    length = TAPS * UP
    t = np.arange(length) - length / 2
    fir = np.sinc(t / DOWN) * np.hamming(length + 1)[:-1]
    m = np.zeros((20, UP))
    for p in range(UP):
        base, phase = divmod(p * DOWN, UP)
        taps = fir[phase::UP]
        taps = taps / taps.sum()
        for k in range(TAPS):  # output p reads samples base + 8 .. base - 7; row 0 is sample -8
            m[8 + base + TAPS // 2 - k, p] += taps[k]
    return m


def _filterbank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    top = RATE * UP / DOWN / 2
    edges = 700 * (10 ** (np.linspace(mel(60), mel(top), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * 2 * top / FFT
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


#: Steps of the taps: 16 of them, times bytes, add up to less than 2**53 steps.
TAP = float(1 << 44)
RESAMPLER, BANK, TAPER = np.rint(_resampler() * TAP), _filterbank(), np.hanning(WINDOW)


def resample(x: np.ndarray, start: int, count: int) -> np.ndarray:
    """``count`` periods of 3 outputs from the period ``start`` on; x holds 8-bit samples, silence lies around them."""
    lo, hi = start * DOWN - 8, (start + count) * DOWN + 12
    part = np.zeros(hi - lo)
    a, b = max(lo, 0), min(hi, len(x))
    if b > a:
        part[a - lo : b - lo] = x[a:b].astype(np.float64) - 128
    rows = part.reshape(-1, DOWN)
    return (np.hstack([rows[i : i + count] for i in range(5)]) @ RESAMPLER).reshape(-1) / (128 * TAP)


def _parts(x: np.ndarray, steps: tuple[float, float]) -> list[np.ndarray]:
    """x as whole numbers of two steps, the second one for what the first leaves."""
    first = np.rint(x * steps[0])
    return [first, np.rint((x - first / steps[0]) * steps[1])]


#: Steps of powers (25 bits above the first, 25 below) and of weights; no product's sum needs more than 53 bits.
POWERS, WEIGHTS = (2.0**9, 2.0**34), (2.0**18, 2.0**36)
_BANKS = _parts(BANK, WEIGHTS)


def in_bands(power: np.ndarray) -> np.ndarray:
    """power @ BANK, from four products of whole numbers, which are exact in any order of adding."""
    out = np.zeros((len(power), MELS))
    for p, x in zip(_parts(power, POWERS), POWERS, strict=True):
        for w, y in zip(_BANKS, WEIGHTS, strict=True):
            out += p @ w / (x * y)
    return out


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x MELS) and each frame's energy in decibels."""
    n = -(-len(x) * UP // DOWN)
    frames = max(1, 1 + -(-(n - WINDOW) // HOP))
    out, energy = np.empty((frames, MELS)), np.empty(frames)
    for f in range(0, frames, RUN):
        g = min(f + RUN, frames)
        y = resample(x, f * HOP // UP, (g - f) * HOP // UP + (WINDOW - HOP) // UP)
        windows = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP][: g - f]
        spectrum = np.fft.rfft(windows * TAPER, FFT, axis=1)
        out[f:g] = np.log(in_bands(spectrum.real**2 + spectrum.imag**2) + 1e-6)
        energy[f:g] = 10 * np.log10(np.square(windows).mean(axis=1) + 1e-9)
    return out, energy


def voiced(energy: np.ndarray) -> np.ndarray:
    """Hysteresis: on from the upper threshold, off below the lower one, unchanged between."""
    mid, spread = float(energy.mean()), float(energy.std())
    on, off = energy >= mid + 0.5 * spread, energy < mid - 0.5 * spread
    decisive = np.where(on | off, np.arange(len(energy)), -1)
    last = np.maximum.accumulate(decisive)
    return (last >= 0) & on[np.maximum(last, 0)]


def spans(active: np.ndarray) -> list[tuple[float, float]]:
    """Start and end, in seconds, of each run of active frames."""
    edge = np.flatnonzero(np.diff(np.r_[0, active.astype(np.int8), 0]))
    step, width = HOP * DOWN / UP / RATE, WINDOW * DOWN / UP / RATE
    return [(round(a * step, 6), round((b - 1) * step + width, 6)) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def tensors(mel: np.ndarray, active: np.ndarray, found: list[tuple[float, float]]) -> bytes:
    """The features as an Arrow IPC stream of fixed-shape tensors with time spans; the voiced spans are in the schema."""
    k = -(-len(mel) // FRAMES)
    whole = np.zeros((k * FRAMES, MELS), np.float16)
    whole[: len(mel)] = mel
    share = np.zeros(k * FRAMES)
    share[: len(active)] = active
    step, width = HOP * DOWN / UP / RATE, WINDOW * DOWN / UP / RATE
    first = np.arange(k) * FRAMES
    end = (np.minimum(first + FRAMES, len(mel)) - 1) * step + width
    batch = pa.record_batch(
        [pa.FixedShapeTensorArray.from_numpy_ndarray(whole.reshape(k, FRAMES, MELS)), pa.array(first * step), pa.array(end), pa.array(share.reshape(k, FRAMES).mean(axis=1))],
        names=["log_mel", "start_s", "end_s", "voiced"],
    ).replace_schema_metadata({"spans": repr(found)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


STORED = ("n_bytes", "media")
FEATURES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "segments", "tensors", "feature")


def _media(text: Column) -> Column:
    @F.arrow_udf("struct<n_bytes:long,media:binary>")
    def made(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = [payload_of(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([wav(p) for _, p in rows], pa.binary())], list(STORED))

    return made(text)


DESCRIBED = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("frames", pa.int64()), ("segments", pa.int32()), ("tensors", pa.binary())])


def described(media: bytes) -> dict:
    back = samples_of(media)
    mel, energy = log_mel(np.frombuffer(back, np.uint8))
    active = voiced(energy)
    found = spans(active)
    return {"payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]), "frames": len(mel), "segments": len(found), "tensors": tensors(mel, active, found)}


def _described(media: Column) -> Column:
    @F.arrow_udf("struct<payload_bytes:long,payload_sha256:string,tail_crc32:long,frames:long,segments:int,tensors:binary>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([described(m.as_py()) for m in batch], DESCRIBED)

    return made(media)


def store_media(df: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The table of media, written and read back: ``columns`` (all) with n_bytes and media, a WAV file a row."""
    kept = [c for c in columns or df.columns if c not in STORED]
    return cut(df.select(carried(kept).alias("own"), _media(F.col(text)).alias("made")).select(*given_back(kept, "own"), "made.n_bytes", "made.media"), "zstd")


def audio_features(stored: DataFrame) -> DataFrame:
    """The table of features of a table of media, written and read back: its columns but media, with those of FEATURES."""
    kept = [c for c in stored.columns if c not in (*FEATURES, "media")]
    digests = F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")
    made = stored.select(carried(kept).alias("own"), *digests, _described(F.col("media")).alias("found"))
    names = [DESCRIBED.field(i).name for i in range(DESCRIBED.num_fields)]
    back = cut(made.select("own", "media_bytes", "media_sha256", *[F.col("found").getField(c).alias(c) for c in names]), "zstd")
    blocks = F.ceil(F.col("frames") / FRAMES)
    feature = F.concat(F.lit("frames="), "frames", F.lit(f";mels={MELS};tensors="), blocks, F.lit(";segments="), "segments", F.lit(";sha256="), F.sha2("tensors", 256))
    return back.withColumn("feature", feature).select(*given_back(kept, "own"), *FEATURES)
