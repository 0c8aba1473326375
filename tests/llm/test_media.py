"""Audio features against sums written out: payloads, resampling, filterbank, spectra, spans."""

import cmath
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from velarium.llm import media

from .test_operators import docs, none, odd_rows  # noqa: F401


def plain_resampled(x, n):
    """Output n of resampling by 3/4, from the windowed sinc itself."""
    length = media.TAPS * 3
    fir = [(1.0 if k == length // 2 else math.sin(math.pi * (k - length / 2) / 4) / (math.pi * (k - length / 2) / 4)) * (0.54 - 0.46 * math.cos(2 * math.pi * k / length)) for k in range(length)]
    base, phase = divmod(n * 4, 3)
    taps = fir[phase::3]
    total = 0.0
    for k, tap in enumerate(taps):
        at = base + media.TAPS // 2 - k
        if 0 <= at < len(x):
            total += tap / sum(taps) * (int(x[at]) - 128) / 128
    return total


def plain_log_mel(y):
    """Log-mel energies of one window, by the definition of the transform and of the triangles."""
    tapered = [v * (0.5 - 0.5 * math.cos(2 * math.pi * n / (len(y) - 1))) for n, v in enumerate(y)]
    power = []
    for k in range(media.FFT // 2 + 1):
        z = sum(v * cmath.exp(-2j * math.pi * k * n / media.FFT) for n, v in enumerate(tapered))
        power.append(abs(z) ** 2)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(60) + (mel(3000) - mel(60)) * i / (media.MELS + 1)) / 2595) - 1) for i in range(media.MELS + 2)]
    out = []
    for b in range(media.MELS):
        low, mid, high = edges[b : b + 3]
        weight = lambda f: max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid)))  # noqa: B023, E731
        out.append(math.log(sum(p * weight(k * 6000 / media.FFT) for k, p in enumerate(power)) + 1e-6))
    return out


def test_resampling_and_log_mel_are_the_plain_sums():
    x = np.random.default_rng(1).integers(0, 256, 1152).astype(np.uint8)
    y = media.resample(x, 0, 288)
    assert np.allclose(y, [plain_resampled(x, n) for n in range(864)], atol=1e-12)
    assert np.allclose(media.resample(x, 10, 50), y[30:180])
    mel, energy = media.log_mel(x)
    for frame in (0, 1, 3, len(mel) - 1):
        window = [plain_resampled(x, n) for n in range(frame * media.HOP, frame * media.HOP + media.WINDOW)]
        assert np.allclose(mel[frame], plain_log_mel(window), atol=1e-9)
        assert abs(energy[frame] - 10 * math.log10(sum(v * v for v in window) / len(window) + 1e-9)) < 1e-9


def test_runs_of_frames_change_nothing(monkeypatch):
    x = np.random.default_rng(2).integers(0, 256, 5760).astype(np.uint8)
    whole, energy = media.log_mel(x)
    monkeypatch.setattr(media, "RUN", 3)
    assert np.array_equal(media.log_mel(x)[0], whole) and np.array_equal(media.log_mel(x)[1], energy)


def test_hysteresis():
    active = media.voiced(np.array([0, 10, 5, 5, 0, 5, 10, 0], float))
    assert active.tolist() == [False, True, True, True, False, False, True, False]
    assert len(media.spans(active)) == 2
    rng = np.random.default_rng(4)
    for _ in range(20):
        energy, on, want = rng.normal(size=50), False, []
        for e in energy:
            on = e >= energy.mean() + 0.5 * energy.std() or (on and e >= energy.mean() - 0.5 * energy.std())
            want.append(on)
        assert media.voiced(energy).tolist() == want


def test_stored_media_and_tensors(docs, none):  # noqa: F811
    stored = media.store_media(docs.withColumn("feature", F.lit(1)).withColumn("media", F.lit("clash")))
    kept = {(r["doc_id"], r["text"]): bytes(r["media"]) for r in stored.collect()}
    rows = media.audio_features(stored).collect()
    assert len(rows) == len(odd_rows())
    seen = {}
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * (576 - len(raw) if not raw else -len(raw) % 576)
        wav = kept[r["doc_id"], r["text"]]
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and bytes(media.samples_of(wav)) == payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_bytes"] == len(wav) and r["media_sha256"] == hashlib.sha256(wav).hexdigest()
        assert seen.setdefault(r["text"] or "", r["feature"]) == r["feature"] and hashlib.sha256(r["tensors"]).hexdigest() in r["feature"]
        with pa.ipc.open_stream(r["tensors"]) as stream:
            t = stream.read_all()
        assert t.column("log_mel").type.shape == [media.FRAMES, media.MELS] and b"spans" in t.schema.metadata
        mel = media.log_mel(np.frombuffer(payload, np.uint8))[0]
        back = np.concatenate([np.asarray(x) for x in t.column("log_mel").combine_chunks().to_numpy_ndarray()]).reshape(-1, media.MELS)
        assert np.array_equal(back[: len(mel)], mel.astype(np.float16)) and not back[len(mel) :].any()
        assert t.column("start_s").to_pylist() == sorted(t.column("start_s").to_pylist())
    assert media.audio_features(media.store_media(none)).count() == 0


def test_any_number_of_frames_gives_the_same_bits():
    x = np.random.default_rng(3).integers(0, 256, 57_600).astype(np.uint8)
    whole = media.resample(x, 0, 14_400)
    spectra = np.random.default_rng(5).random((300, media.FFT // 2 + 1))
    for count in (1, 2, 3, 5, 8, 17, 64, 299):
        assert np.array_equal(media.resample(x, 40, count), whole[120 : 120 + 3 * count])
        assert np.array_equal(media.in_bands(spectra[:count]), media.in_bands(spectra)[:count])
    assert np.allclose(media.in_bands(spectra), spectra @ media.BANK)


def test_columns_with_the_names_used_inside(docs):  # noqa: F811
    names = ["_w", "_d", "own", "made", "found", "c0"]
    clashing = docs.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    out = media.audio_features(media.store_media(clashing))
    assert out.columns == [*docs.columns, *names, "n_bytes", *media.FEATURES]
    assert all([r[n] for n in names] == names for r in out.collect())
