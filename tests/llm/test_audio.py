import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trajkit.llm import audio, queries

SETTINGS = audio.Features()


def test_wav_is_read_by_the_standard_library(tmp_path):
    import wave

    payload = bytes(range(256)) * 9
    path = tmp_path / "a.wav"
    path.write_bytes(audio.to_wav(payload, 24_000))
    with wave.open(str(path)) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate()) == (1, 1, 24_000) and f.readframes(10**6) == payload
    assert audio.from_wav(path.read_bytes()) == (payload, 24_000)


def test_resampling_keeps_a_tone_and_equals_the_plain_sum():
    tone = np.sin(2 * np.pi * 1000 * np.arange(2400) / 24_000).astype(np.float32)
    got = audio.resampled(tone, SETTINGS)
    assert len(got) == 1600 and np.abs(got - np.sin(2 * np.pi * 1000 * np.arange(1600) / 16_000))[100:-100].max() < 1e-3
    noise = np.random.default_rng(1).normal(size=60).astype(np.float32)
    half, cut = SETTINGS.taps // 2, SETTINGS.up / SETTINGS.down
    plain = []
    for n in range(40):
        at = n * SETTINGS.down / SETTINGS.up
        k = np.arange(60) - at
        plain.append((noise * np.where(np.abs(k) < half, cut * np.sinc(cut * k) * np.cos(np.pi * k / SETTINGS.taps) ** 2, 0)).sum())
    assert np.allclose(audio.resampled(noise, SETTINGS), plain, atol=1e-5)


def test_mel_frames_equal_a_plain_transform():
    signal = np.random.default_rng(2).normal(size=2000).astype(np.float32)
    mels, energy = audio.log_mel(signal, SETTINGS)
    assert mels.shape == (11, 32) and len(energy) == 11
    frame = np.zeros(512)
    frame[:400] = signal[320:720] * np.hanning(401)[:-1]
    power = np.abs(np.array([(frame * np.exp(-2j * np.pi * k * np.arange(512) / 512)).sum() for k in range(257)])) ** 2
    assert np.allclose(mels[2], np.log(power @ audio._mel(SETTINGS) + 1e-10), atol=1e-3)


def test_hysteresis():
    level = np.array([-30, -15, -10, -15, -17, -20, -15, -13, 0, -17.9, -18.1, -14])
    assert audio.loud_segments(10 ** (level / 10), SETTINGS) == [(2, 5), (8, 10)]


def plain(text):
    data = (text or "").encode()
    payload = data + b"\xff" * (-len(data) % 576 if data else 576)
    media = audio.to_wav(payload, 24_000)
    return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())


def test_query_equals_plain_bytes(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op2_audio_features(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    features = {}
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == plain(texts[r["doc_id"]])
        assert features.setdefault(texts[r["doc_id"]], r["feature"]) == r["feature"]
    assert len(set(features.values())) == len(features)


def test_odd_rows_and_tensors(spark):
    texts = [None, "", "a" * 575, "a" * 576, "é" * 300, "long " * 100_000, "a" * 576]
    docs = spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"media": F.lit(1), "n_bytes": F.lit("x")})
    got = sorted(audio.audio_media(docs.repartition(3)).collect(), key=lambda r: r["doc_id"] or 0)
    assert [r["n_bytes"] for r in got] == [0, 0, 575, 576, 600, 500_000, 576]
    assert [len(audio.from_wav(bytes(r["media"]))[0]) for r in got] == [576, 576, 576, 576, 1152, 500_544, 576]
    assert got[0]["tensors"] == got[1]["tensors"] and got[3]["tensors"] == got[6]["tensors"] != got[2]["tensors"]
    for r in got:
        stored = audio.read_tensors(bytes(r["tensors"]))
        tensors = stored["mel"].combine_chunks()
        assert isinstance(tensors, pa.FixedShapeTensorArray) and tensors.to_numpy_ndarray().shape == (len(r["spans"]), 16, 32)
        assert list(zip(stored["start"].to_pylist(), stored["end"].to_pylist(), strict=True)) == [tuple(x) for x in r["spans"]]
        assert r["spans"][0]["start"] == 0 and all(a["start"] < b["start"] < a["end"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    assert audio.audio_media(docs.where("false")).count() == 0


def test_the_last_bytes_are_heard():
    length = SETTINGS.window / 16_000
    for units in range(1, 8):
        payload = bytes([128]) * (576 * units)
        whole, spans, _ = audio.features_of(audio.to_wav(payload, 24_000), SETTINGS)
        other, _, _ = audio.features_of(audio.to_wav(payload[:-12] + bytes(range(0, 240, 20)), 24_000), SETTINGS)
        seconds = len(payload) / 24_000
        assert not np.array_equal(whole, other), units
        assert spans[-1][1] >= seconds and spans[-1][1] - seconds < length


def plain_features(payload, f=SETTINGS):
    """Tensors' values by one product per output and frame, in double precision."""
    x = (np.frombuffer(payload, dtype=np.uint8).astype(float) - 128) / 128
    half, cut, count = f.taps // 2, f.up / f.down, -(-len(x) // f.down) * f.up
    signal = np.zeros(count + f.window + f.hop)
    for n in range(count):
        k = np.arange(max(0, n * f.down // f.up - half), min(len(x), n * f.down // f.up + half + 2))
        d = k - n * f.down / f.up
        signal[n] = (x[k] * np.where(np.abs(d) < half, cut * np.sinc(cut * d) * np.cos(np.pi * d / f.taps) ** 2, 0)).sum()
    frames = 1 + max(0, -(-(count - f.window) // f.hop))
    power = [np.abs(np.fft.fft(signal[i * f.hop : i * f.hop + f.window] * np.hanning(f.window + 1)[:-1], f.fft))[: f.fft // 2 + 1] ** 2 for i in range(frames)]
    return np.log(np.array(power) @ audio._mel(f).astype(float) + 1e-10)


def test_features_of_the_tables_equal_plain_ones(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 9 = 0")
    got = audio.audio_media(rows).collect()
    assert len(got) > 15
    for r in got:
        want = plain_features(audio.from_wav(bytes(r["media"]))[0])
        mel = audio.read_tensors(bytes(r["tensors"]))["mel"].combine_chunks().to_numpy_ndarray().reshape(-1, 32)[: len(want)]
        assert np.abs(mel - want).max() < 0.02, r["doc_id"]


def test_long_signals_in_parts(monkeypatch):
    media = audio.to_wav(np.random.default_rng(4).integers(0, 256, 576 * 40, dtype=np.uint8).tobytes(), 24_000)
    whole = audio.features_of(media, SETTINGS)
    monkeypatch.setattr(audio, "PART", 7)
    parts = audio.features_of(media, SETTINGS)
    assert np.abs(whole[0].astype(float) - parts[0]).max() < 0.02 and whole[1] == parts[1] and len(whole[2]) == len(parts[2])
