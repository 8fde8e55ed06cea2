"""Media columns: bytes as 8-bit audio, and features of it.

A text's bytes become the samples of a WAV file (8-bit, one channel). Features are computed from the stored file: polyphase
resampling, overlapped log-mel frames in tensors of one fixed shape with their time spans, and segments of high energy.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajkit.llm.common import lean

#: Frames that are computed together; memory grows with them and not with the signal.
PART = 1024
#: Payloads are filled up with this byte to a positive multiple of UNIT bytes.
FILL, UNIT = 255, 576
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


@dataclass(frozen=True)
class Features:
    """rate: of the samples; up / down: resampling ratio; taps: filter length at the source rate; frames by mels: a tensor's shape."""

    rate: int = 24_000
    up: int = 2
    down: int = 3
    taps: int = 48
    window: int = 400
    hop: int = 160
    fft: int = 512
    mels: int = 32
    frames: int = 16
    rise_db: float = -12.0
    fall_db: float = -18.0


def to_wav(payload: bytes, rate: int) -> bytes:
    return HEADER.pack(b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(payload, rate) of an 8-bit, one-channel WAV file."""
    riff, _, wave, _, _, kind, channels, rate, _, _, bits, _, size = HEADER.unpack_from(media)
    if (riff, wave, kind, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8):
        raise ValueError("not an 8-bit, one-channel WAV file")
    return media[HEADER.size : HEADER.size + size], rate


@lru_cache(maxsize=8)
def _filter(f: Features) -> np.ndarray:
    """A windowed-sinc low-pass filter, cut into its phases: (taps + down, up)."""
    half, width = f.taps // 2, f.taps + f.down
    at = np.arange(width)[:, None] - half + 1 - np.arange(f.up)[None, :] * f.down / f.up
    cut = min(1.0, f.up / f.down)
    return (cut * np.sinc(cut * at) * np.where(np.abs(at) < half, np.cos(np.pi * at / f.taps) ** 2, 0)).astype(np.float32)


@lru_cache(maxsize=8)
def _mel(f: Features) -> np.ndarray:
    """Triangular filters on the mel scale, (fft / 2 + 1, mels)."""
    rate = f.rate * f.up / f.down
    to_mel, to_hz = lambda hz: 2595 * np.log10(1 + hz / 700), lambda mel: 700 * (10 ** (mel / 2595) - 1)
    edges = to_hz(np.linspace(to_mel(20.0), to_mel(rate / 2), f.mels + 2))
    hz = np.arange(f.fft // 2 + 1)[:, None] * rate / f.fft
    return np.maximum(0, np.minimum((hz - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - hz) / (edges[2:] - edges[1:-1]))).astype(np.float32)


def resampled(samples: np.ndarray, f: Features, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Outputs start to stop of polyphase resampling by up / down: for every `down` samples, `up` outputs, each by its phase of the filter.

    samples are numbers, or bytes that stand for (byte - 128) / 128; before the first and after the last one is silence.
    start is a multiple of up. Only the samples that these outputs need are looked at.
    """
    phases = _filter(f)
    steps = -(-len(samples) // f.down)
    stop = steps * f.up if stop is None else min(stop, steps * f.up)
    first, last = start // f.up, -(-stop // f.up)
    if last <= first:
        return np.zeros(0, dtype=np.float32)
    low, high = first * f.down - f.taps // 2 + 1, (last - 1) * f.down - f.taps // 2 + 1 + len(phases)
    part = samples[max(0, low) : max(0, min(high, len(samples)))]
    padded = np.zeros(high - low, dtype=np.float32)
    padded[max(0, -low) : max(0, -low) + len(part)] = (part.astype(np.float32) - 128) / 128 if part.dtype == np.uint8 else part
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(phases))[:: f.down]
    return (np.ascontiguousarray(windows) @ phases).reshape(-1)[: stop - start]


def frame_count(length: int, f: Features) -> int:
    """Frames of a signal of so many outputs, the last one filled up."""
    return 1 + max(0, -(-(length - f.window) // f.hop))


def log_mel(signal: np.ndarray, f: Features) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) natural logs of mel energies, and the energy of each frame; the signal is filled up to a whole last frame."""
    count = frame_count(len(signal), f)
    filled = f.window + (count - 1) * f.hop
    if len(signal) < filled:
        signal = np.concatenate([signal, np.zeros(filled - len(signal), dtype=np.float32)])
    part = np.lib.stride_tricks.sliding_window_view(signal, f.window)[:: f.hop][:count] * np.hanning(f.window + 1)[:-1].astype(np.float32)
    spectrum = np.fft.rfft(part, f.fft, axis=1)
    power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
    return np.log(power @ _mel(f) + np.float32(1e-10)), (part * part).sum(axis=1)


def loud_segments(energy: np.ndarray, f: Features) -> list[tuple[int, int]]:
    """Frame ranges that begin at rise_db or more below the loudest frame and end under fall_db."""
    level = 10 * np.log10(energy / max(float(energy.max()), 1e-20) + 1e-12)
    events = np.where(level >= f.rise_db, 1, np.where(level < f.fall_db, -1, 0))
    last = np.maximum.accumulate(np.where(events != 0, np.arange(len(events)), -1))
    on = np.where(last >= 0, events[last], -1) == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features_of(media: bytes, f: Features) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Tensors (n, frames, mels) in half precision, their time spans, and the loud segments, in seconds."""
    payload, rate = from_wav(media)
    samples = np.frombuffer(payload, dtype=np.uint8)
    total = -(-len(samples) // f.down) * f.up
    frames = frame_count(total, f)
    count = -(-frames // f.frames)
    tensors, energy = np.zeros((count * f.frames, f.mels), dtype=np.float16), np.zeros(frames, dtype=np.float32)
    for a in range(0, frames, PART):
        b = min(frames, a + PART)
        start = a * f.hop // f.up * f.up
        signal = resampled(samples, f, start, min(total, (b - 1) * f.hop + f.window))[a * f.hop - start :]
        tensors[a:b], energy[a:b] = log_mel(signal, f)
    step = f.hop * f.down / f.up / rate
    length = f.window * f.down / f.up / rate
    span = lambda a, b: (round(a * step, 6), round((b - 1) * step + length, 6))
    spans = [span(k * f.frames, min(frames, (k + 1) * f.frames)) for k in range(count)]
    return tensors.reshape(count, f.frames, f.mels), spans, [span(a, b) for a, b in loud_segments(energy, f)]


@lru_cache(maxsize=8)
def _tensor_schema(f: Features) -> pa.Schema:
    return pa.schema([pa.field("mel", pa.fixed_shape_tensor(pa.float16(), (f.frames, f.mels))), pa.field("start", pa.float64()), pa.field("end", pa.float64())])


def stored_tensors(blocks: np.ndarray, spans: list[tuple[float, float]], f: Features) -> bytes:
    """An Arrow IPC stream of (mel, start, end): fixed-shape tensors, each with its time span."""
    schema = _tensor_schema(f)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(blocks.reshape(-1)), f.frames * f.mels)
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(schema.field("mel").type, flat), pa.array([a for a, _ in spans], pa.float64()), pa.array([b for _, b in spans], pa.float64())], schema=schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """What stored_tensors() wrote; column mel is an Arrow array of fixed-shape tensors."""
    return pa.ipc.open_stream(stored).read_all()


def audio_media(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", settings: Features = Features()) -> DataFrame:
    """doc_id, n_bytes, media, tensors, spans, segments of every row.

    media is the WAV file of the text's UTF-8 bytes, filled up with FILL to a positive multiple of UNIT; everything else is
    computed from the stored file, read back. tensors is an Arrow IPC stream of fixed-shape tensors, frames by mels in half
    precision, with their time spans (see read_tensors); spans has these again, segments the loud stretches. Equal texts give
    equal values, whatever stands beside them.

    Null and empty texts have no bytes, and a payload that is all filling. Very long texts are filtered and framed in parts
    of PART frames, so that beside the media itself and its tensors little more is held.
    Repeated rows give repeated results, a null id stays null, an empty table stays empty; other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    times = "array<struct<start:double,end:double>>"
    pairs = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                sizes, media, tensors, spans, segments, held, row = [], [], [], [], [], 0, start
                while row < batch.num_rows and held < 1 << 23:  # rows of about 8 MB go back together
                    data = (batch.column(1)[row].as_py() or "").encode("utf-8", "surrogatepass")
                    payload = data + bytes([FILL]) * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)
                    stored = to_wav(payload, settings.rate)
                    blocks, when, loud = features_of(stored, settings)
                    sizes.append(len(data)), media.append(stored), tensors.append(stored_tensors(blocks, when, settings))
                    spans.append([{"start": a, "end": b} for a, b in when]), segments.append([{"start": a, "end": b} for a, b in loud])
                    held += 2 * len(stored)
                    row += 1
                columns = [batch.column(0).slice(start, row - start), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(tensors, pa.binary()), pa.array(spans, pairs), pa.array(segments, pairs)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media", "tensors", "spans", "segments"])
                start = row

    return lean(docs).mapInArrow(encode, f"doc_id {kind}, n_bytes long, media binary, tensors binary, spans {times}, segments {times}")
