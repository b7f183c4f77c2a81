"""Media columns: audio features of 8-bit samples.

A payload is stored without loss as 8-bit PCM in a WAV container and read back from those bytes. The samples are resampled by a
polyphase filter, cut into overlapping frames and turned into log-mel energies, which fill tensors of one fixed shape with the
time each of them spans; frame energy with two thresholds (hysteresis) gives the active stretches. Each row is worked on by
itself and in blocks of a fixed size, so equal payloads have equal features to the last bit and memory doesn't grow with a row.

Defined results: null text counts as empty; an empty payload is 64 zero bytes; ids are handed through (null or repeated too); other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

RATE_IN, RATE_OUT = 16_000, 10_000
UP, DOWN, TAPS = 5, 8, 16  #: of the polyphase filter; taps for each phase
FRAME, HOP, BANDS = 256, 160, 20
CLIP = 64  #: frames in a tensor
ON_DB, OFF_DB = 6.0, 3.0  #: above the quiet tenth of a row's frames
BLOCK = 8192


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM, lossless."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE_IN, RATE_IN, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples in the container's data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def phases() -> np.ndarray:
    """A windowed sinc low-pass, dealt out to the UP phases; each row is applied to TAPS samples in order."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) * np.hamming(n) / DOWN * UP
    return np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1], dtype=np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS, np.float32), x, np.zeros(DOWN + TAPS, np.float32)])
    rows = -(-n // UP)
    out = np.zeros((rows, UP), np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    for phase, taps in enumerate(phases()[(np.arange(UP) * DOWN) % UP]):
        first = phase * DOWN // UP + 1
        for at in range(0, rows, BLOCK):
            part = windows[first + at * DOWN : first + min(at + BLOCK, rows) * DOWN : DOWN]
            out[at : at + len(part), phase] = part @ taps
    return out.ravel()[:n]


@cache
def mel_filters() -> np.ndarray:
    """Triangles evenly spread on the mel scale."""
    mel = np.linspace(0, 2595 * np.log10(1 + RATE_OUT / 2 / 700), BANDS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / RATE_OUT)
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """In dB, one row per frame; the last frame is filled up with silence."""
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    padded = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    parts = []
    for at in range(0, n, BLOCK):
        power = np.abs(np.fft.rfft(frames[at : min(at + BLOCK, n)] * window)).astype(np.float32) ** 2
        parts.append(10 * np.log10(power @ mel_filters() + np.float32(1e-6)))
    return np.concatenate(parts)


def active(energy: np.ndarray) -> np.ndarray:
    """First frame and frame after the last of each stretch that rises above one threshold, until it falls below the other."""
    floor = np.sort(energy)[len(energy) // 10]
    state = np.where(energy >= floor + ON_DB, 1, np.where(energy < floor + OFF_DB, 0, -1))
    known = np.where(state >= 0, np.arange(len(state)), -1)
    last = np.maximum.accumulate(known)
    on = np.where(last >= 0, state[last], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return edges.reshape(-1, 2)


def features(samples: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tensors (clip, CLIP, BANDS), their spans in seconds, and the active stretches in seconds."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = np.round(log_mel(resample(x)), 2)
    clips = -(-len(mel) // CLIP)
    tensors = np.full((clips * CLIP, BANDS), -60, np.float32)
    tensors[: len(mel)] = mel
    step = HOP / RATE_OUT
    starts = np.arange(clips) * CLIP * step
    spans = np.stack([starts, np.minimum(starts + CLIP * step, len(samples) / RATE_IN)], 1)
    return tensors.reshape(clips, CLIP, BANDS), spans, active(mel.mean(1)) * step


def tensor_table(tensors: np.ndarray, spans: np.ndarray) -> bytes:
    """An Arrow IPC stream: fixed-shape tensors with their time spans."""
    table = pa.table({"tensor": pa.FixedShapeTensorArray.from_numpy_ndarray(tensors), "start_s": spans[:, 0], "end_s": spans[:, 1]})
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue()


def read_tensors(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tensors and spans from the stream."""
    table = pa.ipc.open_stream(stored).read_all().combine_chunks()
    return table.column("tensor").chunk(0).to_numpy_ndarray(), np.stack([table.column(c).to_numpy() for c in ("start_s", "end_s")], 1)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MEDIA = ", media binary, tensors binary, active array<struct<start_s: double, end_s: double>>"


def audio_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """One row per row of ``docs``: sizes and digests; if asked for, the container, the tensors (Arrow IPC) and the active stretches."""
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary(), pa.binary(), span] * with_media
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["media", "tensors", "active"] * with_media

    def run(batches):
        for batch in K.slices(batches):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), K.texts(batch), strict=True):
                raw = text.as_buffer().to_pybytes()
                media = to_wav(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
                samples = from_wav(media)
                tensors, spans, stretches = features(samples)
                stored = tensor_table(tensors, spans)
                tensors, spans = read_tensors(stored)  # the feature tells of what is stored
                feature = f"{len(tensors)}x{CLIP}x{BANDS};active={len(stretches)};active_s={float((stretches[:, 1] - stretches[:, 0]).sum()):.3f};crc={zlib.crc32(tensors.tobytes()):08x}"
                row = (doc, len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                out.append((*row, media, stored, [{"start_s": a, "end_s": b} for a, b in stretches.tolist()]) if with_media else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return wanted.mapInArrow(K.trimmed(run), SCHEMA + MEDIA * with_media)
