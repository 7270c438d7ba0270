"""Media columns: audio stored as 8-bit WAV, and features of it.

Method: samples are resampled by a polyphase filter, cut into overlapped
frames, and turned into log-mel energies; segments start where the frame
energy rises above a high mark and end where it falls below a low one.
``tensors`` gives fixed-shape Arrow tensors with their time spans and those of
the segments; ``audio_features`` stores them, as plain lists since Spark has no
tensor type, and ``media_columns`` describes them.

A text serves as payload: its UTF-8 bytes, padded by spaces to a positive
multiple of 192, are the samples.  Defined results: a null or empty text is
192 spaces; equal texts have equal values; a very long text is one row, whose
samples and tensors a task holds; an empty table gives an empty one; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import texts
from .textbytes import texts_of

RATE, LOW_RATE = 16_000, 8_000
BLOCK = 192
FRAME, HOP, MELS = 256, 128, 24
#: Frames of one tensor.
SHAPE = 32
#: Segments start and end at these parts of the way from the quiet to the loud tenth of frames, if those are RANGE_DB apart.
HIGH, LOW, RANGE_DB = 0.6, 0.4, 3.0
_HEADER = "<4sI4s4sIHHIIHH4sI"


def stored(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit mono samples."""
    pad = len(payload) % 2
    return struct.pack(_HEADER, b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def read_back(media: bytes) -> bytes:
    """The samples of such a file."""
    riff, _, wave, fmt, _, kind, channels, _, _, _, bits, data, n = struct.unpack_from(_HEADER, media)
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8):
        raise ValueError("not an 8-bit mono WAV file")
    at = struct.calcsize(_HEADER)
    return media[at : at + n]


def resampled(x: np.ndarray, up: int = 1, down: int = RATE // LOW_RATE, taps: int = 16) -> np.ndarray:
    """Polyphase resampling by up / down: only the samples that stay are computed."""
    half = taps * max(up, down) // 2
    k = np.arange(-half, half + 1)
    h = np.sinc(k / max(up, down)) * np.hamming(len(k))
    h = (h / h.sum() * up).astype(np.float32)
    n = -(-len(x) * up // down)
    at = np.arange(n) * down
    out = np.zeros(n, np.float32)
    for phase in range(up):
        pick = np.flatnonzero((at + half) % up == phase)
        own = h[phase::up]
        last = (at[pick] + half) // up
        padded = np.concatenate((np.zeros(len(own), np.float32), x, np.zeros(len(own) + 1, np.float32)))
        if up == 1:
            start = len(own) + half - np.arange(len(own))
            stop = start + down * (len(pick) - 1) + 1
            for tap, a, z in zip(own, start, stop, strict=True):
                out += tap * padded[a:z:down]
        else:
            for j, tap in enumerate(own):
                out[pick] += tap * padded[np.minimum(last - j + len(own), len(padded) - 1)]
    return out


def _mel_filters() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(0, mel(LOW_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * LOW_RATE / FRAME
    return np.maximum(0, np.minimum((f[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f[:, None]) / (edge[2:] - edge[1:-1]))).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Log-mel energies of overlapped frames, in dB; the last frame is padded."""
    frames = max(1, -(-max(len(x) - FRAME, 0) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[: len(x)] = x
    window, filters = np.hanning(FRAME).astype(np.float32), _mel_filters()
    out = np.empty((frames, MELS), np.float32)
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    for i in range(0, frames, 512):
        power = np.abs(np.fft.rfft(view[i : i + 512] * window)) ** 2
        out[i : i + 512] = 10 * np.log10(power @ filters + 1e-6)
    return out


def segments(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Frame spans: from a rise to ``high`` or more until a fall below ``low``."""
    state = np.where(energy >= high, 1, np.where(energy < low, -1, 0))
    at = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), 0))
    d = np.diff(np.concatenate(([0], (state[at] == 1).astype(np.int8), [0])))
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True))


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resampled(x))
    energy = mel.mean(axis=1)
    quiet, loud = (float(v) for v in np.percentile(energy, [10, 90]))
    if loud - quiet < RANGE_DB:
        return mel, []
    return mel, segments(energy, quiet + HIGH * (loud - quiet), quiet + LOW * (loud - quiet))


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % BLOCK or (0 if text else BLOCK))


#: The time spans of segments, in seconds.
SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def tensors(samples: bytes) -> pa.RecordBatch:
    """Fixed-shape tensors of log-mel frames with start and end in seconds, their frames, and the segments that start in them; the last is padded by its floor."""
    mel, spans = features(samples)
    n = -(-len(mel) // SHAPE)
    full = np.full((n * SHAPE, MELS), np.float32(-60))
    full[: len(mel)] = mel
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, SHAPE, MELS))
    first = np.arange(n) * SHAPE
    start = first * HOP / LOW_RATE
    own: list[list] = [[] for _ in range(n)]
    for a, z in spans:
        own[a // SHAPE].append({"start_s": a * HOP / LOW_RATE, "end_s": z * HOP / LOW_RATE})
    return pa.RecordBatch.from_arrays(
        [column, pa.array(start), pa.array(np.minimum(start + SHAPE * HOP / LOW_RATE, len(samples) / RATE)), pa.array(np.minimum(len(mel) - first, SHAPE).astype(np.int32)), pa.array(own, SPANS)],
        ["log_mel", "start_s", "end_s", "frames", "segments"],
    )


def _stored(batches):
    for b in batches:
        for t in texts_of(b.column("text")):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(t.first, len(t)), pa.array(np.diff(t.off)), pa.array([stored(payload_of(t.bytes(i))) for i in range(len(t))], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )


def as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media file of each row."""
    return texts(docs).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _tensor_rows(batches):
    for b in batches:
        for doc_id, media in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
            t = tensors(read_back(media))
            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(t), pa.int64()), pa.array(np.arange(len(t), dtype=np.int32)), t.column(0).storage.cast(pa.list_(pa.float32())), *t.columns[1:]], ["doc_id", "part", *t.schema.names])


def audio_features(media: DataFrame) -> DataFrame:
    """One row a tensor (SHAPE x MELS values, row-major) with its time span, its frames and the time spans of segments that start in it."""
    return media.mapInArrow(_tensor_rows, "doc_id long, part int, log_mel array<float>, start_s double, end_s double, frames int, segments array<struct<start_s: double, end_s: double>>")


def described(t: pa.RecordBatch) -> str:
    """The feature string of a document's tensors."""
    mel = t.column("log_mel").to_numpy_ndarray().reshape(-1, MELS)[: sum(t.column("frames").to_pylist())]
    spans = [x for own in t.column("segments").to_pylist() for x in own]
    voiced = sum(round(x["end_s"] * LOW_RATE / HOP) - round(x["start_s"] * LOW_RATE / HOP) for x in spans)
    mean, dev = mel.mean(axis=0, dtype=np.float64), mel.std(axis=0, dtype=np.float64)
    return f"frames={len(mel)};segments={len(spans)};voiced={voiced};mean=" + ",".join(f"{v:.1f}" for v in mean) + ";dev=" + ",".join(f"{v:.1f}" for v in dev)


def _described(batches):
    for b in batches:
        rows = []
        for media in b.column("media").to_pylist():
            payload = read_back(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), described(tensors(payload))))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_columns(docs: DataFrame) -> DataFrame:
    return as_media(docs).mapInArrow(_described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
