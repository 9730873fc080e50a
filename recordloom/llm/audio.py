"""Documents as 8-bit mono audio, and features of it.

``store`` writes each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as the samples of a WAV file
(8-bit PCM) in a binary column. ``features`` reads stored files: polyphase resampling by 2/3, overlapped Hann frames,
log-mel filterbank, and speech-like segments by hysteresis on frame energy (a segment opens above the upper and closes
below the lower threshold, both relative to the file's median). Log-mel frames are kept as one Arrow fixed-shape tensor
array of 16 x 32 patches (8-bit, steps of 0.75 decibels over the floor), as an IPC stream, with the time spans of segments.

Defined results: null or empty text is 192 spaces, hence silence without segments; repeated rows and equal texts give
equal values (each file is computed alone); an empty table gives no rows; other columns are ignored; very long files are
framed in blocks of fixed size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.core import materialize

RATE = 12_000
UP, DOWN, TAPS = 2, 3, 8
FRAME, HOP, MELS = 256, 128, 32
PATCH = 16
UNIT = 192
BLOCK = UNIT * 4096


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """RIFF header for 8-bit mono PCM, then the payload."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(payload), b"WAVE") + form + struct.pack("<4sI", b"data", len(payload)) + payload


def samples(media: bytes) -> memoryview:
    """The data chunk of a WAV file."""
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    return memoryview(media)[at + 8 : at + 8 + struct.unpack_from("<I", media, at + 4)[0]]


@cache
def _phases() -> list[np.ndarray]:
    """Windowed-sinc low-pass at the lower rate, split into UP phases of TAPS taps."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    h *= UP / h.sum()
    return [np.ascontiguousarray(h[p::UP][::-1].astype(np.float32)) for p in range(UP)]


def resample(x: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """y[m] = sum over taps of x around m * DOWN / UP: one phase of the filter for each residue of m * DOWN mod UP. before: the
    TAPS - 1 samples ahead of x, silence if there are none."""
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32) if before is None else before, x, np.zeros(DOWN, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    y = np.empty(n, np.float32)
    for k in range(UP):  # outputs k, k + UP, ... share a phase and step by DOWN inputs
        first, phase = divmod(k * DOWN, UP)
        own = y[k::UP]
        own[:] = views[first::DOWN][: len(own)] @ _phases()[phase]
    return y


@cache
def _mel_bank() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    rise = (bins[:, None] - points[:-2]) / (points[1:-1] - points[:-2])
    fall = (points[2:] - bins[:, None]) / (points[2:] - points[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, MELS) in decibels over -100; at least one frame."""
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)).astype(np.float32) ** 2
    return 10 * np.log10(power @ _mel_bank() + 1e-10) + 100


def segments(energy: np.ndarray, up: float = 3.0, down: float = -1.0) -> np.ndarray:
    """(n, 2) frame ranges [first, stop): open where energy >= median + up, close where it is < median + down."""
    middle = np.median(energy)
    state = np.where(energy >= middle + up, 1, np.where(energy < middle + down, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), 0))
    on = np.concatenate([[0], np.where(state[last] == 1, 1, 0), [0]])
    step = np.diff(on)
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1)


def analyse(media: bytes) -> dict:
    data = samples(media)
    sound = lambda a, z: (np.frombuffer(data[a:z], np.uint8).astype(np.float32) - 128) / 128
    total = max(1, (-(-len(data) * UP // DOWN) - FRAME) // HOP + 1)  # frames of the whole file, wherever blocks end
    keep, parts = BLOCK * UP // DOWN // HOP, []
    for first in range(0, total, keep):  # blocks overlap by what a frame and the filter need, so that memory is bounded
        i = first // keep * BLOCK
        before = sound(i - TAPS + 1, i) if i else None
        parts.append(log_mel(resample(sound(i, i + BLOCK + FRAME * 2), before))[: min(keep, total - first)])
    mel = np.concatenate(parts)
    energy = mel.mean(axis=1)
    spans = segments(energy)
    small = np.clip(np.round(mel * 4 / 3), 0, 255).astype(np.uint8)
    padded = np.zeros((-(-len(small) // PATCH) * PATCH, MELS), np.uint8)
    padded[: len(small)] = small
    second = HOP / (RATE * UP / DOWN)
    digest = bytes(np.round(mel.mean(axis=0)).astype(np.uint8)).hex()
    return {
        "n_frames": len(mel),
        "spans": [{"begin_s": float(a * second), "end_s": float(b * second)} for a, b in spans],
        "patches": padded.reshape(-1, PATCH * MELS),
        "feature": f"{digest}:{len(mel)}:{len(spans)}:{int((spans[:, 1] - spans[:, 0]).sum())}",
    }


def tensor_ipc(patches: np.ndarray) -> bytes:
    """Patches as an Arrow fixed-shape tensor array in an IPC stream."""
    kind = pa.fixed_shape_tensor(pa.uint8(), [PATCH, MELS])
    array = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(patches.ravel()), PATCH * MELS))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([pa.field("log_mel", kind)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([array], names=["log_mel"]))
    return sink.getvalue().to_pybytes()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the table of WAV files, as read back from the shared folder."""
    def stored(batches):
        for batch in batches:
            raw = [(t.as_py() or "").encode("utf-8", "replace") for t in batch["text"]]
            media = [wav(b.ljust(max(UNIT, -(-len(b) // UNIT) * UNIT))) for b in raw]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(stored, "doc_id long, n_bytes long, media binary"), "media")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, spans array<struct<begin_s: double, end_s: double>>, log_mel binary"


def features(media: DataFrame) -> DataFrame:
    """Digests, feature, time spans and the tensor of every stored file."""
    def computed(batches):
        for batch in batches:
            rows = []
            for doc, n, file in zip(batch["doc_id"], batch["n_bytes"], batch["media"], strict=True):
                file = file.as_py()
                data, found = samples(file), analyse(file)
                rows.append({
                    "doc_id": doc.as_py(), "n_bytes": n.as_py(), "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-16:]),
                    "media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest(), "feature": found["feature"], "n_frames": found["n_frames"], "spans": found["spans"], "log_mel": tensor_ipc(found["patches"]),
                })
            schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()), ("spans", pa.list_(pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())]))), ("log_mel", pa.binary())])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return media.mapInArrow(computed, FEATURES)
