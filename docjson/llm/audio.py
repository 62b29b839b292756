"""Audio columns: sample storage, resampling, log-mel tensors and speech spans."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stored rate; the features' rate is ``RATE * UP / DOWN``.
RATE, UP, DOWN = 12_000, 2, 3
#: Frame, step and transform in samples at the features' rate; bands of the filterbank; frames in a tensor.
FRAME, STEP, FFT, BANDS, TENSOR = 200, 80, 256, 20, 64
#: A segment opens this many decibels over the quiet level of its text and closes at the lower one.
OPEN_DB, CLOSE_DB = 6.0, 3.0
#: Samples that are resampled at a time.
BLOCK = 1 << 19


def store_wave(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono samples as a RIFF/WAVE file."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(form) + len(data)) + b"WAVE" + form + data


def read_wave(media: bytes) -> bytes:
    """The samples of a RIFF/WAVE file, whatever chunks it has."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def _phases(up: int, down: int, zeros: int = 8) -> np.ndarray:
    """A Hann-windowed low-pass filter, one row of taps per phase."""
    half = zeros * max(up, down)
    n = np.arange(-half, half + 1)
    h = np.sinc(n / max(up, down)) * (0.5 + 0.5 * np.cos(np.pi * n / (half + 1)))
    h *= up / h.sum()
    taps = -(-len(h) // up)
    return np.pad(h, (0, taps * up - len(h))).reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase rate conversion by ``up/down`` in lowest terms: only the taps that meet samples are multiplied, and only for outputs that are kept."""
    phases = _phases(up, down)
    taps = phases.shape[1]
    delay = (taps * up - 1) // 2
    n_out = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps, np.float32), x.astype(np.float32), np.zeros(taps + delay // up + 2, np.float32)])
    out = np.empty(n_out, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    for at in range(0, n_out, BLOCK):
        m = np.arange(at, min(at + BLOCK, n_out)) * down + delay
        base, phase = m // up, m % up
        for p in range(up):
            mine = phase == p
            if mine.any():
                first = base[mine] - taps + 1 + taps
                # Outputs of one phase lie ``up`` apart, so their windows lie ``down`` apart.
                out[at : at + len(m)][mine] = windows[first[0] : first[-1] + 1 : down] @ phases[p][::-1]
    return out


@lru_cache
def _filterbank(rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    rise = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


def log_mel(y: np.ndarray, rate: int = RATE * UP // DOWN) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies in decibels and the energy of each overlapped frame; a short signal is one frame."""
    if len(y) < FRAME:
        y = np.pad(y, (0, FRAME - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::STEP]
    window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
    bank, mels, energy = _filterbank(rate), np.empty((len(frames), BANDS), np.float32), np.empty(len(frames), np.float32)
    for at in range(0, len(frames), 4096):
        part = frames[at : at + 4096] * window
        power = np.abs(np.fft.rfft(part, FFT, axis=1)).astype(np.float32) ** 2
        mels[at : at + len(part)] = 10 * np.log10(power @ bank + 1e-6)
        energy[at : at + len(part)] = 10 * np.log10((part**2).mean(1) + 1e-8)
    return mels, energy


def active_spans(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames, end exclusive, that rise over the opening level and have not fallen under the closing one."""
    quiet = float(np.percentile(energy, 20))
    strong, weak = energy >= quiet + OPEN_DB, energy >= quiet + CLOSE_DB
    edge = np.flatnonzero(np.diff(np.concatenate([[False], weak, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if strong[a:b].any()]


def tensor_batch(mels: np.ndarray, rate: int = RATE * UP // DOWN) -> bytes:
    """Frames as an Arrow stream of fixed-shape tensors, each with the span of time it covers; the last one is padded."""
    n = -(-len(mels) // TENSOR)
    padded = np.full((n * TENSOR, BANDS), -60.0, np.float16)
    padded[: len(mels)] = mels
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(padded.reshape(n, TENSOR, BANDS))
    starts = np.arange(n) * TENSOR * STEP / rate
    ends = (np.minimum((np.arange(n) + 1) * TENSOR, len(mels)) * STEP + FRAME - STEP) / rate
    batch = pa.record_batch([tensors, pa.array(starts), pa.array(ends)], names=["log_mel", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, zero-filled to a positive multiple of 64, and their number before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0)), len(raw)


_OUT = "doc_id long, n_bytes long, media binary, tensors binary, spans array<struct<start_s:double,end_s:double>>, n_frames long, profile array<int>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rate = RATE * UP // DOWN
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.int64(), pa.list_(pa.int32())]
    names = ["doc_id", "n_bytes", "media", "tensors", "spans", "n_frames", "profile"]
    for batch in batches:
        rows, held = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            payload, n = payload_of(text)
            media = store_wave(payload)
            x = (np.frombuffer(read_wave(media), np.uint8).astype(np.float32) - 128) / 128
            mels, energy = log_mel(resample(x), rate)
            spans = [{"start_s": a * STEP / rate, "end_s": ((b - 1) * STEP + FRAME) / rate} for a, b in active_spans(energy)]
            rows.append((doc_id, n, media, tensor_batch(mels, rate), spans, len(mels), np.rint(mels.mean(0)).astype(int).tolist()))
            held += len(media)
            if held > 8 << 20:
                yield _batch(rows, kinds, names)
                rows, held = [], 0
        yield _batch(rows, kinds, names)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def text_audio(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media, tensors, spans, n_frames, profile`` for every row of ``docs``.

    The text's bytes, zero-filled to a multiple of 64, are the 8-bit samples of a WAVE file (``media``). What is read back
    from it is resampled by a polyphase filter, cut into overlapped frames, and described by log-mel energies, stored as
    fixed-shape Arrow tensors with their spans of time (``tensors``; :func:`read_tensors`), by the active ``spans`` that
    hysteresis on frame energy finds, and by the mean of each band in whole decibels (``profile``).

    Defined cases: null and empty texts are 64 zero samples. A null ``doc_id`` stays null. Repeated rows get equal values. A
    short signal is one frame. Long texts are resampled and transformed in blocks. An empty table gives an empty
    result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_features, _OUT)


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(audio: DataFrame) -> DataFrame:
    """Fixed-size digests of what :func:`text_audio` stored, read back from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _DIGEST.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _DIGEST.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                payload = read_wave(r["media"])
                spans = ";".join(f"{s['start_s']:.2f}-{s['end_s']:.2f}" for s in r["spans"])
                feature = f"frames={r['n_frames']} tensors={read_tensors(r['tensors']).num_rows} mel={','.join(map(str, r['profile']))} spans={len(r['spans'])}:{hashlib.md5(spans.encode()).hexdigest()[:12]}"
                rows.append((r["doc_id"], r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(r["media"]), hashlib.sha256(r["media"]).hexdigest(), feature))
            yield _batch(rows, kinds, names)

    return audio.mapInArrow(run, _DIGEST)
