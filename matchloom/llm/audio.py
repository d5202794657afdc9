"""Audio features of media payloads: polyphase resampling, overlapped log-mel filterbanks, hysteresis segmentation.

A payload is stored losslessly as an 8-bit mono WAV file; features are computed from the bytes read back from it, in
blocks, so that working memory does not grow with the recording. The log-mel frames are kept as an Arrow array of
fixed-shape tensors (PATCH frames by MELS bands, float16, the last one padded with SILENCE), each with its time span.

Defined results: a null or empty text has 0 bytes and a payload of PAD zero bytes; equal texts give equal values; a
null doc_id stays null; repeated rows give equal rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 8000  # samples a second of a stored payload
UP, DOWN = 2, 3  # resampled to RATE * UP / DOWN
TAPS = 24  # filter taps a phase
FRAME, HOP, MELS = 256, 128, 32  # samples of a frame, samples between frames, bands
PATCH = 64  # frames of a tensor
PAD = 64  # payloads are padded to a multiple of so many bytes
BLOCK = 1 << 15  # frames worked on at once
SILENCE = -10.0  # log10 energy of nothing
ON_DB, OFF_DB = 1.5, 0.5  # a segment begins that far over the recording's mean energy and ends below the second


def to_wav(payload: bytes) -> bytes:
    """The stored form: RIFF WAVE, mono, 8-bit unsigned."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> tuple[bytes, int]:
    """Samples and rate of a stored form."""
    with wave.open(io.BytesIO(stored), "rb") as f:
        return f.readframes(f.getnframes()), f.getframerate()


def polyphase_filter() -> np.ndarray:
    """Taps by phase, (UP, TAPS): a windowed sinc that cuts at the lower of both Nyquist frequencies."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = cut * np.sinc(cut * t) * np.hamming(n)
    return (UP * h / h.sum()).reshape(TAPS, UP).T


def resample(x: np.ndarray, first: int, last: int, taps: np.ndarray) -> np.ndarray:
    """Output samples first..last-1 of x resampled by UP / DOWN; x is silent outside its ends."""
    at = np.arange(first, last) * DOWN
    low, high = first * DOWN // UP - TAPS + 1, ((last - 1) * DOWN) // UP + 1
    part = np.zeros(high - low)
    a, b = max(0, low), min(len(x), high)
    if b > a:
        part[a - low : b - low] = (x[a:b].astype(np.float64) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(part, TAPS)[:, ::-1]
    out = np.empty(last - first)
    for phase in range(UP):
        own = np.flatnonzero(at % UP == phase)
        if len(own):
            start, step = at[own[0]] // UP - TAPS + 1 - low, DOWN
            out[own] = windows[start :: step][: len(own)] @ taps[phase]
    return out


def mel_bank(rate: float) -> np.ndarray:
    """Triangular filters, (FRAME // 2 + 1, MELS)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    return np.clip(np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])), 0, None)


def log_mel(samples: bytes, rate: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-mel frames (n, MELS) as float16, each frame's energy in dB, and seconds between frames."""
    x = np.frombuffer(samples, np.uint8)
    length = len(x) * UP // DOWN
    frames = max(1, 1 + -(-(length - FRAME) // HOP))
    taps, window = polyphase_filter(), np.hanning(FRAME)
    bank = mel_bank(rate * UP / DOWN)
    mels, energy = np.empty((frames, MELS), np.float16), np.empty(frames)
    for first in range(0, frames, BLOCK):
        last = min(frames, first + BLOCK)
        y = resample(x, first * HOP, (last - 1) * HOP + FRAME, taps)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * window
        power = np.abs(np.fft.rfft(cut, axis=1)) ** 2 / FRAME
        mels[first:last] = np.log10(power @ bank + 10**SILENCE)
        energy[first:last] = 10 * np.log10(power.sum(1) + 10**SILENCE)
    return mels, energy, HOP * DOWN / (UP * rate)


def segments(energy: np.ndarray, on_db: float = ON_DB, off_db: float = OFF_DB) -> list[tuple[int, int]]:
    """Active runs of frames (end exclusive): begun at on_db over the mean, kept up to the first frame below off_db."""
    over = energy - energy.mean()
    state = np.where(over >= on_db, 1, np.where(over < off_db, -1, 0))
    known = np.flatnonzero(state)
    filled = np.zeros(len(state), bool)
    if len(known):
        last = np.searchsorted(known, np.arange(len(state)), side="right") - 1
        filled = (last >= 0) & (state[known[np.maximum(last, 0)]] > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], filled.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float16(), (PATCH, MELS), dim_names=("frame", "mel"))


def pack_tensors(mels: np.ndarray, step: float) -> bytes:
    """Arrow IPC stream of fixed-shape tensors with the time span of each in milliseconds."""
    n = -(-len(mels) // PATCH)
    full = np.full((n * PATCH, MELS), SILENCE, np.float16)
    full[: len(mels)] = mels
    tensors = pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), PATCH * MELS))
    begin = np.arange(n) * PATCH
    spans = [pa.array((np.round(x * step * 1000)).astype(np.int64)) for x in (begin, np.minimum(begin + PATCH, len(mels)))]
    batch = pa.record_batch([tensors, *spans], names=["log_mel", "start_ms", "end_ms"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as f:
        f.write_batch(batch)
    return out.getvalue()


def unpack_tensors(packed: bytes) -> tuple[np.ndarray, list[int], list[int]]:
    """(n, PATCH, MELS) and the time spans of what pack_tensors wrote."""
    batch = next(iter(pa.ipc.open_stream(packed)))
    flat = batch.column(0).storage.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, PATCH, MELS), batch.column(1).to_pylist(), batch.column(2).to_pylist()


OUT = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string,"
    " n_frames long, tensors binary, segments array<struct<start_ms:long,end_ms:long>>"
)


def audio_features(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Stores each text (UTF-8 bytes, padded by 1 to PAD zero bytes to a multiple of PAD) as WAV and computes features.

    Returns doc_id and OUT; with keep_media also media, the stored bytes. A batch is worked through row by row.
    """

    def one(text: str | None) -> dict:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % PAD or (0 if raw else PAD))
        stored = to_wav(payload)
        back, rate = from_wav(stored)
        mels, energy, step = log_mel(back, rate)
        ms = lambda k: round(k * step * 1000)
        row = {
            "n_bytes": len(raw), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]),
            "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "n_frames": len(mels), "tensors": pack_tensors(mels, step),
            "segments": [{"start_ms": ms(a), "end_ms": ms(b)} for a, b in segments(energy)],
        }
        return row | ({"media": stored} if keep_media else {})

    span = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
    kinds = dict(n_bytes=pa.int64(), payload_bytes=pa.int64(), payload_sha256=pa.string(), tail_crc32=pa.int64(), media_bytes=pa.int64(), media_sha256=pa.string(), n_frames=pa.int64(), tensors=pa.binary(), segments=span)
    if keep_media:
        kinds["media"] = pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = [one(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in kinds.items())], names=["doc_id", *kinds])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {OUT}" + ", media binary" * keep_media)


def digests(features: DataFrame) -> DataFrame:
    """One line a document: features as a string of frames, tensor digest and active spans."""
    spans = F.array_join(F.transform("segments", lambda s: F.concat_ws("-", s["start_ms"], s["end_ms"])), ",")
    return features.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(";", "n_frames", F.sha2("tensors", 256), spans).alias("feature"),
    )
