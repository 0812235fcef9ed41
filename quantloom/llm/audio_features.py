"""Media columns: audio features of 8-bit samples, stored as fixed-shape Arrow tensors with time spans.

A media value is a WAV file (PCM, mono, unsigned 8 bit). Its samples are resampled by a polyphase filter from
``SOURCE_RATE`` to ``TARGET_RATE``, cut into overlapped Hann windows, and turned into log-mel energies. Energy
segmentation uses two thresholds: a segment opens at the upper one and lasts until the level falls below the lower.
Chunks of ``CHUNK`` frames (the last one padded) become a fixed-shape tensor column beside their time spans, one Arrow
IPC stream a row.

``stored_media`` writes the media column as Parquet in the shared folder and reads it back; ``audio_features`` makes the
feature columns from what is stored, and ``digests_of`` describes both. Media are resampled and framed in blocks of
``BLOCK_FRAMES`` frames: beside the media value itself and its features (a third of its size) only one block is held
as numbers, whatever the length.

Edge cases: null text counts as empty; an empty value is padded to one unit of 192 blanks and has one chunk; equal
payloads give equal values; a very long text is one value, in a batch of its own; an empty table gives no row. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

UNIT, PAD = 192, b" "
SOURCE_RATE, TARGET_RATE = 48_000, 16_000
WINDOW, HOP, FFT, MELS, CHUNK = 400, 160, 512, 40, 64
#: Hysteresis: a segment opens this much above the quietest level, in shares of the range, and closes below the second.
OPEN_AT, CLOSE_AT = 0.6, 0.4
BLOCK_FRAMES = 4096


def to_wav(samples: bytes, rate: int = SOURCE_RATE) -> bytes:
    """A canonical WAV file: 44 bytes of header, then one unsigned byte a sample."""
    odd = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of such a file, found by its chunk headers."""
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@functools.cache
def _phases(up: int, down: int) -> np.ndarray:
    return polyphase_filter(up, down)


def polyphase_filter(up: int, down: int, taps_each: int = 16) -> np.ndarray:
    """Hann-windowed sinc, cut at the lower Nyquist rate, as one row of taps for each of the ``up`` phases."""
    n = 2 * taps_each * max(up, down) + 1
    n += -n % up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hanning(n)
    return (h / h.sum() * up).astype(np.float32).reshape(-1, up).T[:, ::-1].copy()


def resample(samples: np.ndarray, up: int, down: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """Outputs first, first + 1, ... of samples, 8-bit or in [-1, 1], at rate times up / down; silence before and after.

    Output k uses phase (k * down) mod up of the filter at input (k * down) div up, so a part equals that of the whole.
    """
    phases = _phases(up, down)
    taps = phases.shape[1]
    count = -(-len(samples) * up // down) - first if count is None else count
    base = first * down // up - taps // 2  # first input that the part uses
    last = (first + count - 1) * down // up - taps // 2 + taps
    x = np.zeros(last - base, np.float32)
    a, b = max(base, 0), min(last, len(samples))
    if b > a:
        x[a - base : b - base] = (samples[a:b].astype(np.float32) - 128) / 128 if samples.dtype == np.uint8 else samples[a:b]
    out = np.empty(count, np.float32)
    for k in range(min(up, count)):
        # Outputs k, k + up, ... share a phase and step through the input by ``down``.
        place, phase = divmod((first + k) * down, up)
        many = len(range(k, count, up))
        span = np.lib.stride_tricks.as_strided(x[place - taps // 2 - base :], (many, taps), (x.strides[0] * down, x.strides[0]))
        out[k::up] = span @ phases[phase]
    return out


def mel_filters() -> np.ndarray:
    """FFT bins x MELS triangles, equally spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(TARGET_RATE / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * TARGET_RATE / FFT
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    rise, fall = (bins[:, None] - low) / (mid - low), (high - bins[:, None]) / (high - mid)
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_HANN, _MEL = np.hanning(WINDOW).astype(np.float32), mel_filters()


def log_mel(samples: np.ndarray, rate: int) -> np.ndarray:
    """frames x MELS log energies of 8-bit samples; at least one frame, the last padded with silence."""
    step = int(np.gcd(rate, TARGET_RATE))
    up, down = TARGET_RATE // step, rate // step
    length = -(-len(samples) * up // down)
    frames = max(1, -(-(length - WINDOW) // HOP) + 1)
    out = np.empty((frames, MELS), np.float32)
    for at in range(0, frames, BLOCK_FRAMES):
        many = min(BLOCK_FRAMES, frames - at)
        x = np.zeros((many - 1) * HOP + WINDOW, np.float32)
        have = min(len(x), length - at * HOP)
        if have > 0:
            x[:have] = resample(samples, up, down, at * HOP, have)
        view = np.lib.stride_tricks.as_strided(x, (many, WINDOW), (x.strides[0] * HOP, x.strides[0]))
        spectrum = np.fft.rfft(view * _HANN, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[at : at + many] = np.log(power @ _MEL + np.float32(1e-6))
    return out


def segments(level: np.ndarray) -> np.ndarray:
    """(first, end) frames of segments: opened at the upper threshold, closed below the lower one."""
    low, high = float(level.min()), float(level.max())
    if high - low < 1e-6:
        return np.zeros((0, 2), np.int64)
    above, below = level >= low + OPEN_AT * (high - low), level < low + CLOSE_AT * (high - low)
    event = np.where(above, 1, np.where(below, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.where(last >= 0, event[last], -1) == 1
    edge = np.flatnonzero(np.diff(np.concatenate(([False], on, [False])).astype(np.int8)))
    return edge.reshape(-1, 2)


def features(media: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks x CHUNK x MELS tensor, chunks x 2 spans in seconds, segments x 2 in seconds) of a WAV file."""
    samples, rate = from_wav(media)
    mel = log_mel(np.frombuffer(samples, np.uint8), rate)
    found = segments(mel.mean(1))
    frames = len(mel)
    chunks = -(-frames // CHUNK)
    tensor = np.full((chunks * CHUNK, MELS), np.log(np.float32(1e-6)), np.float32)
    tensor[:frames] = mel
    first = np.arange(chunks) * CHUNK
    ends = np.minimum(first + CHUNK, frames) - 1
    spans = np.stack((first * HOP, ends * HOP + WINDOW), 1) / TARGET_RATE
    return tensor.reshape(chunks, CHUNK, MELS), spans, found * HOP / TARGET_RATE


def to_tensors(tensor: np.ndarray, spans: np.ndarray) -> bytes:
    """One Arrow IPC stream: a fixed-shape tensor column and its time spans."""
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensor))
    batch = pa.record_batch([column, pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["log_mel", "start_s", "end_s"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue()


def from_tensors(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return table.column("log_mel").chunk(0).to_numpy_ndarray(), np.stack((table.column("start_s").to_numpy(), table.column("end_s").to_numpy()), 1)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(bytes padded to a positive multiple of UNIT, length before)."""
    raw = (text or "").encode()
    return raw + PAD * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): texts as media files."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.pieces(batches, "text", 2 << 20):
            made = [payload_of(t) for t in c.column_of(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([c.column_of(batch, "doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([to_wav(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema)


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_media`` as a table written to the shared folder, which is left to its owner to delete."""
    spark = docs.sparkSession
    path = f"{c.shared_folder(spark)}/media-{uuid.uuid4().hex}"
    encode_media(docs, id_col, text_col).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def audio_features(media: DataFrame) -> DataFrame:
    """``media`` with tensors (binary) and segments (array<struct<start_s, end_s>>) appended, from the column media."""
    own = [x for x in media.columns if x not in ("tensors", "segments")]
    spans = F.array(F.struct(F.lit(0.0).alias("start_s"), F.lit(0.0).alias("end_s")))
    schema = media.select(*own, F.lit(b"").alias("tensors"), spans.alias("segments")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for batch in c.pieces(batches, "media", 2 << 20):
            found = [features(m) for m in c.column_of(batch, "media").to_pylist()]
            blobs = pa.array([to_tensors(t, s) for t, s, _ in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, blobs, pa.array([[{"start_s": a, "end_s": b} for a, b in x.tolist()] for _, _, x in found], kind)], schema.names)

    return media.select(*own).mapInArrow(run, schema)


def said(tensors: bytes, segments: list[dict]) -> str:
    """A summary of the feature columns, from their stored form."""
    tensor, spans = from_tensors(tensors)
    mean, spread = tensor.mean(dtype=np.float64), tensor.std(dtype=np.float64)
    seconds = sum(x["end_s"] - x["start_s"] for x in segments)
    return f"chunks={len(tensor)};span={spans[-1, 1]:.4f};mean={mean:.3f};std={spread:.3f};segments={len(segments)};active={seconds:.3f}"


def digests_of(featured: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored media with features."""
    names = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    schema = featured.select("doc_id", *(F.lit(None).cast(k).alias(n) for n, k in names.items())).schema
    kinds = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.pieces(batches, "media", 2 << 20):
            made = []
            for n, media, tensors, segments in zip(*(c.column_of(batch, x).to_pylist() for x in ("n_bytes", "media", "tensors", "segments")), strict=True):
                payload, _ = from_wav(media)
                made.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), said(tensors, segments)))
            columns = [pa.array(x, kinds[k]) for x, k in zip(zip(*made, strict=True), names.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.column_of(batch, "doc_id"), *columns], ["doc_id", *names])

    return featured.select("doc_id", "n_bytes", "media", "tensors", "segments").mapInArrow(run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """``digests_of`` every document: its media written, read back and analysed."""
    return digests_of(audio_features(stored_media(docs)))
