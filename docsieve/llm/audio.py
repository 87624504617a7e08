"""Media columns: audio stored losslessly, and features of what is read back.

A payload of bytes is kept as 8-bit mono PCM in a WAV container. Features are
computed from the stored bytes: polyphase resampling, overlapped log-mel
filterbanks and a segmentation by energy with hysteresis. The log-mels are
stored as fixed-shape Arrow tensors, clips of a fixed number of frames with
their time spans, and features follow from the tensors read back.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, fresh, quoted, utf8_bytes

#: Payloads are padded with spaces to a positive multiple of this.
BLOCK = 192
RATE = 8_000
#: Resampling ratio: 192 samples become 128.
UP, DOWN = 2, 3
TAPS = 24
FRAME, HOP, MELS = 128, 64, 16
#: Frames in one clip tensor, and the value of frames after the last.
CLIP_FRAMES, FLOOR = 16, -8.0
#: Samples turned over at once (a multiple of DOWN * HOP), so that memory stays bounded.
CHUNK = 192 << 11
#: A segment opens above the mean energy plus OPEN_DB and closes below the mean plus CLOSE_DB.
OPEN_DB, CLOSE_DB = 0.3, -0.3


def padded(content: bytes, block: int = BLOCK) -> bytes:
    return content + b" " * (max(1, -(-len(content) // block)) * block - len(content))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of 8-bit mono PCM."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono PCM")
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache(maxsize=4)
def _low_pass(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc filter, one row of ``taps`` coefficients per phase."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hamming(n)
    return (up * h / h.sum()).reshape(taps, up).T.copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS, before: np.ndarray | None = None) -> np.ndarray:
    """Polyphase resampling: only the samples that stay are computed, each from one phase of the filter.

    ``before``: the samples ahead of ``x``, where it is not the start of the signal.
    """
    phases = _low_pass(up, down, taps)
    n = len(x) * up // down
    ahead = np.zeros(taps - 1)
    if before is not None and len(before):
        last = before[-(taps - 1) :]
        ahead[len(ahead) - len(last) :] = last
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([ahead, x]), taps)  # windows[i] ends at x[i]
    out = np.empty(n)
    for r in range(min(up, n)):
        count = (n - r + up - 1) // up
        out[r::up] = windows[r * down // up :: down][:count] @ phases[r * down % up][::-1]
    return out


@lru_cache(maxsize=4)
def _mel_bank(rate: float, frame: int, mels: int) -> np.ndarray:
    """Triangles, evenly spaced on the mel scale (2595 log10(1 + f / 700))."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


@lru_cache(maxsize=1)
def _window() -> np.ndarray:
    return np.hanning(FRAME)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and energies in dB of frames that overlap by half."""
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * _window())) ** 2
    return np.log10(power @ _mel_bank(rate, FRAME, MELS) + 1e-8), 10 * np.log10((frames * frames).mean(axis=1) + 1e-8)


def segments(energy: np.ndarray, opens: float, closes: float) -> tuple[np.ndarray, np.ndarray]:
    """First and end frame of each stretch that opens at ``opens`` dB and lasts until below ``closes``."""
    mark = np.where(energy >= opens, 1, np.where(energy < closes, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[last] == 1)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def analyse(samples: bytes, rate: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-mel rows (float16), energies in dB and the new rate of a whole recording, worked out chunk by chunk."""
    own_rate = rate * UP / DOWN
    mels, energies, ahead, held = [], [], np.empty(0), np.empty(0)
    for i in range(0, len(samples), chunk):
        x = (np.frombuffer(samples, dtype=np.uint8, offset=i, count=min(chunk, len(samples) - i)).astype(np.float64) - 128) / 128
        held = np.concatenate([held, resample(x, before=ahead)])
        ahead = x
        if i + chunk >= len(samples) and not mels and len(held) < FRAME:
            held = np.concatenate([held, np.zeros(FRAME - len(held))])
        if len(held) >= FRAME:
            m, e = log_mel(held, own_rate)
            mels.append(m.astype(np.float16))
            energies.append(e)
            held = held[len(e) * HOP :]
    return np.concatenate(mels), np.concatenate(energies), own_rate


@lru_cache(maxsize=1)
def tensor_type():
    import pyarrow as pa

    return pa.fixed_shape_tensor(pa.float16(), (CLIP_FRAMES, MELS))


@lru_cache(maxsize=1)
def clip_schema():
    """Columns of a recording's clips: frames in the clip, those inside segments, their energy (sum of dB), time span, log-mels."""
    import pyarrow as pa

    return pa.schema([("frames", pa.int32()), ("active_frames", pa.int32()), ("energy", pa.float64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", tensor_type())])


def clips_of(samples: bytes, rate: int):
    """(record batch of :func:`clip_schema`, (start_s, end_s) of each segment) of one recording."""
    import pyarrow as pa

    mels, energy, own_rate = analyse(samples, rate)
    starts, ends = segments(energy, energy.mean() + OPEN_DB, energy.mean() + CLOSE_DB)
    n = -(-len(energy) // CLIP_FRAMES)
    full = np.full((n * CLIP_FRAMES, MELS), FLOOR, dtype=np.float16)
    full[: len(mels)] = mels
    inside = np.zeros(len(energy) + 1, dtype=np.int64)
    inside[starts] += 1  # no two segments share a start or an end
    inside[ends] -= 1
    first = np.arange(n) * CLIP_FRAMES
    last = np.minimum(first + CLIP_FRAMES, len(energy))
    sums = [np.add.reduceat(v, first) for v in (np.cumsum(inside)[:-1], energy)]
    time = lambda f, to: (f * HOP if to == 0 else (f - 1) * HOP + FRAME) / own_rate
    columns = [pa.array((last - first).astype(np.int32)), pa.array(sums[0].astype(np.int32)), pa.array(sums[1]), pa.array(time(first, 0)), pa.array(time(last, 1))]
    flat = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), CLIP_FRAMES * MELS)
    tensor = pa.ExtensionArray.from_storage(tensor_type(), flat)
    return pa.RecordBatch.from_arrays([*columns, tensor], schema=clip_schema()), (time(starts, 0), time(ends, 1))


def read_clips(stored: bytes):
    """The record batch that ``clips`` of :func:`clip_tensors` holds, tensors included."""
    import pyarrow as pa

    return pa.ipc.read_record_batch(pa.py_buffer(stored), clip_schema())


def feature_text(clips, n_segments: int) -> str:
    """Frames, segments, frames inside them, mean energy and mean log-mels of a record batch of clips, rounded."""
    frames = clips["frames"].to_numpy()
    total, mean = int(frames.sum()), np.zeros(MELS)
    tensor, step = clips["log_mel"].to_numpy_ndarray(), CHUNK // (HOP * CLIP_FRAMES)
    for i in range(0, len(frames), step):
        part = tensor[i : i + step]
        real = np.arange(CLIP_FRAMES) < frames[i : i + step, None]
        mean += part[real].astype(np.float64).sum(axis=0)
    numbers = [clips["energy"].to_numpy().sum() / total, *(mean / total)]
    return f"{total};{n_segments};{int(clips['active_frames'].to_numpy().sum())};" + ",".join(f"{v:.3f}" for v in numbers)


def store_media(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without its text but with ``media`` (binary WAV) and ``n_bytes`` (unpadded length).

    The payload is the text's UTF-8 bytes (null: none) with spaces up to a
    positive multiple of 192. Names that clash get a leading underscore.
    """
    media, n = fresh(docs, "media", "n_bytes")

    @F.pandas_udf("binary")
    def wav(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            yield contents.map(lambda c: to_wav(padded(c)))

    rest = [quoted(c) for c in docs.columns if c != text_col]
    return docs.select(*rest, F.octet_length(utf8_bytes(text_col)).cast("long").alias(n), wav(utf8_bytes(text_col)).alias(media))


AUDIO = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string>"
SEGMENTS = "array<struct<start_s:double,end_s:double>>"


def clip_tensors(recordings: DataFrame, *, media_col: str = "media") -> DataFrame:
    """``recordings`` with ``audio``, ``segments`` and ``clips`` in place of the media.

    ``audio``: payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes),
    media_bytes, media_sha256, all of the stored bytes. ``segments``: the time
    spans of energy segments. ``clips`` (binary): an Arrow record batch of
    :func:`clip_schema`, whose log-mels are fixed-shape tensors of CLIP_FRAMES x
    MELS with their time spans (the last clip is filled up with FLOOR);
    :func:`read_clips` opens it. Equal media have equal values. A null
    recording has nulls for all three; repeated rows are rows of their own; new
    names that clash get a leading underscore; an empty table gives an empty
    result. Recordings go through whole, worked on in chunks of samples.
    """
    names = fresh(recordings.drop(media_col), "audio", "segments", "clips")

    def start():
        import pyarrow as pa

        digest = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])
        span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])

        def work(media):
            audio, cuts, sizes, stored = [], [], [], []
            for m in media:
                if not m.is_valid:
                    audio.append((None,) * 5)
                    sizes.append(0)
                    stored.append(None)
                    continue
                m = m.as_py()
                samples, rate = from_wav(m)
                clips, spans = clips_of(samples, rate)
                audio.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(m), hashlib.sha256(m).hexdigest()))
                cuts.append(spans)
                sizes.append(len(spans[0]))
                stored.append(clips.serialize().to_pybytes())
            none = np.array([c is None for c in stored])
            fields = [pa.array(c, f.type) for c, f in zip(zip(*audio, strict=True), digest, strict=True)]
            flat = [pa.array(np.concatenate([c[k] for c in cuts]) if cuts else np.empty(0)) for k in (0, 1)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.StructArray.from_arrays(flat, fields=list(span)), mask=pa.array(none))
            return [pa.StructArray.from_arrays(fields, fields=list(digest), mask=pa.array(none)), lists, pa.array(stored, pa.binary())]

        return work

    return extended(recordings, media_col, start, keep=False, **dict(zip(names, (AUDIO, SEGMENTS, "binary"), strict=True)))


def features(clipped: DataFrame, *, clips_col: str = "clips", segments_col: str = "segments") -> DataFrame:
    """``clipped`` (of :func:`clip_tensors`) with a string ``feature`` in place of the clips and segments.

    It follows from the stored tensors and spans alone. Rows without clips have
    a null; a name that clashes gets a leading underscore.
    """
    rest = [c for c in clipped.columns if c not in (clips_col, segments_col)]
    (name,) = fresh(clipped.select(*(quoted(c) for c in rest)), "feature")

    @F.pandas_udf("string")
    def feature(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for clips, n in batches:
            yield pd.Series([None if c is None else feature_text(read_clips(c), int(k)) for c, k in zip(clips, n, strict=True)], dtype=object)

    return clipped.select(*(quoted(c) for c in rest), feature(quoted(clips_col), F.size(quoted(segments_col))).alias(name))


def clip_rows(clipped: DataFrame, *, id_col: str = "doc_id", clips_col: str = "clips") -> DataFrame:
    """One row per stored clip: id, clip, frames, active_frames, start_s, end_s and ``log_mel`` (array<float>, row by row).

    Rows without clips give none; ids are passed on as they are.
    """
    import pyarrow as pa

    id_type = clipped.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for key, stored in zip(batch.column(0), batch.column(1), strict=True):
                if stored.is_valid:
                    own = read_clips(stored.as_py())
                    n = own.num_rows
                    flat = own["log_mel"].to_numpy_ndarray().astype(np.float32).ravel()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * CLIP_FRAMES * MELS), pa.array(flat))
                    names = ["frames", "active_frames", "start_s", "end_s"]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * n, type=batch.column(0).type), pa.array(np.arange(n, dtype=np.int32)), *(own[c] for c in names), lists], names=["id", "clip", *names, "log_mel"])

    return clipped.select(quoted(id_col), quoted(clips_col)).mapInArrow(cut, f"id {id_type}, clip int, frames int, active_frames int, start_s double, end_s double, log_mel array<float>")
