"""Operator 3, media columns: texts as WAV files and spectral-peak fingerprints.

A text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are the samples of an 8-bit mono
WAV file. write() stores the files in a table in the shared folder; read() opens the stored files with the
wave module, and digests and features come from what was read: a short-time Fourier transform of 192-sample frames, the strongest
local peaks of each frame, and a hash of each peak with the peaks that follow it, kept as arrays of times and hashes.

Cases: null and empty text give one frame of spaces, which has no peaks and an empty fingerprint. Equal
texts give equal values: magnitudes are quantised before they are compared and ties go to the lower bin.
Very long texts are one file each, in memory as a whole. Repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kindred.llm.common import blocks, cut, map_arrow, utf8

FRAME, RATE, PEAKS, AHEAD = 192, 8000, 2, 3
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, peak_times array<int>, peak_hashes array<int>, media binary"
)
FILES = "doc_id long, n_bytes long, media binary"
_WINDOW = np.hanning(FRAME + 1)[:-1]


def pad(data: bytes) -> bytes:
    return data + b" " * (FRAME * max(1, -(-len(data) // FRAME)) - len(data))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _peaks(frames: np.ndarray) -> np.ndarray:
    """Bins of the PEAKS strongest local peaks of each frame, -1 where there are fewer."""
    centred = (frames.astype(np.float64) - frames.mean(1, keepdims=True)) * _WINDOW
    level = np.round(np.log2(1 + np.abs(np.fft.rfft(centred, axis=1))) * 256).astype(np.int32)
    inner = level[:, 1:-1]
    local = np.where((inner > level[:, :-2]) & (inner >= level[:, 2:]) & (inner > 0), inner, 0)
    found = np.empty((len(frames), PEAKS), np.int32)
    for k in range(PEAKS):
        best = local.argmax(1)
        got = local[np.arange(len(frames)), best] > 0
        found[:, k] = np.where(got, best + 1, -1)
        local[np.arange(len(frames)), best] = 0
    return found


def fingerprints(payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(times, hashes) of each payload: a peak at bin a in frame t with one at bin b, d frames on."""
    counts = np.array([len(p) // FRAME for p in payloads])
    frames = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    peaks = np.concatenate([_peaks(frames[i : i + 4096]) for i in range(0, len(frames), 4096)])
    owner = np.repeat(np.arange(len(payloads)), counts)
    start = np.cumsum(counts) - counts
    times, hashes, owners = [], [], []
    for d in range(1, AHEAD + 1):
        same = np.flatnonzero(owner[:-d] == owner[d:]) if len(owner) > d else np.zeros(0, np.int64)
        for i in range(PEAKS):
            for j in range(PEAKS):
                a, b = peaks[same, i], peaks[same + d, j]
                ok = (a >= 0) & (b >= 0)
                hit = same[ok]
                times.append(hit - start[owner[hit]])
                hashes.append((a[ok] << 16) | (b[ok] << 8) | d)
                owners.append(owner[hit])
    t, h, o = np.concatenate(times), np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, t, o))
    t, h, ends = t[order].astype(np.int32), h[order].astype(np.int32), np.searchsorted(o[order], np.arange(len(payloads) + 1))
    return [(t[ends[k] : ends[k + 1]], h[ends[k] : ends[k + 1]]) for k in range(len(payloads))]


def write_batch(batch: pa.RecordBatch):
    raw, offsets = utf8(batch.column(1))
    for i, j in blocks(offsets, 1 << 21):
        data, at = raw[offsets[i] : offsets[j]].tobytes(), (offsets[i : j + 1] - offsets[i]).tolist()
        media = [to_wav(pad(data[a:b])) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def read_batch(batch: pa.RecordBatch):
    ids, n_bytes, files = batch.columns
    sizes = np.cumsum([0, *pc.binary_length(files).to_pylist()])
    for i, j in blocks(sizes, 1 << 21):
        media = files.slice(i, j - i).to_pylist()
        back = [from_wav(m) for m in media]
        prints = fingerprints(back)
        feature = [f"{len(t)}:{hashlib.sha256(t.astype('<i4').tobytes() + h.astype('<i4').tobytes()).hexdigest()}" for t, h in prints]
        ends = np.cumsum([0, *(len(t) for t, _ in prints)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p[k] for p in prints]).astype(np.int32))) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [
                ids.slice(i, j - i),
                n_bytes.slice(i, j - i),
                pa.array([len(b) for b in back], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                pa.array([zlib.crc32(b[-16:]) for b in back], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                pa.array(feature),
                *lists,
                files.slice(i, j - i),
            ],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "peak_times", "peak_hashes", "media"],
        )


def write(docs: DataFrame) -> DataFrame:
    """The stored table of WAV files, one a document, with the length of the text in each."""
    return cut(map_arrow(docs.select("doc_id", "text"), write_batch, FILES), "media")


def read(files: DataFrame) -> DataFrame:
    """Per stored file: the file, its digests, the fingerprint arrays and their digest."""
    return map_arrow(files.select("doc_id", "n_bytes", "media"), read_batch, SCHEMA)


def media_features(docs: DataFrame) -> DataFrame:
    """One row a document with its file, as stored and read back, and what read() derives from it."""
    return read(write(docs))
