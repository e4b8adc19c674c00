"""Operator 10: media columns: sound stored as wave files, with features as fixed-shape Arrow tensors.

Sound is mono, 8 bits a sample. Features are computed from the stored bytes, read back: polyphase resampling
from 12 to 8 kHz, log-mel filterbanks over overlapping frames, and segments found by energy with hysteresis.
"""

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from . import _shared as S

RATE, UP, DOWN = 12_000, 2, 3
FRAME, HOP, MELS, WINDOW = 256, 128, 16, 32
BLOCK = 192


def encode(samples):
    """A wave file of 8-bit mono samples at 12 kHz."""
    pad = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def decode(media):
    """The samples of a wave file of 8-bit mono sound; other files are refused."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data":
            if form is None or form[:2] != (1, 1) or form[5] != 8:
                raise ValueError("not 8-bit mono sound")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _filter(taps_per_phase=12):
    """Low-pass filter at the lower Nyquist rate: a sinc under a Hann window, as phases (UP, taps)."""
    n = taps_per_phase * UP
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = cut * np.sinc(cut * t) * np.hanning(n + 2)[1:-1]
    return (UP * h / h.sum()).reshape(taps_per_phase, UP).T.copy()


PHASES = _filter()


def resample(x):
    """Polyphase resampling by UP / DOWN: each output takes the phase of the filter that falls on input samples."""
    taps = PHASES.shape[1]
    n_out = -(-len(x) * UP // DOWN)
    padded = np.r_[np.zeros(taps - 1), x, np.zeros(taps)]
    out = np.empty(n_out)
    for r in range(UP):  # outputs r, r + UP, ... have one phase and advance by DOWN inputs
        at = np.arange(r, n_out, UP) * DOWN
        phase, first = at[0] % UP if len(at) else 0, at // UP + taps // 2
        y = np.zeros(len(at))
        for k in range(taps):
            y += PHASES[phase, k] * padded[first + taps - 1 - k]
        out[r::UP] = y
    return out


def _mel_bank():
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    rate = RATE * UP / DOWN
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    return np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])))


BANK, TAPER = _mel_bank(), np.hanning(FRAME)


def log_mel(x):
    """(frames, MELS) log energies and the frames' energies in dB; short sound is padded to a frame."""
    x = np.r_[x, np.zeros(max(0, FRAME - len(x)))]
    x = np.r_[x, np.zeros(-(len(x) - FRAME) % HOP)]
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mels, energy = [], []
    for k in range(0, len(frames), 4096):
        part = frames[k : k + 4096]
        power = np.abs(np.fft.rfft(part * TAPER, axis=1)) ** 2
        mels.append(np.log(power @ BANK + 1e-10))
        energy.append(10 * np.log10((part**2).mean(1) + 1e-10))
    return np.concatenate(mels).astype(np.float32), np.concatenate(energy)


def segments(energy, up=1.0, down=-1.0):
    """Spans of frames [start, end) that begin ``up`` dB over the mean energy and end below ``down`` dB over it."""
    mark = np.where(energy >= energy.mean() + up, 1, np.where(energy < energy.mean() + down, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.r_[False, (last >= 0) & (mark[np.maximum(last, 0)] == 1), False]
    return np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])


def features(media):
    """(Arrow stream of the tensors, segments as (start, end) in seconds, number of frames) of a stored file.

    The stream holds a row per window of WINDOW frames: start and end in seconds and a fixed-shape tensor
    (WINDOW, MELS) of float32; the last window is filled with zeros, its end is that of the sound.
    """
    x = (np.frombuffer(decode(media), np.uint8).astype(float) - 128) / 128
    y = resample(x)
    mel, energy = log_mel(y)
    n = -(-len(mel) // WINDOW)
    filled = np.zeros((n * WINDOW, MELS), np.float32)
    filled[: len(mel)] = mel
    step, rate = HOP * DOWN / (RATE * UP), RATE * UP / DOWN
    start = np.arange(n) * WINDOW * step
    end = np.minimum(start + ((WINDOW - 1) * HOP + FRAME) / rate, len(y) / rate)
    kind = pa.fixed_shape_tensor(pa.float32(), (WINDOW, MELS))
    tensor = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(filled.reshape(-1)), WINDOW * MELS))
    batch = pa.record_batch({"start_s": pa.array(start), "end_s": pa.array(end), "log_mel": tensor})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    a, b = segments(energy)
    return sink.getvalue().to_pybytes(), np.column_stack([a, b]) * step, mel


def read_tensors(stream):
    """The table of an Arrow stream made by ``features``."""
    return pa.ipc.open_stream(stream).read_all()


def payload(text):
    """UTF-8 bytes of a text (null: empty), blanks appended up to a positive multiple of BLOCK; and their number before."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" "), len(raw)


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "media binary, tensors binary, segments array<struct<start_s:double,end_s:double>>"
)


def _columns(keep):
    def made(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):  # media are kept for few rows at a time
                rows = []
                for doc_id, text in zip(pdf["doc_id"][at : at + 256], pdf["text"][at : at + 256], strict=True):
                    data, n = payload(text)
                    media = encode(data)
                    back = decode(media)
                    tensors, spans, mel = features(media)
                    mean = " ".join(f"{v:.3f}" for v in mel.mean(0))
                    feature = f"frames={len(mel)} segments={len(spans)} mel={mean} tensors={hashlib.sha256(tensors).hexdigest()[:16]}"
                    row = [doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature]
                    rows.append([*row, media, tensors, [{"start_s": s, "end_s": e} for s, e in spans.tolist()]] if keep else row)
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                out = pd.DataFrame(rows, columns=names if keep else names[:8])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return made


def audio_columns(docs, keep_media=True):
    """Stores every text of ``docs(doc_id, text)`` as sound and computes its features from what is stored.

    Gives the digests and, with ``keep_media``, the wave file, the tensors (an Arrow stream) and the segments.
    Null and empty texts are one block of blanks; repeated rows give equal rows; null ids pass; other
    columns aren't read; an empty table gives an empty result.
    """
    schema = SCHEMA if keep_media else ", ".join(SCHEMA.split(", ")[:8])
    return docs.select(F.col("doc_id"), "text").mapInPandas(_columns(keep_media), schema)


def op10_audio(spark, sf_dir):
    return audio_columns(S.table(spark, sf_dir, "documents"), keep_media=True)


QUERIES = {"op10_audio": op10_audio}
