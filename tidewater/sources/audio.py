"""Audio: headers, sections, windows and spectra, from PCM WAV and FLAC.

Other codecs plug in as `decode`, a function of the file's bytes that gives samples
[frame, channel] in -1 to 1 and the rate. Sections and lengths can be had from the
bytes of files that are already read (headers, clips), or by path from the shared file
system (headers_at, clips_at): then a length takes the header only, and a section of a
WAV file only its own bytes.
"""

from __future__ import annotations

import wave
from collections.abc import Callable, Iterator
from io import BytesIO
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.files import opened
from tidewater.sources import flac

Decode = Callable[[bytes], tuple[np.ndarray, int]]
Measure = Callable[[BinaryIO], tuple[int, int]]
#: Recordings with wanted sections up to which the list of sections is broadcast, and sections of one.
BROADCAST_RECORDINGS, BROADCAST_SECTIONS = 100_000, 1_000_000


def read_wav(f: BinaryIO, start: float = 0.0, stop: float | None = None) -> tuple[np.ndarray, int]:
    """Samples from start to stop seconds and rate of 8, 16, 24 or 32 bit PCM; only these samples are read."""
    with wave.open(f) as w:
        width, channels, rate, n = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.getnframes()
        a = min(n, max(0, round(start * rate)))
        b = n if stop is None else min(n, max(a, round(stop * rate)))
        w.setpos(a)
        raw = np.frombuffer(w.readframes(b - a), np.uint8)
    if width == 1:
        x = (raw.astype(np.float64) - 128) / 128
    else:
        wide = np.zeros((len(raw) // width, 4), np.uint8)
        wide[:, 4 - width :] = raw.reshape(-1, width)
        x = wide.view("<i4").ravel() / 2.0**31
    return x.reshape(-1, channels), rate


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    return read_wav(BytesIO(content))


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of WAV or FLAC."""
    return flac.decode(content) if content[:4] == flac.MAGIC else decode_wav(content)


def measure(f: BinaryIO) -> tuple[int, int]:
    """(frames, rate) of WAV or FLAC from the header; a FLAC stream of unknown length is decoded."""
    head = f.read(42)
    f.seek(0)
    if head[:4] != flac.MAGIC:
        with wave.open(f) as w:
            return w.getnframes(), w.getframerate()
    about = flac.info(head)
    return about.frames or sum(map(len, flac.blocks(f.read()))), about.rate


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16 bit PCM of one channel."""
    out = BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1 - 2**-15) * 2**15).round().astype("<i2").tobytes())
    return out.getvalue()


def mono(samples: np.ndarray) -> np.ndarray:
    return samples.mean(axis=1) if samples.ndim == 2 else samples


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """To another rate by Fourier transform; its length is rounded."""
    n = round(len(x) * to / rate)
    if rate == to or not len(x) or not n:
        return x[:n] if rate != to else x
    f = np.fft.rfft(x)
    g = np.zeros(n // 2 + 1, complex)
    k = min(len(f), len(g))
    g[:k] = f[:k]
    return np.fft.irfft(g, n) * (n / len(x))


def section(x: np.ndarray, rate: int, start: float, stop: float) -> np.ndarray:
    """Samples from start to stop seconds, as far as there are any."""
    return x[max(0, round(start * rate)) : max(0, round(stop * rate))]


def padded(x: np.ndarray, n: int) -> np.ndarray:
    """x to n samples by reflection."""
    while 0 < len(x) < n:
        x = np.concatenate([x, x[::-1][: n - len(x)]])
    return x[:n]


def mel_db(x: np.ndarray, rate: int, n_fft: int = 1024, hop: int = 512, bands: int = 64) -> np.ndarray:
    """A mel spectrogram in decibels, [band, frame]."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    x = np.pad(x, (0, max(0, n_fft - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] * np.hanning(n_fft)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(n_fft, 1 / rate)[None, :]
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)))
    return 10 * np.log10(np.maximum(bank @ power.T, 1e-10))


def mfcc(x: np.ndarray, rate: int, coefficients: int = 13, **mel: int) -> np.ndarray:
    """Mel-frequency cepstral coefficients, [coefficient, frame]: the orthonormal cosine transform (II) of mel_db."""
    m = mel_db(x, rate, **mel)
    n = len(m)
    basis = np.cos(np.pi * np.arange(coefficients)[:, None] * (np.arange(n) + 0.5) / n) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis @ m


def headers(contents: DataFrame, measure: Measure = measure) -> DataFrame:
    """(path, frames, rate, duration, error) of files (path, content); broken files have an error and no figures."""
    return _headers(contents.select("path", "content"), lambda row: BytesIO(row[1]), measure)


def headers_at(paths: DataFrame, measure: Measure = measure) -> DataFrame:
    """What headers() gives, for files (path) in the shared file system: no more than their headers is read."""
    return _headers(paths.select("path"), lambda row: opened(row[0]), measure)


def _headers(files: DataFrame, open_: Callable[[tuple], BinaryIO], measure: Measure) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                try:
                    with open_(row) as f:
                        n, rate = measure(f)
                    rows.append((row[0], n, rate, n / rate, None))
                except Exception as e:  # one broken file does not end the job; it is reported
                    rows.append((row[0], None, None, None, str(e) or type(e).__name__))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "frames", "rate", "duration", "error"), r, strict=True)) for r in rows], pa.schema([("path", pa.string()), ("frames", pa.int64()), ("rate", pa.int32()), ("duration", pa.float64()), ("error", pa.string())]))

    return files.mapInArrow(run, "path string, frames long, rate int, duration double, error string")


def _parts(wanted: DataFrame) -> DataFrame:
    """(path, parts): each recording's sections together, so that it is opened once."""
    return wanted.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "clip"))).alias("parts"))


Sections = Callable[[float, float], tuple[np.ndarray, int]]


def _cut(recordings: DataFrame, read: Callable[..., Sections], rate: int | None) -> DataFrame:
    """(clip, data, error) of rows (..., parts); `read` takes the columns before parts and gives a reader of sections."""
    schema = pa.schema([("clip", pa.string()), ("data", pa.binary()), ("error", pa.string())])

    def cut(section_: Sections, want: dict) -> bytes:
        x, r = section_(want["start"], want["stop"])
        if not len(x):
            raise ValueError("no audio there")
        return encode_wav(resample(mono(x), r, rate) if rate else mono(x), rate or r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *columns, want in zip(*[c.to_pylist() for c in b.columns], strict=True):
                try:
                    section_, why = read(*columns, want), None
                except Exception as e:  # reported with each of the recording's clips
                    section_, why = None, str(e) or type(e).__name__
                for w in want:
                    row = {"clip": w["clip"], "data": None, "error": why}
                    if section_:
                        try:
                            row["data"] = cut(section_, w)
                        except Exception as e:  # reported with this clip
                            row["error"] = str(e) or type(e).__name__
                    yield pa.RecordBatch.from_pylist([row], schema)

    return recordings.mapInArrow(run, "clip string, data binary, error string")


def _of_samples(x: np.ndarray, rate: int) -> Sections:
    return lambda start, stop: (section(x, rate, start, stop), rate)


def clips(contents: DataFrame, wanted: DataFrame, rate: int | None = None, decode: Decode = decode) -> DataFrame:
    """(clip, data, error): sections of recordings as mono WAV; wanted: (path, clip, start, stop).

    Each recording's sections are gathered first, so it is decoded once. The list of
    sections goes to the recordings, which are not shuffled, while it is short.
    """
    parts = _parts(wanted)
    size = parts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("parts")).alias("sections")).first()
    if size["n"] <= BROADCAST_RECORDINGS and (size["sections"] or 0) <= BROADCAST_SECTIONS:
        parts = F.broadcast(parts)
    rows = contents.join(parts, "path").select("content", "parts")
    return _cut(rows, lambda content, want: _of_samples(*decode(content)), rate)


def clips_at(wanted: DataFrame, rate: int | None = None) -> DataFrame:
    """What clips() gives, for recordings in the shared file system: only the wanted bytes of WAV files are read.

    FLAC files are decoded up to the last wanted sample. No content is shuffled.
    """

    def read(path: str, want: list[dict]) -> Sections:
        with opened(path) as f:
            head = f.read(42)
            if head[:4] == flac.MAGIC:
                last = max(w["stop"] for w in want)
                return _of_samples(*flac.decode(head + f.read(), round(last * flac.info(head).rate) + 1))

        def at(start: float, stop: float) -> tuple[np.ndarray, int]:
            with opened(path) as f:
                return read_wav(f, start, stop)

        return at

    return _cut(_parts(wanted).select("path", "parts"), read, rate)


def loaded(contents: DataFrame, rate: int, decode: Decode = decode) -> DataFrame:
    """(path, samples, error): whole recordings, mono and at one rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = why = None
                try:
                    x, r = decode(content)
                    x = resample(mono(x), r, rate).astype(np.float32)
                except Exception as e:  # one broken file does not end the job; it is reported
                    x, why = None, str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([x], pa.list_(pa.float32())), pa.array([why], pa.string())], ["path", "samples", "error"])

    return contents.select("path", "content").mapInArrow(run, "path string, samples array<float>, error string")


def spectra(frames: DataFrame, rate: int, coefficients: int | None = None, samples: str = "samples") -> DataFrame:
    """frames of equal length with embedding: each window's mel spectrogram in decibels, or its MFCC, row after row."""
    one = (lambda x: mel_db(x, rate)) if coefficients is None else (lambda x: mfcc(x, rate, coefficients))
    return embedded(frames, lambda m: np.stack([one(x).ravel() for x in m]), samples)


def embedded(frames: DataFrame, embed: Callable[[np.ndarray], np.ndarray], samples: str = "samples") -> DataFrame:
    """frames with embedding: `embed` takes a batch [window, sample] and gives [window, size]."""
    columns = frames.columns
    at = columns.index(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = np.asarray(embed(np.array(b.column(at).to_pylist(), np.float32)), np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, vectors], [*columns, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    return frames.mapInArrow(run, f"{schema}, embedding array<float>")
