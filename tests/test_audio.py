"""Audio: FLAC against a stream made here and the standard's first example, sections by seek, spectra, files."""

import hashlib
import wave
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import files
from tidewater.sinks import tables as sinks
from tidewater.sources import audio, flac
from tidewater.sources import tables as sources

#: The first example stream of RFC 9639 (one frame of two channels).
EXAMPLE = bytes.fromhex("664c614380000022100010000000 0f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0ffff869180000bf0358fd03128baa9a")


def bits(x, n):
    return format(int(x) & (1 << n) - 1, f"0{n}b") if n else ""


def rice(residual, parts, k, order, size):
    """Residual in 2**parts partitions; the last one is written raw."""
    out, at = bits(0, 2) + bits(parts, 4), 0
    for i in range(1 << parts):
        n = (size >> parts) - (order if i == 0 else 0)
        part = residual[at : at + n]
        at += n
        if i and i == (1 << parts) - 1:
            out += bits(15, 4) + bits(20, 5) + "".join(bits(r, 20) for r in part)
        else:
            out += bits(k, 4)
            for r in part.tolist():
                z = r << 1 if r >= 0 else (-r << 1) - 1
                out += "0" * (z >> k) + "1" + bits(z, k)
    return out


def subframe(x, way, width):
    if way == "constant":
        return bits(0, 8) + bits(x[0], width)
    if way == "verbatim":
        return bits(1 << 1, 8) + "".join(bits(v, width) for v in x)
    if way == "wasted":  # three low bits are zero
        return bits(1 << 1 | 1, 8) + "001" + "".join(bits(v >> 3, width - 3) for v in x)
    if way.startswith("fixed"):
        n = int(way[5:])
        return bits(8 + n << 1, 8) + "".join(bits(v, width) for v in x[:n]) + rice(np.diff(x, n), 2, 5, n, len(x))
    coefficients, shift = [7, -3, 1], 2
    res = [int(x[i]) - (sum(c * int(x[i - 1 - j]) for j, c in enumerate(coefficients)) >> shift) for i in range(3, len(x))]
    return bits(31 + 3 << 1, 8) + "".join(bits(v, width) for v in x[:3]) + bits(4, 4) + bits(shift, 5) + "".join(bits(c, 5) for c in coefficients) + rice(np.array(res), 1, 6, 3, len(x))


def stream(frames, rate=8000, width=16):
    """A FLAC stream of frames (samples [n, channel], layout, ways)."""
    all_ = np.concatenate([f[0] for f in frames])
    head = bits(1, 16) + bits(4096, 16) + bits(0, 48) + bits(rate, 20) + bits(all_.shape[1] - 1, 3) + bits(width - 1, 5) + bits(len(all_), 36)
    md5 = hashlib.md5(all_.astype("<i2").tobytes()).digest()
    out = b"fLaC" + bytes([0, 0, 0, 34]) + int(head, 2).to_bytes(18, "big") + md5 + bytes([0x84, 0, 0, 3]) + b"abc"
    for number, (x, layout, ways) in enumerate(frames):
        y, wide = [x[:, c] for c in range(x.shape[1])], [width] * x.shape[1]
        if layout == 8:
            y[1], wide[1] = y[0] - y[1], width + 1
        elif layout == 9:
            y[0], wide[0] = y[0] - y[1], width + 1
        elif layout == 10:
            y, wide = [y[0] + y[1] >> 1, y[0] - y[1]], [width, width + 1]
        b = bits(0x7FFC, 15) + "0" + bits(7, 4) + bits(0, 4) + bits(layout, 4) + bits(0, 4) + bits(number, 8) + bits(len(x) - 1, 16) + bits(0, 8)
        b += "".join(subframe(v, w, n) for v, w, n in zip(y, ways, wide, strict=True))
        b += "0" * (-len(b) % 8) + bits(0, 16)
        out += int(b, 2).to_bytes(len(b) // 8, "big")
    return out, all_


@pytest.fixture(scope="module")
def flac_stream():
    rng = np.random.default_rng(4)
    tone = lambda n: np.round(9000 * np.sin(np.arange(n) / 9) + rng.normal(0, 40, n)).astype(np.int64)
    pair = lambda n: np.stack([tone(n), tone(n)], 1)
    frames = [(pair(512), 1, ["verbatim", "fixed0"]), (pair(512), 8, ["fixed1", "fixed2"]), (pair(512), 9, ["fixed3", "fixed4"]), (pair(512), 10, ["linear", "fixed2"])]
    frames += [(np.stack([np.full(64, -5), tone(64) & ~7], 1), 1, ["constant", "wasted"]), (pair(256), 1, ["linear", "verbatim"])]
    return stream(frames)


def test_flac(flac_stream):
    x, rate = flac.decode(EXAMPLE)
    assert rate == 44100 and (x * 32768).tolist() == [[25588, 10416]]  # its own MD5 holds too
    data, want = flac_stream
    x, rate = audio.decode(data)
    assert rate == 8000 and np.array_equal(x * 32768, want)
    assert np.array_equal(flac.decode(data, 700)[0] * 32768, want[:700])
    assert audio.measure(BytesIO(data)) == (len(want), 8000)
    unknown = data[:21] + bytes([data[21] & 0xF0]) + bytes(4) + data[26:]
    assert audio.measure(BytesIO(unknown)) == (len(want), 8000)
    for broken in (data[:-300], data[:90] + bytes([data[90] ^ 255]) + data[91:], b"fLaC", b"", b"none"):
        with pytest.raises(Exception):
            audio.decode(broken)


def test_recordings_by_path(spark, tmp_path, flac_stream):
    data, want = flac_stream
    (tmp_path / "a b.flac").write_bytes(data)
    tone = np.sin(np.arange(16000) / 20) * 0.4
    (tmp_path / "t.wav").write_bytes(audio.encode_wav(tone, 8000))
    (tmp_path / "x.wav").write_bytes(b"broken")
    content = sources.contents(spark, str(tmp_path))
    for got in (audio.headers(content), audio.headers_at(content.select("path"))):
        h = {r.path.rsplit("/", 1)[1].replace("%20", " "): r for r in got.collect()}
        assert (h["a b.flac"].frames, h["a b.flac"].rate, h["t.wav"].duration) == (len(want), 8000, 2.0) and h["x.wav"].error
    w = spark.createDataFrame([("a b.flac", "f1", 0.1, 0.2), ("a b.flac", "f0", 0.0, 0.05), ("a b.flac", "far", 9.0, 9.5), ("t.wav", "w", 0.5, 1.5), ("t.wav", "far", 3.0, 4.0), ("x.wav", "x", 0.0, 1.0)], "n string, clip string, start double, stop double")
    w = w.join(content.select("path", F.replace(F.element_at(F.split("path", "/"), -1), F.lit("%20"), F.lit(" ")).alias("n")), "n").drop("n")
    one, two = ({(r.clip, bytes(r.data or b""), r.error is None) for r in x.collect()} for x in (audio.clips(content, w), audio.clips_at(w)))
    assert one == two and len(one) == 5 and {c for c, _, ok in one if ok} == {"f1", "f0", "w"}
    got = {c: audio.decode_wav(d)[0][:, 0] for c, d, ok in one if ok}
    assert np.allclose(got["f1"], want[800:1600].mean(1) / 32768, atol=2**-15) and np.allclose(got["w"], tone[4000:12000], atol=2**-14)
    whole = {r.error is None: r for r in audio.loaded(content, 4000).collect()}
    assert len(whole[True].samples) in (len(want) // 2, 8000) and whole[False].samples is None


def test_a_section_reads_its_own_bytes(tmp_path):
    (tmp_path / "t.wav").write_bytes(audio.encode_wav(np.zeros(800000), 8000))

    class Counted(BytesIO):
        n = 0

        def read(self, size=-1):
            got = super().read(size)
            Counted.n += len(got)
            return got

    x, _ = audio.read_wav(Counted((tmp_path / "t.wav").read_bytes()), 50, 51)
    assert len(x) == 8000 and Counted.n < 17000
    Counted.n = 0
    assert audio.measure(Counted((tmp_path / "t.wav").read_bytes())) == (800000, 8000) and Counted.n < 200


def test_spectra(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 4096)
    m, c = audio.mel_db(x, 8000), audio.mfcc(x, 8000, 64)
    assert np.allclose((m**2).sum(0), (c**2).sum(0)) and np.allclose(c[0], m.sum(0) / 8)  # orthonormal
    assert np.allclose(audio.mfcc(x, 8000), c[:13])
    frames = spark.createDataFrame([(1, [float(v) for v in x]), (2, [0.0] * 4096)], "i int, samples array<float>")
    got = {r.i: r.embedding for r in audio.spectra(frames, 8000, 13).collect()}
    assert np.allclose(got[1], c[:13].ravel(), atol=1e-2) and len(got[2]) == c[:13].size
    assert len(audio.spectra(frames, 8000).first().embedding) == m.size


def test_stereo_widths(tmp_path):
    for width in (1, 2, 3, 4):
        out = BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(width)
            w.setframerate(100)
            w.writeframes((b"\x80" if width == 1 else bytes(width)) * 2 * 50)
        x, rate = audio.decode(out.getvalue())
        assert x.shape == (50, 2) and rate == 100 and not x.any()


def test_files(spark, tmp_path):
    at = f"file:{tmp_path}/d/e.bin"
    for _ in range(2):
        assert files.put(at, b"12345") == 5
    assert files.exists(at) and files.exists(f"file://{tmp_path}/d/e.bin") and not files.exists(f"{tmp_path}/none")
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["e.bin"]
    with files.opened(at) as f:
        assert files.put(f"{tmp_path}/f/g.bin", f) == 5
    listed = spark.createDataFrame([("a", 5), ("b", 7), ("c", 1)], "path string, length long")
    assert [r.path for r in sources.within_bytes(listed, 12).orderBy("path").collect()] == ["a", "b"] and sources.within_bytes(listed, 4).isEmpty()
    for _ in range(2):
        sinks.log_run(spark, str(tmp_path / "log"), "windows", {"clips": 3, "failed": 1})
    assert spark.read.json(str(tmp_path / "log")).agg(F.sum("n")).first()[0] == 8
