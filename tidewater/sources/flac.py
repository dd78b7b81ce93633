"""FLAC streams (RFC 9639): length and rate from the header, samples frame by frame.

Residuals are decoded by positions in an array of bits, fixed predictors by running
sums; only linear predictors take a step a sample. A frame's bits are unpacked at a
time, so memory does not grow with the file beyond its samples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np

MAGIC = b"fLaC"


@dataclass(frozen=True)
class Info:
    """What the first metadata block says; `frames` is 0 where it is not known."""

    block: int
    rate: int
    channels: int
    bits: int
    frames: int
    md5: bytes


def info(head: bytes) -> Info:
    """From the first 42 bytes of a stream."""
    if head[:4] != MAGIC or len(head) < 42 or head[4] & 127:
        raise ValueError("no FLAC stream")
    packed = int.from_bytes(head[18:26], "big")
    return Info(int.from_bytes(head[10:12], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, head[26:42])


class _Bits:
    """A reader of the bits of some bytes."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        n = len(self.bits)
        ones = np.where(self.bits > 0, np.arange(n), n)
        self.stop = np.minimum.accumulate(ones[::-1])[::-1].tolist()  # the next 1 from each place on
        self.at = 0

    def whole(self, n: int) -> int:
        return int(self.wholes(1, n)[0]) if n else 0

    def wholes(self, count: int, n: int, signed: bool = False) -> np.ndarray:
        """`count` numbers of n bits."""
        if self.at + count * n > len(self.bits):
            raise ValueError("the stream ends within a frame")
        x = self.bits[self.at : self.at + count * n].reshape(count, n).astype(np.int64) @ (np.int64(1) << np.arange(n)[::-1])
        self.at += count * n
        return x - ((x >> (n - 1)) << n) if signed and n else x

    def unary(self) -> int:
        start, self.at = self.at, self.stop[self.at] + 1
        return self.at - 1 - start

    def rice(self, count: int, k: int) -> np.ndarray:
        stop, at, ends = self.stop, self.at, []
        for _ in range(count):
            end = stop[at]
            ends.append(end)
            at = end + 1 + k
        if at > len(self.bits):
            raise ValueError("the stream ends within a frame")
        one = np.array(ends, np.int64)
        x = one - np.r_[self.at, one[:-1] + 1 + k]
        for j in range(k):
            x = x << 1 | self.bits[one + 1 + j]
        self.at = at
        return x >> 1 ^ -(x & 1)


def _residual(b: _Bits, size: int, order: int) -> np.ndarray:
    method = b.whole(2)
    if method > 1:
        raise ValueError("unknown residual coding")
    width, parts = 4 + method, b.whole(4)
    out = []
    for i in range(1 << parts):
        n = (size >> parts) - (order if i == 0 else 0)
        k = b.whole(width)
        if k < (1 << width) - 1:
            out.append(b.rice(n, k))
        else:
            raw = b.whole(5)
            out.append(b.wholes(n, raw, signed=True) if raw else np.zeros(n, np.int64))
    return np.concatenate(out)


def _summed(first: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Samples whose differences of order len(first) are the residual."""
    x = residual
    for j in range(len(first) - 1, -1, -1):
        x = np.diff(first, j)[-1] + np.cumsum(x)
    return np.r_[first, x]


def _foretold(first: np.ndarray, coefficients: np.ndarray, shift: int, residual: np.ndarray) -> np.ndarray:
    """Samples from a linear predictor, the newest sample having the first coefficient."""
    x, back, n = first.tolist(), coefficients[::-1].tolist(), len(first)
    for r in residual.tolist():
        x.append(r + (sum(map(mul, back, x[-n:])) >> shift))
    return np.array(x, np.int64)


def _channel(b: _Bits, size: int, bits: int) -> np.ndarray:
    kind = b.whole(7)
    wasted = b.unary() + 1 if b.whole(1) else 0
    bits -= wasted
    if kind == 0:
        x = np.full(size, b.wholes(1, bits, signed=True)[0])
    elif kind == 1:
        x = b.wholes(size, bits, signed=True)
    elif 8 <= kind <= 12:
        first = b.wholes(kind - 8, bits, signed=True)
        x = _summed(first, _residual(b, size, len(first)))
    elif 32 <= kind < 64:
        first = b.wholes(kind - 31, bits, signed=True)
        precision = b.whole(4) + 1
        shift = int(b.wholes(1, 5, signed=True)[0])
        if precision == 16 or shift < 0:
            raise ValueError("unknown predictor")
        coefficients = b.wholes(len(first), precision, signed=True)
        x = _foretold(first, coefficients, shift, _residual(b, size, len(first)))
    else:
        raise ValueError("unknown kind of channel data")
    return x << wasted


def blocks(data: bytes) -> Iterator[np.ndarray]:
    """The frames' samples [sample, channel], one frame after the other."""
    about = info(data)
    at, last = 4, False
    while not last:
        last, at = data[at] > 127, at + 4 + int.from_bytes(data[at + 1 : at + 4], "big")
    # fixed values: block sizes and sample depths by their codes
    depths = {0: about.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
    room = 2 * max(about.block, 4096) * about.channels * (about.bits + 1) // 8 + 64
    while at < len(data):
        b = _Bits(data[at : at + room])
        if b.whole(15) != 0x7FFC:
            raise ValueError("no frame where one should begin")
        b.at += 1
        size, rate, layout, depth = b.whole(4), b.whole(4), b.whole(4), b.whole(3)
        b.at += 1
        more = 0
        lead = b.whole(8)  # the frame's number, in one to seven bytes
        while lead & 0x80 >> more:
            more += 1
        b.at += 8 * max(0, more - 1)
        if size in (6, 7):
            size = b.whole(8 * (size - 5)) + 1
        elif size == 0:
            raise ValueError("unknown block size")
        else:
            size = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
        b.at += {12: 8, 13: 16, 14: 16}.get(rate, 0) + 8
        if layout > 10 or depth not in depths:
            raise ValueError("unknown layout of channels")
        n, bits = layout + 1 if layout < 8 else 2, depths[depth]
        x = [_channel(b, size, bits + (i == {8: 1, 9: 0, 10: 1}.get(layout))) for i in range(n)]
        if layout == 8:
            x[1] = x[0] - x[1]
        elif layout == 9:
            x[0] = x[0] + x[1]
        elif layout == 10:
            twice = x[0] << 1 | x[1] & 1
            x = [twice + x[1] >> 1, twice - x[1] >> 1]
        at += (b.at + 7) // 8 + 2
        yield np.stack(x, 1)


def decode(data: bytes, frames: int | None = None) -> tuple[np.ndarray, int]:
    """Samples [frame, channel] in -1 to 1 and the rate, as far as the first `frames`; a whole stream is checked by its MD5."""
    about = info(data)
    parts, n = [], 0
    for x in blocks(data):
        parts.append(x)
        n += len(x)
        if frames is not None and n >= frames:
            break
    x = np.concatenate(parts) if parts else np.zeros((0, about.channels), np.int64)
    if frames is None and any(about.md5):
        width = (about.bits + 7) // 8
        raw = x.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
        if hashlib.md5(raw).digest() != about.md5:
            raise ValueError("samples do not match the stream's checksum")
    return x[:frames] / 2.0 ** (about.bits - 1), about.rate
