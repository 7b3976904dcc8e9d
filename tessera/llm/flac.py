"""FLAC media columns: bytes as 8-bit samples, losslessly coded, decoded and verified in batches of frames.

A byte's sample is small where the byte is frequent in texts, so that Rice codes of the samples themselves are short; all fixed
predictors and a linear one are tried on every frame, and the shortest form is taken.

Streams are standard FLAC (one channel, 8 bits): STREAMINFO with the MD5 of the samples, an APPLICATION block with the frequent
bytes that the samples count from, so that a stream tells its own bytes, a SEEKTABLE with every frame's first
sample and offset, frames of BLOCK samples with a fixed or linear predictor and Rice-coded residuals, CRC-8 of headers and
CRC-16 of frames. All frames of a batch are worked on side by side, a column of a matrix each, so that the sequential parts
(Rice prefixes, predictors) take one numpy step per sample of a frame and not per sample.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mapped

BLOCK, RATE, ORDER, PRECISION = 4096, 8000, 8, 10
#: Samples of frames that are worked on at one time.
SAMPLES = 4 << 20
#: Frequent bytes of texts in their order; 0, 1, -1, 2, -2, ... are the samples of these and of all others behind them.
FREQUENT = b" eniarstodlhuc" + bytes([0xC3]) + b"mgpbvfwzykjqx.,EDASTIMC0123456789|#$%&*-'\n"
#: Fixed values of the format: predictors of order 0 to 4.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


#: Id of the APPLICATION block that holds a stream's frequent bytes.
TABLE_ID = b"Tbyt"


@lru_cache(maxsize=64)
def _tables(frequent: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sample of each byte, and the byte of each sample's two's complement."""
    byte = np.array([*frequent, *(b for b in range(256) if b not in frequent)], np.uint8)  # by how far from 0 the sample is
    sample, of_sample = np.zeros(256, np.int8), np.zeros(256, np.uint8)
    sample[byte] = (np.arange(256) + 1 >> 1) * np.where(np.arange(256) & 1, 1, -1)
    of_sample[sample.view(np.uint8)] = np.arange(256)
    return sample, of_sample


_SAMPLE = _tables(FREQUENT)[0]


def _table(poly: int, width: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        t = np.where(t >> (width - 1) & 1, t << 1 ^ poly, t << 1) & ((1 << width) - 1)
    return t.astype(np.uint16)


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _shift16() -> np.ndarray:
    """Tables that move a CRC-16 past 2^k zero bytes: [k][its low or high byte][value]."""
    low, high = np.arange(256, dtype=np.uint16), np.arange(256, dtype=np.uint16) << 8
    step = lambda c: ((c & 255) << 8) ^ _CRC16[c >> 8]
    out = [np.stack([step(low), step(high)])]
    for _ in range(16):
        last = out[-1]
        out.append(np.stack([last[0][x & 255] ^ last[1][x >> 8] for x in last]))
    return np.stack(out)


_SHIFT16 = _shift16()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of data[begin:end] for each pair: bytes first, then neighbours of ever larger halves."""
    size = end - begin
    wide = 1 << int(max(1, size.max(initial=1)) - 1).bit_length()
    at = np.arange(wide)[None, :] - (wide - size)[:, None]  # zeros in front change nothing
    c = np.where(at >= 0, _CRC16[data[np.maximum(at + begin[:, None], 0)]], np.uint16(0))
    for k in range(wide.bit_length() - 1):
        left, right = c[:, 0::2], c[:, 1::2]
        c = _SHIFT16[k, 0][left & 255] ^ _SHIFT16[k, 1][left >> 8] ^ right
    return c[:, 0]


def _utf8_number(n: int) -> bytes:
    """Frame numbers are coded as UTF-8 codes characters, up to 36 bits."""
    if n < 128:
        return bytes([n])
    tail = []
    first_bits = 6
    while n >= 1 << first_bits or not tail:
        tail.append(0x80 | n & 63)
        n >>= 6
        first_bits = 6 - len(tail)
    return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *reversed(tail)])


def _lpc(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor of each row of x (coefficients, shift) by autocorrelation and Levinson-Durbin."""
    f = x.astype(np.float32)
    auto = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : f.shape[1] - k] if k else f) for k in range(ORDER + 1)], 1).astype(np.float64)
    auto[:, 0] = auto[:, 0] * (1 + 1e-9) + 1e-3
    a, err = np.zeros((len(x), ORDER)), auto[:, 0].copy()
    for i in range(ORDER):
        k = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(axis=1)) / err
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)), 0, 15).astype(np.int64)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most - 1, most).astype(np.int32), shift


def _rice(residual: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, best Rice parameter and bits of each row."""
    z = ((residual << 1) ^ (residual >> 31)).astype(np.int32) * valid
    n = valid.sum(axis=1)
    base = np.clip(np.floor(np.log2(np.maximum(z.sum(axis=1, dtype=np.int64) / np.maximum(n, 1), 1))), 0, 13).astype(np.int64)
    best, bits = base, None
    for k in (base, np.maximum(base - 1, 0)):
        b = (z >> k[:, None]).sum(axis=1, dtype=np.int64) + n * (1 + k)
        best, bits = (k, b) if bits is None else (np.where(b < bits, k, best), np.minimum(b, bits))
    return z, best, bits


def _encode_frames(x: np.ndarray, size: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Frames of the rows of x (8-bit samples in int32, zeros behind `size`)."""
    inside = np.arange(x.shape[1])[None, :] < size[:, None]
    z0, k0, bits0 = _rice(x, inside)
    fixed, residual = np.zeros(len(x), np.int64), x
    for o in range(1, 5):  # a fixed predictor's residuals are differences of those of the order below
        residual = np.diff(residual, axis=1, prepend=np.int32(0))
        use = np.flatnonzero(size > o)
        known = inside[use]
        known[:, :o] = False
        z, k, b = _rice(residual[use], known)
        b += 8 * o
        better = b < bits0[use]
        on = use[better]
        z0[on], k0[on], bits0[on], fixed[on] = z[better], k[better], b[better], o
    valid = inside.copy()
    valid[:, :ORDER] = False
    coef, shift = _lpc(x, size)
    guess = np.zeros_like(x)
    for j in range(ORDER):
        guess[:, j + 1 :] += coef[:, j, None] * x[:, : x.shape[1] - j - 1]
    z, k, bits = _rice(x - (guess >> shift[:, None].astype(np.int32)), valid)
    bits += 8 * ORDER + 9 + ORDER * PRECISION
    own = inside & (np.arange(x.shape[1])[None, :] >= fixed[:, None])  # what a fixed predictor's residuals cover
    flat = x.max(axis=1, initial=-128, where=inside) == x.min(axis=1, initial=127, where=inside)
    # 0 constant, 1 verbatim, 2 fixed, 3 linear
    kind = np.where(flat, 0, np.where(np.minimum(bits, bits0) >= 8 * size, 1, np.where(bits0 <= bits, 2, 3)))
    heads: list[bytes] = []
    head_bits = np.zeros(len(x), np.int64)
    for i in range(len(x)):
        n = int(size[i])
        head = bytes([0xFF, 0xF8, 0xC0 if n == 4096 else 0x70, 0x02]) + _utf8_number(int(number[i])) + (b"" if n == 4096 else (n - 1).to_bytes(2, "big"))
        head += bytes([crc8(head)])
        if kind[i] == 0:
            value, width = int(x[i, 0]) & 255, 16
        elif kind[i] == 1:
            value, width = 0b00000010, 8
        elif kind[i] == 2:
            value, width = (0b001000 | int(fixed[i])) << 1, 8
            for s in x[i, : fixed[i]].tolist():
                value, width = value << 8 | s & 255, width + 8
            value, width = value << 10 | int(k0[i]), width + 10
        else:
            value, width = (0b100000 | ORDER - 1) << 1, 8
            for s in x[i, :ORDER].tolist():
                value, width = value << 8 | s & 255, width + 8
            value, width = (value << 4 | PRECISION - 1) << 5 | int(shift[i]), width + 9
            for c in coef[i].tolist():
                value, width = value << PRECISION | c & ((1 << PRECISION) - 1), width + PRECISION
            value, width = value << 10 | int(k[i]), width + 10
        head_bits[i] = 8 * len(head) + width
        heads.append(head + (value << -width % 8).to_bytes((width + 7) // 8, "big"))
    body = np.where(kind == 0, 0, np.where(kind == 1, 8 * size, np.where(kind == 2, bits0 - 8 * fixed, bits - (8 * ORDER + 9 + ORDER * PRECISION))))
    whole = (head_bits + body + 7) // 8 + 2
    begin = np.cumsum(whole) - whole
    out = np.zeros(int(whole.sum()) * 8, np.uint8)
    packed = np.unpackbits(np.frombuffer(b"".join(heads), np.uint8))
    spans = np.array([len(h) * 8 for h in heads])
    put = np.repeat(begin * 8 - (np.cumsum(spans) - spans), spans) + np.arange(len(packed))
    out[put] = packed  # bits behind a head's end are zeros and are written over
    raw = kind == 1
    if raw.any():
        for i in np.flatnonzero(raw):
            at = begin[i] * 8 + head_bits[i]
            out[at : at + 8 * size[i]] = np.unpackbits(x[i, : size[i]].astype(np.int8).view(np.uint8))
    coded = kind >= 2
    if coded.any():
        use = np.where((kind == 2)[:, None], own, valid) & coded[:, None]
        folded = np.where((kind == 2)[:, None], z0, z)[use].astype(np.int64)
        param = np.where(kind == 2, k0, k)
        per = use.sum(axis=1)
        kk = np.repeat(param, per)
        q = folded >> kk
        length = q + 1 + kk
        total = np.cumsum(length)
        first = np.cumsum(per) - per
        before = np.repeat(np.where(per > 0, np.append(0, total)[first], 0), per)
        stop = total - length - before + np.repeat(begin * 8 + head_bits, per) + q
        out[stop] = 1
        for j in range(int(kk.max(initial=0))):
            on = np.flatnonzero(kk > j)
            out[stop[on] + kk[on] - j] = folded[on] >> j & 1
    data = np.packbits(out)
    crc = crc16(data, begin, begin + whole - 2)
    data[begin + whole - 2] = crc >> 8
    data[begin + whole - 1] = crc & 255
    raw_bytes = data.tobytes()
    return [raw_bytes[b : b + n] for b, n in zip(begin.tolist(), whole.tolist(), strict=True)]


def _groups(size: np.ndarray) -> Iterator[np.ndarray]:
    """Frames of like sizes together, SAMPLES at a time."""
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        j = i + max(1, SAMPLES // max(1, int(size[order[i]])))
        while j > i + 1 and (min(j, len(order)) - i) * int(size[order[min(j, len(order)) - 1]]) > SAMPLES:
            j = i + (j - i) // 2
        yield order[i:j]
        i = j


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload's bytes as 8-bit samples; payloads have 16 bytes or more."""
    data = _SAMPLE[np.frombuffer(b"".join(payloads), np.uint8)].astype(np.int16)
    total = np.array([len(p) for p in payloads], np.int64)
    frames = -(-total // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    first = (np.cumsum(total) - total)[owner] + number * BLOCK
    size = np.minimum(BLOCK, total[owner] - number * BLOCK)
    coded: list[bytes] = [b""] * len(owner)
    for rows in _groups(size):
        cols = np.arange(int(size[rows].max()))
        at = first[rows][:, None] + cols[None, :]
        x = np.where(cols[None, :] < size[rows][:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.int32)
        for r, frame in zip(rows.tolist(), _encode_frames(x, size[rows], number[rows]), strict=True):
            coded[r] = frame
    out, f = [], 0
    for i, payload in enumerate(payloads):
        own = coded[f : f + frames[i]]
        f += int(frames[i])
        lengths = [len(c) for c in own]
        samples = _SAMPLE[np.frombuffer(payload, np.uint8)].tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(samples).digest()
        points, offset = b"", 0
        for n, length in enumerate(lengths):
            points += (n * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, len(payload) - n * BLOCK).to_bytes(2, "big")
            offset += length
        table = b"\x02" + (len(TABLE_ID) + len(FREQUENT)).to_bytes(3, "big") + TABLE_ID + FREQUENT
        out.append(b"fLaC" + b"\x00\x00\x00\x22" + info + table + bytes([0x83]) + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


def _layout(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], bytes]:
    """Total samples, MD5, (first sample, begin, end) of each frame, and the frequent bytes, from the metadata."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5, points, frequent = 4, False, 0, b"", None, FREQUENT
    while not last:
        last, kind, size = stream[at] >> 7 == 1, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            total, md5 = packed & (1 << 36) - 1, block[18:34]
            if packed >> 36 & 31 != 7 or packed >> 41 & 7:
                raise ValueError("one channel of 8 bits is asked for")
        elif kind == 2 and block[:4] == TABLE_ID:
            frequent = bytes(block[4:])
        elif kind == 3:
            points = [(int.from_bytes(block[i : i + 8], "big"), int.from_bytes(block[i + 8 : i + 16], "big")) for i in range(0, size, 18)]
            points = [p for p in points if p[0] != (1 << 64) - 1]
        at += 4 + size
    if points is None:
        raise ValueError("a seek table of all frames is asked for")
    ends = [at + o for _, o in points[1:]] + [len(stream)]
    return total, md5, [(s, at + o, e) for (s, o), e in zip(points, ends, strict=True)], frequent


class _Bits:
    """Windows of 57 bits or more at any bit of some bytes."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data + bytes(16), np.uint8).astype(np.uint64)
        n = len(b) - 8
        self.word = np.zeros(n, np.uint64)
        for k in range(8):
            self.word |= b[k : k + n] << np.uint64(56 - 8 * k)

    def peek(self, at: np.ndarray) -> np.ndarray:
        return self.word[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.peek(at) >> np.uint64(64 - n)).astype(np.int64)


_ZEROS = np.full(1 << 16, 16, np.int64)
_ZEROS[1:] = 15 - np.floor(np.log2(np.arange(1, 1 << 16))).astype(np.int64)


def _signed(v: np.ndarray, bits: int) -> np.ndarray:
    return (v ^ 1 << bits - 1) - (1 << bits - 1)


def _decode_frames(data: bytes, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (a column per frame) and sizes of frames, whose checksums and numbers must hold."""
    raw = np.frombuffer(data, np.uint8)
    stored = raw[end - 2].astype(np.uint16) << 8 | raw[end - 1]
    if (crc16(raw, begin, end - 2) != stored).any():
        raise ValueError("a frame's CRC-16 is wrong")
    lanes = len(begin)
    size, at = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for i in range(lanes):
        b = int(begin[i])
        if data[b] != 0xFF or data[b + 1] != 0xF8 or data[b + 3] != 0x02:
            raise ValueError("not a frame of one 8-bit channel in blocks of one size")
        code, p = data[b + 2] >> 4, b + 4
        lead = data[p]
        ones = 8 - (lead ^ 0xFF).bit_length()
        number, p = (lead, p + 1) if lead < 128 else (lead & (1 << 7 - ones) - 1, p + 1)
        for _ in range(max(0, ones - 1)):
            number, p = number << 6 | data[p] & 63, p + 1
        if code == 6:
            size[i], p = data[p] + 1, p + 1
        elif code == 7:
            size[i], p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
        else:
            size[i] = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
        if crc8(data[b:p]) != data[p]:
            raise ValueError("a frame header's CRC-8 is wrong")
        if number * BLOCK != first[i]:
            raise ValueError("a frame's number isn't that of its first sample")
        at[i] = (p + 1) * 8
    bits = _Bits(data)
    kind = bits.take(at, 8) >> 1
    at += 8
    linear, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    order = np.where(linear, kind - 31, np.where(fixed, kind - 8, 0))
    long = int(size.max(initial=0))
    out = np.zeros((long + 32, lanes), np.int32)  # 32 rows of history in front
    coef, shift = np.zeros((32, lanes), np.int32), np.zeros(lanes, np.int32)
    for t in range(int(order.max(initial=0))):
        on = np.flatnonzero(order > t)
        out[32 + t, on] = _signed(bits.take(at[on], 8), 8)
        at[on] += 8
    for o in range(1, 5):
        for j, c in enumerate(FIXED[o]):
            coef[j, fixed & (order == o)] = c
    on = np.flatnonzero(linear)
    if len(on):
        precision = bits.take(at[on], 4) + 1
        shift[on] = bits.take(at[on] + 4, 5)
        at[on] += 9
        for j in range(int(order[on].max())):
            has = order[on] > j
            v = (bits.peek(at[on]) >> (64 - precision).astype(np.uint64)).astype(np.int64)
            coef[j, on[has]] = ((v ^ 1 << precision - 1) - (1 << precision - 1))[has]
            at[on[has]] += precision[has]
    for i in np.flatnonzero(kind == 0):
        out[32 : 32 + size[i], i] = _signed(bits.take(at[i : i + 1], 8), 8)[0]
    for i in np.flatnonzero(kind == 1):
        p, n = int(at[i]), int(size[i])
        piece = np.unpackbits(raw[p >> 3 : (p >> 3) + n + 1])[p & 7 :][: 8 * n]
        out[32 : 32 + n, i] = np.packbits(piece).view(np.int8)
    on = np.flatnonzero(linear | fixed)
    if len(on):
        _residuals(bits, at, size, order, on, out)
        _restore(out, coef, shift, order, size, long)
    return out[32:], size


def _residuals(bits: _Bits, at: np.ndarray, size: np.ndarray, order: np.ndarray, on: np.ndarray, out: np.ndarray) -> None:
    """Read the Rice-coded residuals of frames `on` into out, each behind its first `order` samples."""
    pos, n, lag = at[on], size[on], order[on]
    method, parts = bits.take(pos, 2), 1 << bits.take(pos + 2, 4)
    pos = pos + 6
    width = 4 + method
    k, left, per = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64), n // parts
    started = np.zeros(len(on), bool)
    flat, columns = out.reshape(-1), out.shape[1]
    where = (32 + lag) * columns + on
    stop = n - lag
    least, ends = int(stop.min(initial=0)), 0
    for i in range(int(stop.max(initial=0))):
        if i == ends:  # a partition begins somewhere: read its parameter
            f = np.flatnonzero((left == i) & (i < stop))
            k[f] = (bits.peek(pos[f]) >> (64 - width[f]).astype(np.uint64)).astype(np.int64)
            if (k[f] == (1 << width[f]) - 1).any():
                raise ValueError("residuals without Rice codes aren't read")
            pos[f] += width[f]
            left[f] += per[f] - np.where(started[f], 0, lag[f])
            started[f] = True
            ends = int(left[left > i].min(initial=1 << 40))
            low_shift = (63 - k).astype(np.uint64)
        window = bits.peek(pos)
        zeros = _ZEROS[window >> np.uint64(48)]
        if (zeros == 16).any():  # a long prefix
            more = np.flatnonzero(zeros == 16)
            while len(more):
                step = _ZEROS[(bits.peek(pos[more] + zeros[more]) >> np.uint64(48))]
                zeros[more] += step
                more = more[(step == 16) & (zeros[more] < 1 << 20) & (i < stop[more])]
            low = bits.peek(pos + zeros + 1) >> np.uint64(1) >> low_shift
        else:
            low = window << (zeros + 1).astype(np.uint64) >> np.uint64(1) >> low_shift
        z = zeros << k | low.astype(np.int64)
        z = z >> 1 ^ -(z & 1)
        zeros += k + 1
        if i < least:
            flat[where] = z
            pos += zeros
        else:
            live = i < stop
            flat[where[live]] = z[live]
            pos += np.where(live, zeros, 0)
        where += columns


def _restore(out: np.ndarray, coef: np.ndarray, shift: np.ndarray, order: np.ndarray, size: np.ndarray, long: int) -> None:
    """Add predictions to residuals, a row at a time."""
    most = int(order.max(initial=0))
    if not most:
        return
    turned = coef[:most][::-1]
    for t in range(1, long):
        guess = np.einsum("ij,ij->j", turned, out[32 + t - most : 32 + t]) >> shift
        if t < most:
            guess = np.where(t >= order, guess, 0)
        out[32 + t] += guess


def decode(streams: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Samples of each stream as bytes, with (first sample, samples) of its blocks; checksums and MD5 are verified."""
    data = b"".join(streams)
    base, frames, totals, tables = 0, [], [], []
    for i, stream in enumerate(streams):
        total, md5, layout, frequent = _layout(stream)
        totals.append((total, md5))
        tables.append(_tables(frequent))
        frames += [(i, s, base + b, base + e) for s, b, e in layout]
        base += len(stream)
    owner, first, begin, end = (np.array(x, np.int64) for x in zip(*frames, strict=True)) if frames else (np.zeros(0, np.int64),) * 4
    payloads = [bytearray(t) for t, _ in totals]
    blocks: list[list[tuple[int, int]]] = [[] for _ in streams]
    sizes = np.zeros(len(frames), np.int64)
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    expected = np.where(last, np.array([t for t, _ in totals], np.int64)[owner] - first, BLOCK) if len(owner) else sizes
    for rows in _groups(expected):
        samples, size = _decode_frames(data, begin[rows], end[rows], first[rows])
        sizes[rows] = size
        turned = np.ascontiguousarray(samples.astype(np.int8).view(np.uint8).T)
        for k, r in enumerate(rows.tolist()):
            payloads[owner[r]][first[r] : first[r] + size[k]] = tables[owner[r]][1][turned[k, : size[k]]].tobytes()
    for i, s, n in zip(owner.tolist(), first.tolist(), sizes.tolist(), strict=True):
        blocks[i].append((s, n))
    out = []
    for payload, own, (total, md5), (sample, _) in zip(payloads, blocks, totals, tables, strict=True):
        if len(payload) != total or hashlib.md5(sample[np.frombuffer(payload, np.uint8)].tobytes()).digest() != md5:
            raise ValueError("the samples don't have the stream's MD5 or length")
        out.append((bytes(payload), own))
    return out


def read_samples(stream: bytes, first: int, n: int) -> bytes:
    """Bytes [first, first + n) of the payload: only the frames that hold them are decoded, found by the seek table."""
    total, _, layout, frequent = _layout(stream)
    frames = [f for f in layout if f[0] < min(first + n, total) and f[0] + BLOCK > first]
    if not frames or n <= 0:
        return b""
    at, begin, end = (np.array(x, np.int64) for x in zip(*frames, strict=True))
    samples, size = _decode_frames(stream, begin, end, at)
    own = np.concatenate([samples[: size[i], i] for i in range(len(frames))])
    return _tables(frequent)[1][own.astype(np.int8).view(np.uint8)].tobytes()[max(first, 0) - frames[0][0] :][: n + min(first, 0)]


def payload_of(text: bytes) -> bytes:
    """A text's bytes with zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def feature(payload: bytes) -> str:
    """Integer statistics of the samples: sum, energy, sign changes, least and most."""
    x = _SAMPLE[np.frombuffer(payload, np.uint8)].astype(np.int64)
    sign = x >= 0
    return f"sum={x.sum()};energy={(x * x).sum()};crossings={(sign[1:] != sign[:-1]).sum()};min={x.min()};max={x.max()}"


def _batches(column: pa.Array, most: int = SAMPLES) -> Iterator[tuple[int, list[bytes]]]:
    values, lo, held, size = column, 0, [], 0
    for i in range(len(values)):
        v = values[i].as_buffer()
        v = v.to_pybytes() if v is not None else b""
        if held and size + len(v) > most:
            yield lo, held
            lo, held, size = i, [], 0
        held.append(v)
        size += len(v)
    if held:
        yield lo, held


def _gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches put together up to SAMPLES bytes of a column, as more frames side by side take less time each."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= SAMPLES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()[:1]


def encode_column(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_bytes, media): the text's UTF-8 bytes, padded with zeros to a positive multiple of 64."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in _gathered(batches, "text"):
            for lo, texts in _batches(batch.column("text").cast(pa.large_binary())):
                media = encode([payload_of(t) for t in texts])
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(lo, len(texts)), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array(media, pa.binary())})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame, blocks: bool = False) -> DataFrame:
    """Digests and features of media(doc_id, n_bytes, media), all from the decoded bytes; with `blocks`, these, too.

    blocks(first_sample, n_samples, pcm): the payload in PCM blocks that can be read on their own. A null or empty text has a
    payload of 64 zeros; long ones have as many frames and blocks as it takes; equal texts have equal values; repeated rows stay
    repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in _gathered(batches, "media"):
            for lo, streams in _batches(batch.column("media")):
                read = decode(streams)
                own = [payload for payload, _ in read]
                out = {
                    "doc_id": batch.column("doc_id").slice(lo, len(read)), "n_bytes": batch.column("n_bytes").slice(lo, len(read)),
                    "payload_bytes": pa.array([len(p) for p in own], pa.int64()), "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in own], pa.string()),
                    "tail_crc32": pa.array([zlib.crc32(p[-64:]) for p in own], pa.int64()), "media_bytes": pa.array([len(s) for s in streams], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(s).hexdigest() for s in streams]), "feature": pa.array([feature(p) for p in own], pa.string()),
                }
                if blocks:
                    first, n, pcm = zip(*((s, n, payload[s : s + n]) for payload, parts in read for s, n in parts), strict=True)
                    parts = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(pcm, pa.binary())], ["first_sample", "n_samples", "pcm"])
                    out["blocks"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(b) for _, b in read)]), pa.int32()), parts)
                yield pa.record_batch(out)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", blocks array<struct<first_sample:bigint,n_samples:bigint,pcm:binary>>" if blocks else ""
    return mapped(media.select("doc_id", "n_bytes", "media"), run, schema)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, first_sample, n_samples, pcm) of each block of media(doc_id, n_bytes, media): blocks can be read on their own."""
    return media_features(media, blocks=True).select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")


def archive_media(docs: DataFrame) -> DataFrame:
    """media_features of docs(doc_id, text) with their PCM blocks, decoded from streams that were written to the shared folder
    (flac-streams: doc_id, n_bytes, media; they stay there) and read back. The blocks are written with the result.

    A null text is an empty one, of 64 zero bytes; texts of any length are stored whole, frame by frame. Repeated rows stay repeated,
    a null doc_id stays null, other columns are ignored, and an empty table gives no rows.
    """
    return media_features(kept(encode_column(docs), "flac-streams"), blocks=True)
