"""FLAC media columns: vectorised encoding, decoding with checksum verification, and seekable PCM blocks.

The kernels run all frames of a batch side by side ("lanes"): step i handles sample i of every frame, so a
sample costs a few numpy operations on long columns. The writer makes frames of 192 mono samples of 8 bits
with the cheapest of constant, verbatim, fixed (order 0 to 4) and linear prediction (order 4), residuals as
Rice codes, a seek table, and the MD5 of the samples. The fast reader takes such streams with any of these
subframes, partitions and escapes; streams of other block sizes, channels or sample sizes go through a
plain reader of the same format. Both check CRC-8 of every header, CRC-16 of every frame and the MD5.

Texts become samples by their UTF-8 bytes less 128, padded with blanks to a positive multiple of 192.

Defined cases: a null text is an empty one (one frame of blanks); null or repeated ids are carried along;
very long texts are one stream each; other columns of the input are not read; null media give null results; a
broken checksum raises ValueError; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.text_kernels import batches_by_bytes, text_buffers

#: Samples of a frame, frames between seek points, frames handled at once, order and precision of linear prediction.
BLOCK, SEEK_FRAMES, LANES, LPC_ORDER, LPC_BITS = 192, 32, 1 << 13, 4, 12
RATE = 8000
#: Fixed values of the format: coefficients of the fixed predictors, by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
U64, U32 = np.uint64, np.uint32


def _crc_table(poly: int, width: int) -> np.ndarray:
    """Remainders of all values of width bits followed by width zero bits."""
    t = np.arange(1 << width, dtype=np.uint32)
    for _ in range(width):
        t = np.where(t >> (width - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << width) - 1)
    return t


CRC8 = _crc_table(0x07, 8)
CRC16 = _crc_table(0x8005, 16)


def _crc16_bytes(data: bytes) -> int:
    data = b"\0" * (len(data) % 2) + data
    c = 0
    for w in np.frombuffer(data, ">u2").tolist():
        c = int(CRC16[c ^ w])
    return c


def _crc8_bytes(data: bytes) -> int:
    c = 0
    for x in data:
        c = int(CRC8[c ^ x])
    return c


def crc16_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each span of bytes; zeros in front of a span don't change it."""
    longest = int((ends - starts).max(initial=0))
    longest += longest % 2
    at = ends[None, :] - longest + np.arange(longest)[:, None]
    rows = np.where(at >= starts[None, :], data[np.maximum(at, 0)], 0).astype(np.uint32)
    crc = np.zeros(len(starts), np.uint32)
    for i in range(0, longest, 2):
        crc = CRC16[crc ^ (rows[i] << 8 | rows[i + 1])]
    return crc


class _Bits:
    """Appends bit fields to many lanes at once."""

    def __init__(self, lanes: int, words: int):
        self.out = np.zeros((lanes, words), U32)
        self.held, self.n, self.at, self.rows = np.zeros(lanes, U64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.arange(lanes)

    def put(self, value, length) -> None:
        """length: at most 32, a number or one for each lane; 0 leaves a lane as it is."""
        self.held = (self.held << np.asarray(length).astype(U64)) | np.asarray(value).astype(U64)
        self.n = self.n + length
        full = np.flatnonzero(self.n >= 32)
        if len(full):
            rest = self.n[full] - 32
            self.out[full, self.at[full]] = (self.held[full] >> rest.astype(U64)).astype(U32)
            self.held[full] &= (U64(1) << rest.astype(U64)) - U64(1)
            self.at[full] += 1
            self.n[full] = rest

    def rows_of_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes by lane, bytes used in each lane); lanes are filled up to whole bytes."""
        self.put(np.zeros(len(self.n), U64), -self.n % 8)
        used = self.at * 4 + self.n // 8
        left = self.n > 0
        self.out[self.rows[left], self.at[left]] = (self.held[left] << (32 - self.n[left]).astype(U64)).astype(U32)
        return self.out.astype(">u4").view(np.uint8).reshape(len(self.n), -1), used


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 31)


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (order, lanes) and shifts of linear prediction, from exact autocorrelations."""
    wide = x.astype(np.int64)
    r = np.stack([(wide[k:] * wide[: len(x) - k]).sum(0) for k in range(LPC_ORDER + 1)]).astype(float)
    a = np.zeros((LPC_ORDER, x.shape[1]))
    error = np.where(r[0] > 0, r[0] * (1 + 2.0**-30), 1.0)
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum((a[j] * r[i - j] for j in range(i)), np.zeros(x.shape[1]))) / error
        old = a.copy()
        a[i] = k
        for j in range(i):
            a[j] = old[j] - k * old[i - 1 - j]
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(0), 1e-6)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
    limit = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * 2.0**shift), -limit, limit).astype(np.int32), shift.astype(np.int32)


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of samples (BLOCK, lanes): (bytes of all frames one after another, offset of each and the end)."""
    lanes = samples.shape[1]
    x = samples.astype(np.int32)
    best_bits = np.full(lanes, 8 * BLOCK, np.int64)
    kind, order, rice = np.ones(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    codes = np.zeros((BLOCK, lanes), np.int32)
    coefficients, shift = _linear(x)
    residual = x
    for candidate in range(6):
        if candidate < 5:
            p, own, extra = candidate, 8 + candidate, 8 * candidate + 10
            if candidate:
                residual = residual[1:] - residual[:-1]
        else:
            p, own, extra = LPC_ORDER, 31 + LPC_ORDER, 8 * LPC_ORDER + 19 + LPC_BITS * LPC_ORDER
            guess = sum(coefficients[j] * x[LPC_ORDER - 1 - j : BLOCK - 1 - j] for j in range(LPC_ORDER))
            residual = x[LPC_ORDER:] - (guess >> shift)
        u = _zigzag(residual)
        n = BLOCK - p
        mean = u.sum(0, dtype=np.int64) / n
        k0 = np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1))).astype(np.int64), 0, 13)
        for k in (k0, k0 + 1):
            bits = extra + n * (1 + k) + (u >> k.astype(np.int32)).sum(0, dtype=np.int64)
            win = bits < best_bits
            best_bits[win], kind[win], order[win], rice[win] = bits[win], own, p, k[win]
            if win.any():
                codes[p:, win] = u[:, win]
    constant = (x == x[0]).all(0)
    kind[constant] = 0
    order[constant] = 0
    coded = kind >= 8
    out = _Bits(lanes, (8 * BLOCK + 200) // 32 + 4)
    number = numbers.astype(np.int64)
    length = 1 + (number >= 0x80) + (number >= 0x800) + (number >= 0x10000) + (number >= 0x200000) + (number >= 0x4000000)
    lead = np.where(length == 1, number, ((0xFF00 >> length) & 0xFF) | number >> (6 * (length - 1)))
    header = [np.full(lanes, 0xFF), np.full(lanes, 0xF8), np.full(lanes, 0x14), np.full(lanes, 0x02), lead]
    crc = np.zeros(lanes, np.int64)
    for b in header:
        out.put(b, 8)
        crc = CRC8[crc ^ b].astype(np.int64)
    for j in range(4, -1, -1):
        has = length > j + 1
        b = np.where(has, 0x80 | number >> (6 * j) & 0x3F, 0)
        out.put(b, 8 * has)
        crc = np.where(has, CRC8[crc ^ b], crc)
    out.put(crc, 8)
    out.put(kind << 1, 8)
    low = (x & 0xFF).astype(np.int64)
    out.put(np.where(constant, low[0], 0), 8 * constant)
    for j in range(LPC_ORDER):
        has = coded & (order > j)
        out.put(np.where(has, low[j], 0), 8 * has)
    linear = kind >= 32
    out.put(np.where(linear, (LPC_BITS - 1) << 5 | shift, 0), 9 * linear)
    for j in range(LPC_ORDER):
        out.put(np.where(linear, coefficients[j] & ((1 << LPC_BITS) - 1), 0), LPC_BITS * linear)
    wide = rice > 14
    out.put(np.where(coded, np.where(wide, 1, 0) << 4, 0), 6 * coded)
    out.put(np.where(coded, rice, 0), np.where(coded, np.where(wide, 5, 4), 0))
    verbatim = kind == 1
    mask = (1 << rice) - 1
    for i in range(BLOCK):
        on = coded & (i >= order)
        u = codes[i].astype(np.int64)
        q = np.where(on, u >> rice, 0)
        while (q > 16).any():
            z = np.where(q > 16, 16, 0)
            out.put(np.zeros(lanes, U64), z)
            q -= z
        out.put(np.where(on, 1 << rice | u & mask, np.where(verbatim, low[i], 0)), np.where(on, q + 1 + rice, 8 * verbatim))
    rows, used = out.rows_of_bytes()
    ends = np.cumsum(used)
    width = int(used.max(initial=0)) + 2
    inside = np.arange(width)[None, :] < used[:, None]
    crc = crc16_lanes(rows[:, :width][inside], ends - used, ends)
    lane = np.arange(lanes)
    rows[lane, used], rows[lane, used + 1] = crc >> 8, crc & 0xFF
    used = used + 2
    return rows[:, :width][np.arange(width)[None, :] < used[:, None]], np.concatenate([[0], np.cumsum(used)])


def _stream(frames: bytes, sizes: np.ndarray, samples: bytes) -> bytes:
    """A whole FLAC stream of encoded frames of one text."""
    points = range(0, len(sizes), SEEK_FRAMES)
    at = np.concatenate([[0], np.cumsum(sizes)])
    table = b"".join(struct.pack(">QQH", k * BLOCK, int(at[k]), BLOCK) for k in points)
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(samples).digest()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + frames


def padded(text: bytes) -> bytes:
    """The payload: blanks up to a positive multiple of the block."""
    return text + b" " * (-len(text) % BLOCK or (0 if text else BLOCK))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, each a positive multiple of the block long."""
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    parts, sizes = [], []
    for lo in range(0, len(data), LANES):
        part, offsets = encode_frames(data[lo : lo + LANES].T.astype(np.int32) - 128, numbers[lo : lo + LANES])
        parts.append(part)
        sizes.append(np.diff(offsets))
    whole, sizes = np.concatenate(parts).tobytes(), np.concatenate(sizes)
    at = np.concatenate([[0], np.cumsum(sizes)])
    signed = (data ^ 0x80).tobytes()
    return [_stream(whole[at[a] : at[b]], sizes[a:b], signed[a * BLOCK : b * BLOCK]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def stream_info(data: bytes) -> dict:
    """Stream parameters, seek points and the place of the first frame."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, out = 4, {"seek": []}
    while True:
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            v = int.from_bytes(body[10:18], "big")
            out |= {"blocks": struct.unpack(">HH", body[:4]), "rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "samples": v & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = [x for x in struct.iter_unpack(">QQH", body) if x[0] != 2**64 - 1]
        at += 4 + size
        if last:
            return out | {"frames": at}


def decode_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Samples (BLOCK, lanes) of frames of 192 mono samples of 8 bits, after their checksums."""
    lanes = len(starts)
    if crc16_lanes(data, starts, ends).any():
        raise ValueError("a frame fails its CRC-16")
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    window = np.lib.stride_tricks.sliding_window_view(room, 8).copy().view(">u8").ravel().astype(U64)
    lead = data[starts + 4].astype(np.int64)
    pos = (starts + 4 + np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, np.where(lead < 0xFC, 5, 6))))) + 1) * 8

    def peek(n):
        """The next n bits (1 to 57) of each lane."""
        return ((window[pos >> 3] << (pos & 7).astype(U64)) >> (U64(64) - np.asarray(n).astype(U64))).astype(np.int64)

    def signed(v, n):
        return v - ((v >> (n - 1) & 1) << n)

    head = peek(8)
    pos = pos + 8
    kind, bad = head >> 1, (head & 0x81) != 0
    linear, fixed, verbatim, constant = kind >= 32, (kind >= 8) & (kind <= 12), kind == 1, kind == 0
    if (bad | ~(linear | fixed | verbatim | constant)).any():
        raise ValueError("wasted bits or a reserved subframe")
    order = np.where(linear, kind - 31, np.where(fixed, kind - 8, 0))
    coded = linear | fixed
    x = np.zeros((BLOCK, lanes), np.int64)
    same = signed(peek(8), 8)
    pos = pos + 8 * constant
    most = int(order.max(initial=0))
    for j in range(most):
        has = coded & (order > j)
        x[j] = np.where(has, signed(peek(8), 8), 0)
        pos = pos + 8 * has
    weights, shift = np.zeros((most, lanes), np.int64), np.zeros(lanes, np.int64)
    for p in range(1, min(4, most) + 1):
        for j, c in enumerate(FIXED[p]):
            weights[j][fixed & (order == p)] = c
    if linear.any():
        v = peek(9)
        precision, shift = np.where(linear, (v >> 5) + 1, 1), np.where(linear, v & 31, 0)
        pos = pos + 9 * linear
        if (linear & (shift > 15)).any():
            raise ValueError("a negative shift")
        for j in range(most):
            has = linear & (order > j)
            c = signed(peek(precision), precision)
            weights[j] = np.where(has, c, weights[j])
            pos = pos + np.where(has, precision, 0)
    v = peek(6)
    pos = pos + 6 * coded
    wide, partition = np.where(coded, v >> 4, 0), np.where(coded, v & 15, 0)
    if (wide > 1).any() or (BLOCK % (1 << partition)).any():
        raise ValueError("a reserved residual coding")
    size = BLOCK >> partition
    several = bool(partition.any())
    rice, raw = np.zeros(lanes, np.int64), np.full(lanes, -1, np.int64)
    for i in range(BLOCK):
        on = coded & (i >= order)
        begin = coded & (i == order)
        if several:
            begin |= on & (i % size == 0)
        if begin.any():
            n = 4 + wide
            v = peek(n)
            pos = pos + np.where(begin, n, 0)
            escape = begin & (v == (1 << n) - 1)
            rice = np.where(begin, v, rice)
            raw = np.where(begin, -1, raw)
            if escape.any():
                raw = np.where(escape, peek(5), raw)
                pos = pos + 5 * escape
        w = window[pos >> 3] << (pos & 7).astype(U64)
        top = (w >> U64(32)).astype(np.float64)
        plain = on & (raw < 0)
        q = np.zeros(lanes, np.int64)
        while (long := plain & (top == 0)).any():
            pos = pos + 32 * long
            q += 32 * long
            w = window[pos >> 3] << (pos & 7).astype(U64)
            top = np.where(long, (w >> U64(32)).astype(np.float64), top)
        zeros = 31 - ((np.maximum(top, 1).view(np.int64) >> 52) - 1023)
        q += zeros
        step = np.where(plain, zeros + 1, 0)
        pos = pos + step
        n = np.where(plain, rice, 0)
        w = window[pos >> 3] << (pos & 7).astype(U64)
        u = (q << n) | ((w >> U64(1)) >> (U64(63) - n.astype(U64))).astype(np.int64)
        r = (u >> 1) ^ -(u & 1)
        pos = pos + n
        if (raw >= 0).any():
            n = np.where(on & (raw > 0), raw, 0)
            v = peek(np.maximum(n, 1))
            r = np.where(raw >= 0, np.where(n > 0, signed(v, np.maximum(n, 1)), 0), r)
            pos = pos + n
        if verbatim.any():
            r = np.where(verbatim, signed(peek(8), 8), r)
            pos = pos + 8 * verbatim
        if most:
            guess = np.zeros(lanes, np.int64)
            for j in range(min(i, most)):
                guess += weights[j] * x[i - 1 - j]
            r = np.where(on, r + (guess >> shift), r)
        x[i] = np.where(constant, same, np.where(on | verbatim, r, x[i]))
    if ((pos + 7 >> 3) + 2 != ends).any():
        raise ValueError("a frame does not end where its codes end")
    return x


def find_frames(data: bytes, info: dict) -> np.ndarray | None:
    """Places of the frames of a stream in the writer's form, or None where the plain reader must walk it.

    Sync codes with a right CRC-8 and the next frame number are taken; the frames' CRC-16 then confirm them.
    """
    if info["blocks"] != (BLOCK, BLOCK) or info["channels"] != 1 or info["bits"] != 8 or info["samples"] % BLOCK or not info["samples"]:
        return None
    at, n, out = info["frames"], info["samples"] // BLOCK, []
    mark = data[at : at + 4]
    if mark[:2] != b"\xff\xf8" or mark[2] >> 4 != 1:
        return None
    while len(out) < n:
        k = len(out)
        coded = chr(k).encode("utf-8", "surrogatepass") if k < 0x110000 else None
        if coded is None:
            return None
        head = mark + coded
        head += bytes([_crc8_bytes(head)])
        at = data.find(head, at)
        if at < 0:
            return None
        out.append(at)
        at += len(head)
    return np.array(out)


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """Unsigned 8-bit samples of each stream, all checksums verified."""
    infos = [stream_info(s) for s in streams]
    places = [find_frames(s, i) for s, i in zip(streams, infos, strict=True)]
    fast = [k for k, p in enumerate(places) if p is not None]
    out: list = [None] * len(streams)
    base = np.cumsum([0, *(len(streams[k]) for k in fast)])
    if fast:
        data = np.frombuffer(b"".join(streams[k] for k in fast), np.uint8)
        starts = np.concatenate([places[k] + b for k, b in zip(fast, base, strict=False)])
        ends = np.concatenate([np.append(places[k][1:], len(streams[k])) + b for k, b in zip(fast, base, strict=False)])
        made = []
        for lo in range(0, len(starts), LANES):
            s, e = starts[lo : lo + LANES], ends[lo : lo + LANES]
            made.append((decode_lanes(data[s[0] : e[-1]], s - s[0], e - s[0]).T + 128).astype(np.uint8).tobytes())
        whole, at = b"".join(made), 0
        for k in fast:
            out[k] = whole[at : at + infos[k]["samples"]]
            at += infos[k]["samples"]
    for k, info in enumerate(infos):
        if out[k] is None:
            samples = decode_plain(streams[k], info)
            if info["bits"] != 8 or info["channels"] != 1:
                raise ValueError("only mono streams of 8 bits hold bytes")
            out[k] = bytes(v + 128 for v in samples[0])
        if any(info["md5"]) and hashlib.md5((np.frombuffer(out[k], np.uint8) ^ 0x80).tobytes()).digest() != info["md5"]:
            raise ValueError("the samples fail the stream's MD5")
    return out


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.pos = data, 8 * at

    def bits(self, n: int) -> int:
        if not n:
            return 0
        lo, hi = self.pos >> 3, self.pos + n + 7 >> 3
        v = int.from_bytes(self.data[lo:hi], "big") >> (8 * hi - self.pos - n) & (1 << n) - 1
        self.pos += n
        return v

    def signed(self, n: int) -> int:
        v = self.bits(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.bits(1):
            n += 1
        return n


def plain_frame(data: bytes, at: int, info: dict) -> tuple[int, list[list[int]], int]:
    """(first sample, samples by channel, end) of the frame at a place; any block size, channels and sample size."""
    r = _Reader(data, at)
    if r.bits(15) != 0x7FFC:
        raise ValueError(f"no frame at {at}")
    variable = r.bits(1)
    size_code, rate_code, assignment, depth_code, _ = r.bits(4), r.bits(4), r.bits(4), r.bits(3), r.bits(1)
    lead = r.bits(8)
    more = max(0, 7 - (~lead & 0xFF).bit_length()) if lead >= 0xC0 else 0
    number = lead if not more else lead & (0x3F >> more)
    for _ in range(more):
        number = number << 6 | r.bits(8) & 0x3F
    size = 192 if size_code == 1 else 576 << (size_code - 2) if 2 <= size_code <= 5 else r.bits(8) + 1 if size_code == 6 else r.bits(16) + 1 if size_code == 7 else 256 << (size_code - 8)
    r.bits({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    if _crc8_bytes(data[at : r.pos >> 3]) != r.bits(8):
        raise ValueError(f"the header of the frame at {at} fails its CRC-8")
    depth = {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth_code]
    channels = []
    for c in range(assignment + 1 if assignment < 8 else 2):
        side = (assignment, c) in ((8, 1), (9, 0), (10, 1))
        channels.append(_plain_subframe(r, size, depth + side))
    r.pos += -r.pos % 8
    end = r.pos >> 3
    if _crc16_bytes(data[at:end]) != r.bits(16):
        raise ValueError(f"the frame at {at} fails its CRC-16")
    if assignment >= 8:
        a, b = channels
        if assignment == 8:
            channels = [a, [x - y for x, y in zip(a, b, strict=True)]]
        elif assignment == 9:
            channels = [[x + y for x, y in zip(a, b, strict=True)], b]
        else:
            mid = [x << 1 | y & 1 for x, y in zip(a, b, strict=True)]
            channels = [[m + y >> 1 for m, y in zip(mid, b, strict=True)], [m - y >> 1 for m, y in zip(mid, b, strict=True)]]
    return number if variable else number * info["blocks"][0], channels, end + 2


def _plain_subframe(r: _Reader, size: int, depth: int) -> list[int]:
    r.bits(1)
    kind, wasted = r.bits(6), 0
    if r.bits(1):
        wasted = r.unary() + 1
    depth -= wasted
    if kind == 0:
        x = [r.signed(depth)] * size
    elif kind == 1:
        x = [r.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        x = [r.signed(depth) for _ in range(order)]
        weights, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision, shift = r.bits(4) + 1, r.signed(5)
            weights = [r.signed(precision) for _ in range(order)]
        width, partitions = 4 + r.bits(2), r.bits(4)
        for p in range(1 << partitions):
            k = r.bits(width)
            raw = r.bits(5) if k == (1 << width) - 1 else None
            for _ in range((size >> partitions) - (order if p == 0 else 0)):
                if raw is None:
                    u = r.unary() << k | r.bits(k)
                    e = u >> 1 ^ -(u & 1)
                else:
                    e = r.signed(raw)
                x.append(e + (sum(w * v for w, v in zip(weights, reversed(x), strict=False)) >> shift))
    else:
        raise ValueError(f"reserved subframe {kind}")
    return [v << wasted for v in x]


def decode_plain(data: bytes, info: dict | None = None, first: int = 0, last: int | None = None) -> list[list[int]]:
    """Samples first to last-1 by channel, walking from the nearest seek point."""
    info = info or stream_info(data)
    last = info["samples"] if last is None else last
    at = info["frames"] + max((x[1] for x in info["seek"] if x[0] <= first), default=0)
    out: list[list[int]] = [[] for _ in range(info["channels"])]
    while at < len(data) and len(out[0]) < last - first:
        begin, channels, at = plain_frame(data, at, info)
        for c, got in zip(out, channels, strict=True):
            c += got[max(0, first - begin) : max(0, last - begin)]
    return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id, n_bytes, media): the texts' bytes as FLAC streams."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches_by_bytes(batches, "t", 3 << 19):
            data, off = text_buffers(b.column(1))
            whole = data.tobytes()
            payloads = [padded(whole[x:y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off), pa.int64()), pa.array(encode_payloads(payloads), pa.binary())], ["i", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, n_bytes long, media binary").withColumnRenamed("i", id_col)


def _cut(batches, at: int, limit: int = 3 << 19):
    """Batches cut so that a binary column holds at most limit bytes, or one row."""
    for b in batches:
        sizes = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in b.column(at))])
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + limit, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def features(samples: bytes) -> str:
    """Frames, energy, zero crossings and peak of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    return f"frames={-(-len(x) // BLOCK)} energy={int((x * x).sum())} crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())} peak={int(np.abs(x).max(initial=0))}"


def describe(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decodes the media column and returns digests and features of what was read."""
    at = media.columns.index("media")
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    kept = [c for c in media.columns if c != "media"]
    schema = media.select(*kept).selectExpr("*", "0L payload_bytes", "'' payload_sha256", "0L tail_crc32", "0L media_bytes", "'' media_sha256", "'' feature").schema

    def run(batches):
        for b in _cut(batches, at):
            media = b.column(at).to_pylist()
            had = [m for m in media if m is not None]
            read = iter(decode_streams(had)) if had else iter(())
            rows = []
            for m in media:
                if m is None:
                    rows.append((None,) * 6)
                    continue
                p = next(read)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), features(p)))
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k != at), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], [*kept, *names])

    return media.mapInArrow(run, schema)


def pcm_blocks(media: DataFrame, block_samples: int = 64 * BLOCK, id_col: str = "doc_id") -> DataFrame:
    """Decoded samples in blocks: (id, block, sample_offset, n_samples, pcm); a range of samples is a range of blocks.

    Write the result as Parquet, by id and offset, to seek by sample; nothing but the blocks wanted is then read.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in _cut(batches, 1):
            ids, media = b.column(0).to_pylist(), b.column(1).to_pylist()
            had = [(i, m) for i, m in zip(ids, media, strict=True) if m is not None]
            rows = [(i, k, at, p[at : at + block_samples]) for (i, _), p in zip(had, decode_streams([m for _, m in had]), strict=True) for k, at in enumerate(range(0, len(p), block_samples))]
            if rows:
                i, k, at, pcm = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, b.column(0).type), pa.array(k, pa.int64()), pa.array(at, pa.int64()), pa.array([len(x) for x in pcm], pa.int64()), pa.array(pcm, pa.binary())], ["i", "block", "sample_offset", "n_samples", "pcm"])

    return media.select(F.col(id_col).alias("i"), "media").mapInArrow(run, f"i {kind}, block long, sample_offset long, n_samples long, pcm binary").withColumnRenamed("i", id_col)


def samples_between(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """The blocks that hold samples first to last-1, cut to that range."""
    near = blocks.where((F.col("sample_offset") < last) & (F.col("sample_offset") + F.col("n_samples") > first))
    skip = F.greatest(F.lit(first) - F.col("sample_offset"), F.lit(0)).cast("int")
    cut = F.substring(F.col("pcm"), skip + 1, (F.least(F.lit(last) - F.col("sample_offset"), F.col("n_samples")) - skip).cast("int"))
    return near.withColumns({"pcm": cut, "sample_offset": F.col("sample_offset") + skip}).withColumn("n_samples", F.octet_length("pcm").cast("long"))


def digests(docs: DataFrame) -> DataFrame:
    """Stores every text as FLAC, reads it back and returns digests and features."""
    return describe(encode(docs))
