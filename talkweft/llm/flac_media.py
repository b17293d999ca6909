"""FLAC media columns: store bytes as 8-bit mono FLAC, and decode FLAC into PCM blocks.

Every frame holds 576 samples. The encoder takes the shortest of the fixed predictors of order 0, 1 and 2 and a linear
predictor of order LPC_ORDER made for the frame, with one Rice parameter a frame, or a verbatim subframe where that is
shorter. There is a seek point for every SEEK_FRAMES frames, and an application block with the size of each frame, so
that any frame is found by its sample offset. The decoder checks the CRC-8 of each header, the CRC-16 of each frame and
the MD5 of the samples. Such frames are decoded many at a time, one sample of every frame a step; any other mono frame
(other orders, several partitions, escapes, wasted bits, constant) by a bit reader.

Edge cases: null and empty texts are stored as one frame of bytes 255; equal texts give equal bytes; a
damaged stream raises ``FlacError`` naming the check that failed; repeated rows, ties and null doc_ids are rows like
others; an empty table gives no rows; other columns are not read, so their names can't clash. Frames are worked on in
blocks of BLOCK_FRAMES, and texts in slices of some MB, so scratch memory is bounded beside a text's own bytes and
frames.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

SAMPLES = 576
BLOCK_FRAMES = 2048
PCM_BLOCK = 576 * 114  # samples of one PCM block that decode_flac writes
LPC_ORDER, LPC_BITS = 4, 8
LPC_HEAD = 4 + 5 + LPC_ORDER * LPC_BITS  # bits of precision, shift and coefficients
LPC_GAIN = 1.08  # linear prediction is used where it saves so much: chosen by the size of the stored table, as its bits have less in common with those of like texts
SEEK_FRAMES = 16  # a seek point for so many frames; SIZES has every frame's size
SIZES = b"twfs"  # id of the application block that holds them


class FlacError(ValueError):
    """A stream that is not what its headers or checksums say."""


def _table(poly: int, width: int, size: int) -> np.ndarray:
    v = np.arange(1 << size, dtype=np.uint32) << max(0, width - size)
    for _ in range(size):
        v = np.where(v >> (width - 1) & 1, (v << 1) ^ poly, v << 1) & ((1 << width) - 1)
    return v


def crc8_table() -> list[int]:
    return _table(0x07, 8, 8).tolist()


def crc16_table() -> np.ndarray:
    """CRC-16 of every pair of bytes."""
    return _table(0x8005, 16, 16).astype(np.uint16)


def crc16(frames: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-16 of runs of ``frames`` of these sizes: rows are filled up at the left, where zeros count nothing."""
    wide = int(sizes.max() + 1) // 2 * 2
    grid = np.zeros((len(sizes), wide), np.uint8)
    grid[np.arange(wide) >= (wide - sizes)[:, None]] = frames
    words = np.ascontiguousarray(grid.view(">u2").astype(np.uint16).T)
    crc = np.zeros(len(sizes), np.uint16)
    for w in words:
        crc = table[crc ^ w]
    return crc


def _coded(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(lead << 1 | 1)) & 0xFF | n, *reversed(tail)])


def _header(number: int, crc8: list[int]) -> bytes:
    h = b"\xff\xf8\x20\x02" + _coded(number)
    c = 0
    for b in h:
        c = crc8[c ^ b]
    return h + bytes([c])


def _residuals(x: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Residuals of a fixed predictor of order ``best`` (0 to 2) for each frame."""
    d1 = np.zeros_like(x)
    np.subtract(x[:, 1:], x[:, :-1], out=d1[:, 1:])
    d2 = np.zeros_like(x)
    np.subtract(d1[:, 2:], d1[:, 1:-1], out=d2[:, 2:])
    sums = [np.abs(r[:, 2:]).sum(1, dtype=np.int64) for r in (x, d1, d2)]
    best[:] = np.argmin(np.stack(sums), axis=0)
    return np.where((best == 0)[:, None], x, np.where((best == 1)[:, None], d1, d2)).astype(np.int32)


def linear_predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients [frames, LPC_ORDER] and their shifts, by the Levinson-Durbin recursion on each frame's autocorrelation."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, j:] * f[:, : SAMPLES - j]).sum(1) for j in range(LPC_ORDER + 1)], axis=1)
    r[:, 0] += 1
    a, error = np.zeros((len(x), LPC_ORDER)), r[:, 0].copy()
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = k
        error *= 1 - k * k
    top = 1 << (LPC_BITS - 1)
    shift = np.clip(LPC_BITS - 1 - np.ceil(np.log2(np.maximum(np.abs(a).max(1), 2.0**-9))), 0, 15).astype(np.int32)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -top, top - 1).astype(np.int32), shift


def _predicted(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Residuals of linear prediction; the first LPC_ORDER are 0."""
    wide = x.astype(np.int32)
    out = np.zeros_like(wide)
    said = sum(coef[:, j : j + 1] * wide[:, LPC_ORDER - 1 - j : SAMPLES - 1 - j] for j in range(LPC_ORDER))
    out[:, LPC_ORDER:] = wide[:, LPC_ORDER:] - (said >> shift[:, None])
    return out


def _rice(r: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals (warm-up ones 0), the parameter of each frame and the bits of its codes."""
    u = (r << 1) ^ (r >> 31)
    u[np.arange(SAMPLES) < order[:, None]] = 0
    count = SAMPLES - order
    k = np.log2(np.maximum(u.sum(1) / count * 0.7, 1)).astype(np.int64)
    k = np.maximum(k, np.ceil(np.log2((u.max(1) + 1) / 32)).astype(np.int64))  # no unary run is over 31
    size = lambda k: (u >> k[:, None]).sum(1) + (1 + k) * count
    low, high = size(k), size(k + 1)
    return u, np.where(high < low, k + 1, k), np.minimum(low, high)


def _bodies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subframes of samples [frames, 576]: all bytes in a row, and the size of each."""
    n = len(x)
    best = np.zeros(n, np.int64)
    u, k, rice = _rice(_residuals(x, best), best)
    coef, shift = linear_predictors(x)
    own_u, own_k, own_rice = _rice(_predicted(x, coef, shift), np.full(n, LPC_ORDER))
    lpc = ((own_rice + 8 * LPC_ORDER + LPC_HEAD) * LPC_GAIN < rice + 8 * best) & (own_k < 15)
    u, k, rice = np.where(lpc[:, None], own_u, u), np.where(lpc, own_k, k), np.where(lpc, own_rice, rice)
    best = np.where(lpc, LPC_ORDER, best)
    head = 8 * best + LPC_HEAD * lpc  # bits between the type and the residuals
    warm = np.arange(SAMPLES) < best[:, None]
    plain = rice + 10 + head >= 8 * SAMPLES
    n_bits = 8 + np.where(plain, 8 * SAMPLES, head + 10 + rice)
    n_bytes = (n_bits + 7) // 8
    at = 8 * np.concatenate([[0], np.cumsum(n_bytes)[:-1]])
    bits = np.zeros(int(n_bytes.sum()) * 8, np.uint8)

    def put(pos: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[pos + j] = value >> (width - 1 - j) & 1

    put(at, np.where(plain, 2, np.where(lpc, 32 | (LPC_ORDER - 1), 8 | best) << 1), 8)
    if plain.any():
        put(at[plain][:, None] + 8 + 8 * np.arange(SAMPLES), x[plain].astype(np.int32) & 255, 8)
    for order in (1, 2, LPC_ORDER):
        own = ~plain & (best == order)
        if own.any():
            put(at[own][:, None] + 8 + 8 * np.arange(order), x[own][:, :order].astype(np.int32) & 255, 8)
    own = np.flatnonzero(lpc & ~plain)
    if len(own):
        place = at[own] + 8 + 8 * LPC_ORDER
        put(place, np.full(len(own), LPC_BITS - 1), 4)
        put(place + 4, shift[own], 5)
        put(place[:, None] + 9 + LPC_BITS * np.arange(LPC_ORDER), coef[own] & ((1 << LPC_BITS) - 1), LPC_BITS)
    for kk in np.unique(k[~plain]):
        own = np.flatnonzero(~plain & (k == kk))
        start = at[own] + 8 + head[own]
        put(start + 6, np.full(len(own), kk), 4)
        v = u[own]
        length = (v >> kk) + (1 + kk)
        length[warm[own]] = 0
        end = np.cumsum(length, axis=1) + (start + 10)[:, None] - kk  # just after each code's stop bit
        live = ~warm[own]
        end, v = end[live], v[live]
        bits[end - 1] = 1
        for j in range(kk):
            bits[end + j] = v >> (kk - 1 - j) & 1
    return np.packbits(bits), n_bytes


def encode_many(payloads: list[bytes], tables: tuple) -> list[bytes]:
    """One FLAC stream for each payload of a positive multiple of 576 bytes."""
    crc8, crc = tables
    counts = [len(p) // SAMPLES for p in payloads]
    frames: list[bytes] = []
    numbers = [i for c in counts for i in range(c)]
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SAMPLES)
    heads: dict[int, bytes] = {}
    for a in range(0, len(data), BLOCK_FRAMES):
        x = data[a : a + BLOCK_FRAMES].astype(np.int16) - 128
        body, sizes = _bodies(x)
        body, ends = body.tobytes(), np.cumsum(sizes).tolist()
        whole, at = [], 0
        for n, end in zip(numbers[a : a + BLOCK_FRAMES], ends, strict=True):
            if n not in heads:
                heads[n] = _header(n, crc8)
            whole.append(heads[n] + body[at:end])
            at = end
        sums = crc16(np.frombuffer(b"".join(whole), np.uint8), np.array([len(w) for w in whole]), crc).astype(">u2").tobytes()
        frames += [w + sums[2 * i : 2 * i + 2] for i, w in enumerate(whole)]
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        own = frames[at : at + c]
        at += c
        size = np.array([len(f) for f in own])
        seek = np.zeros(-(-c // SEEK_FRAMES), dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        seek["sample"] = np.arange(0, c, SEEK_FRAMES) * SAMPLES
        seek["offset"] = (np.cumsum(size) - size)[::SEEK_FRAMES]
        seek["n"] = SAMPLES
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = SAMPLES.to_bytes(2, "big") * 2 + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big") + (8000 << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        blocks = [(3, seek[i : i + 900_000].tobytes()) for i in range(0, len(seek), 900_000)]  # a metadata block holds 16 MB
        blocks += [(2, SIZES + size[i : i + 8_000_000].astype(">u2").tobytes()) for i in range(0, c, 8_000_000)]
        meta = b"".join((kind | (128 if i == len(blocks) - 1 else 0)).to_bytes(1, "big") + len(t).to_bytes(3, "big") + t for i, (kind, t) in enumerate(blocks))
        out.append(b"".join([b"fLaC\x00\x00\x00\x22", info, meta, *own]))
    return out


def _frames_of(media: bytes) -> tuple[int, bytes, int, list[tuple[int, int]]]:
    """Total samples, MD5, bits a sample and the (start, end) of each frame."""
    if media[:4] != b"fLaC":
        raise FlacError("marker")
    at, last, info, seek, sizes = 4, False, b"", [], []
    while not last:
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        last, block = kind > 127, media[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            info = block
        elif kind & 127 == 3:
            seek.append(np.frombuffer(block, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        elif kind & 127 == 2 and block[:4] == SIZES:
            sizes.append(np.frombuffer(block[4:], ">u2"))
        at += 4 + size
    if len(info) < 34:
        raise FlacError("stream info")
    packed = int.from_bytes(info[10:18], "big")
    total, depth = packed & (1 << 36) - 1, (packed >> 36 & 31) + 1
    if packed >> 41 & 7:
        raise FlacError("only mono streams are decoded")
    if sizes:
        ends = (at + np.cumsum(np.concatenate(sizes).astype(np.int64))).tolist()
        if ends[-1] != len(media):
            raise FlacError("frame sizes")
        return total, info[18:34], depth, list(zip([at, *ends[:-1]], ends, strict=True))
    if seek:
        points = np.concatenate(seek)
        if int(points["n"].sum()) == total:  # a point for every frame
            starts = (points["offset"].astype(np.int64) + at).tolist()
            return total, info[18:34], depth, list(zip(starts, [*starts[1:], len(media)], strict=True))
    return total, info[18:34], depth, _by_sync(media, at)


def _by_sync(media: bytes, at: int) -> list[tuple[int, int]]:
    """Frames between sync codes at which the checksum of what lies before holds."""
    table, found, start = crc16_table(), [], at
    while start < len(media):
        end = start + 2
        while True:
            end = media.find(b"\xff\xf8", end)
            end = len(media) if end < 0 else end
            body = np.frombuffer(media[start : end - 2], np.uint8)
            if end - start > 6 and int(crc16(body, np.array([len(body)]), table)[0]) == int.from_bytes(media[end - 2 : end], "big"):
                break
            if end == len(media):
                raise FlacError("frame checksum")
            end += 1
        found.append((start, end))
        start = end
    return found


def _open(frame: bytes, crc8: list[int]) -> tuple[int, int]:
    """Samples of a frame and where its subframe starts."""
    if frame[:2] != b"\xff\xf8":
        raise FlacError("sync code")
    lead = frame[4]
    extra = 0 if lead < 0x80 else 7 - (~lead & 0xFF).bit_length()
    code, at = frame[2] >> 4, 5 + extra
    if code == 1:
        n = 192
    elif code in (6, 7):
        n, at = int.from_bytes(frame[at : at + code - 5], "big") + 1, at + code - 5
    else:
        n = 576 << code - 2 if code < 6 else 256 << code - 8
    at += {12: 1, 13: 2, 14: 2}.get(frame[2] & 15, 0)
    c = 0
    for b in frame[:at]:
        c = crc8[c ^ b]
    if c != frame[at]:
        raise FlacError("header checksum")
    return n, at + 1


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.text = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def take(self, n: int) -> int:
        self.at += n
        return int(self.text[self.at - n : self.at], 2) if n else 0

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        start = self.at
        self.at = self.text.index("1", start) + 1
        return self.at - 1 - start


def _subframe(data: bytes, n: int, depth: int) -> list[int]:
    """Any mono subframe, bit by bit."""
    bits = _Bits(data)
    kind = bits.take(8) >> 1 & 63
    wasted = 0
    if bits.text[7] == "1":
        wasted = bits.unary() + 1
        depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * n
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        if kind < 32:
            coef, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
        else:
            width = bits.take(4) + 1
            shift = bits.signed(5)
            coef = [bits.signed(width) for _ in range(order)]
        size, parts = 4 + bits.take(2), 1 << bits.take(4)
        for p in range(parts):
            k = bits.take(size)
            count = n // parts - (order if p == 0 else 0)
            raw = bits.take(5) if k == (1 << size) - 1 else None
            for _ in range(count):
                if raw is None:
                    u = bits.unary() << k
                    u |= bits.take(k)
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = bits.signed(raw)
                out.append(r + (sum(c * v for c, v in zip(coef, reversed(out), strict=False)) >> shift))
    else:
        raise FlacError("subframe type")
    return [v << wasted for v in out]


def _fast(buf: np.ndarray, at: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples [frames, 576] of subframes at byte ``at`` with one partition, and a fixed predictor of order 0 to 2 or LPC_ORDER linear ones.

    The second result marks frames that have a unary run of over 31 zeros, whose samples aren't right here.
    """
    n = len(at)
    out = np.zeros((SAMPLES, n), np.int32)
    b = np.concatenate([buf, np.zeros(16, np.uint8)])
    size = len(b) - 8
    window = np.empty((size, 8), np.uint8)
    for j in range(8):
        window[:, j] = b[j : j + size]
    window = window.view(">u8").ravel().astype(np.int64)  # 64 bits from each byte on
    lpc = order == LPC_ORDER
    pos = 8 * (at + 1 + order) + 6 + LPC_HEAD * lpc
    k = (window[pos >> 3] >> (60 - (pos & 7))) & 15
    pos = pos + 4
    mask = (1 << k) - 1
    long = np.zeros(n, bool)
    top = np.int64(0xFFFFFFFF)
    last = size - 1

    def step(p: np.ndarray, k: np.ndarray, mask: np.ndarray) -> tuple:
        w = window[np.minimum(p >> 3, last)] << (p & 7)
        high = (w >> 32) & top
        zeros = 1054 - (high.astype(np.float64).view(np.int64) >> 52)
        zeros[high == 0] = 32
        u = ((w >> (63 - zeros - k)) & mask) | (zeros << k)
        return u, p + zeros + 1 + k, zeros

    for i in range(LPC_ORDER):  # warm-up samples have no code
        own = np.flatnonzero(order <= i)
        out[i, own], pos[own], zeros = step(pos[own], k[own], mask[own])
        long[own] |= zeros > 31
    more = 1 + k
    shift = 63 - k
    for i in range(LPC_ORDER, SAMPLES):
        w = window[pos >> 3] << (pos & 7)
        high = (w >> 32) & top
        zeros = 1054 - (high.astype(np.float64).view(np.int64) >> 52)
        if zeros.max() > 31:
            long |= zeros > 31
            zeros = np.minimum(zeros, 32)
            pos = np.minimum(pos, 8 * last - 64)
        out[i] = ((w >> (shift - zeros)) & mask) | (zeros << k)
        pos = pos + (zeros + more)
    out = (out >> 1) ^ -(out & 1)
    for o in range(LPC_ORDER):
        own = order > o
        out[o, own] = buf[at[own] + 1 + o].view(np.int8)
    two = order == 2
    if two.any():  # residuals from the third sample on are second differences
        d = out[:, two]
        d[1] -= d[0]
        d[1:] = np.cumsum(d[1:], axis=0)
        out[:, two] = np.cumsum(d, axis=0)
    one = order == 1
    if one.any():
        out[:, one] = np.cumsum(out[:, one], axis=0)
    if lpc.any():
        x, w = out[:, lpc], window[at[lpc] + 1 + LPC_ORDER]
        shift = (w >> 55 & 31).astype(np.int32)
        coef = [(w >> (47 - 8 * j) & 255).astype(np.uint8).view(np.int8).astype(np.int32) for j in range(LPC_ORDER)]
        for t in range(LPC_ORDER, SAMPLES):
            said = coef[0] * x[t - 1]
            for j in range(1, LPC_ORDER):
                said += coef[j] * x[t - 1 - j]
            x[t] += said >> shift
        out[:, lpc] = x
    return out.T, long


def _decoded(frames: list[tuple[int, bytes]], tables: tuple) -> list[bytes]:
    """Samples of frames (bits a sample, bytes), checked one by one."""
    pcm: list[bytes] = []
    crc8, crc = tables
    for a in range(0, len(frames), BLOCK_FRAMES):
        some = frames[a : a + BLOCK_FRAMES]
        joined = np.frombuffer(b"".join(f for _, f in some), np.uint8)
        sizes = np.array([len(f) for _, f in some])
        if crc16(joined, sizes, crc).any():  # a frame followed by its own checksum gives 0
            raise FlacError("frame checksum")
        starts = np.cumsum(sizes) - sizes
        opened = [_open(f, crc8) for _, f in some]
        at = starts + np.array([o[1] for o in opened])
        kind = joined[at] >> 1 & 63
        linear = kind == 32 | (LPC_ORDER - 1)
        order = np.where(linear, LPC_ORDER, kind.astype(np.int64) - 8)
        wide = np.concatenate([joined, np.zeros(16, np.uint8)])
        at2 = at + 1 + np.clip(order, 0, 4)
        simple = np.array([o[0] == SAMPLES and d == 8 for o, (d, _) in zip(opened, some, strict=True)])
        at3 = at + 1 + LPC_ORDER  # of linear ones: precision, shift, coefficients, then residuals from the second bit of the sixth byte on
        after = wide[at3 + 5].astype(np.int64) << 8 | wide[at3 + 6]
        whole = linear & (wide[at3] >> 4 == LPC_BITS - 1) & (((wide[at3] & 15) << 1 | wide[at3 + 1] >> 7) < 16) & (after >> 9 & 63 == 0) & (after >> 5 & 15 != 15)
        fast = simple & ~linear & (order >= 0) & (order <= 2) & (joined[at] & 129 == 0) & (wide[at2] >> 2 == 0) & (((wide[at2] & 3) << 2 | wide[at2 + 1] >> 6) != 15)
        fast |= simple & whole & (joined[at] & 129 == 0)
        plain = simple & (kind == 1) & (joined[at] & 129 == 0)
        rows: dict[int, bytes] = {}
        if fast.any():
            own = np.flatnonzero(fast)
            x, long = _fast(joined, at[own], order[own])
            x = (x + 128).astype(np.uint8).tobytes()
            fast[own[long]] = False
            for j, i in enumerate(own.tolist()):
                rows[i] = x[SAMPLES * j : SAMPLES * (j + 1)]
        for i in np.flatnonzero(~fast).tolist():
            frame = some[i][1]
            if plain[i]:
                s = opened[i][1] + 1
                rows[i] = (np.frombuffer(frame[s : s + SAMPLES], np.uint8) ^ 128).tobytes()
            else:
                rows[i] = bytes(v + 128 for v in _subframe(frame[opened[i][1] : -2], opened[i][0], some[i][0]))
        pcm += [rows[i] for i in range(len(some))]
    return pcm


def read_samples(media: bytes, start: int, n: int, tables: tuple) -> bytes:
    """Samples from ``start`` on, up to ``n``; only the frames that hold them are decoded. For streams with SAMPLES a frame."""
    total, _, depth, where = _frames_of(media)
    end = min(start + n, total)
    if start >= end:
        return b""
    first = start // SAMPLES
    data = b"".join(_decoded([(depth, media[a:b]) for a, b in where[first : -(-end // SAMPLES)]], tables))
    return data[start - first * SAMPLES : end - first * SAMPLES]


def decode_many(streams: list[bytes], tables: tuple) -> list[bytes]:
    """The samples of each 8-bit mono stream as unsigned bytes."""
    heads = [_frames_of(m) for m in streams]
    frames = [(d, m[a:b]) for (_, _, d, where), m in zip(heads, streams, strict=True) for a, b in where]
    pcm = _decoded(frames, tables)
    out, at = [], 0
    for total, md5, _, where in heads:
        data = b"".join(pcm[at : at + len(where)])
        at += len(where)
        if len(data) != total or hashlib.md5((np.frombuffer(data, np.uint8) ^ 128).tobytes()).digest() != md5:
            raise FlacError("MD5 of the samples")
        out.append(data)
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(data) // SAMPLES)) * SAMPLES
    return len(data), data.ljust(size, b"\xff")


def encode_flac(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the FLAC ``media`` of every text."""

    def make():
        tables = crc8_table(), crc16_table()

        def work(x: dict) -> dict:
            made = [payload_of(t) for t in x["text"]]
            return {"doc_id": x["doc_id"], "n_bytes": [n for n, _ in made], "media": encode_many([p for _, p in made], tables)}

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, media binary")


def blocks_of(data: bytes) -> Iterator[tuple[int, bytes]]:
    """The PCM blocks of a stream's samples with their offsets."""
    for a in range(0, len(data), PCM_BLOCK):
        yield a, data[a : a + PCM_BLOCK]


def decode_flac(media: DataFrame) -> DataFrame:
    """PCM blocks: doc_id, sample_offset, n_samples, pcm (unsigned 8-bit), in order of offsets within a stream."""

    def make():
        tables = crc8_table(), crc16_table()

        def work(x: dict) -> dict:
            out: dict[str, list] = {"doc_id": [], "sample_offset": [], "n_samples": [], "pcm": []}
            for doc_id, data in zip(x["doc_id"], decode_many(x["media"], tables), strict=True):
                for a, block in blocks_of(data):
                    for k, v in zip(out, (doc_id, a, len(block), block), strict=True):
                        out[k].append(v)
            return out

        return work

    return map_batches(media.select("doc_id", "media"), make, "doc_id long, sample_offset long, n_samples long, pcm binary")


def write_pcm(media: DataFrame) -> DataFrame:
    """The PCM blocks of decode_flac as a written table in the shared folder, in order of doc_id and offset within each file.

    A reader of samples opens row groups by doc_id and sample_offset alone; ``samples_at`` does.
    """
    return written(decode_flac(media).sortWithinPartitions("doc_id", "sample_offset"), "pcm", "zstd")


def samples_at(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, start, n and pcm of the ranges of samples that ``wanted`` (doc_id, start, n) asks for, cut at a stream's end.

    A range meets the blocks that it touches by doc_id and offset, so only those are joined. Ranges before or beyond a stream, of
    nothing or of unknown streams are empty; ranges that repeat are answered once.
    """
    asked = wanted.select("doc_id", "start", "n").distinct()
    inside = asked.where("start >= 0 AND n > 0")
    touched = inside.withColumn("sample_offset", F.explode(F.sequence(F.expr(f"start div {PCM_BLOCK} * {PCM_BLOCK}"), F.expr(f"(start + n - 1) div {PCM_BLOCK} * {PCM_BLOCK}"), F.lit(PCM_BLOCK).cast("long"))))
    first = F.greatest(F.col("start") - F.col("sample_offset"), F.lit(0))
    last = F.least(F.col("start") + F.col("n") - F.col("sample_offset"), F.col("n_samples"))
    part = F.struct("sample_offset", F.substring("pcm", (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")).alias("pcm"))
    found = touched.join(blocks, ["doc_id", "sample_offset"]).groupBy("doc_id", "start", "n").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    whole = F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["pcm"]))
    found = found.select(F.col("doc_id").alias("_doc"), F.col("start").alias("_start"), F.col("n").alias("_n"), whole.alias("pcm"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("start") == F.col("_start")) & (F.col("n") == F.col("_n"))
    return asked.join(found, same, "left").select("doc_id", "start", "n", F.coalesce("pcm", F.lit("").cast("binary")).alias("pcm"))


def media_features(media: DataFrame) -> DataFrame:
    """Decode every stream and describe the samples of its PCM blocks, those of decode_flac: mean, energy, zero crossings and peak."""

    def make():
        tables = crc8_table(), crc16_table()

        def work(x: dict) -> dict:
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            out: dict[str, list] = {k: [] for k in names}
            for m, data in zip(x["media"], decode_many(x["media"], tables), strict=True):
                size, total, energy, crossings, low, high, tail, sha, last = 0, 0, 0, 0, 127, -128, b"", hashlib.sha256(), None
                for _, block in blocks_of(data):
                    s = (np.frombuffer(block, np.uint8) ^ 128).view(np.int8)
                    wide = s.astype(np.int64)
                    size, total, energy = size + len(block), total + int(wide.sum()), energy + int((wide * wide).sum())
                    crossings += int(np.count_nonzero(s[1:] & -128 != s[:-1] & -128)) + (last is not None and (last < 0) != (int(s[0]) < 0))
                    low, high, last = min(low, int(s.min())), max(high, int(s.max())), int(s[-1])
                    tail = (tail + block[-32:])[-32:]
                    sha.update(block)
                feature = f"sum={total};energy={energy};crossings={crossings};low={low};high={high}"
                row = (size, sha.hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), feature)
                for k, v in zip(names, row, strict=True):
                    out[k].append(v)
            return {"doc_id": x["doc_id"], "n_bytes": x["n_bytes"]} | out

        return work

    return map_batches(media, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
