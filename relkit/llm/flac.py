"""FLAC for columns of 8-bit mono samples: a frame writer, and a decoder of all mono streams up to 24 bits.

Frames of a batch are handled in step: one numpy operation does the n-th residual, the
n-th prediction or the n-th checksum byte of some thousand frames.  Streams written here
have a seek point for every frame; the decoder starts at those, and without a seek table
goes from frame to frame.
"""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK = 576
ORDER = 4
PRECISION = 12
PARTITIONS = 4  # of the residual, so the partition order is 2
GROUP = 8192


class FlacError(ValueError):
    pass


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table & (1 << (bits - 1)), (table << 1) ^ poly, table << 1) & ((1 << bits) - 1)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """CRC-8 or CRC-16 of each byte range."""
    table, sizes = (_CRC8, ends - starts) if bits == 8 else (_CRC16, ends - starts)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    value = np.zeros(len(starts), np.uint32)
    alive = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), "right")
    mask = np.uint32((1 << bits) - 1)
    for i, n in enumerate(alive.tolist()):
        v = value[:n]
        value[:n] = ((v << 8) & mask) ^ table[(v >> (bits - 8)) ^ data[starts[:n] + i]]
    out = np.empty_like(value)
    out[order] = value
    return out


# --- writing -----------------------------------------------------------------


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors (frames x ORDER) and their shifts, by Levinson's recursion."""
    y = x * np.hanning(BLOCK + 2)[1:-1]
    auto = np.stack([(y[:, : BLOCK - j] * y[:, j:]).sum(1) for j in range(ORDER + 1)], 1)
    auto[:, 0] = auto[:, 0] * (1 + 1e-9) + 1e-9
    a, err = np.zeros((len(x), ORDER)), auto[:, 0].copy()
    for i in range(ORDER):
        r = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(1)) / err
        old = a[:, :i].copy()
        a[:, :i] = old - r[:, None] * old[:, ::-1]
        a[:, i] = r
        err = np.maximum(err * (1 - r * r), 1e-9)
    top = np.abs(a).max(1)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(top, 1e-6))).astype(int), 0, 15)
    coefs = np.clip(np.round(a * (1 << shift)[:, None]), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1)
    return coefs.astype(np.int64), shift


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + (width - 1 - j)] = (value >> j) & 1


def _numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8 way: frames x 6 bytes, and how many of them count."""
    limits = np.array([1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31])
    size = np.searchsorted(limits, n, "right") + 1
    out = np.zeros((len(n), 6), np.int64)
    for s in range(1, 7):
        own = np.flatnonzero(size == s)
        if len(own):
            for j in range(s):
                out[own, j] = (n[own] >> (6 * (s - 1 - j))) & 0x3F | 0x80
            lead = (0xFF00 >> s) & 0xFF if s > 1 else 0
            out[own, 0] = lead | (n[own] >> (6 * (s - 1)))
    return out, size


def _frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of BLOCK signed 8-bit samples each: their bytes, and where each begins (one more than frames)."""
    n = len(x)
    constant = (x == x[:, :1]).all(1)
    coefs, shift = _predictors(x.astype(np.float32))
    total = np.zeros((n, BLOCK), np.int32)
    for j in range(ORDER):
        total[:, ORDER:] += coefs[:, j : j + 1].astype(np.int32) * x[:, ORDER - 1 - j : BLOCK - 1 - j]
    total >>= shift[:, None].astype(np.int32)
    np.subtract(x, total, out=total)
    total[:, :ORDER] = 0
    step = np.zeros_like(x)
    np.subtract(x[:, 1:], x[:, :-1], out=step[:, 1:])
    residuals, orders = (x, step, total), np.array([0, 1, ORDER])
    best = np.stack([np.abs(r).sum(1) for r in residuals]).argmin(0)
    order = orders[best]
    res = np.where((best == 2)[:, None], total, np.where((best == 1)[:, None], step, x))
    u = ((res << 1) ^ (res >> 31)).reshape(n, PARTITIONS, -1)
    held = np.full((n, PARTITIONS), BLOCK // PARTITIONS)
    held[:, 0] -= order
    # the best Rice parameter of a geometric source of that mean
    k = np.clip(np.floor(np.log2(np.maximum(u.sum(2) / held * 0.7, 1))), 0, 8).astype(np.int32)
    high = u >> k[:, :, None]
    cost = (held * (1 + k) + high.sum(2)).sum(1)
    # fixed: 8 + warm-up + 6 + ...; LPC has its precision, shift and coefficients besides
    lpc = best == 2
    size = 8 + 8 * order + lpc * (9 + PRECISION * ORDER) + 6 + 4 * PARTITIONS + cost
    verbatim = ~constant & (size >= 8 + 8 * BLOCK)
    size = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, size))
    number, number_size = _numbers(numbers)
    head = 5 + number_size
    length = head + (size + 7) // 8 + 2
    starts = np.concatenate(([0], np.cumsum(length)))
    bits = np.zeros(starts[-1] * 8, np.uint8)
    at = starts[:-1] * 8
    _put(bits, at, np.full(n, 0xFFF82002), 32)  # block of 576, rate from STREAMINFO, mono, 8 bits
    for j in range(6):
        own = number_size > j
        _put(bits, at[own] + 32 + 8 * j, number[own, j], 8)
    at = at + 8 * head
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 32 + ORDER - 1, 8 + order)))
    _put(bits, at, kind << 1, 8)
    at = at + 8
    unsigned = x & 0xFF
    _put(bits, at[constant], unsigned[constant, 0], 8)
    if verbatim.any():
        _put(bits, (at[verbatim][:, None] + 8 * np.arange(BLOCK)).ravel(), unsigned[verbatim].ravel(), 8)
    extra = np.uint8(0)
    coded = np.flatnonzero(~constant & ~verbatim)
    if len(coded):
        at, order, lpc, k, x8 = at[coded], order[coded], lpc[coded], k[coded], unsigned[coded]
        u, high = u[coded].reshape(len(coded), -1), high[coded].reshape(len(coded), -1)
        for j in range(ORDER):
            own = order > j
            _put(bits, at[own] + 8 * j, x8[own, j], 8)
        at = at + 8 * order
        own = np.flatnonzero(lpc)
        _put(bits, at[own], np.full(len(own), PRECISION - 1), 4)
        _put(bits, at[own] + 4, shift[coded][own], 5)
        for j in range(ORDER):
            _put(bits, at[own] + 9 + PRECISION * j, coefs[coded][own, j] & ((1 << PRECISION) - 1), PRECISION)
        at = at + lpc * (9 + PRECISION * ORDER)
        _put(bits, at, np.full(len(at), 2), 6)  # 4-bit parameters, partition order 2
        each = np.repeat(k, BLOCK // PARTITIONS, axis=1)
        real = np.arange(BLOCK) >= order[:, None]
        width = (1 + each + high) * real
        ahead = width.copy()
        ahead[:, :: BLOCK // PARTITIONS] += 4  # a partition begins with its parameter
        ends = np.cumsum(ahead, axis=1, dtype=np.int64) + (at + 6)[:, None]
        for p in range(PARTITIONS):
            c = p * (BLOCK // PARTITIONS)
            _put(bits, ends[:, c] - width[:, c] - 4, k[:, p], 4)
        # stop bit and low bits: nine at most, so within two bytes; no two of these overlap
        code = ((1 << each) | (u & ((1 << each) - 1))) * real
        begin = (ends - 1 - each).ravel()
        code = (code.ravel() << (15 - each.ravel() - (begin & 7))).astype(np.int64)
        begin >>= 3
        coded_bytes = np.bincount(begin, code >> 8, starts[-1] + 1)
        coded_bytes[1:] += np.bincount(begin, code & 0xFF, starts[-1])[: starts[-1]]
        extra = coded_bytes[: starts[-1]].astype(np.uint8)
    data = np.packbits(bits) + extra
    data[starts[:-1] + head - 1] = crc(data, starts[:-1], starts[:-1] + head - 1, 8)
    sums = crc(data, starts[:-1], starts[1:] - 2, 16)
    data[starts[1:] - 2], data[starts[1:] - 1] = sums >> 8, sums & 0xFF
    return data, starts


def encode(payloads: list[np.ndarray], rate: int = 8000) -> list[bytes]:
    """A stream for each array of bytes, of a positive multiple of BLOCK; byte b is the sample b - 128."""
    sizes = np.array([len(p) // BLOCK for p in payloads])
    numbers = np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else np.zeros(0, int)
    flat = np.concatenate(payloads).reshape(-1, BLOCK)
    parts, lengths = [], []
    for lo in range(0, len(flat), GROUP):
        data, starts = _frames(flat[lo : lo + GROUP].astype(np.int32) - 128, numbers[lo : lo + GROUP])
        parts.append(data.tobytes())
        lengths.append(np.diff(starts))
    data, length = b"".join(parts), np.concatenate(lengths)
    ends, out, frame = np.cumsum(length), [], 0
    for payload, s in zip(payloads, sizes.tolist()):
        own = slice(frame, frame + s)
        begin = int(ends[frame] - length[frame])
        points = np.zeros(s, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = np.arange(s) * BLOCK, ends[own] - length[own] - begin, BLOCK
        info = BLOCK.to_bytes(2) * 2 + int(length[own].min()).to_bytes(3) + int(length[own].max()).to_bytes(3) + (rate << 44 | 7 << 36 | len(payload)).to_bytes(8) + hashlib.md5((payload ^ 0x80).tobytes()).digest()
        out.append(b"fLaC\x00" + len(info).to_bytes(3) + info + _seek_blocks(points.tobytes()) + data[begin : int(ends[frame + s - 1])])
        frame += s
    return out


def _seek_blocks(points: bytes) -> bytes:
    """SEEKTABLE blocks; a block is at most 2**24 - 1 bytes long."""
    most = (2**24 - 1) // 18 * 18
    cut = [points[i : i + most] for i in range(0, len(points), most)]
    return b"".join((0x83 if i + 1 == len(cut) else 0x03).to_bytes(1) + len(c).to_bytes(3) + c for i, c in enumerate(cut))


# --- reading -----------------------------------------------------------------


class _Bits:
    """Reads at many places of one buffer at once."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate((data, np.zeros(16, np.uint8)))
        self.words = np.lib.stride_tricks.as_strided(self.data, (len(self.data) - 7, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)

    def ahead(self, at: np.ndarray) -> np.ndarray:
        """The 57 bits at least that follow, from the top."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned value of `width` (up to 56) bits."""
        w = np.asarray(width)
        v = self.ahead(at) >> (np.uint64(63) - np.maximum(w, 1).astype(np.uint64) + np.uint64(1)).astype(np.uint64)
        return np.where(w > 0, v, 0).astype(np.int64)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        v, w = self.take(at, width), np.asarray(width)
        return np.where((w > 0) & ((v >> np.maximum(w - 1, 0)) & 1 == 1), v - (1 << w), v)

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rice codes of parameter k and where each ends."""
        v = self.ahead(at)
        zeros = 53 - np.frexp((v >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        long = (zeros + k > 55) | (zeros > 52)
        low = (v << np.minimum(zeros + 1, 63).astype(np.uint64)) >> (np.uint64(63) - k.astype(np.uint64)) >> np.uint64(1)
        code = (zeros << k) | low.astype(np.int64)
        if long.any():
            own = np.flatnonzero(long)
            zeros[own] = self.unary(at[own])
            code[own] = zeros[own] << k[own] | self.take(at[own] + zeros[own] + 1, k[own])
        return (code >> 1) ^ -(code & 1), at + zeros + 1 + k

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        zeros = np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        while len(todo):
            v = (self.ahead(at[todo] + zeros[todo]) >> np.uint64(11)).astype(np.float64)
            n = 53 - np.frexp(v)[1].astype(np.int64)
            stop = v > 0
            zeros[todo] += np.where(stop, n, 53)
            if int((at[todo] + zeros[todo]).max()) >> 3 > len(self.data):
                raise FlacError("a residual goes on after the end of the data")
            todo = todo[~stop]
        return zeros


_SIZES = {1: 192, **{n: 576 << (n - 2) for n in range(2, 6)}, **{n: 256 << (n - 8) for n in range(8, 16)}}
_WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def decode_frames(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Samples, frame number and end of each frame that begins at one of the places; checksums are verified."""
    b, n = _Bits(data), len(starts)
    at = starts.astype(np.int64) * 8
    if (b.take(at, 15) != 0x7FFC).any():
        raise FlacError("no frame at its place")
    code, rate = b.take(at + 16, 4), b.take(at + 20, 4)
    if (b.take(at + 24, 4) != 0).any():
        raise FlacError("only mono streams are read")
    bits = np.array([_WIDTHS.get(c, width) for c in b.take(at + 28, 3).tolist()])
    lead = b.take(at + 32, 8)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    number = np.where(more > 0, lead & ((1 << np.maximum(6 - more, 0)) - 1), lead)
    for j in range(1, int(more.max(initial=0)) + 1):
        number = np.where(more >= j, number << 6 | b.take(at + 32 + 8 * j, 8) & 0x3F, number)
    at = at + 40 + 8 * more
    size = np.array([_SIZES.get(c, 0) for c in code.tolist()])
    size = np.where(code == 6, b.take(at, 8) + 1, np.where(code == 7, b.take(at, 16) + 1, size))
    at = at + np.select([code == 6, code == 7], [8, 16], 0) + np.select([rate == 12, (rate == 13) | (rate == 14)], [8, 16], 0)
    if (crc(b.data, starts, at >> 3, 8) != b.take(at, 8)).any():
        raise FlacError("a frame header's checksum is wrong")
    at = at + 8
    kind, wasted = b.take(at + 1, 6), b.take(at + 7, 1)
    at = at + 8
    lost = np.zeros(n, np.int64)
    if wasted.any():
        own = np.flatnonzero(wasted)
        lost[own] = b.unary(at[own]) + 1
        at[own] += lost[own]
    bits = bits - lost
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | lpc | (kind < 2)).all():
        raise FlacError("a subframe of a reserved kind")
    order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, 0))
    most = int(size.max(initial=0))
    out = np.zeros((most, n), np.int64)
    whole = kind < 2  # constant: one sample is read; verbatim: all of them
    for i in range(most):
        own = np.flatnonzero((i < size) & np.where(kind == 1, True, np.where(kind == 0, i < 1, i < order)))
        if not len(own):
            break
        out[i, own] = b.signed(at[own], bits[own])
        at[own] += bits[own]
    out[:, kind == 0] = out[0, kind == 0]
    coefs, shift = np.zeros((32, n), np.int64), np.zeros(n, np.int64)
    own = np.flatnonzero(lpc)
    if len(own):
        precision = b.take(at[own], 4) + 1
        shift[own] = b.signed(at[own] + 4, np.full(len(own), 5))
        at[own] += 9
        for j in range(int(order[own].max())):
            has = order[own] > j
            coefs[j, own[has]] = b.signed(at[own[has]], precision[has])
            at[own[has]] += precision[has]
    for o in range(1, 5):
        coefs[:o, fixed & (order == o)] = np.array(_FIXED[o])[:, None]
    own = np.flatnonzero(~whole)
    if len(own):
        _residuals(b, at, own, size, order, out)
        _restore(out, own, size, order, coefs, shift, int(bits.max()) <= 8 and (order[own] <= 16).all())
    out <<= lost
    end = (at + 7) >> 3
    if (crc(b.data, starts, end, 16) != b.take(end * 8, 16)).any():
        raise FlacError("a frame's checksum is wrong")
    return [out[:s, i] for i, s in enumerate(size.tolist())], number, end + 2


def _residuals(b: _Bits, at: np.ndarray, own: np.ndarray, size: np.ndarray, order: np.ndarray, out: np.ndarray) -> None:
    """Reads Rice-coded residuals into `out`, from each frame's order on."""
    p, o, n = at[own], order[own], size[own]
    wide = 4 + b.take(p, 2)
    if (wide > 5).any():
        raise FlacError("a reserved residual coding")
    part = n >> b.take(p + 2, 4)
    p = p + 6
    k, raw = np.zeros(len(own), np.int64), np.full(len(own), -1)
    for i in range(int(n.max())):
        live = (i >= o) & (i < n)
        new = np.flatnonzero(live & ((i % part == 0) | (i == o)))
        if len(new):
            k[new] = b.take(p[new], wide[new])
            escape = k[new] == (1 << wide[new]) - 1
            raw[new] = np.where(escape, b.take(p[new] + wide[new], 5), -1)
            p[new] += wide[new] + 5 * escape
        live = np.flatnonzero(live) if not live.all() else slice(None)
        q = p[live]
        plain = raw[live] < 0
        if plain.all():
            out[i, own[live]], p[live] = b.rice(q, k[live])
        else:
            value, q[~plain] = b.signed(q, np.maximum(raw[live], 0)), q[~plain] + raw[live][~plain]
            value[plain], q[plain] = b.rice(q[plain], k[live][plain])
            out[i, own[live]], p[live] = value, q
    at[own] = p


def _restore(out: np.ndarray, own: np.ndarray, size: np.ndarray, order: np.ndarray, coefs: np.ndarray, shift: np.ndarray, small: bool) -> None:
    """Adds the predictions to the residuals."""
    o, n, deep = order[own], size[own], int(order[own].max())
    kind = np.int32 if small else np.int64  # 8-bit samples times 15-bit coefficients fit 32 bits
    x, c, s = out[:, own].astype(kind), coefs[:, own].astype(kind), shift[own].astype(kind)
    for i in range(int(n.max())):
        total = np.zeros(len(own), kind)
        for j in range(min(deep, i)):
            total += c[j] * x[i - 1 - j]
        x[i] += np.where(i >= o, total >> s, 0)
    out[:, own] = x


def read(stream: bytes) -> tuple[dict, np.ndarray, int]:
    """STREAMINFO, the byte offsets in the seek table (empty without one), and where frames begin."""
    if stream[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, info, points, last = 4, None, [], False
    while not last:
        last, kind, size = stream[at] & 0x80, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            x = int.from_bytes(body[10:18])
            info = {"rate": x >> 44, "channels": (x >> 41 & 7) + 1, "width": (x >> 36 & 31) + 1, "samples": x & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            points.append(np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])))
        at += 4 + size
    seek = np.concatenate(points) if points else np.zeros(0, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
    seek = seek[seek["sample"] != 2**64 - 1]
    return info, seek, at


def decode(streams: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """STREAMINFO and samples of each stream; every frame's checksums and the samples' MD5 are verified."""
    heads = [read(s) for s in streams]
    out: list = [None] * len(streams)
    ready = [i for i, (info, seek, _) in enumerate(heads) if len(seek) and int(seek["n"].astype(np.int64).sum()) == info["samples"] and info["width"] == heads[0][0]["width"]]
    frames = [(i, j) for i in ready for j in range(len(heads[i][1]))]
    pieces: dict[int, list] = {i: [] for i in range(len(streams))}
    for lo in range(0, len(frames), GROUP):
        own = frames[lo : lo + GROUP]
        first, last = own[0][0], own[-1][0]
        used = list(dict.fromkeys(i for i, _ in own))
        base, buffers, total = {}, [], 0
        for i in used:
            # of a long stream only the bytes from this group's first frame to its last
            lowest = own[0][1] if i == first else 0
            highest = own[-1][1] + 1 if i == last else len(heads[i][1])
            offsets = heads[i][1]["offset"].astype(np.int64)
            a = heads[i][2] + int(offsets[lowest])
            z = heads[i][2] + int(offsets[highest]) if highest < len(offsets) else len(streams[i])
            buffers.append(np.frombuffer(streams[i], np.uint8)[a:z])
            base[i] = total - int(offsets[lowest])
            total += z - a
        starts = np.concatenate([heads[i][1]["offset"].astype(np.int64)[(own[0][1] if i == first else 0) : (own[-1][1] + 1 if i == last else None)] + base[i] for i in used])
        got, _, _ = decode_frames(np.concatenate(buffers), starts, heads[ready[0]][0]["width"])
        for (i, _), x in zip(own, got):
            pieces[i].append(x)
    for i in sorted(set(range(len(streams))) - set(ready)):
        info, _, at = heads[i]
        data, have = np.frombuffer(streams[i], np.uint8), 0
        while have < info["samples"] if info["samples"] else at < len(data):
            got, _, ends = decode_frames(data[at:], np.zeros(1, np.int64), info["width"])
            pieces[i] += got
            have, at = have + len(got[0]), at + int(ends[0])
    for i, (info, _, _) in enumerate(heads):
        samples = np.concatenate(pieces[i]) if pieces[i] else np.zeros(0, np.int64)
        kind = np.int8 if info["width"] <= 8 else "<i2" if info["width"] <= 16 else "<i4"
        raw = samples.astype(kind)
        packed = raw.tobytes() if info["width"] <= 16 else raw.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        if any(info["md5"]) and hashlib.md5(packed).digest() != info["md5"]:
            raise FlacError("the samples' MD5 is wrong")
        out[i] = (info, samples)
    return out
