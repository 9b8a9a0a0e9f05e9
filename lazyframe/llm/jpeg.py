"""Media columns: progressive JPEG, decoded in numpy to full-resolution RGB.

The decoder reads progressive files scan by scan: spectral selection says which
coefficients a scan fills, successive approximation to which bit; coefficient arrays
gather all scans, then one inverse transform gives samples, chroma is upsampled and RGB
stored. Scans whose Huffman table has a single symbol have a fixed stride and are read
at once, as are runs of ended blocks; all others are read symbol by symbol, each by one
look into a table of all 16-bit beginnings.

The encoder stores any bytes losslessly: each is one quantised coefficient. A byte b
becomes the AC value b (from 128 up) or b - 255 (below), whose eight magnitude bits in
JPEG's coding are b itself; the first coefficient of a block is the DC value b, sent bit
by bit by refinement scans. Chroma has half the resolution, as in ordinary files: 192 bytes
are two blocks of luma, one over the other, and half a block of each chroma. Bytes that follow each other lie next to each other in a scan,
and the steps of the quantiser are the largest, so both the file and the picture, which
shows noise in few tones, are small once packed.

RGB tensors are packed without loss, by their pixels alone, many pictures in a block.
"""

from __future__ import annotations

import bz2
import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, pieces, texts, work, written

UNIT = 192
LOW = 5  # AC coefficients 1 to LOW go in one scan, the others in a first and a refining scan
WIDEST = 8190  # blocks in a row of the picture; the format's 16-bit width allows one more, but an even number cuts no unit


def _zigzag() -> np.ndarray:
    """Row-major place of the k-th coefficient."""
    return np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """(coefficient in zigzag order, sample) of the two-dimensional inverse cosine transform."""
    x = np.arange(8)
    one = np.where(x == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()


#: What chroma adds to a tone, by its sample; green's two parts are summed up in 65536ths.
_CHROMA = np.arange(-128, 128)
RED, BLUE = (np.floor(x * _CHROMA + 0.5).astype(np.int16) for x in (1.402, 1.772))
GREEN_BY_CB, GREEN_BY_CR = np.rint(-0.344136 * 65536 * _CHROMA).astype(np.int32) + 32768, np.rint(-0.714136 * 65536 * _CHROMA).astype(np.int32)


class BadJpeg(ValueError):
    """The bytes aren't a progressive JPEG that this decoder knows."""


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, codes: list[tuple[int, int]]) -> bytes:
    """A Huffman table of (length, symbol), in canonical order."""
    counts = [sum(1 for n, _ in codes if n == k) for k in range(1, 17)]
    return _segment(0xC4, bytes([kind << 4 | number, *counts, *(s for _, s in sorted(codes, key=lambda x: x[0]))]))


def _scan(components: list[tuple[int, int, int]], start: int, end: int, high: int, low: int, data: bytes) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c, dc << 4 | ac]) for c, dc, ac in components) + bytes([start, end, high << 4 | low])
    return _segment(0xDA, body) + data.replace(b"\xff", b"\xff\x00")


#: Table numbers: DC 0 has "no difference"; AC 0 has 8-bit values, AC 1 7-bit values, AC 2 the runs of ended blocks.
_TABLES = _table(0, 0, [(1, 0x00)]) + _table(1, 0, [(1, 0x08)]) + _table(1, 1, [(1, 0x07)]) + _table(1, 2, [(4, k << 4) for k in range(15)])
#: The quantiser's step. Samples then reach far beyond the range of tones and are clipped, as to which decoders differ; up to 4 none do.
STEP = 255


def _quant(step: int) -> bytes:
    return _segment(0xDB, bytes([0, *[step] * 64]))


def _padded(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as bytes, filled up with ones."""
    short = -bits.shape[1] % 8
    return np.packbits(np.hstack([bits, np.ones((len(bits), short), np.uint8)]) if short else bits, axis=1)


def encode(payload: bytes, step: int = STEP) -> bytes:
    """A progressive JPEG whose quantised coefficients are ``payload`` (a positive multiple of 192 bytes)."""
    n = len(payload) // UNIT
    if not n or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    wide = min(n, WIDEST)
    tall = -(-n // wide)
    across = -(-wide // 2)
    sizes = (2 * tall * wide, tall * across, tall * across)  # blocks of each component
    blocks = sum(sizes)
    x = np.frombuffer(payload, np.uint8)
    if blocks * 64 > len(x):
        x = np.concatenate([x, np.zeros(blocks * 64 - len(x), np.uint8)])
    high, low, dc = (part.reshape(blocks, -1) for part in np.split(x, [blocks * (63 - LOW), blocks * 63]))
    of = [slice(end - size, end) for size, end in zip(sizes, np.cumsum(sizes).tolist(), strict=True)]
    parts = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _quant(step)]
    parts += [_segment(0xC2, struct.pack(">BHHB", 8, tall * 16, wide * 8, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES]
    every = [(c, 0, 0) for c in (1, 2, 3)]
    # a unit of the scans of all components: four blocks of luma, beyond the picture's edge of zeros, and one of each chroma
    luma = np.zeros((tall, 2, across, 2), np.uint8)
    luma.reshape(2 * tall, 2 * across)[:, :wide] = dc[of[0]].reshape(2 * tall, wide)
    dc = np.hstack([luma.transpose(0, 2, 1, 3).reshape(-1, 4), dc[of[1]], dc[of[2]]])
    parts.append(_scan(every, 0, 0, 0, 8, _padded(np.zeros((1, dc.size), np.uint8)).tobytes()))
    dc = np.unpackbits(dc.reshape(-1, 1), axis=1)
    for k, plane in enumerate(_padded(np.ascontiguousarray(dc.T))):
        parts.append(_scan(every, 0, 0, 8 - k, 7 - k, plane.tobytes()))
    low = np.unpackbits(low[..., None], axis=2)
    low = np.concatenate([np.zeros((*low.shape[:2], 1), np.uint8), low], axis=2)
    first = high >> 1
    fine = (high & 1) ^ (high < 128)
    for c in range(3):
        parts.append(_scan([(c + 1, 0, 0)], 1, LOW, 0, 0, _padded(low[of[c]].reshape(1, -1)).tobytes()))
        parts.append(_scan([(c + 1, 0, 1)], LOW + 1, 63, 0, 1, first[of[c]].tobytes()))
    most = 1 << 14
    for c in range(3):
        runs, mine = [], fine[of[c]]
        for a in range(0, len(mine), most):
            m = min(most, len(mine) - a)
            r = m.bit_length() - 1
            runs += [np.array([int(b) for b in f"{r:04b}" + (f"{m - (1 << r):0{r}b}" if r else "")], np.uint8), mine[a : a + m].ravel()]
        parts.append(_scan([(c + 1, 0, 2)], LOW + 1, 63, 1, 0, _padded(np.concatenate(runs)[None]).tobytes()))
    return b"".join([*parts, b"\xff\xd9"])


_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, at = {}, 0, 0
        for n, k in enumerate(counts, 1):
            for _ in range(k):
                self.codes[n, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.single = (counts.index(1) + 1, symbols[0]) if sum(counts) == 1 else None
        self._looks: list[tuple[int, int]] | None = None

    @property
    def looks(self) -> list[tuple[int, int]]:
        """(length, symbol) by the next 16 bits; length 0 where they begin no code."""
        if self._looks is None:
            got = [(0, 0)] * (1 << 16)
            for (n, code), symbol in self.codes.items():
                got[code << (16 - n) : (code + 1) << (16 - n)] = [(n, symbol)] * (1 << (16 - n))
            self._looks = got
        return self._looks


@lru_cache(maxsize=16)
def _huffman(counts: bytes, symbols: bytes) -> _Huffman:
    """Files that one encoder made share their tables."""
    return _Huffman(counts, symbols)


class _Bits:
    """Bits of a scan's data between two restart markers."""

    def __init__(self, data: bytes):
        self.data, self.at, self._bits, self._windows = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8), 0, None, None
        self.size = 8 * len(self.data)

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(self.data)
        return self._bits

    @property
    def windows(self) -> list[int]:
        """The 32 bits that begin at each byte."""
        if self._windows is None:
            d = np.concatenate([self.data, np.zeros(4, np.uint8)]).astype(np.uint32)
            self._windows = (d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]).tolist()
        return self._windows

    def take(self, n: int) -> int:
        """The next n bits, 16 at the most, as a number."""
        at = self.at
        self.at = at + n
        if self.at > self.size:
            raise BadJpeg("a scan ends early")
        return self.windows[at >> 3] >> (32 - (at & 7) - n) & ((1 << n) - 1)

    def many(self, n: int) -> np.ndarray:
        got = self.bits[self.at : self.at + n]
        if len(got) < n:
            raise BadJpeg("a scan ends early")
        self.at += n
        return got

    def symbol(self, table: _Huffman) -> int:
        at = self.at
        if at >= self.size:
            raise BadJpeg("a scan ends early")
        n, symbol = table.looks[self.windows[at >> 3] >> (16 - (at & 7)) & 0xFFFF]
        if not n:
            raise BadJpeg("an unknown code")
        self.at = at + n
        return symbol

    def value(self, size: int) -> int:
        """A number of ``size`` magnitude bits."""
        got = self.take(size)
        return got if got >> (size - 1) else got - (1 << size) + 1

    def fixed(self, count: int, skip: int, size: int) -> np.ndarray:
        """``count`` values of ``size`` bits, each after ``skip`` bits of code."""
        if skip + size == 8 and not self.at % 8:  # a value a byte
            got = self.data[self.at // 8 : self.at // 8 + count]
            if len(got) < count:
                raise BadJpeg("a scan ends early")
            self.at += 8 * count
            return _extended((got & ((1 << size) - 1)).astype(np.int32), size)
        rows = self.many(count * (skip + size)).reshape(count, skip + size)[:, skip:]
        if size <= 8:
            return _extended((np.packbits(rows, axis=1)[:, 0] >> (8 - size)).astype(np.int32), size)
        return _extended(rows.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32)), size)


def _extended(value, size: int):
    return np.where(value < 1 << (size - 1), value - (1 << size) + 1, value)


def _upsampled(x: np.ndarray, h: int, v: int) -> np.ndarray:
    """Samples at h times the width and v times the height: between two neighbours at three parts of the nearer
    and one of the farther, with the roundings of the usual decoders; other factors and pictures of two columns repeat."""
    if h != 2 or v > 2 or x.shape[1] <= 2:
        x = np.repeat(x, v, axis=0) if v > 1 else x
        return np.repeat(x, h, axis=1) if h > 1 else x
    x = x.astype(np.int16)
    bits, more = (2, (1, 2)) if v == 1 else (4, (8, 7))
    if v == 2:
        near = 3 * x
        x = np.stack([near + np.concatenate([x[:1], x[:-1]]), near + np.concatenate([x[1:], x[-1:]])], 1).reshape(-1, x.shape[1])
    near = 3 * x
    left, right = np.concatenate([x[:, :1], x[:, :-1]], 1), np.concatenate([x[:, 1:], x[:, -1:]], 1)
    return (np.stack([near + left + more[0], near + right + more[1]], 2) >> bits).reshape(len(x), -1).astype(np.uint8)


class Picture:
    """Coefficients (per component: blocks down, blocks across, 64 in zigzag order) and what is needed to show them."""

    def __init__(self, data: bytes):
        self.comments, self.quant, self.components, self.coefficients, self.restart = [], {}, [], [], 0
        self.dc: dict[int, _Huffman] = {}
        self.ac: dict[int, _Huffman] = {}
        try:
            self._read(data)
        except (IndexError, KeyError, TypeError, ValueError, struct.error) as e:
            raise e if isinstance(e, BadJpeg) else BadJpeg(f"damaged: {e!r}") from e

    def _read(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise BadJpeg("no JPEG")
        at, done = 2, False
        while at < len(data) and not done:
            if data[at] != 0xFF:
                raise BadJpeg("no marker")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                done = True
                continue
            n = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDB:
                self._quant(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, *range(0xC3, 0xD0)) and marker not in (0xC4, 0xC8, 0xCC):
                raise BadJpeg("not progressive")
            elif marker == 0xDA:
                end = _END.search(data, at)
                stop = end.start() if end else len(data)
                self._scan(body, data[at:stop])
                at = stop
        if not self.components:
            raise BadJpeg("no frame")

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            self.quant[number] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.float32)
            at += 65 + 64 * bool(wide)

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            (self.ac if body[at] >> 4 else self.dc)[body[at] & 15] = _huffman(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if bits != 8 or n not in (1, 3) or not self.height or not self.width:
            raise BadJpeg("only 8-bit pictures of one or three components")
        self.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        self.most = max(c[1] for c in self.components), max(c[2] for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
        self.orders: dict[tuple[int, ...], list[np.ndarray]] = {}
        self.coefficients = [np.zeros((self.down * v, self.across * h, 64), np.int32) for _, h, v, _ in self.components]

    def _order(self, chosen: list[int]) -> list[np.ndarray]:
        """For each chosen component its blocks (flat numbers) in the scan's order, a row a unit."""
        if len(chosen) == 1:
            _, h, v, _ = self.components[chosen[0]]
            wide = -(-(-(-self.width * h // self.most[0])) // 8)
            tall = -(-(-(-self.height * v // self.most[1])) // 8)
            return [(np.arange(tall)[:, None] * (self.across * h) + np.arange(wide)).reshape(-1, 1)]
        out = []
        for k in chosen:
            _, h, v, _ = self.components[k]
            rows = np.arange(self.down)[:, None, None, None] * v + np.arange(v)[None, None, :, None]
            cols = np.arange(self.across)[None, :, None, None] * h + np.arange(h)[None, None, None, :]
            out.append((rows * (self.across * h) + cols).reshape(-1, h * v))
        return out

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        names = [c[0] for c in self.components]
        chosen = [names.index(body[1 + 2 * k]) for k in range(n)]
        tables = [(body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
        start, end, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        order = self.orders.get(tuple(chosen))
        if order is None:
            order = self.orders[tuple(chosen)] = self._order(chosen)
        units = len(order[0])
        if start == 0 and high and not self.restart:
            return self._dc_refine(_Bits(data), chosen, order, low)
        flat = [self.coefficients[k].reshape(-1, 64) for k in chosen]
        step = self.restart or units
        pieces = re.split(rb"\xff[\xd0-\xd7]", data) if self.restart else [data]
        for k, a in enumerate(range(0, units, step)):
            bits, part = _Bits(pieces[k]), [o[a : a + step] for o in order]
            if start == 0 and high:
                # one raw bit a block, in the order of the units
                widths = [p.shape[1] for p in part]
                got = bits.many(len(part[0]) * sum(widths)).reshape(-1, sum(widths)).astype(np.int32)
                for f, p, w, first in zip(flat, part, widths, np.cumsum([0, *widths[:-1]]), strict=True):
                    f[p, 0] |= got[:, first : first + w] << low
            elif start == 0:
                self._dc_first(bits, flat, part, [self.dc[t[0]] for t in tables], low)
            elif high:
                self._ac_refine(bits, flat[0], part[0].ravel(), self.ac[tables[0][1]], start, end, low)
            else:
                self._ac_first(bits, flat[0], part[0].ravel(), self.ac[tables[0][1]], start, end, low)

    def _dc_refine(self, bits, chosen, order, low) -> None:
        """One raw bit a block, for all units at once."""
        widths = [p.shape[1] for p in order]
        got = bits.many(len(order[0]) * sum(widths)).reshape(-1, sum(widths)).astype(np.int32) << low
        first = 0
        for c, p, w in zip(chosen, order, widths, strict=True):
            x, mine = self.coefficients[c], got[:, first : first + w]
            first += w
            if p.size < x.size // 64:
                x.reshape(-1, 64)[p, 0] |= mine
            elif w == 1:
                x.reshape(-1, 64)[:, 0] |= mine[:, 0]
            else:  # the same blocks as a view, faster than by their numbers
                _, h, v, _ = self.components[c]
                there = x[:, :, 0].reshape(self.down, v, self.across, h).transpose(0, 2, 1, 3)
                there |= mine.reshape(there.shape)

    @staticmethod
    def _dc_first(bits, flat, part, tables, low) -> None:
        if all(t.single and t.single[1] == 0 for t in tables):
            return  # no block differs from the one before it, and the first from 0
        places, values = [[] for _ in flat], [[] for _ in flat]
        before = [0] * len(flat)
        part = [p.tolist() for p in part]
        for unit in range(len(part[0])):
            for k, (p, t) in enumerate(zip(part, tables, strict=True)):
                for block in p[unit]:
                    size = bits.symbol(t)
                    if size:
                        before[k] += bits.value(size)
                    places[k].append(block)
                    values[k].append(before[k] << low)
        for f, p, v in zip(flat, places, values, strict=True):
            f[p, 0] = v

    @staticmethod
    def _ac_first(bits, f, blocks, table, start, end, low) -> None:
        if table.single and table.single[1] >> 4 == 0 and table.single[1] & 15:
            n, size = table.single
            values = bits.fixed(len(blocks) * (end - start + 1), n, size)
            into = slice(None) if len(blocks) == len(f) else blocks
            f[into, start : end + 1] = (values << low).reshape(len(blocks), -1)
            return
        run, places, values = 0, [], []
        for block in blocks.tolist():
            if run:
                run -= 1
                continue
            k = start
            while k <= end:
                symbol = bits.symbol(table)
                zeros, size = symbol >> 4, symbol & 15
                if size:
                    k += zeros
                    if k > end:
                        raise BadJpeg("a run of zeros leaves the band")
                    places.append((block, k))
                    values.append(bits.value(size) * (1 << low))
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) - 1 + (bits.take(zeros) if zeros else 0)
                    break
        if places:
            f[tuple(np.array(places).T)] = values

    @staticmethod
    def _ac_refine(bits, f, blocks, table, start, end, low) -> None:
        one, at, take = 1 << low, 0, bits.take

        def corrected(x: int) -> int:
            return x + (one if x > 0 else -one) if take(1) and not abs(x) & one else x

        while at < len(blocks):
            block, k = blocks[at], start
            row = None
            while k <= end:
                symbol = bits.symbol(table)
                zeros, size = symbol >> 4, symbol & 15
                if not size and zeros < 15:
                    run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                    if row is not None:
                        for j in range(k, end + 1):
                            if row[j]:
                                row[j] = corrected(row[j])
                        f[block] = row
                        at, run = at + 1, run - 1
                    mine = blocks[at : at + run]
                    if len(mine) and mine[-1] - mine[0] == len(mine) - 1:
                        mine = slice(mine[0], mine[-1] + 1)
                    band = f[mine, start : end + 1]
                    there = band != 0
                    if there.all():
                        fine = bits.many(band.size).reshape(band.shape).astype(np.int32)
                    else:
                        fine = np.zeros(band.shape, np.int32)
                        fine[there] = bits.many(int(there.sum()))
                    fine &= (np.abs(band) & one) == 0
                    f[mine, start : end + 1] = band + np.where(band < 0, -fine, fine) * one
                    at += run
                    break
                if row is None:
                    row = f[block].tolist()
                value = (one if take(1) else -one) if size else 0
                while k <= end:
                    if row[k]:
                        row[k] = corrected(row[k])
                    elif zeros:
                        zeros -= 1
                    else:
                        break
                    k += 1
                if value and k <= end:
                    row[k] = value
                k += 1
            else:
                f[block] = row
                at += 1

    def rgb(self) -> np.ndarray:
        """(height, width, 3) bytes: transformed, chroma interpolated to full resolution, converted."""
        planes = []
        for (_, h, v, q), x in zip(self.components, self.coefficients, strict=True):
            tall, wide, _ = x.shape
            s = (x.reshape(-1, 64) * self.quant[q]) @ BASIS
            s += np.float32(128.5)  # a half is rounded by cutting off
            s = np.clip(s, 0, 255, out=s).astype(np.uint8).reshape(tall, wide, 8, 8).transpose(0, 2, 1, 3).reshape(tall * 8, wide * 8)
            s = s[: -(-self.height * v // self.most[1]), : -(-self.width * h // self.most[0])]
            planes.append(_upsampled(s, self.most[0] // h, self.most[1] // v)[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        y, cb, cr = planes
        y = y.astype(np.int16)
        out = np.empty((*y.shape, 3), np.uint8)
        for k, more in enumerate((RED[cr], (GREEN_BY_CB[cb] + GREEN_BY_CR[cr]) >> 16, BLUE[cb])):
            out[:, :, k] = np.clip(y + more, 0, 255)
        return out

    def payload(self) -> bytes:
        """The bytes that ``encode`` stored."""
        n = next((int(c[8:]) for c in self.comments if c.startswith(b"payload ")), None)
        if n is None:
            raise BadJpeg("it stores no payload")
        # blocks beyond the picture's edge only fill its units
        x = np.concatenate([c[: -(-self.height * v // (8 * self.most[1])), : -(-self.width * h // (8 * self.most[0]))].reshape(-1, 64) for (_, h, v, _), c in zip(self.components, self.coefficients, strict=True)])
        x = np.where(x < 0, x + 255, x).astype(np.uint8)
        return b"".join(x[:, a:b].tobytes() for a, b in ((LOW + 1, 64), (1, LOW + 1), (0, 1)))[:n]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes filled with blanks to a positive multiple of 192, the bytes before that)."""
    data = (text or "").encode()
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)), len(data)


#: Pixels after which a block of packed pictures is full; it ends with a whole picture.
BLOCK = 1 << 22
_HEAD = struct.Struct(">BQ")


def _paired(x: np.ndarray) -> np.ndarray:
    """The pixels with the second row and the third, the fourth and the fifth, and so on, taken by columns: where
    chroma had half the resolution, such two rows lie between the same two rows of it, so one nearly tells the other."""
    n = (len(x) - 1) // 2
    return np.concatenate([x[0], x[1 : 2 * n + 1].reshape(n, 2, x.shape[1]).transpose(0, 2, 1).ravel(), x[2 * n + 1 :].ravel()])


def _unpaired(x: np.ndarray, height: int, width: int) -> np.ndarray:
    n = (height - 1) // 2
    out = np.empty((height, width), x.dtype)
    first, pairs, last = np.split(x, [width, (2 * n + 1) * width])
    out[0] = first
    out[1 : 2 * n + 1].reshape(n, 2, width)[:] = pairs.reshape(n, width, 2).transpose(0, 2, 1)
    out[2 * n + 1 :] = last.reshape(-1, width)
    return out


def pack(pictures: list[np.ndarray]) -> bytes:
    """RGB pictures (height, width, 3 bytes), any at all, without loss: a byte a pixel names one of 255 colours or, as 0, one
    spelled out beside. Both are sorted by what follows them (bz2), which fits noise of few tones better than repeats do."""
    colours = []
    for x in pictures:
        wide = np.zeros((*x.shape[:2], 4), np.uint8)
        wide[:, :, :3] = x
        colours.append(_paired(wide.view("<u4")[:, :, 0]))
    colours = np.concatenate(colours)
    # which colours get names may be told by a part of the pixels
    some, counts = np.unique(colours[:: max(1, len(colours) >> 17)], return_counts=True)
    named = some[np.argsort(-counts, kind="stable")[:255]]
    names = np.zeros(1 << 24, np.uint8)
    names[named] = np.arange(1, len(named) + 1)
    name = names[colours]
    bare = [x.view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for x in (named, colours[name == 0])]
    packed = bz2.compress(name.tobytes())
    return b"".join([_HEAD.pack(len(named), len(packed)), bare[0], packed, bz2.compress(bare[1])])


def unpack(data: bytes, sizes: list[tuple[int, int]]) -> list[np.ndarray]:
    """The pictures of these (height, width) that ``pack`` packed."""
    n, size = _HEAD.unpack_from(data)
    at = _HEAD.size + 3 * n
    colours = np.zeros((n + 1, 4), np.uint8)
    colours[1:, :3] = np.frombuffer(data, np.uint8, 3 * n, _HEAD.size).reshape(-1, 3)
    name = np.frombuffer(bz2.decompress(data[at : at + size]), np.uint8)
    pixels = colours.view("<u4")[:, 0][name]
    rest = np.frombuffer(bz2.decompress(data[at + size :]), np.uint8).reshape(-1, 3)
    wide = np.zeros((len(rest), 4), np.uint8)
    wide[:, :3] = rest
    pixels[name == 0] = wide.view("<u4")[:, 0]
    out, at = [], 0
    for height, width in sizes:
        x = _unpaired(pixels[at : at + height * width], height, width)
        out.append(np.ascontiguousarray(x.view(np.uint8).reshape(height, width, 4)[:, :, :3]))
        at += height * width
    return out


def decode_column(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with a struct ``rgb`` (height, width, data) decoded from a binary column; null where it is null.

    Bytes that aren't a progressive JPEG fail the job rather than vanish.
    """
    @F.pandas_udf("height int, width int, data binary")
    def run(column):
        import pandas as pd

        made = [None if x is None else Picture(bytes(x)).rgb() for x in column]
        return pd.DataFrame({"height": [None if x is None else x.shape[0] for x in made], "width": [None if x is None else x.shape[1] for x in made], "data": [None if x is None else x.tobytes() for x in made]}).astype({"height": "Int32", "width": "Int32"})

    return df.withColumn("rgb", F.when(F.col(media).isNotNull(), run(F.col(media))))


def store_texts(docs: DataFrame) -> DataFrame:
    """Stores every row's whole text as a progressive JPEG, reads it back and describes it.

    Two tables of the shared folder: the media as encoded, and what is decoded from the media
    reread, with the RGB tensors, packed in blocks of rows; the means come from these reread.
    Row by row and without a shuffle; memory is bounded by the Arrow batch, cut by bytes
    through its row count, a block and one picture. Null texts count as empty (192 blanks); null ids are kept; repeated rows give
    equal values; an empty table gives none.
    """
    stored = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("media", pa.binary())])
    decoded = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])
    digest = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    described = pa.schema([*list(decoded)[:7], ("feature", pa.string())])
    blocks = pa.schema([*((x.name, pa.list_(x.type)) for x in list(decoded)[:9]), ("packed", pa.binary())])

    @work("jpeg")
    def store(batches):
        for x in pieces(batches, 500):
            rows = []
            for doc_id, text in zip(x.column(0).to_pylist(), texts(x.column(1)), strict=True):
                payload, n = payload_of(text)
                rows.append((doc_id, n, hashlib.sha256(payload).hexdigest(), encode(payload)))
            yield batch(stored, *zip(*rows, strict=True))

    @work("jpeg")
    def decode(batches):
        rows, pictures, pixels = [], [], 0
        for x in pieces(batches, 500):
            for doc_id, n, sha, media in zip(*(x.column(k).to_pylist() for k in range(4)), strict=True):
                picture = Picture(media)
                back, rgb = picture.payload(), picture.rgb()
                told = hashlib.sha256(back).hexdigest()
                if told != sha:
                    raise ValueError(f"document {doc_id} isn't read back as stored")
                rows.append((doc_id, n, len(back), told, zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), *rgb.shape[:2]))
                pictures.append(rgb)
                pixels += rgb.size // 3
                if pixels >= BLOCK:
                    yield batch(blocks, *([list(c)] for c in zip(*rows, strict=True)), [pack(pictures)])
                    rows, pictures, pixels = [], [], 0
        if rows:
            yield batch(blocks, *([list(c)] for c in zip(*rows, strict=True)), [pack(pictures)])

    def unpacked(batches):
        """(columns but for the tensors, tensors) of each block."""
        for x in batches:
            for k in range(x.num_rows):
                columns = [x.column(c)[k].values for c in range(9)]
                yield columns, unpack(x.column(9)[k].as_py(), list(zip(*(c.to_pylist() for c in columns[7:]), strict=True)))

    @work("jpeg")
    def show(batches):
        for columns, pictures in unpacked(batches):
            yield batch(decoded, *columns, [x.tobytes() for x in pictures])

    @work("jpeg")
    def describe(batches):
        for columns, pictures in unpacked(batches):
            means = [x.reshape(-1, 3).mean(axis=0, dtype=np.float64) for x in pictures]
            yield batch(described, *columns[:7], [f"{x.shape[1]}x{x.shape[0]}:" + ",".join(f"{m:.2f}" for m in mean) for x, mean in zip(pictures, means, strict=True)])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
    media = written(d.mapInArrow(store, "doc_id long, n_bytes long, sha256 string, media binary"), "media", **packed)
    lists = ", ".join(f"{name} array<{kind}>" for name, kind in (x.split() for x in f"{digest}, height int, width int".split(", ")))
    tensors = written(media.mapInArrow(decode, f"{lists}, packed binary"), "tensors", read=lambda t: t.mapInArrow(show, f"{digest}, height int, width int, rgb binary"), **packed)
    return tensors.stored.mapInArrow(describe, f"{digest}, feature string")
