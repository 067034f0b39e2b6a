"""Progressive JPEG in numpy: a lossless byte store and a decoder to full-resolution RGB tensors.

``encode`` stores a payload as the quantised coefficients of a YCbCr 4:2:0
progressive JPEG: one byte, one coefficient.  Byte b becomes a coefficient of
magnitude 2 to 129, so no coefficient is zero, and the scans are

1. DC of all components, interleaved, without its lowest bit;
2. AC without the lowest bit, the luma in two spectral bands, each chroma in one;
3. a DC refinement and three AC refinements that add the lowest bit.

The Huffman tables give size s a code of W - s bits, which is the best code for
evenly spread coefficients and makes every coded coefficient W bits long.  The
payload's length stands in a comment segment.

``decode`` reads any baseline-precision progressive JPEG (spectral selection,
successive approximation, end-of-band runs, restart intervals, 1 to 4
components of any sampling): it accumulates the scans into coefficient arrays.
Runs of blocks whose codes all have one length, end-of-band runs in refinements
and DC refinements are read for all blocks at once; everything else is read
code by code.  ``to_rgb`` dequantises, applies the inverse transform in strips
of bounded size, upsamples chroma and converts to RGB.

Defined results: null text counts as empty; an empty payload is padded to one
unit of 576 bytes; equal texts give equal files, tensors and features; rows are
handled one by one, so repeated rows, ties, empty tables and null ids need no
special care; extra columns are never read; an id may have any name (a result column
of that name gets an underscore).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagevault.llm.store import batched, beside, col, column, table

UNIT = 576  # a payload's length is a positive multiple of this
STRIP = 1 << 14  # blocks transformed at once
RESULT_BYTES = 4 << 20  # of tensors after which a batch of results is passed on


def _zigzag() -> np.ndarray:
    """Natural position of each coefficient in scan order."""
    order = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([i * 8 + j for i, j in order])


ZIGZAG = _zigzag()
NATURAL = np.argsort(ZIGZAG)


def _dct() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    m = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m.astype(np.float32)


DCT = _dct()


@dataclass
class Huffman:
    """A table in JPEG's form: counts of codes by length (1 to 16) and symbols in order."""

    counts: list[int]
    symbols: list[int]
    codes: dict[tuple[int, int], int] = field(init=False)
    lengths: dict[int, tuple[int, int]] = field(init=False)
    _widths: dict[bool, int] = field(init=False, default_factory=dict)
    _levels: dict[bool, np.ndarray | None] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.codes, self.lengths, code, k = {}, {}, 0, 0
        for n, count in enumerate(self.counts, 1):
            for _ in range(count):
                self.codes[n, code] = self.symbols[k]
                self.lengths[self.symbols[k]] = (n, code)
                code, k = code + 1, k + 1
            code <<= 1

    def width(self, dc: bool) -> int:
        """The common length of a code with its extra bits over the symbols with a size, or 0."""
        if dc not in self._widths:
            found = {n + s for s, (n, _) in self.lengths.items() if (dc or 0 < s < 16)}
            self._widths[dc] = found.pop() if len(found) == 1 else 0
        return self._widths[dc]

    def level(self, dc: bool) -> np.ndarray | None:
        """For tables of one width: the value of each bit pattern of that width (INVALID where there is none)."""
        if dc not in self._levels:
            w, out = self.width(dc), None
            if 0 < w <= 16:
                out = np.full(1 << w, INVALID, dtype=np.int32)
                for s, (n, code) in self.lengths.items():
                    if dc or 0 < s < 16:
                        v = np.arange(1 << s)
                        out[(code << s) + v] = np.where(v < (1 << s >> 1), v - (1 << s) + 1, v)
            self._levels[dc] = out
        return self._levels[dc]


INVALID = 1 << 20  # above every value
DC_WIDTH, AC_WIDTH = 9, 8
DC_TABLE = Huffman([1] * 9 + [0] * 7, [8, 7, 6, 5, 4, 3, 2, 1, 0])
AC_TABLE = Huffman([1] * 8 + [0] * 8, [7, 6, 5, 4, 3, 2, 1, 0])
REFINE_TABLE = Huffman([0, 0, 0, 15] + [0] * 12, [n << 4 for n in range(15)])

_byte = np.arange(256)
VALUE = np.where(_byte < 128, _byte + 2, 126 - _byte).astype(np.int16)  # the coefficient of a byte
BYTE = np.zeros(512, dtype=np.uint8)  # and back, at coefficient + 256
BYTE[VALUE + 256] = _byte


def _field(values: np.ndarray, table: Huffman, width: int, dc: bool) -> np.ndarray:
    """The bit pattern of each value under a table of one width."""
    level = table.level(dc)
    known = np.flatnonzero(level != INVALID)
    back = np.zeros(1024, dtype=np.uint16)
    back[level[known] + 512] = known
    return back[values + 512]


_AC_FIELD = np.zeros(256, dtype=np.uint8)
_AC_FIELD[:] = _field(np.sign(VALUE) * (np.abs(VALUE) >> 1), AC_TABLE, AC_WIDTH, False)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _dht(kind: int, slot: int, t: Huffman) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | slot, *t.counts, *t.symbols]))


def _sos(parts: list[tuple[int, int, int]], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *[x for c, d, a in parts for x in (c, d << 4 | a)], first, last, high << 4 | low]))


def _stuffed(raw: np.ndarray) -> bytes:
    return raw.tobytes().replace(b"\xff", b"\xff\x00")


def _unstuffed(data: bytes) -> np.ndarray:
    return np.frombuffer(data.replace(b"\xff\x00", b"\xff"), dtype=np.uint8)


def _packed(bits: np.ndarray) -> bytes:
    """Bits to stuffed bytes, padded with ones."""
    raw = np.packbits(bits)
    if short := -len(bits) % 8:
        raw[-1] |= (1 << short) - 1
    return _stuffed(raw)


def geometry(payload: int) -> tuple[int, int]:
    """Width and height in units of 16 x 16 pixels (six blocks) for so many bytes."""
    n = -(-payload // 384)
    across = int(np.ceil(np.sqrt(n)))
    return across, -(-n // across)


_HEAD = _segment(0xDB, bytes([0]) + bytes([1]) * 64)
_TABLES = _dht(0, 0, DC_TABLE) + _dht(1, 0, AC_TABLE) + _dht(1, 1, REFINE_TABLE)
_ALL = [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
_DC_SCAN, _DC_REFINEMENT = _sos(_ALL, 0, 0, 0, 1), _sos(_ALL, 0, 0, 1, 0)
_AC_SCANS = [(c, a, b, _sos([(c + 1, 0, 0)], a, b, 0, 1)) for c, a, b in ((0, 1, 5), (1, 1, 63), (2, 1, 63), (0, 6, 63))]
_AC_REFINEMENTS = [_sos([(c + 1, 0, 1)], 1, 63, 1, 0) for c in range(3)]
_HALF = VALUE >> 1  # the DC coefficient of a byte without its lowest bit, which is that of the byte
_DC_BITS = np.unpackbits(_field(np.arange(-255, 256), DC_TABLE, DC_WIDTH, True).astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - DC_WIDTH :]  # of each difference + 255


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences to the value before, the first to 0."""
    out = x.copy()
    out[1:] -= x[:-1]
    return out


@lru_cache(maxsize=1024)
def _run_bits(run: int) -> np.ndarray:
    """The code of an end-of-band run of so many blocks."""
    e = run.bit_length() - 1
    size, code = REFINE_TABLE.lengths[e << 4]
    sign = (code << e) + run - (1 << e)
    return np.array([sign >> k & 1 for k in range(size + e - 1, -1, -1)], dtype=np.uint8)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload`` in its coefficients."""
    across, down = geometry(len(payload))
    n = across * down
    data = np.full(n * 384, 255, dtype=np.uint8)
    data[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    blocks, coded, low = data.reshape(-1, 64), _AC_FIELD[data].reshape(-1, 64), (data & 1).reshape(-1, 64)
    parts = [slice(0, 4 * n), slice(4 * n, 5 * n), slice(5 * n, 6 * n)]
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _HEAD]
    out += [_segment(0xC2, bytes([8]) + (down * 16).to_bytes(2, "big") + (across * 16).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES]
    dc = np.empty((n, 6), dtype=np.uint8)  # bytes of a unit's DC coefficients
    dc[:, :4] = blocks[parts[0], 0].reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    dc[:, 4], dc[:, 5] = blocks[parts[1], 0], blocks[parts[2], 0]
    units = _HALF[dc]
    units[:, :4] = _steps(units[:, :4].reshape(-1)).reshape(-1, 4)
    units[:, 4:] = _steps(units[:, 4:])
    out += [_DC_SCAN, _packed(_DC_BITS[units.reshape(-1) + 255].reshape(-1))]
    for c, a, b, head in _AC_SCANS:
        out += [head, _stuffed(coded[parts[c], a : b + 1])]
    out += [_DC_REFINEMENT, _packed((dc & 1).reshape(-1))]
    for part, head in zip(parts, _AC_REFINEMENTS, strict=True):
        bits = low[part, 1:]
        runs = []
        for at in range(0, len(bits), 32767):
            run = bits[at : at + 32767]
            runs += [_run_bits(len(run)), run.reshape(-1)]
        out += [head, _packed(np.concatenate(runs))]
    return b"".join([*out, b"\xff\xd9"])


@dataclass
class Component:
    h: int
    v: int
    quant: int
    blocks: np.ndarray  # (rows, columns, 64) coefficients in scan order
    rows: int = 0  # of blocks in a scan of this component alone
    columns: int = 0


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes


class _Bits:
    """Bits of one entropy-coded stretch; ones follow its end."""

    def __init__(self, raw: np.ndarray) -> None:
        self.raw, self.at = raw, 0

    @cached_property
    def bits(self) -> np.ndarray:
        return np.unpackbits(self.raw)

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | (int(self.bits[self.at]) if self.at < len(self.bits) else 1)
            self.at += 1
        return v

    def symbol(self, t: Huffman) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in t.codes:
                return t.codes[n, code]
        raise ValueError("a code that the Huffman table doesn't have")

    def fields(self, n: int, width: int) -> np.ndarray | None:
        """The next n fields of one width, without moving on; None if there are fewer bits."""
        if self.at + n * width > 8 * len(self.raw):
            return None
        if width == 8 and self.at % 8 == 0:
            return self.raw[self.at // 8 : self.at // 8 + n]
        part = self.bits[self.at : self.at + n * width]
        wide = np.zeros((n, 16), dtype=np.uint8)
        wide[:, 16 - width :] = part.reshape(n, width)
        return np.packbits(wide, axis=1).view(">u2").reshape(-1).astype(np.int64)


def _extend(v: int, s: int) -> int:
    return v - (1 << s) + 1 if s and v < 1 << (s - 1) else v


def _dc_first(bits: _Bits, order: list[tuple[int, np.ndarray]], tables: list[Huffman], low: int) -> None:
    """order: for each unit of a data unit, its component's place in the scan and all blocks' DC in turn, as (units, 1) views."""
    n = len(order[0][1])
    level = tables[0].level(True)
    if level is not None and all(t is tables[0] for t in tables) and (f := bits.fields(n * len(order), tables[0].width(True))) is not None:
        diff = level[f].reshape(n, len(order))
        if diff.max() < INVALID:
            bits.at += n * len(order) * tables[0].width(True)
            for part in {p for p, _ in order}:
                mine = [k for k, (p, _) in enumerate(order) if p == part]
                total = np.cumsum(diff[:, mine].reshape(-1)).reshape(n, len(mine)) << low
                for j, k in enumerate(mine):
                    order[k][1][:, 0] = total[:, j]
            return
    last = dict.fromkeys((p for p, _ in order), 0)
    for i in range(n):
        for p, block in order:
            s = bits.symbol(tables[p])
            last[p] += _extend(bits.take(s), s)
            block[i, 0] = last[p] << low


def _ac_first(bits: _Bits, blocks: np.ndarray, t: Huffman, a: int, b: int, low: int) -> None:
    n, level = len(blocks) * (b - a + 1), t.level(False)
    if level is not None and (f := bits.fields(n, t.width(False))) is not None:
        v = level[f]
        if v.max() < INVALID:
            bits.at += n * t.width(False)
            blocks[:, a : b + 1] = (v << low).reshape(len(blocks), -1)
            return
    skip = 0
    for block in blocks:
        if skip:
            skip -= 1
            continue
        k = a
        while k <= b:
            r, s = divmod(bits.symbol(t), 16)
            if s:
                k += r
                block[k] = _extend(bits.take(s), s) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                skip = (1 << r) + bits.take(r) - 1
                break


def _ac_refine(bits: _Bits, blocks: np.ndarray, t: Huffman, a: int, b: int, low: int) -> None:
    bit = 1 << low
    i = 0

    def amend(block: np.ndarray, k: int) -> None:
        if bits.take(1):
            block[k] += bit if block[k] > 0 else -bit

    while i < len(blocks):
        block, k, run = blocks[i], a, 0
        while k <= b:
            r, s = divmod(bits.symbol(t), 16)
            new = 0
            if s:
                new = bit if bits.take(1) else -bit
            elif r < 15:
                run = (1 << r) + bits.take(r)
                break
            while k <= b:
                if block[k]:
                    amend(block, k)
                elif r:
                    r -= 1
                else:
                    break
                k += 1
            if new and k <= b:
                block[k] = new
            k += 1
        if not run:
            i += 1
            continue
        rest = blocks[i : i + run, a : b + 1]  # the run's blocks, the first from k on: bits for what is not zero
        mask = rest != 0
        mask[0, : k - a] = False
        held = int(np.count_nonzero(mask))
        more = bits.bits[bits.at : bits.at + held].astype(rest.dtype)
        bits.at += held
        if held == mask.size:
            rest += np.sign(rest) * (more.reshape(rest.shape) << low)
        else:
            rest[mask] += np.sign(rest[mask]) * (more << low)
        i += run


MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")  # that ends a scan
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


@lru_cache(maxsize=64)
def _table(spec: bytes) -> Huffman:
    return Huffman(list(spec[:16]), list(spec[16:]))


def decode(data: bytes) -> Image:
    """Coefficient arrays of a progressive JPEG, all scans accumulated."""
    at, quant, tables, image, restart = 2, {}, {}, None, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    comment = b""
    while at < len(data):
        if data[at] != 255:
            raise ValueError("a marker is missing")
        m = data[at + 1]
        if m == 0xD9:
            break
        if m == 255:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if m == 0xFE:
            comment = body
        elif m == 0xDD:
            restart = int.from_bytes(body, "big")
        elif m == 0xDB:
            while body:
                wide, slot = divmod(body[0], 16)
                n = 64 << wide
                quant[slot] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif m == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                tables[divmod(body[0], 16)] = _table(body[1 : 17 + n])
                body = body[17 + n :]
        elif m in (0xC0, 0xC1, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif m == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            specs = [(body[6 + 3 * i], *divmod(body[7 + 3 * i], 16), body[8 + 3 * i]) for i in range(body[5])]
            hmax, vmax = max(s[1] for s in specs), max(s[2] for s in specs)
            across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            parts = [Component(h, v, q, np.zeros((down * v, across * h, 64), dtype=np.int16), -(-(-(-height * v // vmax)) // 8), -(-(-(-width * h // hmax)) // 8)) for _, h, v, q in specs]
            ids = {s[0]: i for i, s in enumerate(specs)}
            image = Image(width, height, parts, quant, comment)
        elif m == 0xDA:
            if image is None:
                raise ValueError("a scan before the frame")
            n = body[0]
            inside = [(image.components[ids[body[1 + 2 * i]]], *divmod(body[2 + 2 * i], 16)) for i in range(n)]
            a, b, high, low = body[1 + 2 * n], body[2 + 2 * n], *divmod(body[3 + 2 * n], 16)
            end = found.start() if (found := MARKER.search(data, at)) else len(data)
            stretches = [_unstuffed(x) for x in RESTART.split(data[at:end])]
            _scan(image, inside, tables, stretches, a, b, high, low, restart)
            at = end
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def _scan(image: Image, inside: list, tables: dict, stretches: list[np.ndarray], a: int, b: int, high: int, low: int, restart: int) -> None:
    if len(inside) == 1:
        c = inside[0][0]
        whole = c.blocks[: c.rows, : c.columns]
        blocks = whole.reshape(-1, 64)  # a copy where the frame is wider than the component
        order = [(0, blocks)]
    else:  # of DC coefficients only: those of a unit side by side
        dcs = [x for c, _, _ in inside for x in [c.blocks[:, :, 0].reshape(c.blocks.shape[0] // c.v, c.v, c.blocks.shape[1] // c.h, c.h).transpose(0, 2, 1, 3)]]
        held = [x.reshape(-1, x.shape[2] * x.shape[3]) for x in dcs]
        order = [(p, x[:, k : k + 1]) for p, x in enumerate(held) for k in range(x.shape[1])]
    n = len(order[0][1])
    step = restart or n
    for i, stretch in enumerate(stretches):
        lo, hi = i * step, min(n, (i + 1) * step)
        if lo >= hi:
            break
        bits, part = _Bits(stretch), [(p, x[lo:hi]) for p, x in order]
        if a == 0 and high == 0:
            _dc_first(bits, part, [tables[0, d] for _, d, _ in inside], low)
        elif a == 0:
            count = (hi - lo) * len(part)
            got = bits.bits[:count].reshape(hi - lo, len(part))
            for k, (_, x) in enumerate(part):
                x[:, 0] |= got[:, k].astype(np.int16) << low
        elif high == 0:
            _ac_first(bits, part[0][1], tables[1, inside[0][2]], a, b, low)
        else:
            _ac_refine(bits, part[0][1], tables[1, inside[0][2]], a, b, low)
    if len(inside) > 1:
        for (c, _, _), x, mine in zip(inside, dcs, held, strict=True):
            c.blocks[:, :, 0] = mine.reshape(x.shape).transpose(0, 2, 1, 3).reshape(c.blocks.shape[:2])
    elif not np.shares_memory(blocks, c.blocks):
        whole[:] = blocks.reshape(whole.shape)


def _plane(c: Component, quant: np.ndarray) -> np.ndarray:
    """Samples (float, without the level shift) of one component."""
    rows, columns, _ = c.blocks.shape
    flat = c.blocks.reshape(-1, 64)
    out = np.empty((rows * columns, 8, 8), dtype=np.float32)
    quant = quant[NATURAL]
    for i in range(0, len(flat), STRIP):
        x = (flat[i : i + STRIP].take(NATURAL, axis=1) * quant).reshape(-1, 8)
        x = (x @ DCT).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8)
        out[i : i + STRIP] = (x @ DCT).reshape(-1, 8, 8).transpose(0, 2, 1)
    return out.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)


def to_rgb(image: Image) -> np.ndarray:
    """The full-resolution tensor (height, width, 3) of 8-bit samples."""
    hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        p = _plane(c, image.quant[c.quant])
        p = np.repeat(np.repeat(p, vmax // c.v, axis=0), hmax // c.h, axis=1)
        planes.append(p[: image.height, : image.width])
    if len(planes) < 3:
        y = np.clip(np.rint(planes[0] + 128), 0, 255).astype(np.uint8)
        return np.stack([y, y, y], axis=-1)
    y, cb, cr = planes[0] + np.float32(128), planes[1], planes[2]
    rgb = np.empty((image.height, image.width, 3), dtype=np.uint8)
    for k, x in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        np.rint(x, out=x)
        np.maximum(x, 0, out=x)
        rgb[..., k] = np.minimum(x, 255, out=x)
    return rgb


def payload_of(image: Image) -> bytes:
    """The bytes that ``encode`` stored."""
    n = int(image.comment.split()[1])
    return BYTE[np.concatenate([c.blocks.reshape(-1) for c in image.components])[:n] + 256].tobytes()


def padded(text: bytes) -> bytes:
    n = max(1, -(-len(text) // UNIT)) * UNIT
    return text + b"\xff" * (n - len(text))


def feature(rgb: np.ndarray) -> str:
    """Size, mean and spread of each channel, and the mean step between neighbouring columns."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    if n < 1 << 16:  # whole numbers below 2 ** 53: exact
        x = flat.T.astype(np.float64, order="C")
        total, squares = x.sum(axis=1), np.einsum("ij,ij->i", x, x)
    else:
        total, squares = flat.sum(axis=0, dtype=np.int64), np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
    mean = total / n
    spread = np.sqrt(np.maximum(0, squares / n - mean**2))
    green = rgb[..., 1].astype(np.int16)
    step = float(np.abs(green[:, 1:] - green[:, :-1]).mean())
    return f"{rgb.shape[1]}x{rgb.shape[0]};mean=" + ",".join(f"{x:.3f}" for x in mean) + ";std=" + ",".join(f"{x:.3f}" for x in spread) + f";step={step:.3f}"


def store_media(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row: the id, ``n_bytes`` of the text and ``media``, the progressive JPEG that holds its padded UTF-8."""
    kind = docs.schema[id].dataType.simpleString()
    held_bytes, stored = beside(id, "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for i in range(0, len(texts), 256):  # results of bounded size
                held = [x.as_py() or b"" for x in texts[i : i + 256]]
                media = [encode(padded(x)) for x in held]
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 256], pa.array([len(x) for x in held], type=pa.int64()), pa.array(media, type=pa.binary())], names=[id, held_bytes, stored])

    return batched(docs).select(col(id).alias("k"), col(text).alias("t")).mapInArrow(run, f"{column(id, kind)}, {held_bytes} bigint, {stored} binary")


def read_media(media: DataFrame, id: str = "doc_id", tensors: bool = True) -> DataFrame:
    """Per row of ``store_media``: payload digests, the file's digest, a feature and, if wanted, the RGB tensor."""
    kind = media.schema[id].dataType.simpleString()
    names = [id, *beside(id, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", *["rgb"] * tensors)]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()] + [pa.binary()] * tensors

    def one(data: bytes) -> tuple:
        image = decode(data)
        payload, rgb = payload_of(image), to_rgb(image)
        row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(rgb), image.height, image.width)
        return (*row, rgb.tobytes()) if tensors else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, rows, held = 0, [], 0
            for r in range(b.num_rows):
                rows.append(one(b.column(2)[r].as_py()))
                held += len(rows[-1][-1]) if tensors else 0
                if r + 1 == b.num_rows or len(rows) == 1024 or held > RESULT_BYTES:
                    columns = [b.column(1)[first : r + 1], *(pa.array(list(x), type=t) for x, t in zip(zip(*rows, strict=True), types[1:], strict=True))]
                    yield pa.RecordBatch.from_arrays([b.column(0)[first : r + 1], *columns], names=names)
                    first, rows, held = r + 1, [], 0

    kinds = ["bigint", "bigint", "string", "bigint", "bigint", "string", "string", "int", "int", "binary"]
    return media.toDF("k", "n", "m").mapInArrow(run, ", ".join(column(n, k) for n, k in zip(names, [kind, *kinds], strict=False)))


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's stored form, read back: digests, feature, size, and the full-resolution RGB tensor itself."""
    return read_media(store_media(table(spark, sf_dir, "documents")))


QUERIES = {"op6_progressive_jpeg": op6_progressive_jpeg}
SQL: dict[str, str] = {}
