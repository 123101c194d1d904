"""Progressive JPEG in numpy: many images at once, restart intervals in step.

``encode`` stores a payload losslessly in the format's own unit, the quantised
DCT coefficient: byte b becomes coefficient b - 128, 64 to a block in zigzag
order, blocks dealt in turn to the 4:2:0 units of a YCbCr image (four Y, one
Cb, one Cr). Scans select DC, then bands of AC, and refine the last bit by
successive approximation. Every unit is a restart interval, so thousands of
intervals decode in step. A comment holds the payload's length.

``decode`` reads any progressive Huffman JPEG of 8 bits and one to four
components sampled 1 or 2 to a unit: it accumulates all scans into coefficient
arrays, inverse-transforms them, upsamples chroma and gives RGB at full
resolution. (Fewer restart intervals mean less work in step, not other results.)
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from vectide.llm.text import ragged

BLOCK = 64
# Fixed values of the format: the zigzag order.
ZIGZAG = np.array(
    [
        0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
        35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
    ]
)
#: (components, first and last coefficient, bit refined, lowest bit sent) of each scan written
SCANS = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1),
    ((1,), 1, 63, 0, 1),
    ((2,), 1, 63, 0, 1),
    ((0,), 6, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0),
    ((1,), 1, 63, 1, 0),
    ((2,), 1, 63, 1, 0),
    ((0,), 1, 63, 1, 0),
)
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: Codes written: DC sizes in 4 bits, all AC symbols in 8.
DC_SYMBOLS = tuple(range(12))
AC_SYMBOLS = tuple(s for s in range(256) if (s & 15) <= 10)
_AC_CODE = np.zeros(256, np.uint64)
_AC_CODE[list(AC_SYMBOLS)] = np.arange(len(AC_SYMBOLS))
U64 = np.uint64


@lru_cache(maxsize=4)
def _basis() -> np.ndarray:
    """zigzag coefficient x pixel of the 8x8 inverse DCT."""
    k = np.arange(8)
    c = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return np.einsum("uy,vx->uvyx", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


@dataclass(frozen=True)
class Shape:
    """Size in pixels and sampling of each component."""

    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]

    @property
    def units(self) -> tuple[int, int]:
        h, v = (max(s[i] for s in self.sampling) for i in (0, 1))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def per_unit(self) -> int:
        return sum(h * v for h, v in self.sampling)

    @property
    def blocks(self) -> int:
        across, down = self.units
        return across * down * self.per_unit


@lru_cache(maxsize=8192)
def raster(shape: Shape, component: int) -> np.ndarray:
    """Places, in unit order, of a component's blocks row by row (as a scan of its own has them)."""
    hmax, vmax = (max(s[i] for s in shape.sampling) for i in (0, 1))
    h, v = shape.sampling[component]
    across = -(-(-(-shape.width * h // hmax)) // 8)
    down = -(-(-(-shape.height * v // vmax)) // 8)
    y, x = np.divmod(np.arange(across * down), across)
    slot = sum(a * b for a, b in shape.sampling[:component])
    return ((y // v) * shape.units[0] + x // h) * shape.per_unit + slot + (y % v) * h + x % h


# ---- writing


def _bitpack(value: np.ndarray, bits: np.ndarray, interval: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes in a row -> bytes, every interval filled to a whole byte with ones, and each interval's size."""
    size = np.bincount(interval, bits, n).astype(np.int64)
    count = (size + 7) // 8
    first = np.cumsum(count) - count
    total = np.cumsum(bits)
    before = np.concatenate([[0], np.cumsum(size)])[:-1]
    at = total - bits - before[interval] + 8 * first[interval]
    word = at >> 5
    shifted = value << (64 - bits - (at & 31)).astype(U64)
    start = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(count.sum()) // 4 + 3, U64)
    if len(start):
        out[word[start]] += np.add.reduceat(shifted >> U64(32), start)
        out[word[start] + 1] += np.add.reduceat(shifted & U64(0xFFFFFFFF), start)
    raw = out.astype(">u4").view(np.uint8)[: int(count.sum())].copy()
    part = np.flatnonzero(size & 7)
    raw[first[part] + count[part] - 1] |= ((1 << (8 - (size[part] & 7))) - 1).astype(np.uint8)
    return raw, count


#: Of values -2048 .. 2047, at value + 2048: size category and extra bits.
_VALUES = np.arange(-2048, 2048)
_CATEGORY = np.array([int(abs(x)).bit_length() for x in _VALUES], np.int64)
_EXTRA = np.where(_VALUES < 0, _VALUES + (1 << _CATEGORY) - 1, _VALUES).astype(np.uint64)


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category of values, and their extra bits."""
    at = v + 2048
    return _CATEGORY[at], _EXTRA[at]


def _dc_first(coef: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    v = coef[:, 0].reshape(-1, 6).astype(np.int64) >> low
    diff = v.copy()
    diff[:, 1:4] -= v[:, 0:3]
    size, extra = _magnitude(diff.reshape(-1))
    return _bitpack((size.astype(U64) << size.astype(U64)) | extra, 4 + size, np.arange(len(size)) // 6, len(v))


def _dc_refine(coef: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    bit = ((coef[:, 0].astype(np.int64) >> low) & 1).astype(U64)
    return _bitpack(bit, np.ones(len(bit), np.int64), np.arange(len(bit)) // 6, len(bit) // 6)


def _ac_first(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    n, width = band.shape
    v = (band + ((band < 0) * ((1 << low) - 1)).astype(np.int16)) >> low  # towards zero
    size, extra = _magnitude(v.reshape(-1))
    if v.all():  # no runs and no early ends
        code = (_AC_CODE[size] << size.astype(U64)) | extra
        return _bitpack(code, 8 + size, np.repeat(np.arange(n), width), n)
    flat = np.flatnonzero(v)
    block, k = np.divmod(flat, width)
    size, extra = size[flat], extra[flat]
    same = np.zeros(len(block), bool)
    same[1:] = block[1:] == block[:-1]
    run = k - np.where(same, np.concatenate([[0], k[:-1]]), -1) - 1
    long = run >> 4
    each = long + 1
    per = np.bincount(block, each, n).astype(np.int64)
    last = np.full(n, -1)
    last[block] = k
    ends = (last < width - 1).astype(np.int64)
    first = np.cumsum(per + ends) - per - ends
    place = first[block] + np.cumsum(each) - (np.cumsum(per) - per)[block] - 1
    total = int((per + ends).sum())
    code, bits = np.full(total, _AC_CODE[0xF0], U64), np.full(total, 8, np.int64)
    code[place] = (_AC_CODE[((run & 15) << 4) | size] << size.astype(U64)) | extra
    bits[place] = 8 + size
    code[(first + per)[ends > 0]] = _AC_CODE[0]
    return _bitpack(code, bits, np.repeat(np.arange(n), per + ends), n)


def _ac_refine(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """low is 0: one bit was held back. Blocks without a coefficient that this bit makes non-zero
    are one end code and the bits of the others."""
    n, width = band.shape
    size = np.abs(band)
    plain = ~(size == 1).any(1)
    if plain.all():
        known = size > 1
        count = 8 + known.sum(1)
        whole = (count + 7) // 8
        first = np.cumsum(whole) - whole
        bits = np.ones(int(whole.sum()) * 8, np.uint8)
        end = int(_AC_CODE[0])
        bits[first[:, None] * 8 + np.arange(8)] = [(end >> (7 - i)) & 1 for i in range(8)]
        flat = np.flatnonzero(known)
        block = flat // width
        rank = np.arange(len(flat)) - (np.cumsum(count - 8) - (count - 8))[block]
        bits[first[block] * 8 + 8 + rank] = (size.reshape(-1)[flat] & 1).astype(np.uint8)
        return np.packbits(bits), whole
    if plain.any():
        return _joined(plain, _ac_refine(band[plain], low), _ac_refine(band[~plain], low))
    known = size > 1
    new = size == 1
    zero = size == 0
    k = np.arange(width)
    last = np.where(new, k, -1).max(1)
    zeros = np.cumsum(zero, 1, dtype=np.int16)
    at_new = np.maximum.accumulate(np.where(new, zeros, 0), 1)
    run = zeros.copy()
    run[:, 1:] -= at_new[:, :-1]
    stop = new | (zero & (run > 0) & (run % 16 == 0) & (k < last[:, None]))
    begins = np.ones_like(stop)
    begins[:, 1:] = stop[:, :-1]
    upto = np.minimum.accumulate(np.where(stop, k, width)[:, ::-1], 1)[:, ::-1]
    b, start = np.nonzero(begins)
    end = upto[b, start]
    ends = end < width
    inside = np.minimum(end, width - 1)
    is_new = ends & new[b, inside]
    symbol = np.where(is_new, ((run[b, inside] % 16).astype(np.int64) << 4) | 1, np.where(ends, 0xF0, 0))
    code = np.zeros((n, width, 2), U64)
    bits = np.zeros((n, width, 2), np.int8)
    sign = (band[b, inside] > 0).astype(U64)
    code[b, start, 0] = np.where(is_new, (_AC_CODE[symbol] << U64(1)) | sign, _AC_CODE[symbol])
    bits[b, start, 0] = 8 + is_new
    code[:, :, 1] = size & 1
    bits[:, :, 1] = known
    used = np.flatnonzero(bits.reshape(-1))
    return _bitpack(code.reshape(-1)[used], bits.reshape(-1)[used].astype(np.int64), used // (2 * width), n)


def _joined(which: np.ndarray, yes: tuple[np.ndarray, np.ndarray], no: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of two sets of blocks, dealt back to their places."""
    count = np.zeros(len(which), np.int64)
    count[which], count[~which] = yes[1], no[1]
    mine = np.repeat(which, count)
    raw = np.empty(len(mine), np.uint8)
    raw[mine], raw[~mine] = yes[0], no[0]
    return raw, count


def _marked(raw: np.ndarray, count: np.ndarray, per_scan: np.ndarray) -> list[bytes]:
    """Intervals of every image's scan, stuffed, with restart markers between them."""
    number = np.arange(len(count)) - np.repeat(np.cumsum(per_scan) - per_scan, per_scan)
    ends = np.cumsum(count)
    ff = raw == 255
    stuffed = np.concatenate([[0], np.cumsum(ff)])
    restart = np.where(number > 0, 2, 0)
    shift = np.cumsum(restart)
    place = np.arange(len(raw)) + stuffed[:-1] + np.repeat(shift, count)
    total = len(raw) + int(stuffed[-1]) + int(restart.sum())
    out = np.zeros(total, np.uint8)
    out[place] = raw
    starts = ends - count + stuffed[ends - count] + shift
    again = np.flatnonzero(number > 0)
    out[starts[again] - 2] = 255
    out[starts[again] - 1] = 0xD0 + (number[again] - 1) % 8
    stop = np.append(starts[np.cumsum(per_scan)[:-1]], total)
    begin = np.append(0, stop[:-1])
    data = out.tobytes()
    return [data[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _tables() -> bytes:
    dc = bytes([0x00, *(12 if i == 4 else 0 for i in range(1, 17)), *DC_SYMBOLS])
    ac = bytes([0x10, *(len(AC_SYMBOLS) if i == 8 else 0 for i in range(1, 17)), *AC_SYMBOLS])
    return _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC4, dc) + _segment(0xC4, ac) + _segment(0xDD, struct.pack(">H", 1))


def shape_for(n_bytes: int) -> Shape:
    """One row of units, or more where a row would be too wide for the format."""
    units = max(1, -(-n_bytes // (BLOCK * 6)))
    down = -(-units // 4095)
    return Shape(16 * -(-units // down), 16 * down, SAMPLING)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length must be a multiple of 64."""
    if not payloads:
        return []
    shapes = [shape_for(len(p)) for p in payloads]
    blocks = np.array([s.blocks for s in shapes])
    base = np.cumsum(blocks) - blocks
    raw = b"".join(p.ljust(int(b) * BLOCK, b"\x80") for p, b in zip(payloads, blocks, strict=True))
    coef = (np.frombuffer(raw, np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK)
    units = blocks // 6
    order = [np.concatenate([raster(s, c) for s in shapes]) + np.repeat(base, units * h * v) for c, (h, v) in enumerate(SAMPLING)]
    parts: list[list[bytes]] = []
    for comps, first, last, high, low in SCANS:
        if first == 0:
            packed = (_dc_refine if high else _dc_first)(coef, low)
            per_scan = units
        else:
            band = coef[order[comps[0]], first : last + 1]
            packed = (_ac_refine if high else _ac_first)(band, low)
            per_scan = units * (4 if comps[0] == 0 else 1)
        head = bytes([len(comps), *(x for c in comps for x in (c + 1, 0)), first, last, (high << 4) | low])
        parts.append([_segment(0xDA, head) + data for data in _marked(*packed, per_scan)])
    out = []
    for i, s in enumerate(shapes):
        frame = struct.pack(">BHHB", 8, s.height, s.width, 3) + b"".join(bytes([c + 1, (h << 4) | v, 0]) for c, (h, v) in enumerate(s.sampling))
        out.append(b"".join([b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payloads[i])), _segment(0xC2, frame), _tables(), *(p[i] for p in parts), b"\xff\xd9"]))
    return out


# ---- reading


@dataclass
class Image:
    shape: Shape
    base: int
    quant: list[np.ndarray] = field(default_factory=list)
    payload_bytes: int = -1
    restart: int = 0


# Fixed values of the format: the colour conversion, by chroma sample.
_CHROMA = np.arange(256) - 128
_CR_RED, _CR_GREEN = (np.rint(f * _CHROMA).astype(np.int16) for f in (1.402, 0.714136))
_CB_GREEN, _CB_BLUE = (np.rint(f * _CHROMA).astype(np.int16) for f in (0.344136, 1.772))
_MASK = (1 << np.arange(17)) - 1


class Reader:
    """Coefficients of a batch of JPEGs: ``coef`` has all blocks, in unit order, image after image."""

    def __init__(self, blobs: list[bytes]):
        buf = np.frombuffer(b"".join(blobs) + bytes(8), np.uint8)
        nxt = buf[1:]
        ff = np.flatnonzero(buf[:-1] == 255)
        after = nxt[ff]
        self.markers = ff[(after != 0) & (after != 255) & ~((after >= 0xD0) & (after <= 0xD7))]
        self.restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
        keep = np.ones(len(buf), bool)
        keep[ff[after == 0] + 1] = False
        self.moved = np.cumsum(keep) - keep  # place of each byte without stuffing
        plain = np.concatenate([buf[keep], np.zeros(8, np.uint8)]).astype(np.int64)
        self.window = (plain[:-4] << 32) | (plain[1:-3] << 24) | (plain[2:-2] << 16) | (plain[3:-1] << 8) | plain[4:]
        self.images: list[Image] = []
        self.scans: list[dict[tuple, list[tuple]]] = []
        start = blocks = 0
        for blob in blobs:
            blocks += self._parse(blob, start, blocks)
            start += len(blob)
        self.coef = np.zeros((blocks, BLOCK), np.int16)
        for group in self.scans:
            for key, parts in group.items():
                self._scan(key, parts)

    def _parse(self, blob: bytes, start: int, base: int) -> int:
        at, number = 2, 0
        tables: dict[int, bytes] = {}
        quant: dict[int, np.ndarray] = {}
        image, ids, tq, restart, note = None, [], [], 0, -1
        while at < len(blob):
            while blob[at + 1] == 255:
                at += 1
            marker = blob[at + 1]
            if marker == 0xD9:
                break
            size = (blob[at + 2] << 8) | blob[at + 3]
            body = blob[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC4:
                p = 0
                while p < len(body):
                    n = sum(body[p + 1 : p + 17])
                    tables[body[p]] = body[p + 1 : p + 17 + n]
                    p += 17 + n
            elif marker == 0xDB:
                p = 0
                while p < len(body):
                    wide = body[p] >> 4
                    n = 128 if wide else 64
                    quant[body[p] & 15] = np.frombuffer(body[p + 1 : p + 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                    p += 1 + n
            elif marker == 0xDD:
                restart = (body[0] << 8) | body[1]
            elif marker == 0xFE and body.startswith(b"payload "):
                note = int(body[8:])
            elif marker == 0xC2:
                if body[0] != 8:
                    raise ValueError("only 8-bit samples are read")
                parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
                ids, tq = [p[0] for p in parts], [p[2] for p in parts]
                shape = Shape((body[3] << 8) | body[4], (body[1] << 8) | body[2], tuple((p[1] >> 4, p[1] & 15) for p in parts))
                image = Image(shape, base, payload_bytes=note)
                self.images.append(image)
            elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("only progressive Huffman JPEGs are read")
            elif marker == 0xDA:
                image.quant = [quant[q] for q in tq]
                n = body[0]
                comps = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
                used = [body[2 + 2 * i] for i in range(n)]
                first, last, approx = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
                codes = tuple(tables.get(u >> 4 if first == 0 else 0x10 | (u & 15)) for u in used)
                end = int(self.markers[np.searchsorted(self.markers, start + at)])
                while len(self.scans) <= number:
                    self.scans.append({})
                self.scans[number].setdefault((image.shape.sampling, comps, first, last, approx >> 4, approx & 15, codes), []).append((image, start + at, end, restart))
                number += 1
                at = end - start
        return image.shape.blocks

    def _peek(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.window[at >> 3] >> (40 - n - (at & 7))) & ((1 << n) - 1)

    @staticmethod
    @lru_cache(maxsize=64)
    def _codes(table: bytes) -> np.ndarray:
        """(symbol << 8) | length by the next 16 bits."""
        out = np.zeros(1 << 16, np.int64)
        code, at = 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                out[code << (16 - length) : (code + 1) << (16 - length)] = (table[at] << 8) | length
                code += 1
                at += 1
            code <<= 1
        return out

    def _scan(self, key: tuple, parts: list[tuple]) -> None:
        sampling, comps, first, last, high, low, codes = key
        alone = len(comps) == 1
        per = 1 if alone else sum(sampling[c][0] * sampling[c][1] for c in comps)
        if alone:
            places = [raster(image.shape, comps[0]) for image, *_ in parts]
        else:
            slots = np.array([s for c in comps for s in range(sum(h * v for h, v in sampling[:c]), sum(h * v for h, v in sampling[: c + 1]))])
            places = [(np.arange(image.shape.blocks // image.shape.per_unit)[:, None] * image.shape.per_unit + slots).reshape(-1) for image, *_ in parts]
        size = np.array([len(p) for p in places])
        place = np.concatenate(places) + np.repeat([image.base for image, *_ in parts], size)
        starts = np.array([a for _, a, _, _ in parts])
        low_restart = np.searchsorted(self.restarts, starts)
        units = size // per
        step = np.array([r or u for (*_, r), u in zip(parts, units.tolist(), strict=True)])
        intervals = -(-units // step)
        part, number = ragged(intervals)
        at = np.where(number == 0, starts[part], self.restarts[np.minimum(low_restart[part] + number - 1, len(self.restarts) - 1)] + 2 if len(self.restarts) else starts[part])
        units = np.minimum(step[part], units[part] - step[part] * number)
        begin = (np.cumsum(units) - units) * per
        bit = self.moved[at] * 8
        if first == 0 and high:
            self._dc_refine(bit, place, begin, units * per, low)
        elif first == 0:
            self._dc_first(bit, place, begin, units, [(c, sampling[c][0] * sampling[c][1] if not alone else 1) for c in comps], codes, low)
        elif high:
            self._ac_refine(bit, place, begin, units, first, last, codes[0], low)
        else:
            self._ac_first(bit, place, begin, units, first, last, codes[0], low)

    def _dc_first(self, bit, place, begin, units, layout, codes, low) -> None:
        per = sum(n for _, n in layout)
        tables = [self._codes(c) for c in codes]
        before = np.zeros((len(bit), len(layout)), np.int64)
        for u in range(int(units.max())):
            live = np.flatnonzero(units > u)
            slot = 0
            for j, (_, n) in enumerate(layout):
                for _ in range(n):
                    found = tables[j][self._peek(bit[live], 16)]
                    size = found >> 8
                    bit[live] += found & 255
                    diff = self._signed(bit[live], size)
                    bit[live] += size
                    before[live, j] += diff
                    self.coef[place[begin[live] + u * per + slot], 0] = before[live, j] << low
                    slot += 1

    def _dc_refine(self, bit, place, begin, blocks, low) -> None:
        owner = np.repeat(np.arange(len(bit)), blocks)
        at = bit[owner] + np.arange(len(owner)) - begin[owner]
        self.coef[place, 0] |= (self._peek(at, 1) << low).astype(np.int16)

    def _signed(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        raw = self._peek(at, size)
        return np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)

    def _ac_first(self, bit, place, begin, units, first, last, code, low) -> None:
        table = self._codes(code)
        flat = self.coef.reshape(-1)
        at, bb, k, stop = bit, begin.copy(), np.full(len(bit), first), begin + units
        while len(at):
            word = (self.window[at >> 3] >> (8 - (at & 7))) & 0xFFFFFFFF
            found = table[word >> 16]
            length, run, size = found & 255, found >> 12, (found >> 8) & 15
            at = at + length + size
            raw = (word >> (32 - length - size)) & _MASK[size]
            k = k + run
            if size.all():
                flat[place[bb] * BLOCK + k] = (raw + np.where(raw <= _MASK[size] >> 1, -_MASK[size], 0)) << low
                k += 1
                over = k > last
            else:
                v = np.flatnonzero(size)
                full = _MASK[size[v]]
                flat[place[bb[v]] * BLOCK + k[v]] = (raw[v] + np.where(raw[v] <= full >> 1, -full, 0)) << low
                k += 1
                over = k > last
                ended = np.flatnonzero((size == 0) & (run < 15))
                more = run[ended]
                bb[ended] += (1 << more) - 1 + ((word[ended] >> (32 - length[ended] - more)) & _MASK[more])
                at[ended] += more
                over[ended] = True
            if over.any():
                bb = bb + over
                k[over] = first
                rest = bb < stop
                if not rest.all():
                    at, bb, k, stop = at[rest], bb[rest], k[rest], stop[rest]

    def _ac_refine(self, bit, place, begin, units, first, last, code, low) -> None:
        table = self._codes(code)
        width = last - first + 1
        band = self.coef[place, first : last + 1]
        known = band != 0
        n = len(place)
        zeros = np.zeros((n, width + 1), np.int32)
        np.cumsum(~known, 1, out=zeros[:, 1:])
        zero_at = np.flatnonzero(~known.reshape(-1)) % width
        zero_first = np.cumsum(zeros[:, -1]) - zeros[:, -1]
        zero_at = np.append(zero_at, 0)
        address = np.zeros((n, width), np.int64)  # differences, then bit place less the rank among known ones
        fresh = np.zeros((n, width), np.int8)
        block, k = begin.copy(), np.zeros(len(bit), np.int64)
        runs, base = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
        stop = begin + units
        live = np.flatnonzero(units > 0)
        while len(live):
            at, kk, bb, eob, was = bit[live], k[live], block[live], runs[live], base[live]
            reads = eob == 0
            found = np.where(reads, table[self._peek(at, 16)], 0)
            at += found & 255
            symbol = found >> 8
            run, size = symbol >> 4, symbol & 15
            ends = reads & (size == 0) & (run < 15)
            extra = np.where(ends, run, np.where(size > 0, 1, 0))
            raw = self._peek(at, extra)
            at += extra
            eob = np.where(ends, (1 << run) + raw, eob)
            tail = eob > 0
            skipped = zeros[bb, kk] + run
            have = skipped < zeros[bb, -1]
            end = np.where(tail | ~have, width, zero_at[np.minimum(zero_first[bb] + skipped, len(zero_at) - 1)])
            rank = kk - zeros[bb, kk]
            here = at - rank
            inside = kk < width
            address[bb[inside], kk[inside]] += (here - was)[inside]
            was = np.where(inside, here, was)
            at += (end - zeros[bb, end]) - rank
            put = (size > 0) & (end < width)
            fresh[bb[put], end[put]] = np.where(raw[put] > 0, 1, -1)
            kk = np.where(tail, width, end + 1)
            eob -= tail
            over = kk >= width
            bb += over
            kk = np.where(over, 0, kk)
            was = np.where(over, 0, was)
            bit[live], k[live], block[live], runs[live], base[live] = at, kk, bb, eob, was
            rest = bb < stop[live]
            if not rest.all():
                live = live[rest]
        np.cumsum(address, 1, out=address)
        address += np.arange(width) - zeros[:, :-1]
        b, q = np.nonzero(known)
        more = self._peek(address[b, q], 1).astype(np.int16) << low
        old = band[b, q]
        band[b, q] = np.where(old > 0, old + more, old - more)
        band[fresh != 0] = fresh[fresh != 0].astype(np.int16) << low
        self.coef[place, first : last + 1] = band

    # ---- what the coefficients hold

    def payload(self, i: int) -> bytes:
        """The bytes ``encode`` stored in image i."""
        image = self.images[i]
        own = self.coef[image.base : image.base + image.shape.blocks]
        return (own + 128).astype(np.uint8).tobytes()[: image.payload_bytes]

    def samples(self) -> np.ndarray:
        """8-bit samples of all blocks (blocks x 8 x 8)."""
        basis = _basis()
        scale = np.ones(self.coef.shape, np.float32)
        plain = True
        for image in self.images:
            if all((q == 1).all() for q in image.quant):
                continue
            plain = False
            slots = np.concatenate([np.tile(q, (h * v, 1)) for q, (h, v) in zip(image.quant, image.shape.sampling, strict=True)])
            scale[image.base : image.base + image.shape.blocks] = np.tile(slots, (image.shape.blocks // len(slots), 1))
        pixel = (self.coef.astype(np.float32) if plain else self.coef * scale) @ basis
        return np.clip(np.rint(pixel + 128), 0, 255).astype(np.uint8).reshape(-1, 8, 8)

    def tiles(self, samples: np.ndarray, images: slice | list[int] = slice(None)) -> np.ndarray:
        """Red, green and blue of the units of images that share one sampling (3 x units x height x width)."""
        chosen = self.images[images] if isinstance(images, slice) else [self.images[i] for i in images]
        sampling = chosen[0].shape.sampling
        hmax, vmax = (max(s[i] for s in sampling) for i in (0, 1))
        own = samples[chosen[0].base : chosen[-1].base + chosen[-1].shape.blocks].reshape(-1, chosen[0].shape.per_unit, 8, 8)
        planes, slot = [], 0
        for h, v in sampling:
            planes.append(own[:, slot : slot + h * v].reshape(-1, v, h, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 8 * v, 8 * h))
            slot += h * v
        n = len(own)
        out = np.empty((3, n, 8 * vmax, 8 * hmax), np.uint8)
        if len(planes) < 3:
            out[:] = planes[0]
            return out
        up = lambda x, c: x.repeat(vmax // sampling[c][1], 1).repeat(hmax // sampling[c][0], 2)
        y = up(planes[0], 0).astype(np.int16)
        cb, cr = planes[1], planes[2]
        np.clip(y + up(_CR_RED[cr], 2), 0, 255, out=out[0], casting="unsafe")
        np.clip(y - up(_CB_GREEN[cb], 1) - up(_CR_GREEN[cr], 2), 0, 255, out=out[1], casting="unsafe")
        np.clip(y + up(_CB_BLUE[cb], 1), 0, 255, out=out[2], casting="unsafe")
        return out

    def rgb(self, i: int, samples: np.ndarray | None = None) -> np.ndarray:
        """The full-resolution RGB tensor (height x width x 3) of image i."""
        shape = self.images[i].shape
        tiles = self.tiles(self.samples() if samples is None else samples, [i])
        across, down = shape.units
        _, _, h, w = tiles.shape
        return tiles.reshape(3, down, across, h, w).transpose(1, 3, 2, 4, 0).reshape(down * h, across * w, 3)[: shape.height, : shape.width]
