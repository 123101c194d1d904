"""The progressive reader on files of another writer: end-of-band runs over many blocks, no or few restarts, other samplings."""

import numpy as np
import pytest

from vectide.llm import jpeg


class Bits:
    """Entropy-coded data: all AC symbols have codes of 8 bits, DC sizes of 4."""

    def __init__(self):
        self.out, self.run, self.held = [], 0, []

    def put(self, value, n):
        self.out += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def value(self, c):
        n = abs(int(c)).bit_length()
        self.put(int(c) if c > 0 else int(c) + (1 << n) - 1, n)

    def flush(self):
        """The end-of-band run so far, and the correction bits held back for it."""
        if self.run:
            n = self.run.bit_length() - 1
            self.put(n << 4, 8)
            self.put(self.run - (1 << n), n)
            self.out += self.held
            self.run, self.held = 0, []

    def ended(self, bits=()):
        self.run += 1
        self.held += bits
        if self.run == 0x7FFF:
            self.flush()

    def take(self):
        self.flush()
        bits = self.out + [1] * (-len(self.out) % 8)
        self.out = []
        raw = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\0")


def ac_first(bits, block, first, last, low):
    run = 0
    for c in block[first : last + 1]:
        c = int(np.sign(c)) * (abs(int(c)) >> low)
        if not c:
            run += 1
            continue
        bits.flush()
        while run > 15:
            bits.put(0xF0, 8)
            run -= 16
        bits.put(run << 4 | abs(c).bit_length(), 8)
        bits.value(c)
        run = 0
    if run:
        bits.ended()


def ac_refine(bits, block, first, last, low):
    size = [abs(int(c)) >> low for c in block[first : last + 1]]
    final = max((i for i, a in enumerate(size) if a == 1), default=-1)
    run, held = 0, []
    for i, a in enumerate(size):
        if not a:
            run += 1
            continue
        while run > 15 and i <= final:
            bits.flush()
            bits.put(0xF0, 8)
            bits.out += held
            run, held = run - 16, []
        if a > 1:
            held.append(a & 1)
            continue
        bits.flush()
        bits.put(run << 4 | 1, 8)
        bits.put(int(block[first + i] > 0), 1)
        bits.out += held
        run, held = 0, []
    if run or held:
        bits.ended(held)


def written(width, height, sampling, coef, restart, scans):
    """coef: for each component, blocks down x across x 64 in zigzag order, filled up to whole units."""
    segment = lambda marker, body: bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    hmax, vmax = (max(s[i] for s in sampling) for i in (0, 1))
    out = b"\xff\xd8" + segment(0xDB, bytes([0, *range(1, 65)]))
    out += segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([7 + i, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    out += segment(0xC4, bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)]) + bytes([0x10, *[0] * 7, 255, *[0] * 8, *range(255)]))
    if restart:
        out += segment(0xDD, restart.to_bytes(2, "big"))
    for comps, first, last, high, low in scans:
        if len(comps) == 1:
            (c,) = comps
            h, v = sampling[c]
            down, across = -(-(-(-height * v // vmax)) // 8), -(-(-(-width * h // hmax)) // 8)
            units = [[(c, y, x)] for y in range(down) for x in range(across)]
        else:
            down, across = -(-height // (8 * vmax)), -(-width // (8 * hmax))
            units = [[(c, y * sampling[c][1] + j, x * sampling[c][0] + i) for c in comps for j in range(sampling[c][1]) for i in range(sampling[c][0])] for y in range(down) for x in range(across)]
        out += segment(0xDA, bytes([len(comps), *(b for c in comps for b in (7 + c, 0)), first, last, high << 4 | low]))
        bits, before = Bits(), dict.fromkeys(comps, 0)
        for n, unit in enumerate(units):
            if restart and n and n % restart == 0:
                out += bits.take() + bytes([255, 0xD0 + (n // restart - 1) % 8])
                before = dict.fromkeys(comps, 0)
            for c, y, x in unit:
                block = coef[c][y, x]
                if first == 0 and high:
                    bits.put(int(block[0]) >> low & 1, 1)
                elif first == 0:
                    value = int(block[0]) >> low
                    size = abs(value - before[c]).bit_length()
                    bits.put(size, 4)
                    if size:
                        bits.value(value - before[c])
                    before[c] = value
                else:
                    (ac_refine if high else ac_first)(bits, block, first, last, low)
        out += bits.take()
    return out + b"\xff\xd9"


SHAPES = {
    "grey": (((1, 1),), 37, 29),
    "444": (((1, 1), (1, 1), (1, 1)), 50, 33),
    "422": (((2, 1), (1, 1), (1, 1)), 70, 41),
    "420": (((2, 2), (1, 1), (1, 1)), 75, 52),
}


def scans_of(n):
    """Spectral selection, and successive approximation in two steps."""
    every = tuple(range(n))
    yield every, 0, 0, 0, 1
    for c in every:
        yield (c,), 1, 5, 0, 2
        yield (c,), 6, 63, 0, 2
    for c in every:
        yield (c,), 1, 63, 2, 1
    yield every, 0, 0, 1, 0
    for c in every:
        yield (c,), 1, 63, 1, 0


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("restart", [0, 1, 5])
def test_coefficients_of_other_writers(name, restart):
    sampling, width, height = SHAPES[name]
    rng = np.random.default_rng(len(name) + restart)
    hmax, vmax = (max(s[i] for s in sampling) for i in (0, 1))
    down, across = -(-height // (8 * vmax)), -(-width // (8 * hmax))
    coef = []
    for h, v in sampling:
        block = np.zeros((down * v, across * h, 64), int)
        block[..., 0] = rng.integers(-200, 200, block.shape[:2])
        there = rng.random(block.shape) < np.where(rng.random(block.shape[:2]) < 0.4, 0.2, 0.0)[..., None]  # most blocks have no AC at all
        ac = np.where(there, rng.integers(-9, 10, block.shape), 0)
        high, wide = -(-(-(-height * v // vmax)) // 8), -(-(-(-width * h // hmax)) // 8)
        block[:high, :wide, 1:] = ac[:high, :wide, 1:]  # blocks beyond the image have a DC alone
        coef.append(block)
    raw = written(width, height, sampling, coef, restart, list(scans_of(len(sampling))))
    reader = jpeg.Reader([raw, raw])
    for image in reader.images:
        own = reader.coef[image.base : image.base + image.shape.blocks].reshape(down, across, -1, 64)
        slot = 0
        for (h, v), want in zip(sampling, coef, strict=True):
            got = own[:, :, slot : slot + h * v].reshape(down, across, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(want.shape)
            assert (got == want).all()
            slot += h * v
    rgb = reader.rgb(0)
    assert rgb.shape == (height, width, 3) and (len(sampling) > 1 or (rgb[..., 0] == rgb[..., 2]).all())


def test_flat_colours_at_full_resolution():
    """DC alone: every pixel has the colour that the three components' levels give, chroma upsampled."""
    sampling, width, height = SHAPES["420"]
    down, across = -(-height // 16), -(-width // 16)
    levels = (40, -24, 56)
    coef = []
    for (h, v), level in zip(sampling, levels, strict=True):
        block = np.zeros((down * v, across * h, 64), int)
        block[..., 0] = level * 8  # the table's first step is 1
        coef.append(block)
    rgb = jpeg.Reader([written(width, height, sampling, coef, 0, list(scans_of(3)))]).rgb(0)
    y, cb, cr = (128 + x for x in levels)
    want = [y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)]
    assert rgb.shape == (height, width, 3)
    assert np.abs(rgb.reshape(-1, 3).astype(int) - np.clip(np.round(want), 0, 255)).max() <= 1
