"""Lossless WebP (VP8L): a decoder for every feature of the format, and an encoder that can use them.

Follows the public specification of the WebP lossless bitstream. Pixels are 32-bit ARGB in numpy arrays.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

MAX_SIDE = 1 << 14
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_SPREAD = 0x1E35A7BD
#: Fixed values of the format: the pixel (x to the left, y up) of each of the first 120 distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Damaged(ValueError):
    """The bytes are no lossless WebP image."""


class Code:
    """A canonical prefix code as a table over all windows of its longest length."""

    def __init__(self, lengths: tuple[int, ...]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.only = used[0][1] if len(used) == 1 else None  # a code of one symbol takes no bits
        self.top = 0 if len(used) < 2 else max(n for n, _ in used)
        self.codes, self.bits = np.zeros(len(lengths), dtype=np.uint64), np.zeros(len(lengths), dtype=np.int64)
        self.symbols, self.sizes = np.zeros(1 << self.top, dtype=np.int32), np.zeros(1 << self.top, dtype=np.int32)
        if not used:
            self.only = 0
        if self.only is not None:
            self.symbols[:] = self.only
        else:
            if sum(1 << (self.top - n) for n, _ in used) != 1 << self.top:
                raise Damaged("an incomplete prefix code")
            code, last = 0, 0
            for n, s in sorted(used):
                code <<= n - last
                last = n
                turned = int(f"{code:0{n}b}"[::-1], 2)
                self.codes[s], self.bits[s] = turned, n
                self.symbols[turned :: 1 << n] = s
                self.sizes[turned :: 1 << n] = n
                code += 1
        self.symbol_list: list[int] | None = None
        self.size_list: list[int] | None = None

    def lists(self) -> tuple[list[int], list[int]]:
        if self.symbol_list is None or self.size_list is None:
            self.symbol_list, self.size_list = self.symbols.tolist(), self.sizes.tolist()
        return self.symbol_list, self.size_list


code_of = lru_cache(maxsize=4096)(Code)


class Reader:
    """Bits of the stream, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + (n + 14 >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        x = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise Damaged("the stream ends early")
        return x

    def symbol(self, code: Code) -> int:
        if code.only is not None:
            return code.only
        symbols, sizes = code.lists()
        w = self.peek(code.top)
        self.at += sizes[w]
        if self.at > self.end:
            raise Damaged("the stream ends early")
        return symbols[w]


def read_code(r: Reader, alphabet: int) -> Code:
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        lengths = [0] * alphabet
        lengths[r.read(8 if wide else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return code_of(tuple(lengths))
    known = [0] * 19
    for i in range(4 + r.read(4)):
        known[CODE_LENGTH_ORDER[i]] = r.read(3)
    code = code_of(tuple(known))
    most = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    lengths, last = [], 8
    while len(lengths) < alphabet and most:
        most -= 1
        s = r.symbol(code)
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + r.read(2))
        else:
            lengths += [0] * (3 + r.read(3) if s == 17 else 11 + r.read(7))
    if len(lengths) > alphabet:
        raise Damaged("too many code lengths")
    return code_of(tuple(lengths + [0] * (alphabet - len(lengths))))


_groups: dict[tuple[bytes, int, int], tuple[list[Code], int]] = {}


def read_group(r: Reader, cache_bits: int) -> list[Code]:
    """The five codes of a group. Groups that begin with the same bytes are read once."""
    start = r.data[r.at >> 3 : (r.at >> 3) + 256]
    key = (start, r.at & 7, cache_bits)
    if key not in _groups:
        began = r.at
        codes = [read_code(r, n) for n in (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)]
        if len(_groups) > 256:
            _groups.clear()
        if r.at - (began & ~7) > 8 * len(start):  # the key does not cover the group
            return codes
        _groups[key] = codes, r.at - began
        return codes
    codes, n = _groups[key]
    r.at += n
    return codes


def spread(r: Reader, prefix: int) -> int:
    """The value of a length or distance prefix with its extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return (2 + (prefix & 1) << extra) + r.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


#: Images of so many pixels, palettes above all, are read with one number for all their bits.
SMALL_IMAGE = 256


def read_literals(r: Reader, group: list[Code], out: list[int]) -> int:
    """Fills out with pixels up to the first that is no literal; how many."""
    base = r.at >> 3
    value, at = int.from_bytes(r.data[base : base + 8 * len(out) + 8], "little") >> (r.at & 7), 0
    codes = [(shift, c.only, *c.lists(), (1 << c.top) - 1) for shift, c in zip((8, 16, 0, 24), group[:4], strict=True)]
    used = 0
    for i in range(len(out)):
        pixel, now = 0, used
        for shift, only, symbols, sizes, mask in codes:
            if only is None:
                w = value >> now & mask
                now += sizes[w]
                s = symbols[w]
            else:
                s = only
            if s >= LITERALS:
                r.at += used
                return i
            pixel |= s << shift
        out[i], used = pixel, now
    r.at += used
    if r.at > r.end:
        raise Damaged("the stream ends early")
    return len(out)


def read_pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise Damaged("a colour cache of more than 11 bits")
    tiles, tile_bits = None, 0
    if main and r.read(1):
        tile_bits = r.read(3) + 2
        tiles = read_pixels(r, -(-width >> tile_bits), -(-height >> tile_bits), False) >> 8 & 0xFFFF
    groups = [read_group(r, cache_bits) for _ in range(int(tiles.max()) + 1 if tiles is not None else 1)]
    if len(groups) == 1 and not cache_bits and all(c.only is not None for c in groups[0][1:4]) and groups[0][0].only is None:
        return read_green(r, groups[0], width, width * height)
    n, at = width * height, 0
    out = [0] * n
    if tiles is None and not cache_bits and n <= SMALL_IMAGE:
        at = read_literals(r, groups[0], out)
    cache, cached = [0] * (1 << cache_bits), 0  # pixels before cached are in the cache
    tile_row = -(-width >> tile_bits)
    tile_list = tiles.tolist() if tiles is not None else None
    while at < n:
        green, red, blue, alpha, far = groups[tile_list[(at // width >> tile_bits) * tile_row + (at % width >> tile_bits)]] if tile_list else groups[0]
        s = r.symbol(green)
        if s < LITERALS:
            red_, blue_ = r.symbol(red), r.symbol(blue)
            out[at] = r.symbol(alpha) << 24 | red_ << 16 | s << 8 | blue_
            at += 1
        elif s < LITERALS + LENGTHS:
            length = spread(r, s - LITERALS)
            back = distance(spread(r, r.symbol(far)), width)
            if back > at or at + length > n:
                raise Damaged("a reference outside the image")
            for _ in range(length):
                out[at] = out[at - back]
                at += 1
        else:
            while cached < at:
                cache[(CACHE_SPREAD * out[cached] & 0xFFFFFFFF) >> 32 - cache_bits] = out[cached]
                cached += 1
            out[at] = cache[s - LITERALS - LENGTHS]
            at += 1
    return np.array(out, dtype=np.uint32)


def read_green(r: Reader, group: list[Code], width: int, n: int) -> np.ndarray:
    """Pixels of a group whose codes but green and distance take no bits.

    Table lookups at all bit positions of a window at once give each position's next one; eight steps are joined
    into one, the chain is walked, and the places between are filled in. References break the chain.
    """
    green, far = group[0], group[4]
    fixed = (group[3].only or 0) << 24 | (group[1].only or 0) << 16 | (group[2].only or 0)
    out = np.empty(n, dtype=np.uint8)
    at, top = 0, green.top
    step = np.where(green.symbols < LITERALS, green.sizes, 0).astype(np.int32)
    window = 1 << 16  # bytes looked at together
    base, m = 0, 0
    while at < n:
        if not base <= r.at >> 3 < base + m - 4:
            base = r.at >> 3
            raw = np.frombuffer(r.data[base : base + window] + b"\0\0\0\0\0\0\0\0", dtype=np.uint8).astype(np.uint32)
            m = len(raw) - 3
            word = raw[:m] | raw[1 : m + 1] << np.uint32(8) | raw[2 : m + 2] << np.uint32(16)
            look = (word[:, None] >> np.arange(8, dtype=np.uint32)).ravel() & np.uint32((1 << top) - 1)
            places = np.arange(8 * m, dtype=np.int32)
            jump = np.minimum(places + step[look], 8 * m - 1)
            if base + window < len(r.data):  # the last bytes belong to the next window
                jump[8 * (window - 3) :] = places[8 * (window - 3) :]
            jump2 = jump[jump]
            jump4 = jump2[jump2]
            jump8 = memoryview(jump4[jump4])
        p, heads = r.at - 8 * base, []
        limit = -(-(n - at) // 8)
        while len(heads) < limit:
            heads.append(p)
            q = jump8[p]
            if q == p:
                break
            p = q
        chain = np.empty((len(heads), 8), dtype=np.int32)
        chain[:, 0] = heads
        for k in range(1, 8):
            chain[:, k] = jump[chain[:, k - 1]]
        chain = chain.ravel()
        # the chain stands still at a reference or at the end of the window
        still = np.flatnonzero(jump[chain] == chain)
        stop = min(int(still[0]) if len(still) else len(chain), n - at)
        if stop:
            out[at : at + stop] = green.symbols[look[chain[:stop]]]
            at += stop
            r.at = 8 * base + int(jump[chain[stop - 1]])
            if r.at > r.end:
                raise Damaged("the stream ends early")
        if at < n and (not stop or len(still)):
            s = r.symbol(green)
            if s < LITERALS:
                out[at] = s
                at += 1
                continue
            length = spread(r, s - LITERALS)
            back = distance(spread(r, r.symbol(far)), width)
            if back > at or at + length > n:
                raise Damaged("a reference outside the image")
            piece = out[at - back : at - back + min(back, length)]
            out[at : at + length] = np.resize(piece, length)
            at += length
    return out.astype(np.uint32) << np.uint32(8) | np.uint32(fixed)


def channels(x: np.ndarray) -> np.ndarray:
    """Bytes of pixels along a last axis: blue, green, red, alpha."""
    return np.ascontiguousarray(x, dtype="<u4").view(np.uint8).reshape(*x.shape, 4)


def pixels(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c, dtype=np.uint8).view("<u4").reshape(c.shape[:-1])


def mean2(a: list[int], b: list[int]) -> list[int]:
    return [x + y >> 1 for x, y in zip(a, b, strict=True)]


def clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predicted(mode: int, left: list[int], up: list[int], right: list[int], corner: list[int]) -> list[int]:
    """The predictor of one of the 14 modes; left, up, right (above) and corner (above left) are channel lists."""
    if mode == 1:
        return left
    if mode == 2:
        return up
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return mean2(mean2(left, right), up)
    if mode == 6:
        return mean2(left, corner)
    if mode == 7:
        return mean2(left, up)
    if mode == 8:
        return mean2(corner, up)
    if mode == 9:
        return mean2(up, right)
    if mode == 10:
        return mean2(mean2(left, corner), mean2(up, right))
    if mode == 11:
        by_left = sum(abs(u - c) for u, c in zip(up, corner, strict=True))
        by_up = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if by_left < by_up else up
    if mode == 12:
        return [clamp(x + u - c) for x, u, c in zip(left, up, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean2(left, up), corner, strict=True)]
    return [0, 0, 0, 255]


def predict(c: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Adds the predictions to residuals, or with forward subtracts them from pixels. c: height, width, 4."""
    height, width, _ = c.shape
    if not forward and (modes == 1).all():  # sums from the left, below the corner from above
        first = np.cumsum(c[:, 0], axis=0, dtype=np.uint8)
        first[:, 3] += np.uint8(255)
        return np.cumsum(np.concatenate([first[:, None], c[:, 1:]], axis=1), axis=1, dtype=np.uint8)
    source = c.tolist()
    made = [[[0, 0, 0, 0]] * width for _ in range(height)]
    real = source if forward else made
    rows = modes.tolist()
    for y in range(height):
        for x in range(width):
            if not y:
                p = real[0][x - 1] if x else [0, 0, 0, 255]
            elif not x:
                p = real[y - 1][0]
            else:
                above = real[y - 1]
                p = predicted(rows[y >> bits][x >> bits], real[y][x - 1], above[x], above[x + 1] if x + 1 < width else real[y][0], above[x - 1])
            made[y][x] = [(a - b if forward else a + b) & 255 for a, b in zip(source[y][x], p, strict=True)]
    return np.array(made, dtype=np.uint8).reshape(c.shape)


def cross(c: np.ndarray, tiles: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Inverts (or with forward applies) the cross-colour transform; tiles: ARGB elements."""
    height, width, _ = c.shape
    full = np.repeat(np.repeat(channels(tiles), 1 << bits, 0), 1 << bits, 1)[:height, :width].view(np.int8).astype(np.int32)
    green_to_red, green_to_blue, red_to_blue = full[..., 0], full[..., 1], full[..., 2]
    blue, green, red = (c[..., k].astype(np.int32) for k in range(3))
    signed = lambda x: (x & 255) - ((x & 128) << 1)
    sign = -1 if forward else 1
    new_red = red + sign * (green_to_red * signed(green) >> 5) & 255
    true_red = red if forward else new_red
    new_blue = blue + sign * ((green_to_blue * signed(green) >> 5) + (red_to_blue * signed(true_red) >> 5)) & 255
    out = c.copy()
    out[..., 2], out[..., 0] = new_red, new_blue
    return out


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels (height, width; uint32) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise Damaged("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    r = Reader(data[20 : 20 + size])
    if r.read(8) != 0x2F:
        raise Damaged("no signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise Damaged("an unknown version")
    steps: list[tuple] = []
    now = width
    while r.read(1):
        kind = r.read(2)
        if kind in {s[0] for s in steps}:
            raise Damaged("a transform twice")
        if kind < 2:
            bits = r.read(3) + 2
            across, down = -(-now >> bits), -(-height >> bits)
            steps.append((kind, bits, read_pixels(r, across, down, False).reshape(down, across), now))
        elif kind == 2:
            steps.append((kind, 0, None, now))
        else:
            colours = r.read(8) + 1
            deltas = channels(read_pixels(r, colours, 1, False))
            table = pixels(np.cumsum(deltas, axis=0, dtype=np.uint8))
            bits = bundle_bits(colours)
            steps.append((kind, bits, table, now))
            now = -(-now >> bits)
    image = read_pixels(r, now, height, True).reshape(height, now)
    for kind, bits, table, across in reversed(steps):
        if kind == 0:
            image = pixels(predict(channels(image), table >> 8 & 15, bits, False))
        elif kind == 1:
            image = pixels(cross(channels(image), table, bits, False))
        elif kind == 2:
            green = image >> 8 & 0xFF
            image = image & np.uint32(0xFF00FF00) | ((image & 0xFF0000) + (green << 16) & 0xFF0000) | ((image & 0xFF) + green & 0xFF)
        else:
            index = image >> 8 & 0xFF
            if bits:
                each = 8 >> bits
                index = (index[..., None] >> (np.arange(1 << bits, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :across]
            image = np.r_[table, np.zeros(256 - len(table), dtype=np.uint32)][index]
    return image


# ------------------------------------------------------------------------------------------------ encoder


class Writer:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def lengths_of(weights: list[int], most: int = 15) -> list[int]:
    """Huffman code lengths of at most so many bits; weights are flattened until they fit."""
    while True:
        heap = [(w, i, (i,)) for i, w in enumerate(weights) if w]
        if len(heap) < 2:
            return [int(bool(w)) for w in weights]
        heapq.heapify(heap)
        lengths = [0] * len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths) <= most:
            return lengths
        weights = [w and 1 + w // 2 for w in weights]


def put_code(w: Writer, lengths: list[int]) -> Code:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2 and (used or [0])[0] < 256:
        w.put(1 | 4, 3)
        w.put((used or [0])[0], 8)
        return code_of(tuple(int(s == (used or [0])[0]) for s in range(len(lengths))))
    w.put(0, 1)
    w.put(15, 4)
    for s in CODE_LENGTH_ORDER:
        w.put(4 if s < 16 else 0, 3)
    plain = code_of((4,) * 16 + (0,) * 3)
    w.put(0, 1)
    for n in lengths:
        w.put(int(plain.codes[n]), 4)
    return code_of(tuple(lengths))


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix, number of extra bits and their value of a length or distance code from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + (v >> extra & 1), extra, v & ((1 << extra) - 1)


def put_pixels(w: Writer, image: np.ndarray, main: bool, cache_bits: int = 0, matches: dict[int, tuple[int, int]] | None = None) -> None:
    """Writes an image with codes of its own; matches: length and distance by the pixel where a reference starts."""
    flat = image.ravel().tolist()
    w.put(1 | cache_bits << 1, 5) if cache_bits else w.put(0, 1)
    if main:
        w.put(0, 1)
    symbols: list[tuple] = []
    cache, at = {}, 0
    while at < len(flat):
        if matches and at in matches:
            length, back = matches[at]
            symbols.append((length, back))
            took = length
        else:
            x = flat[at]
            slot = (CACHE_SPREAD * x & 0xFFFFFFFF) >> 32 - cache_bits if cache_bits else 0
            symbols.append((LITERALS + LENGTHS + slot,) if cache_bits and cache.get(slot, 0) == x else (x >> 8 & 255, x >> 16 & 255, x & 255, x >> 24))
            took = 1
        if cache_bits:
            for x in flat[at : at + took]:
                cache[(CACHE_SPREAD * x & 0xFFFFFFFF) >> 32 - cache_bits] = x
        at += took
    counts = [[0] * n for n in (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)]
    for s in symbols:
        if len(s) == 2:
            counts[0][LITERALS + prefix_of(s[0])[0]] += 1
            counts[4][prefix_of(s[1] + len(NEAR))[0]] += 1
        else:
            for k, v in enumerate(s):
                counts[k][v] += 1
    codes = [put_code(w, lengths_of(c)) for c in counts]

    def put(k: int, v: int) -> None:
        if codes[k].only is None:
            w.put(int(codes[k].codes[v]), int(codes[k].bits[v]))

    for s in symbols:
        if len(s) == 2:
            for k, (prefix, extra, rest) in ((0, prefix_of(s[0])), (4, prefix_of(s[1] + len(NEAR)))):
                put(k, prefix + (0 if k else LITERALS))
                w.put(rest, extra)
        else:
            for k, v in enumerate(s):
                put(k, v)


def riff(body: bytes) -> bytes:
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + (len(padded) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + padded


def head(w: Writer, width: int, height: int) -> None:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError(f"{width} x {height} does not fit the format")
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)


def encode(image: np.ndarray, predictor: np.ndarray | None = None, colour: np.ndarray | None = None, subtract: bool = False, palette: bool = False, cache_bits: int = 0, matches: dict | None = None, bits: int = 2) -> bytes:
    """A lossless WebP file of ARGB pixels, with the transforms asked for; predictor and colour hold one value a tile."""
    height, width = image.shape
    w = Writer()
    head(w, width, height)
    image = image.astype(np.uint32)
    if palette:
        table, index = np.unique(image, return_inverse=True)
        index = index.reshape(image.shape).astype(np.uint32)
        w.put(1 | 3 << 1, 3)
        w.put(len(table) - 1, 8)
        deltas = channels(table).copy()
        deltas[1:] -= channels(table)[:-1]
        put_pixels(w, pixels(deltas), False)
        pack = bundle_bits(len(table))
        if pack:
            index = np.pad(index, ((0, 0), (0, -width % (1 << pack)))).reshape(height, -1, 1 << pack)
            index = (index << (np.arange(1 << pack, dtype=np.uint32) * (8 >> pack))).sum(-1).astype(np.uint32)
        image = index << np.uint32(8) | np.uint32(0xFF000000)
    if subtract:
        w.put(1 | 2 << 1, 3)
        green = image >> 8 & 0xFF
        image = image & np.uint32(0xFF00FF00) | ((image & 0xFF0000) - (green << 16) & 0xFF0000) | ((image & 0xFF) - green & 0xFF)
    if colour is not None:
        w.put(1 | 1 << 1, 3)
        w.put(bits - 2, 3)
        put_pixels(w, colour, False)
        image = pixels(cross(channels(image), colour, bits, True))
    if predictor is not None:
        w.put(1, 3)
        w.put(bits - 2, 3)
        put_pixels(w, predictor.astype(np.uint32) << 8 | np.uint32(0xFF000000), False)
        image = pixels(predict(channels(image), predictor, bits, True))
    w.put(0, 1)
    put_pixels(w, image, True, cache_bits, matches)
    return riff(w.value.to_bytes(-(-w.n // 8), "little"))


def put_only(w: Writer, symbol: int) -> None:
    """A code of one symbol, which takes no bits."""
    w.put(1 | 4, 3)
    w.put(symbol, 8)


@lru_cache(maxsize=4)
def sample_lengths(kind: str) -> tuple[int, ...]:
    """Fixed code lengths of green samples and references, by rule.

    text: blanks, then small letters by the usual order of frequency, then other characters; rank: samples that are
    numbered by how often they are; step: differences around zero; flat: all alike.
    """
    weights = [1] * (LITERALS + LENGTHS)
    if kind == "text":
        for i in range(128, 192):
            weights[i] = 24
        for i in range(32, 127):
            weights[i] = 24
        for i, c in enumerate(b" etnaohirsdluf"):
            weights[c] = 6000 - 420 * i
        for c in b"cmgpbywv":
            weights[c] = 400
        for c in b".,\n\xc3":
            weights[c] = 200
        weights[255] = 8
    elif kind == "rank":
        weights = [1 + int(8000 * 0.9**i) for i in range(LITERALS)] + [30] * LENGTHS
    elif kind == "step":
        weights = [1 + int(8000 * 0.8 ** min(i, LITERALS - i)) for i in range(LITERALS)] + [30] * LENGTHS
    return tuple(lengths_of(weights))


@lru_cache(maxsize=8)
def group_bits(kind: str, alpha: int) -> tuple[int, int, Code, Code]:
    """Bits (value, number) from the last transform to the last code of a green image, and its two codes."""
    w = Writer()
    w.put(0, 1)
    w.put(0, 2)  # no colour cache, one group
    green = put_code(w, list(sample_lengths(kind)))
    for only in (0, 0, alpha):
        put_only(w, only)
    far = put_code(w, [5] * 24 + [6] * 16)
    return w.value, w.n, green, far


TURNED = [int(f"{i:08b}"[::-1], 2) for i in range(256)]


def put_palette(w: Writer, values: np.ndarray) -> None:
    """The palette transform of samples in the green channel: deltas with eight bits, and one for alpha."""
    w.put(1 | 3 << 1, 3)
    w.put(len(values) - 1, 8)
    w.put(0, 1)
    w.put(0, 1)  # green: 256 lengths that are all eight
    w.put(CODE_LENGTH_ORDER.index(8) + 1 - 4, 4)
    for s in CODE_LENGTH_ORDER[: CODE_LENGTH_ORDER.index(8) + 1]:
        w.put(int(s == 8), 3)
    w.put(1, 1)
    w.put(3, 3)
    w.put(LITERALS - 2, 8)
    put_only(w, 0)
    put_only(w, 0)
    w.put(1 | 2 | 4, 3)  # alpha: 0 or 255
    w.put(0, 8)
    w.put(255, 8)
    put_only(w, 0)
    turned, n = 0, 0
    for i, d in enumerate(np.diff(values, prepend=np.uint8(0)).tolist()):
        turned |= (TURNED[d] | (i == 0) << 8) << n
        n += 9
    w.put(turned, n)


def runs_of(samples: np.ndarray, least: int = 12, most: int = 4096) -> list[tuple[int, int, int]]:
    """References (start, length, 1) of runs of one sample."""
    edges = np.flatnonzero(np.r_[True, samples[1:] != samples[:-1], True])
    long = np.flatnonzero(np.diff(edges) > least)
    return [(k, min(most, b - k), 1) for a, b in zip(edges[long].tolist(), edges[long + 1].tolist(), strict=True) for k in range(a + 1, b, most)]


@lru_cache(maxsize=4)
def length_array(kind: str) -> np.ndarray:
    return np.array(sample_lengths(kind)[:LITERALS])


#: Bits a sample from which the predictor is thought of.
LEAST_STEP = 6


def best_plan(samples: np.ndarray, width: int) -> tuple[str, np.ndarray]:
    """How a grey image takes the fewest bits, and its distinct samples by frequency.

    grey: as it is; palette: samples as ranks; packed: as ranks of which several share a pixel; step: by the predictor
    of left neighbours, if samples take many bits otherwise. Bits are reckoned for all samples, without references.
    """
    counts = np.bincount(samples, minlength=256)
    order = np.argsort(-counts, kind="stable")
    order = order[: np.count_nonzero(counts)]
    sizes = {"grey": int(length_array("text") @ counts)}
    if pack := bundle_bits(len(order)):  # so few colours always share pixels
        sizes["packed"] = (9 * len(samples) >> pack) + 9 * len(order) + 110
    else:
        sizes["palette"] = int(length_array("rank")[: len(order)] @ counts[order]) + 9 * len(order) + 110
    if min(sizes.values()) > LEAST_STEP * len(samples):  # else differences do not take fewer
        rows = samples.reshape(-1, width)
        steps = np.bincount(np.diff(rows, axis=1).ravel(), minlength=256) + np.bincount(np.diff(rows[:, 0], prepend=np.uint8(0)), minlength=256)
        sizes["step"] = int(length_array("step") @ steps) + 60
    return min(sizes, key=lambda k: (sizes[k], k)), order.astype(np.uint8)


def encode_grey(samples: np.ndarray, width: int, matches: list[tuple[int, int, int]]) -> bytes:
    """A grey image of 8-bit samples with fixed codes, after the transforms that make it smallest.

    matches: (start, length up to 4096, distance) of references between equal samples, in order. All plans subtract
    green, so that grey pixels keep a green sample only.
    """
    plan, values = best_plan(samples, width)
    w = Writer()
    head(w, width, len(samples) // width)
    w.put(1 | 2 << 1, 3)
    kind, alpha = {"grey": "text", "palette": "rank", "packed": "flat", "step": "step"}[plan], 255
    if plan in ("palette", "packed"):
        put_palette(w, values)
        rank = np.zeros(256, dtype=np.uint8)
        rank[values] = np.arange(len(values), dtype=np.uint8)
        samples = rank[samples]
    if plan == "packed":
        pack = bundle_bits(len(values))
        each = np.arange(1 << pack, dtype=np.uint8) * np.uint8(8 >> pack)
        padded = np.pad(samples.reshape(-1, width), ((0, 0), (0, -width % (1 << pack))))
        samples = np.bitwise_or.reduce(padded.reshape(len(padded), -1, 1 << pack) << each, axis=2).ravel()
        matches = runs_of(samples)
    if plan == "step":
        w.put(1, 3)
        w.put(7, 3)  # tiles of 512 pixels, all of mode 1
        w.put(0, 1)
        for only in (1, 0, 0, 255, 0):
            put_only(w, only)
        rows = samples.reshape(-1, width)
        samples = np.concatenate([np.diff(rows[:, 0], prepend=np.uint8(0))[:, None], np.diff(rows, axis=1)], axis=1).ravel()
        matches, alpha = runs_of(samples), 0
    value, n, green, far = group_bits(kind, alpha)
    w.put(value, n)
    first = w.value.to_bytes(-(-w.n // 8), "little")
    codes, bits, at = [], [], 0
    for start, length, back in [*matches, (len(samples), 0, 0)]:
        part = samples[at:start]
        codes.append(green.codes[part])
        bits.append(green.bits[part])
        if length:
            for code, (prefix, extra, rest), base in ((green, prefix_of(length), LITERALS), (far, prefix_of(back + len(NEAR)), 0)):
                codes.append(np.array([code.codes[base + prefix], rest], dtype=np.uint64))
                bits.append(np.array([code.bits[base + prefix], extra]))
        at = start + length
    code, size = np.concatenate(codes), np.concatenate(bits)
    ends = np.cumsum(size) + (w.n & 7)
    total = int(ends[-1]) if len(ends) else w.n & 7
    starts = ends - size
    # codes are at most 20 bits: each touches up to four bytes; sums of disjoint bits do not carry
    shifted = code << (starts & 7).astype(np.uint64)
    byte = starts >> 3
    body = np.zeros(-(-total // 8) + 4, dtype=np.int64)
    for k in range(4):
        body[: len(body)] += np.bincount(byte + k, (shifted >> np.uint64(8 * k) & np.uint64(255)).astype(np.float64), minlength=len(body))[: len(body)].astype(np.int64)
    whole = body[: -(-total // 8)].astype(np.uint8).tobytes()
    if w.n & 7:
        joined = first[:-1] + bytes([first[-1] | whole[0]]) + whole[1:]
    else:
        joined = first + whole
    return riff(joined)
