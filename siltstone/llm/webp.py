"""Lossless WebP (VP8L): a decoder for the whole format and an encoder for 8-bit samples.

The decoder reads prefix codes, LZ77 back-references, the colour cache and meta prefix groups, inverts the predictor,
cross-colour, subtract-green and palette transforms, and returns an array of ARGB pixels. Images in which one prefix code
gives all colours (the others having a single symbol) are decoded without a loop over symbols: for every bit position it
is worked out where the next symbol would begin, with the extra bits and the distance behind a back-reference; these jumps
are doubled, the symbols are read where the jumps lead, and back-references are followed for all pixels at once by
doubling pointers until they reach literals. All other images take the symbol-by-symbol path.

The encoder stores samples in the green channel with length-limited Huffman codes and back-references: the nearest earlier
place with the same four samples, as far as both go on alike. Samples of at most 16 values are stored as a palette with
several to a pixel where that is shorter. A predictor, cross-colour and the colour cache are read but never written: a
pixel holds one sample, so there is no second colour to predict and a cached colour is as long as its literal. Payloads
that need more than MAX_ROWS rows become several images, one after the other.

Defined results: null and empty texts are a payload of blanks; rows with null or repeated doc_id are kept; an empty table
gives no rows; further columns are ignored; equal payloads have equal media; a file that is cut or broken raises ValueError.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 192
MAX_ROWS = 4096  # of an image; bounds what decoding one takes in memory
MAX_LENGTH = 15
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40

# Fixed values of the format: the order in which code-length code lengths are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: (x, y) of the first 120 distance codes, x to the left and y upwards.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, data: bytes) -> None:
        self.data, self.pos = data, 0

    def peek(self, n: int) -> int:
        k = self.pos >> 3
        return int.from_bytes(self.data[k : k + 8], "little") >> (self.pos & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.pos += n
        if self.pos > 8 * len(self.data):
            raise ValueError("the image ends early")
        return value


_reversals: dict[int, np.ndarray] = {}


def _reversed(n: int) -> np.ndarray:
    """The numbers below 2**n with their n bits in reverse order."""
    if n not in _reversals:
        out = np.zeros(1, np.int64)
        for k in range(n):
            out = np.concatenate([out, out + (1 << (n - 1 - k))])
        _reversals[n] = out
    return _reversals[n]


class Code:
    """A canonical prefix code: a table by the next `bits` bits gives the symbol and its length."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if len(used) == 1:
            self.bits, self.symbol, self.length, self.single = 0, used.astype(np.int32), np.zeros(1, np.uint8), int(used[0])
            return
        if not len(used):
            raise ValueError("a prefix code without symbols")
        self.single = None
        order = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[order].astype(np.int64)
        self.bits = int(size[-1])
        spans = 1 << (self.bits - size)
        if spans.sum() != 1 << self.bits:
            raise ValueError("a prefix code is not complete")
        back = _reversed(self.bits)
        self.symbol = np.repeat(order, spans).astype(np.int32)[back]
        self.length = np.repeat(size, spans).astype(np.uint8)[back]

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        k = bits.peek(self.bits)
        bits.pos += int(self.length[k])
        return int(self.symbol[k])


@functools.lru_cache(512)
def _simple_code(*symbols: int) -> Code:
    lengths = np.zeros(LITERALS, np.uint8)
    lengths[list(symbols)] = 1
    return Code(lengths)


@functools.lru_cache(512)
def _length_code(n: int, packed: int) -> Code:
    """The code of code lengths from its first n lengths of three bits each; most images have the same one."""
    sizes = np.zeros(len(CODE_LENGTH_ORDER), np.uint8)
    for k, i in enumerate(CODE_LENGTH_ORDER[:n]):
        sizes[i] = packed >> (3 * k) & 7
    return Code(sizes)


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        return _simple_code(first, bits.read(8)) if two else _simple_code(first)
    lengths = np.zeros(max(alphabet, LITERALS), np.uint8)
    n = 4 + bits.read(4)
    code = _length_code(n, bits.read(3 * n))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    if code.single is None and code.length.min() == code.length.max() and code.symbol.max() < 16:
        # All lengths take the same number of bits and none repeats: they lie side by side.
        n = min(left, alphabet)
        at = bits.pos + code.bits * np.arange(n)
        if bits.pos + code.bits * n > 8 * len(bits.data):
            raise ValueError("the image ends early")
        raw = np.frombuffer(bits.data[at[0] >> 3 : (at[-1] >> 3) + 2] + b"\0", np.uint8).astype(np.int64)
        k = (at >> 3) - (at[0] >> 3)
        lengths[:n] = code.symbol[(raw[k] | raw[k + 1] << 8) >> (at & 7) & ((1 << code.bits) - 1)]
        bits.pos += code.bits * n
        return Code(lengths)
    k, before = 0, 8
    while k < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[k] = s
            before = s or before
            k += 1
            continue
        value, times = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if k + times > alphabet:
            raise ValueError("code lengths beyond the alphabet")
        lengths[k : k + times] = value
        k += times
    return Code(lengths)


def _prefixed(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _windows(data: bytes, first: int) -> np.ndarray:
    """The 16 bits from every bit position on, from byte `first`; zeros behind the end, which has a position of its own."""
    raw = np.frombuffer(data, np.uint8, offset=first)
    wide = np.zeros(len(raw) + 2, np.uint32)
    wide[: len(raw)] = raw
    wide = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
    out = np.zeros(8 * len(raw) + 1, np.uint16)
    grid = out[:-1].reshape(len(raw), 8)
    for k in range(8):
        grid[:, k] = wide >> np.uint32(k) & np.uint32(0xFFFF)
    return out


def _index_type(n: int) -> type:
    """Of arrays of places: that of numpy's indexes, which needs no conversion, or half as wide where it would take much memory."""
    return np.intp if n < 1 << 20 else np.int32


def _walk(one: np.ndarray, at: int, end: int, most: int) -> np.ndarray:
    """The places below `end` that jumps lead to from `at`, at most `most`; the loop goes eight jumps at a time."""
    two = one.take(one)
    four = two.take(two)
    step, p = memoryview(four.take(four)), []
    for _ in range(-(-most // 8)):
        if at >= end:
            break
        p.append(at)
        at = step[at]
    here = np.empty((len(p), 8), one.dtype)
    here[:, 0] = p
    here[:, 1] = one.take(here[:, 0])
    here[:, 2:4] = two.take(here[:, 0:2])
    here[:, 4:8] = four.take(here[:, 0:4])
    here = here.ravel()
    return here[here < end][:most]


_EXTRA = np.array([0, 0, 0, 0, *((s - 2) >> 1 for s in range(4, LITERALS))])  # broken files have any symbol of eight bits


def _extra(symbol: np.ndarray) -> np.ndarray:
    return _EXTRA.take(symbol)


def _values(symbol: np.ndarray, extra: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The numbers that prefix symbols and their extra bits stand for."""
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + (more & ((1 << extra) - 1)) + 1)


def _one_code(bits: Bits, green: Code, distance: Code, n: int, width: int) -> np.ndarray:
    """n samples of an image whose colours lie in one code, with back-references, without a loop over symbols."""
    first, total = bits.pos >> 3, 8 * len(bits.data)
    window = _windows(bits.data, first)
    size = len(window) - 1
    kind = _index_type(size)
    key = (window & np.uint16((1 << green.bits) - 1)).astype(kind)
    symbol = green.symbol.take(key)
    one = np.arange(size + 1, dtype=kind)
    one += green.length.take(key)
    np.minimum(one, size, out=one)

    def behind(at: np.ndarray) -> tuple[np.ndarray, ...]:
        """For back-references that begin at bit positions: symbols and extra bits of length and distance, and the ends of these."""
        s = symbol[at] - LITERALS
        e = _extra(s)
        p = np.minimum(one[at] + e, size)
        k = window[p] & np.uint16((1 << distance.bits) - 1)
        d = distance.symbol[k]
        q = np.minimum(p + distance.length[k], size)
        return s, e, p, d, _extra(d), q

    if int(green.symbol.max()) >= LITERALS:
        back = np.flatnonzero(symbol >= LITERALS)
        back = back[back < size]
        _, _, _, _, e, q = behind(back)
        after = np.minimum(q + e, size)
    else:
        back = after = np.zeros(0, np.int64)
    begin = one.copy() if len(back) else one  # behind the green symbol alone
    one[back] = after
    one[size] = size
    if green.bits == 0 and not len(back):
        raise ValueError("a code without bits")
    here = _walk(one, bits.pos & 7, size, n)
    found = symbol[here]
    refers = np.flatnonzero(found >= LITERALS)
    count = np.ones(len(here), np.int64)
    one, one_after = begin, one
    s, e, _, d, e2, q = behind(here[refers])
    count[refers] = _values(s, e, window[begin[here[refers]]].astype(np.int64))
    ends = np.cumsum(count)
    last = int(np.searchsorted(ends, n))
    if last >= len(ends) or ends[last] != n:
        raise ValueError("the image ends early")
    bits.pos = 8 * first + int(one_after[here[last]])
    if bits.pos > total or here[last] + int(green.length[key[here[last]]]) > total - 8 * first:
        raise ValueError("the image ends early")
    found, count, ends = found[: last + 1], count[: last + 1], ends[: last + 1]
    out = np.zeros(n, np.uint8)
    starts = ends - count
    literal = found < LITERALS
    out[starts[literal]] = found[literal]
    kept = np.searchsorted(refers, last, side="right")
    if not kept:
        return out
    refers, d, e2, q = refers[:kept], d[:kept], e2[:kept], q[:kept]
    code = _values(d, e2, window[q].astype(np.int64) | window[np.minimum(q + 16, size)].astype(np.int64) << 16)
    near = _near(width)
    back = np.where(code <= len(NEAR), near[np.minimum(code, len(NEAR)) - 1], code - len(NEAR))
    if (back > starts[refers]).any():
        raise ValueError("a back-reference leaves the image")
    pointer = np.arange(n)
    copied = np.flatnonzero(~np.repeat(literal, count))
    pointer[copied] -= np.repeat(back, count[refers])
    while True:
        further = pointer.take(pointer)
        if (further == pointer).all():
            return out[pointer]
        pointer = further


_nears: dict[int, np.ndarray] = {}


def _near(width: int) -> np.ndarray:
    """The distances of the first 120 distance codes in an image of this width."""
    if width not in _nears:
        _nears[width] = np.array([max(1, x + y * width) for x, y in NEAR])
    return _nears[width]


def read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image: width * height ARGB values."""
    n = width * height
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, meta_bits = None, 0
    if top and bits.read(1):
        meta_bits = bits.read(3) + 2
        across = (width + (1 << meta_bits) - 1) >> meta_bits
        meta = (read_pixels(bits, across, (height + (1 << meta_bits) - 1) >> meta_bits, False) >> 8 & 0xFFFF).astype(np.int64)
    groups = []
    for _ in range(int(meta.max()) + 1 if meta is not None else 1):
        groups.append([read_code(bits, a) for a in (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)])
    green, red, blue, alpha, _ = groups[0]
    if meta is None and not cache_bits and None not in (red.single, blue.single, alpha.single):
        rest = np.uint32(alpha.single << 24 | red.single << 16 | blue.single)
        if green.single is None:
            return _one_code(bits, green, groups[0][4], n, width).astype(np.uint32) << np.uint32(8) | rest
        if green.single < LITERALS:
            return np.full(n, green.single << 8, np.uint32) | rest
    out: list[int] = [0] * n
    cache, k = [0] * (1 << cache_bits), 0
    shift = 32 - cache_bits
    while k < n:
        group = groups[meta[((k // width) >> meta_bits) * ((width + (1 << meta_bits) - 1) >> meta_bits) + ((k % width) >> meta_bits)]] if meta is not None else groups[0]
        s = group[0].read(bits)
        if s < LITERALS:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            made = [a << 24 | r << 16 | s << 8 | b]
        elif s < LITERALS + LENGTHS:
            length = _prefixed(bits, s - LITERALS)
            d = _prefixed(bits, group[4].read(bits))
            if d <= len(NEAR):
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            else:
                d -= len(NEAR)
            if d > k or k + length > n:
                raise ValueError("a back-reference leaves the image")
            made = [out[k - d + i % d] for i in range(length)]
        else:
            made = [cache[s - LITERALS - LENGTHS]]
        out[k : k + len(made)] = made
        k += len(made)
        if cache_bits:
            for pixel in made:
                cache[(0x1E35A7BD * pixel & 0xFFFFFFFF) >> shift] = pixel
    if bits.pos > 8 * len(bits.data):
        raise ValueError("the image ends early")
    return np.array(out, np.uint32)


# --- inverse transforms -------------------------------------------------------------------------------------------


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) int32: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4).astype(np.int32)


def _packed(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((channels & 255).astype(np.uint8)).view("<u4")[..., 0]


def _predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The prediction from the neighbours; right is the one above to the right, corner above to the left."""
    if mode in (0, 14, 15):
        return np.broadcast_to(np.array([0, 0, 0, 255]), top.shape)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode <= 9:
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return (a + b) >> 1
    if mode == 10:
        return ((left + corner >> 1) + (top + right >> 1)) >> 1
    if mode == 11:
        nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = (left + top) >> 1
    half = mean - corner
    return np.clip(mean + (half + (half < 0) >> 1), 0, 255)


_USES_LEFT = {1, 5, 6, 7, 10, 11, 12, 13}


def inverse_predictor(residual: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    """Rows in order; runs of a row whose mode needs no left neighbour are done at once."""
    height, width = residual.shape
    out = _channels(residual)
    out[0, 0] = (out[0, 0] + np.array([0, 0, 0, 255])) & 255
    out[0] = np.cumsum(out[0], 0) & 255  # the first row takes its left neighbour
    for y in range(1, height):
        row, up = out[y], out[y - 1]
        row[0] = (row[0] + up[0]) & 255
        above_right = np.concatenate([up[1:], row[:1]])
        for bx in range((width - 1 >> size_bits) + 1):
            mode = int(modes[y >> size_bits, bx])
            a, b = max(1, bx << size_bits), min(width, (bx + 1) << size_bits)
            if mode not in _USES_LEFT:
                row[a:b] = (row[a:b] + _predict(mode, None, up[a:b], above_right[a:b], up[a - 1 : b - 1])) & 255
            else:
                for x in range(a, b):
                    row[x] = (row[x] + _predict(mode, row[x - 1], up[x], above_right[x], up[x - 1])) & 255
    return _packed(out)


def inverse_cross_color(pixels: np.ndarray, factors: np.ndarray, size_bits: int) -> np.ndarray:
    """Adds back what was taken from red and blue in proportion to green and red."""
    height, width = pixels.shape
    ys, xs = np.arange(height) >> size_bits, np.arange(width) >> size_bits
    f = factors[np.ix_(ys, xs)]
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int32)
    green_to_red, green_to_blue, red_to_blue = signed(f & 255), signed(f >> 8 & 255), signed(f >> 16 & 255)
    c = _channels(pixels)
    green = signed(c[..., 1])
    c[..., 2] = (c[..., 2] + (green_to_red * green >> 5)) & 255
    c[..., 0] += (green_to_blue * green >> 5) + (red_to_blue * signed(c[..., 2]) >> 5)
    return _packed(c)


def inverse_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(255)
    red_blue = (pixels & np.uint32(0xFF00FF)) + (green << np.uint32(16) | green)
    return pixels & np.uint32(0xFF00FF00) | red_blue & np.uint32(0xFF00FF)


def inverse_palette(pixels: np.ndarray, table: np.ndarray, width: int, width_bits: int) -> np.ndarray:
    index = pixels >> np.uint32(8) & np.uint32(255)
    if width_bits:
        each = 8 >> width_bits
        parts = [index >> np.uint32(each * k) & np.uint32((1 << each) - 1) for k in range(1 << width_bits)]
        index = np.stack(parts, -1).reshape(len(pixels), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels (height x width) of a lossless WebP file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != SIGNATURE:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + struct.unpack_from("<I", data, 16)[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    todo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOR):
            size_bits = bits.read(3) + 2
            across, down = ((side + (1 << size_bits) - 1) >> size_bits for side in (coded, height))
            plane = read_pixels(bits, across, down, False).reshape(down, across)
            todo.append((kind, plane, size_bits))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = _packed(np.cumsum(_channels(read_pixels(bits, n, 1, False)), 0))
            width_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, table, width_bits, coded))
            coded = (coded + (1 << width_bits) - 1) >> width_bits
        else:
            todo.append((kind,))
    pixels = read_pixels(bits, coded, height, True).reshape(height, coded)
    for kind, *more in reversed(todo):
        if kind == PREDICTOR:
            pixels = inverse_predictor(pixels, more[0] >> np.uint32(8) & np.uint32(15), more[1])
        elif kind == CROSS_COLOR:
            pixels = inverse_cross_color(pixels, more[0], more[1])
        elif kind == SUBTRACT_GREEN:
            pixels = inverse_subtract_green(pixels)
        else:
            pixels = inverse_palette(pixels, more[0], more[2], more[1])
    return pixels


# --- encoder for samples ------------------------------------------------------------------------------------------


def huffman_lengths(counts: list[int], limit: int = MAX_LENGTH) -> list[int]:
    """Code lengths of a Huffman code, in the order of the counts; counts are flattened until none is over the limit."""
    while True:
        n = len(counts)
        order = sorted(range(n), key=counts.__getitem__)
        leaves = [counts[i] for i in order]
        parent, weight, a, b = [0] * (2 * n - 1), [], 0, 0
        for k in range(n - 1):
            total = 0
            for _ in range(2):
                if a < n and (b >= len(weight) or leaves[a] <= weight[b]):
                    total += leaves[a]
                    parent[a] = n + k
                    a += 1
                else:
                    total += weight[b]
                    parent[n + b] = n + k
                    b += 1
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            out = [0] * n
            for k, i in enumerate(order):
                out[i] = depth[k]
            return out
        counts = [(c + 1) // 2 + 1 for c in counts]


def _bit_string(*fields: tuple[int, int]) -> tuple[int, int]:
    value = at = 0
    for v, n in fields:
        value |= v << at
        at += n
    return value, at


# One symbol each: red and blue 0 and, for a main image, alpha 255 (1 = simple code, 0 = one symbol, then its width and itself).
_RED_BLUE, _OPAQUE = _bit_string((0b0001, 4), (0b0001, 4)), _bit_string((0b101, 3), (255, 8))
# A code-length code with four bits for each of the lengths 0 to 15 and none for repeats; the number of lengths follows in 10 bits.
_FOUR_BITS = _bit_string((0, 1), (15, 4), *((4 if k < 16 else 0, 3) for k in CODE_LENGTH_ORDER), (1, 1), (4, 3))
LEAST_MATCH, MOST_MATCH = 4, 4096


def _written_code(counts: np.ndarray) -> tuple[tuple[int, int], np.ndarray, np.ndarray]:
    """(its description as bits, code words, lengths) of a prefix code for symbols with these counts."""
    used = np.flatnonzero(counts)
    lengths, words = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.uint64)
    if len(used) <= 1:
        only = int(used[0]) if len(used) else 0
        if only < 256:
            return _bit_string((0b101, 3), (only, 8)), words, lengths
        used = np.array([0, only])  # a length symbol alone needs a longer code
    lengths[used] = huffman_lengths(counts[used].tolist())
    symbols = int(used[-1]) + 1
    symbols += symbols & 1
    nibbles = np.zeros(symbols, np.uint8)
    own = lengths[:symbols]
    nibbles[: len(own)] = _reversed(4)[own]
    table = int.from_bytes((nibbles[0::2] | nibbles[1::2] << 4).tobytes(), "little")
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order]
    top = int(size[-1])
    words[order] = _reversed(top)[np.cumsum(1 << (top - size)) - (1 << (top - size))]  # canonical codes, left-aligned to `top` bits
    return _bit_string(_FOUR_BITS, (symbols - 2, 10), (table, 4 * symbols)), words, lengths


_HIGH = np.frexp(np.maximum(np.arange(1 << 16), 1).astype(np.float64))[1].astype(np.int64) - 1  # place of the highest bit


def _parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits, what they hold) of numbers from 1 on."""
    v = values - 1
    high = _HIGH.take(v) if len(v) and v.max() < len(_HIGH) else np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), extra, v & ((1 << extra) - 1)


def matches(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of the parts of a greedy parse; literals have length 1 and distance 0."""
    n = len(samples)
    x = samples.astype(np.uint32)
    gram = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    ordered = np.sort(gram.astype(np.uint64) << np.uint64(32) | np.arange(n - 3, dtype=np.uint64))
    same = np.flatnonzero(ordered[1:] >> np.uint64(32) == ordered[:-1] >> np.uint64(32))
    order = (ordered & np.uint64(0xFFFFFFFF)).astype(np.int64)
    distance = np.zeros(n, np.int64)
    distance[order[same + 1]] = order[same + 1] - order[same]
    change = np.append(np.flatnonzero(distance[1:] != distance[:-1]), n - 1)
    place = np.arange(n)
    length = np.minimum(np.repeat(change, np.diff(change, prepend=-1)) - place + LEAST_MATCH, MOST_MATCH)
    good = (distance > 0) & (length >= LEAST_MATCH + (distance >= 200) + (distance >= 3000))
    one = np.append(place + np.where(good, length, 1), n).astype(_index_type(n), copy=False)
    start = _walk(one, 0, n, n)
    return start, np.where(good[start], length[start], 1), np.where(good[start], distance[start], 0)


def _image(samples: np.ndarray, head: tuple[int, int]) -> bytes:
    """The bits of a head and of a main image with these samples in green."""
    start, length, distance = matches(samples)
    copies = np.flatnonzero(distance)
    sizes, size_extra, size_more = _parts(length[copies])
    places, place_extra, place_more = _parts(distance[copies] + len(NEAR))
    symbol = samples[start].astype(np.int64)
    symbol[copies] = LITERALS + sizes
    green, green_words, green_lengths = _written_code(np.bincount(symbol, minlength=LITERALS + LENGTHS))
    far, far_words, far_lengths = _written_code(np.bincount(places, minlength=DISTANCES))
    value, at = _bit_string(head, (0, 1), (0, 1), green, _RED_BLUE, _OPAQUE, far)
    fields = np.zeros((len(symbol), 4), np.uint64)
    widths = np.zeros((len(symbol), 4), np.int64)
    fields[:, 0], widths[:, 0] = green_words[symbol], green_lengths[symbol]
    fields[copies, 1], widths[copies, 1] = size_more, size_extra
    fields[copies, 2], widths[copies, 2] = far_words[places], far_lengths[places]
    fields[copies, 3], widths[copies, 3] = place_more, place_extra
    used = widths.ravel() > 0
    fields, widths = fields.ravel()[used], widths.ravel()[used]
    if not len(fields):
        return value.to_bytes((at + 7) // 8, "little")
    ends = np.cumsum(widths)
    starts = ends - widths + at
    total = at + int(ends[-1])
    word = starts >> 5
    shifted = fields << (starts & 31).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(shifted, first)
    words = np.zeros((total >> 5) + 2, np.uint64)
    words[word[first]] = sums & np.uint64(0xFFFFFFFF)
    words[word[first] + 1] |= sums >> np.uint64(32)
    body = bytearray(words.astype("<u4").tobytes()[: (total + 7) // 8])
    front = int.from_bytes(body[: (at + 7) // 8], "little") | value
    body[: (at + 7) // 8] = front.to_bytes((at + 7) // 8, "little")
    return bytes(body)


def _palette(values: np.ndarray) -> tuple[int, int]:
    """The palette transform: green steps from value to value, alpha 255 once and then 0."""
    steps = np.diff(values, prepend=0) & 255
    code, words, lengths = _written_code(np.bincount(steps, minlength=LITERALS + LENGTHS))
    alpha = _bit_string((0b111, 3), (0, 8), (255, 8)) if len(values) > 1 else _OPAQUE
    fields = [(PALETTE << 1 | 1, 3), (len(values) - 1, 8), (0, 1), code, _RED_BLUE, alpha, (0b0001, 4)]
    for k, step in enumerate(steps.tolist()):
        fields.append((int(words[step]), int(lengths[step])))
        if len(values) > 1:
            fields.append((int(k == 0), 1))
    return _bit_string(*fields)


def encode(samples: np.ndarray, width: int = WIDTH) -> bytes:
    """One image of the samples; their number is a multiple of the width."""
    height = len(samples) // width
    head = _bit_string((width - 1, 14), (height - 1, 14), (0, 4))
    body = _image(samples, _bit_string(head, (0, 1)))
    values = np.flatnonzero(np.bincount(samples, minlength=LITERALS))
    if len(values) <= 16:
        width_bits = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
        each, group = 8 >> width_bits, 1 << width_bits
        rows = np.searchsorted(values, samples).reshape(height, width)
        rows = np.pad(rows, ((0, 0), (0, -width % group))).reshape(height, -1, group)
        packed = (rows << (each * np.arange(group))).sum(-1).astype(np.uint8)
        body = min(body, _image(packed.ravel(), _bit_string(head, _palette(values), (0, 1))), key=len)
    chunk = bytes([SIGNATURE]) + body
    pad = b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + pad


def store(payload: np.ndarray) -> bytes:
    """A payload of a positive multiple of WIDTH bytes as one image or, if it is long, several."""
    rows = WIDTH * MAX_ROWS
    return b"".join(encode(payload[a : a + rows]) for a in range(0, len(payload), rows))


def load(media: bytes) -> list[np.ndarray]:
    """The pixel arrays of stored media."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(decode(media[at:end]))
        at = end
    return out


def payload_of(text: bytes) -> bytes:
    """The text followed by blanks up to a positive multiple of WIDTH bytes."""
    n = max(WIDTH, -(-len(text) // WIDTH) * WIDTH)
    return text.ljust(n, b" ")


MEDIA = "doc_id long, n_bytes long, media binary"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as lossless images. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, buf, off in common.blocks(batch, "text"):
                data = memoryview(np.ascontiguousarray(buf))
                media = [store(np.frombuffer(payload_of(bytes(data[a:b])), np.uint8)) for a, b in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(off)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEDIA)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(images: list[np.ndarray]) -> tuple[bytes, str]:
    """The samples of the images, and `WxH` with the mean, the number of values, and the mean step between rows and columns."""
    grey = np.concatenate([(x >> np.uint32(8)).astype(np.uint8) for x in images])
    wide = grey.astype(np.int16)
    across, down = np.abs(np.diff(wide, axis=1)), np.abs(np.diff(wide, axis=0))
    values = int((np.bincount(grey.ravel(), minlength=256) > 0).sum())
    numbers = (int(grey.sum(dtype=np.int64)) * 1000 // grey.size, values, int(across.sum(dtype=np.int64)) * 1000 // max(1, across.size), int(down.sum(dtype=np.int64)) * 1000 // max(1, down.size))
    return grey.tobytes(), f"{grey.shape[1]}x{grey.shape[0]}:" + ":".join(map(str, numbers))


def read_media(media: DataFrame) -> DataFrame:
    """Decodes stored media and describes the pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                payload, feature = describe(load(data))
                rows.append((doc, n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), sha256(data).hexdigest(), feature))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in FEATURES.split(", ")])

    return media.mapInArrow(run, FEATURES)
