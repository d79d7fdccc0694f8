"""The lossless WebP decoder against a plain encoder written here, which uses every feature of the format."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest

from siltstone.llm import webp


class Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def put(self, value, n):
        self.value |= value << self.at
        self.at += n

    def bytes(self):
        return self.value.to_bytes((self.at + 7) // 8, "little")


def flat_lengths(n, size):
    """A complete code over the first n of size symbols."""
    k = max(1, (n - 1).bit_length())
    short = (1 << k) - n
    return [k - 1 if i < short else k for i in range(n)] + [0] * (size - n)


def canonical(lengths):
    codes, code = {}, 0
    for length in range(1, 16):
        for s, n in enumerate(lengths):
            if n == length:
                codes[s] = (code, length)
                code += 1
        code <<= 1
    return codes


def put_code(w, lengths, repeats=True):
    """The long form, with repeat codes; returns a function that writes a symbol."""
    w.put(0, 1)
    used = flat_lengths(19, 19)
    order = webp.CODE_LENGTH_ORDER
    w.put(15, 4)
    for k in order:
        w.put(used[k], 3)
    w.put(0, 1)
    table = canonical(used)

    def put(symbol, codes):
        code, n = codes[symbol]
        w.put(int(f"{code:0{n}b}"[::-1], 2), n)

    i, before = 0, 8
    while i < len(lengths):
        run = 1
        while i + run < len(lengths) and lengths[i + run] == lengths[i]:
            run += 1
        if repeats and lengths[i] == 0 and run >= 11:
            run = min(run, 138)
            put(18, table)
            w.put(run - 11, 7)
        elif repeats and lengths[i] == 0 and run >= 3:
            run = min(run, 10)
            put(17, table)
            w.put(run - 3, 3)
        elif repeats and lengths[i] == before and run >= 3:
            run = min(run, 6)
            put(16, table)
            w.put(run - 3, 2)
        else:
            run = 1
            put(lengths[i], table)
            before = lengths[i] or before
        i += run
    codes = canonical(lengths)
    return lambda s: put(s, codes)


def prefix(value):
    """(symbol, extra bits, number of them) of a length or distance from 1 up."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 1
    half = v >> (n - 1) & 1
    return 2 * n + half, v & ((1 << (n - 1)) - 1), n - 1


def put_image(w, pixels, width, top, cache_bits=0, lz=False, groups=None, meta_bits=2):
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    height = len(pixels) // width
    across = (width + (1 << meta_bits) - 1) >> meta_bits
    if top:
        w.put(1 if groups else 0, 1)
        if groups:
            w.put(meta_bits - 2, 3)
            down = (height + (1 << meta_bits) - 1) >> meta_bits
            plane = [random.Random(i).randrange(groups) for i in range(across * down)]
            put_image(w, [g << 8 for g in plane], across, False)
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    writers = [[put_code(w, flat_lengths(n, n), repeats=bool(i % 2)) for n in sizes] for i in range((groups or 0) and max(plane) + 1 or 1)]
    cache, i = {}, 0
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    near = {(x, y): d + 1 for d, (x, y) in enumerate(webp.NEAR)}
    while i < len(pixels):
        put = writers[plane[((i // width) >> meta_bits) * across + ((i % width) >> meta_bits)] if groups else 0]
        best = (0, 0)
        if lz:
            for d in (1, 2, width, width + 1, 3 * width - 2, 37):
                if d <= i:
                    n = 0
                    while i + n < len(pixels) and n < 3000 and pixels[i + n] == pixels[i + n - d]:
                        n += 1
                    best = max(best, (n, d))
        if best[0] >= 3:
            n, d = best
            symbol, extra, bits = prefix(n)
            put[0](256 + symbol)
            w.put(extra, bits)
            code = next((near[x, y] for x, y in near if x + y * width == d and d > 1), d + 120)
            symbol, extra, bits = prefix(code)
            put[4](symbol)
            w.put(extra, bits)
            made = pixels[i : i + n]
        elif cache_bits and cache.get(slot(pixels[i])) == pixels[i]:
            put[0](280 + slot(pixels[i]))
            made = pixels[i : i + 1]
        else:
            p = pixels[i]
            for k, v in ((0, p >> 8), (1, p >> 16), (2, p), (3, p >> 24)):
                put[k](v & 255)
            made = [p]
        for p in made:
            if cache_bits:
                cache[slot(p)] = p
        i += len(made)


def parts(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


def joined(c):
    return (c[0] & 255) << 24 | (c[1] & 255) << 16 | (c[2] & 255) << 8 | c[3] & 255


def predicted(mode, left, top, right, corner):
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        pl = sum(abs(t - c) for t, c in zip(top, corner))
        pt = sum(abs(x - c) for x, c in zip(left, corner))
        return left if pl < pt else top
    return [
        lambda: [255, 0, 0, 0], lambda: left, lambda: top, lambda: right, lambda: corner, lambda: avg(avg(left, right), top), lambda: avg(left, corner), lambda: avg(left, top), lambda: avg(corner, top),
        lambda: avg(top, right), lambda: avg(avg(left, corner), avg(top, right)), None, lambda: [clamp(x + t - c) for x, t, c in zip(left, top, corner)],
        lambda: [clamp(a + int((a - c) / 2)) for a, c in zip(avg(left, top), corner)],
    ][mode]()


def encoded(pixels, width, transforms=(), **options):
    height = len(pixels) // width
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    coded = width
    for kind in transforms:
        w.put(1, 1)
        w.put({"predictor": 0, "cross": 1, "green": 2, "palette": 3}[kind], 2)
        side = (coded + 3) >> 2
        down = (height + 3) >> 2
        if kind == "predictor":
            w.put(0, 3)
            modes = [(i * 5 + 1) % 14 for i in range(side * down)]
            put_image(w, [m << 8 for m in modes], side, False)
            grid = [parts(p) for p in pixels]
            out = []
            for i, p in enumerate(grid):
                y, x = divmod(i, coded)
                if i == 0:
                    guess = [255, 0, 0, 0]
                elif y == 0:
                    guess = grid[i - 1]
                elif x == 0:
                    guess = grid[i - coded]
                else:
                    guess = predicted(modes[(y >> 2) * side + (x >> 2)], grid[i - 1], grid[i - coded], grid[i - coded + 1], grid[i - coded - 1])
                out.append(joined([a - b for a, b in zip(p, guess)]))
            pixels = out
        elif kind == "cross":
            w.put(0, 3)
            rng = random.Random(3)
            factors = [(rng.randrange(256), rng.randrange(256), rng.randrange(256)) for _ in range(side * down)]
            put_image(w, [joined([255, r2b, g2b, g2r]) for g2r, g2b, r2b in factors], side, False)
            signed = lambda v: v - 256 if v > 127 else v
            out = []
            for i, p in enumerate(pixels):
                y, x = divmod(i, coded)
                g2r, g2b, r2b = map(signed, factors[(y >> 2) * side + (x >> 2)])
                a, r, g, b = parts(p)
                out.append(joined([a, r - (g2r * signed(g) >> 5), g, b - (g2b * signed(g) >> 5) - (r2b * signed(r) >> 5)]))
            pixels = out
        elif kind == "green":
            pixels = [joined([a, r - g, g, b - g]) for a, r, g, b in map(parts, pixels)]
        else:
            table = sorted(set(pixels))
            w.put(len(table) - 1, 8)
            steps = [joined([x - y for x, y in zip(parts(c), parts(p))]) for c, p in zip(table, [0, *table])]
            put_image(w, steps, len(table), False)
            bits = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            index = {c: i for i, c in enumerate(table)}
            per, each, out = 1 << bits, 8 >> bits, []
            for y in range(height):
                row = [index[p] for p in pixels[y * coded : (y + 1) * coded]]
                out += [sum(v << (each * k) for k, v in enumerate(row[x : x + per])) << 8 | 255 << 24 for x in range(0, coded, per)]
            coded = (coded + per - 1) // per
            pixels = out
    w.put(0, 1)
    put_image(w, pixels, coded, True, **options)
    chunk = bytes([webp.SIGNATURE]) + w.bytes()
    chunk += b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk


def picture(width, height, colours, seed=1):
    rng = random.Random(seed)
    table = [rng.randrange(1 << 32) for _ in range(colours)]
    out = [table[(x // 3 + y // 2) % colours] if rng.random() < 0.8 else rng.choice(table) for y in range(height) for x in range(width)]
    return out


@pytest.mark.parametrize("transforms", [(), ("predictor",), ("cross",), ("green",), ("predictor", "cross", "green"), ("green", "predictor"), ("cross", "predictor")])
@pytest.mark.parametrize("options", [{}, {"cache_bits": 4}, {"lz": True}, {"lz": True, "cache_bits": 7, "groups": 3}])
def test_decodes_every_feature(transforms, options):
    pixels = picture(21, 14, 90)
    assert webp.decode(encoded(pixels, 21, transforms, **options)).ravel().tolist() == pixels


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_decodes_palettes(colours):
    pixels = picture(19, 8, colours)
    assert webp.decode(encoded(pixels, 19, ("palette",), lz=True)).ravel().tolist() == pixels


@pytest.mark.parametrize("seed", range(12))
def test_samples_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = 192 * int(rng.integers(1, 40))
    skew = rng.integers(0, 256, n) if seed % 3 else np.minimum(255, rng.geometric(0.5, n))
    samples = (skew % (1 if seed == 4 else 2 if seed == 5 else 256)).astype(np.uint8)
    images = webp.load(webp.store(samples))
    payload, _ = webp.describe(images)
    assert payload == samples.tobytes()
    assert all(((x >> 16 & 255) == (x & 255)).all() and (x >> 24 == 255).all() for x in images)


def prose(words, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n)).encode()


@pytest.mark.parametrize("text", [prose(["thon", "was", "hend", "é日", "oftionnten."], 4000, 1), prose(["a", "b"], 500, 2), b"x", b"ab" * 5000, b"word " * 30_000, bytes(range(256)) * 9, prose([f"w{i}" for i in range(3000)], 3000, 3) * 2], ids=range(7))
def test_texts_round_trip_through_back_references(text):
    """What back-references, palettes and long distances store comes back, by the fast path as by the one symbol at a time."""
    payload = np.frombuffer(webp.payload_of(text), np.uint8)
    media = webp.store(payload)
    assert webp.describe(webp.load(media))[0] == payload.tobytes()
    counts = np.bincount(payload)
    entropy = -(counts[counts > 0] / len(payload) * np.log2(counts[counts > 0] / len(payload))).sum() * len(payload) / 8
    assert len(media) < entropy or len(text) < 3000  # shorter than any code of single bytes


def test_both_paths_read_the_same(monkeypatch):
    payload = np.frombuffer(webp.payload_of(prose(["thon", "was", "hend", "oftionnten."], 600, 4)), np.uint8)
    media = webp.store(payload)
    fast = webp.decode(media)
    real = webp.read_code

    def apart(bits, alphabet):
        code = real(bits, alphabet)
        if code.single == 255:  # alpha: as if it had a choice, so that every symbol is read by itself
            code = webp.Code(np.eye(1, 256, 255, dtype=np.uint8)[0])
            code.single = None
        return code

    monkeypatch.setattr(webp, "read_code", apart)
    assert (webp.decode(media) == fast).all()


def test_long_payloads_become_several_images():
    samples = np.resize(np.frombuffer("añ日 ".encode(), np.uint8), 192 * (webp.MAX_ROWS * 2 + 5))
    images = webp.load(webp.store(samples))
    assert [x.shape[0] for x in images] == [webp.MAX_ROWS, webp.MAX_ROWS, 5]
    assert webp.describe(images)[0] == samples.tobytes()


def test_length_limit_on_steep_counts():
    counts = [1, 1]
    while len(counts) < 40:
        counts.append(counts[-1] + counts[-2])
    lengths = webp.huffman_lengths(counts)
    assert max(lengths) <= 15 and sum(2.0**-n for n in lengths) == 1.0


@pytest.mark.parametrize("cut", [10, 24, 40, 60])
def test_broken_files_are_refused(cut):
    data = webp.store(np.frombuffer(b"some text to keep " * 32, np.uint8)[:384])
    with pytest.raises((ValueError, struct.error)):
        webp.decode(data[:cut])


def test_headers_are_read_in_few_steps(monkeypatch):
    """The code of code lengths is one field, and made once: a short text costs little more than its samples."""
    text = bytes(range(32, 127)) * 8
    media = webp.store(np.frombuffer(webp.payload_of(text), np.uint8))
    reads, read = [], webp.Bits.read
    monkeypatch.setattr(webp.Bits, "read", lambda self, n: reads.append(n) or read(self, n))
    grey, _ = webp.describe(webp.load(media))
    assert grey == webp.payload_of(text) and len(reads) < 45
    webp.load(media)
    assert webp._length_code.cache_info().hits > 0


@pytest.mark.parametrize("n", [webp.WIDTH, 1 << 18])
def test_small_and_large_arrays_of_places_give_the_same(monkeypatch, n):
    samples = np.frombuffer(webp.payload_of(bytes(random.Random(n).choices(range(97, 123), k=n))), np.uint8)
    media = webp.store(samples)
    monkeypatch.setattr(webp, "_index_type", lambda n: np.int32)
    assert webp.store(samples) == media and webp.describe(webp.load(media))[0] == samples.tobytes()
