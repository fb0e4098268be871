"""The reader of lossless WebP against streams that use every part of the format, written here bit by bit."""

import heapq

import numpy as np
import pytest

from quillspan.llm import webp


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n)]

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def code_lengths(freq, most=15):
    """Huffman; counts are halved until no code is longer than ``most``."""
    lengths = huffman(freq)
    while max(lengths) > most:
        freq = [(f + 1) // 2 for f in freq]
        lengths = huffman(freq)
    return lengths


def huffman(freq):

    live = [(f, i, (i,)) for i, f in enumerate(freq) if f]
    lengths = [0] * len(freq)
    if len(live) == 1:
        lengths[live[0][1]] = 1
        return lengths
    heapq.heapify(live)
    while len(live) > 1:
        a, b = heapq.heappop(live), heapq.heappop(live)
        for s in a[2] + b[2]:
            lengths[s] += 1
        heapq.heappush(live, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return lengths


def canonical(lengths):
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        before = n
        out[s] = [int(c) for c in format(code, f"0{n}b")]
        code += 1
    return {s: [] for s in out} if len(out) == 1 else out


def put_code(out, freq):
    lengths = code_lengths(freq)
    runs, i = [], 0  # (symbol, extra bits, n)
    while i < len(lengths):
        j = i
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        n = j - i
        if lengths[i] == 0 and n >= 3:
            n = min(n, 138)
            runs.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
        elif n >= 4:
            n = min(n, 7)
            runs += [(lengths[i], 0, 0), (16, n - 4, 2)]
        else:
            n = 1
            runs.append((lengths[i], 0, 0))
        i += n
    of = [0] * 19
    for s, _, _ in runs:
        of[s] += 1
    of_lengths = code_lengths(of, 7)
    out.put(0, 1)
    out.put(15, 4)
    for s in webp.CODE_LENGTH_ORDER:
        out.put(of_lengths[s], 3)
    out.put(0, 1)
    table = canonical(of_lengths)
    for s, extra, n in runs:
        out.bits += table[s]
        out.put(extra, n)
    return canonical(lengths)


def prefix(value):
    """prefix code, extra bits, their number of a length or distance code from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def put_image(out, argb, width, main, cache_bits=0, references=False, group_bits=None):
    """Tokens by greedy search of one candidate distance, then codes a group, then the tokens."""
    n = len(argb)
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    group_of = [0] * n
    if main:
        out.put(0 if group_bits is None else 1, 1)
        if group_bits is not None:
            out.put(group_bits - 2, 3)
            across, down = -(-width >> group_bits), -(-(n // width) >> group_bits)
            ids = [(b % 2) for b in range(across * down)]
            put_image(out, [g << 8 for g in ids], across, False)
            group_of = [ids[(i // width >> group_bits) * across + (i % width >> group_bits)] for i in range(n)]
    groups = max(group_of) + 1
    size = 280 + (1 << cache_bits if cache_bits else 0)
    freq = [[[0] * size, [0] * 256, [0] * 256, [0] * 256, [0] * 40] for _ in range(groups)]
    tokens, cache, i = [], {}, 0
    while i < n:
        g, c = group_of[i], argb[i]
        slot = (0x1E35A7BD * c & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        found = 0
        if references:
            for d in (1, width, width + 1, 130):
                m = 0
                while d <= i and i + m < n and argb[i + m] == argb[i + m - d] and m < 4096:
                    m += 1
                if m >= 3:
                    found = m
                    break
        if found:
            near = [k for k, (x, y) in enumerate(webp.NEAR) if max(1, x + y * width) == d]
            lp, le, ln = prefix(found)
            dp, de, dn = prefix(near[0] + 1 if near else d + 120)
            tokens.append((g, [(0, 256 + lp, le, ln), (4, dp, de, dn)]))
        elif cache_bits and cache.get(slot) == c:
            tokens.append((g, [(0, 280 + slot, 0, 0)]))
            found = 1
        else:
            tokens.append((g, [(0, c >> 8 & 255, 0, 0), (1, c >> 16 & 255, 0, 0), (2, c & 255, 0, 0), (3, c >> 24, 0, 0)]))
            found = 1
        for c in argb[i : i + found]:
            if cache_bits:
                cache[(0x1E35A7BD * c & 0xFFFFFFFF) >> (32 - cache_bits)] = c
        i += found
    for g, parts in tokens:
        for k, s, _, _ in parts:
            freq[g][k][s] += 1
    codes = []
    for g in range(groups):
        for f in freq[g]:
            f[0] += not any(f)
        codes.append([put_code(out, f) for f in freq[g]])
    for g, parts in tokens:
        for k, s, extra, bits in parts:
            out.bits += codes[g][k][s]
            out.put(extra, bits)


def start(width, height):
    out = Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    return out


def picture(width, height, seed, colours=None):
    rng = np.random.default_rng(seed)
    px = rng.integers(0, 256, (height, width, 4)).astype(np.uint8)
    px[height // 3 : height // 2] = px[0]  # repeats for references
    px[:, : width // 3] = px[0, 0]
    if colours:
        px = rng.integers(0, 256, (colours, 4)).astype(np.uint8)[rng.integers(0, colours, (height, width))]
    return px


def numbers(px):
    return [int(x) for x in np.ascontiguousarray(px).reshape(-1, 4).view("<u4")[:, 0]]


@pytest.mark.parametrize("options", [{}, {"references": True}, {"cache_bits": 4}, {"cache_bits": 10, "references": True}, {"group_bits": 3, "references": True, "cache_bits": 6}])
def test_prefix_codes_references_cache_and_groups(options):
    px = picture(37, 29, 1)
    out = start(37, 29)
    out.put(0, 1)
    put_image(out, numbers(px), 37, True, **options)
    w, h, got = webp.decode(webp.riff(out.bytes()))
    assert (w, h) == (37, 29) and (got == px).all()


def test_subtract_green():
    px = picture(20, 11, 2)
    sent = px.copy()
    sent[..., 0] -= px[..., 1]
    sent[..., 2] -= px[..., 1]
    out = start(20, 11)
    out.put(1, 1)
    out.put(webp.SUBTRACT_GREEN, 2)
    out.put(0, 1)
    put_image(out, numbers(sent), 20, True)
    assert (webp.decode(webp.riff(out.bytes()))[2] == px).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    width, height, size_bits = 13, 10, 2
    px = picture(width, height, mode).astype(np.int64)
    across, down = -(-width >> size_bits), -(-height >> size_bits)
    modes = [(mode + b % 2 * 3) % 14 for b in range(across * down)]
    sent = np.zeros_like(px)
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = [0, 0, 0, 255] if x == 0 else px[0, x - 1]
            elif x == 0:
                p = px[y - 1, 0]
            else:
                right = px[y - 1, x + 1] if x + 1 < width else px[y, 0]
                m = modes[(y >> size_bits) * across + (x >> size_bits)]
                p = webp.predict(m, px[y, x - 1].tolist(), px[y - 1, x].tolist(), px[y - 1, x - 1].tolist(), right.tolist())
            sent[y, x] = (px[y, x] - np.array(p)) & 255
    out = start(width, height)
    out.put(1, 1)
    out.put(webp.PREDICTOR, 2)
    out.put(size_bits - 2, 3)
    put_image(out, [m << 8 for m in modes], across, False)
    out.put(0, 1)
    put_image(out, numbers(sent.astype(np.uint8)), width, True)
    assert (webp.decode(webp.riff(out.bytes()))[2] == px).all()


def test_predictions_by_hand():
    left, top, corner = [10, 20, 30, 255], [30, 10, 40, 255], [20, 20, 20, 255]
    assert webp.predict(12, left, top, corner, top) == [20, 10, 50, 255]
    assert webp.predict(13, left, top, corner, top) == [20, 13, 42, 255]
    assert webp.predict(11, left, top, corner, top) == top  # the estimate is 40 off the left pixel and 20 off the top one
    assert webp.predict(10, left, top, corner, [0, 0, 0, 255]) == [15, 12, 22, 255]


def test_cross_colour():
    width, height, size_bits = 19, 9, 2
    px = picture(width, height, 5)
    across, down = -(-width >> size_bits), -(-height >> size_bits)
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 256, (down, across, 3)).astype(np.uint8)  # green->red, green->blue, red->blue
    signed = lambda b: int(b) - 256 if b > 127 else int(b)
    sent = px.copy()
    for y in range(height):
        for x in range(width):
            e = elements[y >> size_bits, x >> size_bits]
            blue, green, red, _ = (int(v) for v in px[y, x])
            sent[y, x, 2] = (red - ((signed(e[0]) * signed(green)) >> 5)) & 255
            sent[y, x, 0] = (blue - ((signed(e[1]) * signed(green)) >> 5) - ((signed(e[2]) * signed(red)) >> 5)) & 255
    out = start(width, height)
    out.put(1, 1)
    out.put(webp.CROSS_COLOUR, 2)
    out.put(size_bits - 2, 3)
    put_image(out, [int(e[2]) << 16 | int(e[1]) << 8 | int(e[0]) for e in elements.reshape(-1, 3)], across, False)
    out.put(0, 1)
    put_image(out, numbers(sent), width, True)
    assert (webp.decode(webp.riff(out.bytes()))[2] == px).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 13, 16, 17, 200])
def test_palette(colours):
    width, height = 21, 8
    px = picture(width, height, 9, colours)
    table, index = np.unique(np.array(numbers(px), np.uint32), return_inverse=True)
    index = index.reshape(height, width)
    deltas = np.diff(table.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
    out = start(width, height)
    out.put(1, 1)
    out.put(webp.PALETTE, 2)
    out.put(len(table) - 1, 8)
    put_image(out, numbers(deltas), len(table), False)
    bits = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    now = -(-width >> bits)
    packed = [0] * (now * height)
    for y in range(height):
        for x in range(width):
            packed[y * now + (x >> bits)] |= int(index[y, x]) << (8 + (8 >> bits) * (x & ((1 << bits) - 1)))
    out.put(0, 1)
    put_image(out, packed, now, True)
    assert (webp.decode(webp.riff(out.bytes()))[2] == px).all()


def test_all_transforms_together_and_the_writer():
    px = picture(16, 40, 4)
    file = webp.encode(px)
    assert (webp.decode(file)[2] == px).all() and webp.encode(px) == file
    for flat in (np.zeros((3, 5, 4), np.uint8), np.full((1, 1, 4), 7, np.uint8)):
        assert (webp.decode(webp.encode(flat))[2] == flat).all()
    assert len(webp.files(file + file)) == 2
    with pytest.raises(ValueError):
        webp.decode(file[:40])
    with pytest.raises(ValueError):
        webp.decode(b"RIFF\x04\0\0\0WEBP")


def test_near_offsets():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)


def test_the_store_of_documents_goes_through_every_part(monkeypatch):
    """Counts, over the texts of a table, the images in which each part of the format is read; round trips are exact."""
    import collections

    import duckdb

    from quillspan.llm import media

    seen = collections.Counter()
    for name in ("undo_predictor", "undo_cross_colour", "undo_subtract_green", "undo_palette"):
        monkeypatch.setattr(webp, name, lambda *a, f=getattr(webp, name), n=name: (seen.update([n]), f(*a))[1])

    def steps(*a, f=webp._steps):
        out = f(*a)
        seen.update(["copies"] if ((out[0] >= 256) & (out[0] < 280)).any() else [])
        seen.update(["cache"] if (out[0] >= 280).any() else [])
        seen.update(["uneven"] if any(c.even is None for c in a[1]) else [])
        return out

    monkeypatch.setattr(webp, "_steps", steps)
    texts = [r[0] for r in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    for t in texts:
        data = t.encode()
        assert media.read(media.store(data)) == data + b"\0" * (-len(data) % 64)
    assert len(texts) == 1000 and seen["uneven"] > 990
    assert all(seen[k] >= 20 for k in ("undo_predictor", "undo_cross_colour", "undo_subtract_green", "copies", "cache")), seen
    assert all(media.read(media.store(t)) == t for t in (b"\0" * 64, b"ab" * 64, bytes(range(256)) * 8)) and seen["undo_palette"] >= 3


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (0, 1, 2), (2, 1, 0)])
def test_the_writer_on_pictures_and_noise(transforms):
    rng = np.random.default_rng(5)
    smooth = np.cumsum(rng.integers(-2, 3, (70, 45, 4)), axis=1).astype(np.uint8)
    noise = rng.integers(0, 256, (33, 17, 4), dtype=np.uint8)
    tiled = np.tile(rng.integers(0, 256, (3, 5, 4), dtype=np.uint8), (20, 9, 1))
    for px in (smooth, noise, tiled, noise[:1], noise[:, :1], noise[:1, :1], np.zeros((300, 400, 4), np.uint8), np.tile(noise, (20, 30, 1))):
        w, h, got = webp.decode(webp.encode(px, transforms))
        assert (h, w) == px.shape[:2] and (got == px).all()


def test_a_small_file_that_declares_a_huge_image_is_refused():
    px = np.zeros((4, 4, 4), np.uint8)
    data = bytearray(webp.encode(px))
    at = data.index(b"VP8L") + 9
    data[at : at + 4] = (0x3FFF | 0x3FFF << 14 | 1 << 28).to_bytes(4, "little")
    with pytest.raises(ValueError, match="more than"):
        webp.decode(bytes(data), 1 << 20)


def test_random_bytes_never_hang_or_crash_otherwise():
    rng = np.random.default_rng(9)
    good = webp.encode(rng.integers(0, 64, (20, 20, 4), dtype=np.uint8))
    for _ in range(300):
        data = bytearray(good)
        for at in rng.integers(25, len(data), 3):
            data[at] = rng.integers(0, 256)
        try:
            webp.decode(bytes(data), 1 << 16)
        except (ValueError, IndexError):
            pass
