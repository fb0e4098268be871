"""Lossless WebP (VP8L): a reader and a writer for the whole format but, in the writer, several groups of codes.

``decode`` reads prefix codes (simple and normal, with groups chosen by an entropy image), back-references, the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette transforms. ``encode`` writes uneven prefix codes,
back-references for repeated stretches, a colour cache where it is hit often enough, and the transforms asked for.

A prefix code is read in whole arrays: what each bit position *would* decode to is looked up for all positions of a stretch
of the stream at once, which gives the position after the pixel that starts there; the true positions are then one
walk along these. Copies and cache hits become pointers to earlier pixels, followed by doubling. Only images with several groups of
codes, where the code depends on the place of the pixel, are read symbol by symbol.
"""

from __future__ import annotations

import struct
from functools import cache, lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
N_LENGTH_CODES, N_DISTANCE_CODES, CACHE_MULTIPLIER = 24, 40, 0x1E35A7BD
MAX_SIDE = 1 << 14

#: The 120 near offsets of short distance codes: by Euclidean distance, then |x|, positive x first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


@cache
def _reversed(width: int) -> np.ndarray:
    """The numbers of ``width`` bits with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate((out << 1, out << 1 | 1))
    return out


class Bits:
    """Bits of a byte string, least significant first; reads past the end give zeros once, then fail."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def span(self, at: int, n: int) -> int:
        """The ``n`` bits from ``at`` on, as one number."""
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end + 7:
            raise ValueError("the stream is cut short")
        return value


class Code:
    """A prefix code given by the code length of each symbol."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths)
        self.symbols = lengths.nonzero()[0]
        self.single = int(self.symbols[0]) if len(self.symbols) == 1 else None
        used = lengths[self.symbols]
        if self.single is None:
            if not len(used) or int((1 << (15 - used.astype(np.int64))).sum()) != 1 << 15:
                raise ValueError("code lengths do not make a complete prefix code")
        #: the one length of all codes, where they have one (0 for a single symbol)
        self.even = 0 if self.single is not None else int(used[0]) if (used == used[0]).all() else None
        self.lengths = lengths
        self._table: np.ndarray | None = None

    @property
    def width(self) -> int:
        return 0 if self.single is not None else int(self.lengths.max())

    def lookup(self) -> np.ndarray:
        """``symbol << 4 | length`` by the next ``width`` bits of the stream."""
        if self._table is None:
            if self.single is not None:
                self._table = np.array([self.single << 4], np.int32)
            else:
                used = self.lengths[self.symbols].astype(np.int64)
                order = np.argsort(used, kind="stable")
                entry = (self.symbols[order] << 4 | used[order]).astype(np.int32)
                # in the order of codes read from the top, each takes a share of the table; the stream has them from the bottom
                self._table = np.repeat(entry, 1 << (self.width - used[order]))[_reversed(self.width)]
        return self._table

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        entry = int(self.lookup()[bits.peek(self.width)])
        bits.read(entry & 15)
        return entry >> 4


@lru_cache(4096)
def _code_of_lengths(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8))


def _read_code(bits: Bits, n: int, known: dict[bytes, Code]) -> Code:
    """The next code, over ``n`` symbols. Channels often share their lengths: a code in ``known`` is not built again."""
    lengths = np.zeros(n, np.uint8)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    of_lengths = np.zeros(19, np.uint8)
    several = 4 + bits.read(4)
    each = bits.read(3 * several)
    for i in range(several):
        of_lengths[CODE_LENGTH_ORDER[i]] = each >> (3 * i) & 7
    code = _code_of_lengths(of_lengths.tobytes())
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else n
    if code.even is not None and not (code.symbols > 15).any():
        # lengths without runs, in codes of one length: read as an array
        left = min(left, n)
        lengths[:left] = _even_symbols(bits, code, left)
        key = lengths.tobytes()
        if key not in known:
            known[key] = Code(lengths)
        return known[key]
    i, last = 0, 8
    while i < n and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[i] = s
            last = s or last
            i += 1
        else:
            value, run = (last, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
            if i + run > n:
                raise ValueError("a run of code lengths is too long")
            lengths[i : i + run] = value
            i += run
    return Code(lengths)


def _even_symbols(bits: Bits, code: Code, n: int) -> np.ndarray:
    if code.even == 0:
        return np.full(n, code.single)
    size = code.even * n
    if bits.at + size > bits.end:
        raise ValueError("the stream is cut short")
    raw = np.frombuffer(bits.data[bits.at >> 3 : (bits.at + size + 15) >> 3], np.uint8)
    flags = np.unpackbits(raw, bitorder="little")[bits.at & 7 :][:size].reshape(n, code.even)
    bits.at += size
    return code.symbols[np.packbits(flags, axis=1)[:, 0] >> (8 - code.even)]


def _value(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _even_pixels(bits: Bits, codes: list[Code], n: int) -> np.ndarray:
    """ARGB of ``n`` pixels in literal codes of one length a channel."""
    green, red, blue, alpha = codes[:4]
    total = sum(c.even for c in (green, red, blue, alpha))
    if bits.at + total * n > bits.end:
        raise ValueError("the stream is cut short")
    raw = np.frombuffer(bits.data[bits.at >> 3 : (bits.at + total * n + 15) >> 3], np.uint8)
    flags = np.unpackbits(raw, bitorder="little")[bits.at & 7 :][: total * n].reshape(n, total)
    bits.at += total * n
    out, at = np.zeros((n, 4), np.uint8), 0
    for channel, code in ((1, green), (2, red), (0, blue), (3, alpha)):
        if code.even == 0:
            out[:, channel] = code.single
            continue
        index = np.packbits(flags[:, at : at + code.even], axis=1)[:, 0] >> (8 - code.even)
        out[:, channel] = code.symbols[index]
        at += code.even
    return out.view("<u4")[:, 0]


#: bit positions looked at together
STRETCH = 1 << 15
_SHIFTS = np.arange(8, dtype=np.uint32)
# values of length and distance prefixes: the smallest value and the number of extra bits
_EXTRA = np.array([0 if p < 4 else (p - 2) >> 1 for p in range(N_DISTANCE_CODES)], np.int64)
_LEAST = np.array([p + 1 if p < 4 else ((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(N_DISTANCE_CODES)], np.int64)
_NEAR_X, _NEAR_Y = np.array(NEAR).T


def _steps(bits: Bits, codes: list[Code], n: int) -> tuple[np.ndarray, ...]:
    """(symbol, pixels that it gives, distance code, ARGB of a literal) of each green symbol of an image of ``n`` pixels."""
    green, red, blue, alpha, far = codes
    data = np.frombuffer(bits.data + b"\0" * 64, np.uint8)
    out: list[tuple[np.ndarray, ...]] = []
    done, at = 0, bits.at
    while done < n:
        if at > bits.end:
            raise ValueError("the stream is cut short")
        first = at >> 3
        m = min(STRETCH >> 3, (bits.end >> 3) + 1 - first)
        raw = data[first : first + m + 20]
        windows = np.ndarray((len(raw) - 4,), "<u4", raw, strides=(1,))
        window = (windows[:, None] >> _SHIFTS).reshape(-1)
        limit, places = 8 * m, np.arange(8 * (len(raw) - 4))

        def entries(code: Code, at=None) -> np.ndarray:
            w = window if at is None else window[at]
            return code.lookup()[w & np.uint32((1 << code.width) - 1)]

        whole = entries(green)
        symbol, after_green = whole[:limit] >> 4, places[:limit] + (whole[:limit] & 15)
        # where a code that starts at each place ends; codes of several channels are often the same
        ends: dict[int, np.ndarray] = {}
        step = [ends[id(c)] if id(c) in ends else ends.setdefault(id(c), places + (entries(c) & 15)) for c in (red, blue, alpha)]
        # a pixel has 60 bits at most, and there are 128 places beyond the last start
        after_red = step[0][after_green]
        after_blue = step[1][after_red]
        goes = step[2][after_blue]
        special = (symbol >= 256).nonzero()[0]
        if len(special):
            goes[special] = after_green[special]
            ref = special[symbol[special] < 256 + N_LENGTH_CODES]
            q, prefix = after_green[ref], symbol[ref] - 256
            length = _LEAST[prefix] + (window[q] & ((1 << _EXTRA[prefix]) - 1))
            q = q + _EXTRA[prefix]
            e = entries(far, q)
            q, prefix = q + (e & 15), e >> 4
            distance = _LEAST[prefix] + (window[q] & ((1 << _EXTRA[prefix]) - 1))
            goes[ref] = q + _EXTRA[prefix]
        walk, q, to = [], at - 8 * first, memoryview(goes)
        for _ in range(n - done):
            if q >= limit:
                break
            walk.append(q)
            q = to[q]
        true = np.array(walk, np.int64)
        s = symbol[true]
        gives, code = np.ones(len(s), np.int64), np.zeros(len(s), np.int64)
        copies = ((s >= 256) & (s < 256 + N_LENGTH_CODES)).nonzero()[0]
        if len(copies):
            where = np.searchsorted(ref, true[copies])
            gives[copies], code[copies] = length[where], distance[where]
            total = np.cumsum(gives)
            if total[-1] + done >= n:
                k = int(np.searchsorted(total, n - done)) + 1
                if total[k - 1] + done > n:
                    raise ValueError("a back-reference leaves the image")
                s, gives, code, q, true = s[:k], gives[:k], code[:k], int(goes[true[k - 1]]), true[:k]
        a, b, c = after_green[true], after_red[true], after_blue[true]
        argb = ((entries(alpha, c) >> 4) << 24) | ((entries(red, a) >> 4) << 16) | (s << 8) | (entries(blue, b) >> 4)
        out.append((s, gives, code, argb.astype(np.uint32)))
        done += int(gives.sum())
        at = 8 * first + q
    bits.at = at
    if at > bits.end:
        raise ValueError("the stream is cut short")
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if len(out) > 1 else out[0]


def _follow(pointer: np.ndarray) -> np.ndarray:
    """Where the pointers to earlier places end."""
    while True:
        far = pointer[pointer]
        if np.array_equal(far, pointer):
            return far
        pointer = far


def _hash(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    return (argb.astype(np.uint32) * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)


def _resolve(symbol: np.ndarray, gives: np.ndarray, code: np.ndarray, argb: np.ndarray, n: int, width: int, cache_bits: int) -> np.ndarray:
    """The pixels that the steps of an image stand for."""
    if len(symbol) == n and (symbol < 256).all():
        return argb
    start = np.cumsum(gives) - gives
    pointer, literal = np.arange(n + 1), np.zeros(n + 1, np.uint32)  # the last one is the colour 0 of an empty cache
    literal[start] = argb
    copy = ((symbol >= 256) & (symbol < 256 + N_LENGTH_CODES)).nonzero()[0]
    if len(copy):
        c = code[copy]
        near = np.minimum(c, 120) - 1
        distance = np.where(c > 120, c - 120, np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * width))
        if (distance > start[copy]).any():
            raise ValueError("a back-reference leaves the image")
        size = gives[copy]
        place = np.repeat(start[copy] - np.cumsum(size) + size, size) + np.arange(size.sum())
        pointer[place] = place - np.repeat(distance, size)
        pointer = _follow(pointer)
    cached = (symbol >= 256 + N_LENGTH_CODES).nonzero()[0]
    if len(cached):
        key = _hash(literal[:n], cache_bits).astype(np.int64)
        key[start[cached]] = symbol[cached] - 256 - N_LENGTH_CODES
        key = key[pointer[:n]]
        # a hit is the last pixel before it of the same key
        order = np.argsort(key, kind="stable")
        before = np.full(n, n)
        same = key[order[1:]] == key[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        pointer[start[cached]] = before[start[cached]]
        pointer = _follow(pointer)
    return literal[pointer[:n]]


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB of an entropy-coded image, as ``width * height`` numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, block_bits, across, of_block = 1, 0, 0, None
    if main and bits.read(1):
        block_bits = bits.read(3) + 2
        across = -(-width >> block_bits)
        of_block = ((_read_image(bits, across, -(-height >> block_bits), False) >> 8) & 0xFFFF).tolist()
        groups = max(of_block) + 1
    cache_size = (1 << cache_bits) if cache_bits else 0
    sizes = (256 + N_LENGTH_CODES + cache_size, 256, 256, 256, N_DISTANCE_CODES)
    known: dict[bytes, Code] = {}
    codes = []
    for _ in range(groups):
        group: list[Code] = []
        before = 0, 0, 0
        for n in sizes:
            start = bits.at
            # channels often share their code: the same bits over as many symbols are the same code
            if before[0] == n and bits.span(start, before[2] - before[1]) == bits.span(before[1], before[2] - before[1]):
                bits.at += before[2] - before[1]
                group.append(group[-1])
            else:
                group.append(_read_code(bits, n, known))
                before = n, start, bits.at
        codes.append(group)
    n = width * height
    if groups == 1:
        if not cache_bits and all(c.even is not None and c.even <= 8 for c in codes[0][:4]) and codes[0][0].symbols[-1] < 256:
            return _even_pixels(bits, codes[0], n)
        return _resolve(*_steps(bits, codes[0], n), n, width, cache_bits)
    out: list[int] = []
    cache, cached = [0] * max(cache_size, 1), 0
    shift = 32 - cache_bits
    while len(out) < n:
        at = len(out)
        group = codes[0] if of_block is None else codes[of_block[(at // width >> block_bits) * across + (at % width >> block_bits)]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 256 + N_LENGTH_CODES:
            length = _value(s - 256, bits)
            code = _value(group[4].read(bits), bits)
            distance = code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
            if distance > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for i in range(at - distance, at - distance + length):
                out.append(out[i])
        else:
            while cached < at:  # colours enter the cache in the order of pixels, before it is next read
                cache[(CACHE_MULTIPLIER * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out.append(cache[s - 256 - N_LENGTH_CODES])
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _average(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _clip(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predict(mode: int, left, top, top_left, top_right):
    """The prediction of a pixel (4 channels) from its neighbours, by the 14 modes of the format."""
    if mode == 0:
        return [0, 0, 0, 255]
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - d) for t, d in zip(top, top_left, strict=True))
        to_top = sum(abs(x - d) for x, d in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [_clip(x + t - d) for x, t, d in zip(left, top, top_left, strict=True)]
    if mode == 13:
        mean = _average(left, top)
        # the half difference is truncated towards zero
        return [_clip(m + int((m - d) / 2)) for m, d in zip(mean, top_left, strict=True)]
    return [0, 0, 0, 255]


#: modes that need nothing of their own row, and the one that adds up along it
_ROW_MODES = (0, 1, 2, 3, 4, 8, 9, 14, 15)


def _from_above(mode: int, above: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Predictions of the pixels of a row from its second on; ``first`` stands right of the last one above."""
    top, left = above[1:], above[:-1]
    if mode == 2:
        return top
    if mode == 4:
        return left
    if mode == 8:
        return (left + top) >> 1
    right = np.concatenate((above[2:], first[None]))
    if mode == 3:
        return right
    if mode == 9:
        return (top + right) >> 1
    return np.broadcast_to(np.array([0, 0, 0, 255], above.dtype), top.shape)


def _row_plan(mode: np.ndarray) -> tuple[list[tuple[int, np.ndarray | slice]], list[tuple[int, int]]] | None:
    """(mode, places after the first) of the modes that look above only, and the stretches that add up along the row; None where a
    mode needs both."""
    held = set(mode[1:].tolist())
    if not held <= set(_ROW_MODES):
        return None
    if len(held) == 1 and 1 not in held:
        return [(held.pop(), slice(None))], []
    left = mode == 1
    left[0] = False
    edges = np.flatnonzero(np.diff(np.concatenate(([False], left, [False])))).reshape(-1, 2)
    return [(m, (mode[1:] == m).nonzero()[0]) for m in held if m != 1], [(int(a), int(b)) for a, b in edges]


def _fill_row(row: np.ndarray, above: np.ndarray, over: list, along: list) -> None:
    """The pixels of a row in place of its differences."""
    row[0] = (row[0] + above[0]) & 255
    for mode, at in over:
        row[1:][at] = (row[1:][at] + _from_above(mode, above, row[0])[at]) & 255
    for start, end in along:
        row[start:end] = (row[start - 1] + np.cumsum(row[start:end], axis=0)) & 255


def undo_predictor(argb: np.ndarray, width: int, height: int, size_bits: int, modes: np.ndarray) -> np.ndarray:
    rows = _channels(argb.reshape(height, width)).astype(np.int32)
    across = -(-width >> size_bits)
    mode_of = ((modes >> 8) & 0xF).reshape(-1, across)
    rows[0, 0] = (rows[0, 0] + [0, 0, 0, 255]) & 255
    rows[0] = np.cumsum(rows[0], axis=0) & 255
    plan = None
    for y in range(1, height):
        of = mode_of[y >> size_bits]
        if y == 1 or not y & ((1 << size_bits) - 1):
            plan = _row_plan(np.repeat(of, 1 << size_bits)[:width])
        if plan is not None:
            _fill_row(rows[y], rows[y - 1], *plan)
            continue
        above = rows[y - 1].tolist()
        line = rows[y].tolist()
        line[0] = [(v + t) & 255 for v, t in zip(line[0], above[0], strict=True)]
        of = of.tolist()
        for x in range(1, width):
            right = above[x + 1] if x + 1 < width else line[0]
            p = predict(of[x >> size_bits], line[x - 1], above[x], above[x - 1], right)
            line[x] = [(v + q) & 255 for v, q in zip(line[x], p, strict=True)]
        rows[y] = line
    return rows.astype(np.uint8).reshape(-1).view("<u4")


def undo_cross_colour(argb: np.ndarray, width: int, height: int, size_bits: int, elements: np.ndarray) -> np.ndarray:
    px = _channels(argb.reshape(height, width)).copy()
    at = _channels(elements.reshape(-(-height >> size_bits), -(-width >> size_bits)))
    at = at.repeat(1 << size_bits, axis=0).repeat(1 << size_bits, axis=1)[:height, :width].view(np.int8).astype(np.int32)
    signed = lambda c: c.view(np.int8).astype(np.int32)
    green = signed(px[..., 1].copy())
    px[..., 2] += ((at[..., 0] * green) >> 5).astype(np.uint8)
    px[..., 0] += ((at[..., 1] * green) >> 5).astype(np.uint8)
    px[..., 0] += ((at[..., 2] * signed(px[..., 2].copy())) >> 5).astype(np.uint8)
    return px.reshape(-1).view("<u4")


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    px = _channels(argb).copy()
    px[:, 0] += px[:, 1]
    px[:, 2] += px[:, 1]
    return px.reshape(-1).view("<u4")


def undo_palette(argb: np.ndarray, width: int, height: int, width_bits: int, table: np.ndarray) -> np.ndarray:
    index = ((argb >> 8) & 255).reshape(height, -1)
    if width_bits:
        per, deep = 1 << width_bits, 8 >> width_bits
        index = ((index[:, :, None] >> (deep * np.arange(per))) & ((1 << deep) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)  # an index beyond the palette is transparent black
    full[: len(table)] = table
    return full[index].reshape(-1)


def decode_vp8l(data: bytes, most_pixels: int = MAX_SIDE * MAX_SIDE) -> tuple[int, int, np.ndarray]:
    """width, height and ARGB numbers of one VP8L chunk; an image of more than ``most_pixels`` is refused before it is read."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    if width * height > most_pixels:
        raise ValueError(f"{width} x {height} pixels are more than {most_pixels}")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            blocks = _read_image(bits, -(-now >> size_bits), -(-height >> size_bits), False)
            undo.append((undo_predictor if kind == PREDICTOR else undo_cross_colour, (now, height, size_bits, blocks)))
        elif kind == SUBTRACT_GREEN:
            undo.append((undo_subtract_green, ()))
        else:
            size = bits.read(8) + 1
            deltas = _channels(_read_image(bits, size, 1, False))
            table = np.cumsum(deltas, axis=0, dtype=np.uint8).reshape(-1).view("<u4")
            width_bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((undo_palette, (now, height, width_bits, table)))
            now = -(-now >> width_bits)
    argb = _read_image(bits, now, height, True)
    for f, args in reversed(undo):
        argb = f(argb, *args)
    return width, height, argb


def files(data: bytes) -> list[bytes]:
    """The WebP files that follow each other in ``data``."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        size = 8 + struct.unpack_from("<I", data, at + 4)[0]
        out.append(data[at : at + size])
        at += size
    return out


def decode(file: bytes, most_pixels: int = MAX_SIDE * MAX_SIDE) -> tuple[int, int, np.ndarray]:
    """width, height, samples (height x width x 4 bytes: blue, green, red, alpha) of a lossless WebP file."""
    at = 12
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"VP8L":
            width, height, argb = decode_vp8l(file[at + 8 : at + 8 + size], most_pixels)
            return width, height, _channels(argb.reshape(height, width))
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def riff(chunk: bytes) -> bytes:
    body = b"WEBP" + b"VP8L" + struct.pack("<I", len(chunk)) + chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


class Writer:
    """(value, number of bits) pairs, packed at the end; no value has more than 64 bits."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, *pairs: tuple[int, int]) -> None:
        self.many(np.array([v for v, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64))

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values.append(values)
        self.sizes.append(sizes)

    def bytes(self) -> bytes:
        value, size = np.concatenate(self.values), np.concatenate(self.sizes)
        end = np.cumsum(size)
        word, shift = (end - size) >> 6, (end - size) & 63
        out = np.zeros((int(end[-1]) >> 6) + 2, np.uint64)
        first = np.concatenate(([0], (word[1:] != word[:-1]).nonzero()[0] + 1))
        out[word[first]] = np.bitwise_or.reduceat(value << shift.astype(np.uint64), first)
        over = (shift + size > 64).nonzero()[0]  # one value at most reaches over the end of a word
        out[word[over] + 1] |= value[over] >> (64 - shift[over]).astype(np.uint64)
        return out.tobytes()[: (int(end[-1]) + 7) >> 3]


LONGEST = 12


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code for the symbols that occur, ``LONGEST`` at most, near the logarithm of their share."""
    out = np.zeros(len(counts), np.int64)
    used = counts.nonzero()[0]
    if len(used) < 2:
        return out
    c = np.maximum(counts[used], counts.sum() / (1 << (LONGEST - 1)))
    length = np.maximum(1, np.ceil(np.log2(c.sum() / c)).astype(np.int64))
    left = (1 << LONGEST) - int((1 << (LONGEST - length)).sum())
    by_count, lengths = np.argsort(-c, kind="stable").tolist(), length.tolist()
    while left:  # what is left is a sum of the smallest shares, so one of the longest codes can always be made shorter
        for i in by_count:
            share = 1 << (LONGEST - lengths[i])
            if share <= left and lengths[i] > 1:
                lengths[i] -= 1
                left -= share
    out[used] = lengths
    return out


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, first bit lowest."""
    used = lengths.nonzero()[0]
    out = np.zeros(len(lengths), np.uint64)
    if len(used):
        order = used[np.argsort(lengths[used], kind="stable")]
        share = 1 << (LONGEST - lengths[order])
        out[order] = _reversed(LONGEST)[np.cumsum(share) - share]
    return out


def _put_code(w: Writer, lengths: np.ndarray, counts: np.ndarray) -> None:
    used = counts.nonzero()[0]
    if len(used) < 2:
        w.put((1, 1), (0, 1), (1, 1), (int(used[0]) if len(used) else 0, 8))
        return
    last = max(2, int(used[-1]) + 1)
    occur = set(lengths[:last].tolist())
    deep = max(1, (len(occur) - 1).bit_length())
    # lengths are written in codes of one length; lengths that don't occur fill these up
    fill = [x for x in range(16) if x not in occur][: (1 << deep) - len(occur)]
    values = sorted([*occur, *fill])
    table = sum((deep if x in values else 0) << (3 * i) for i, x in enumerate(CODE_LENGTH_ORDER))
    wide = max(0, ((last - 2).bit_length() - 1) // 2)
    w.put((0, 1), (15, 4), (table, 57), (1, 1), (wide, 3), (last - 2, 2 + 2 * wide))
    w.many(_reversed(deep)[np.searchsorted(np.array(values), lengths[:last])].astype(np.uint64), np.full(last, deep))


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits, their number) of lengths or distance codes, from 1 on."""
    p = np.searchsorted(_LEAST, value, "right") - 1
    return p, (value - _LEAST[p]).astype(np.uint64), _EXTRA[p]


LONGEST_COPY, LEAST_COPY = 4096, 4


def repeated(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches of ``LEAST_COPY`` pixels or more that stand earlier in the image, in order.

    Earlier places come from one sort of hashes of ``LEAST_COPY`` pixels; a stretch is compared pixel by pixel."""
    n = len(argb) - LEAST_COPY + 1
    if n < 2:
        return []
    key = np.zeros(n, np.uint64)
    for j in range(LEAST_COPY):
        key = (key ^ argb[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    again = (key[order[1:]] == key[order[:-1]]).nonzero()[0]
    if not len(again):
        return []
    before = dict(zip(order[again + 1].tolist(), order[again].tolist(), strict=True))
    out, free = [], 0
    for at in sorted(before):
        if at < free:
            continue
        source = before[at]
        most = min(LONGEST_COPY, len(argb) - at)
        length = 0
        while length < most:  # in growing steps, as most stretches are short
            size = min(most, max(16, 4 * length)) - length
            differ = argb[at + length : at + length + size] != argb[source + length : source + length + size]
            stop = int(differ.argmax()) if differ.any() else size
            length += stop
            if stop < size:
                break
        if length >= LEAST_COPY:
            out.append((at, length, at - source))
            free = at + length
    return out


@cache
def _near_codes(width: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, (x, y) in enumerate(NEAR):
        out.setdefault(max(1, x + y * width), i + 1)
    return out


def _put_image(w: Writer, argb: np.ndarray, width: int, main: bool) -> None:
    """One entropy-coded image: copies of repeated stretches, then cache hits, then literals."""
    n = len(argb)
    copies = repeated(argb)
    literal = np.ones(n, bool)
    for at, length, _ in copies:
        literal[at : at + length] = False
    cache_bits, hit = 0, None
    wish = 6 if n < 4000 else 8 if n < 40_000 else 10
    if n >= 64:
        key = _hash(argb, wish)
        order = np.argsort(key, kind="stable")
        same = (key[order[1:]] == key[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
        hit = np.zeros(n, bool)
        hit[order[1:][same]] = True
        hit &= literal
        # a hit saves some 12 bits, a place of the cache costs 3 or so in the table of lengths
        if 12 * int(hit.sum()) > 4 * (1 << wish):
            cache_bits = wish
    px = _channels(argb)
    symbol = px[:, 1].astype(np.int64)
    if cache_bits:
        symbol[hit] = 256 + N_LENGTH_CODES + key[hit]
    plain = literal & ~hit if cache_bits else literal.copy()
    whole = plain.all()
    channels = [(px if whole else px[plain])[:, c] for c in (2, 0, 3)]
    extra = None
    if copies:
        at, length, distance = np.array(copies).T
        near = _near_codes(width)
        code = np.array([near.get(d, d + 120) for d in distance.tolist()])
        length_prefix, length_extra, length_bits = _prefix(length)
        far_prefix, far_extra, far_bits = _prefix(code)
        symbol[at] = 256 + length_prefix
        literal[at] = True
        extra = at
    shown = symbol if whole else symbol[literal]
    counts = np.bincount(shown, minlength=256 + N_LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0))
    # one code for the three other channels where each has more than one value
    each = [np.bincount(c, minlength=256) for c in channels]
    joint = sum(x for x in each if np.count_nonzero(x) > 1)
    other = [joint if np.count_nonzero(x) > 1 else x for x in each]
    far_counts = np.bincount(far_prefix, minlength=N_DISTANCE_CODES) if copies else np.zeros(N_DISTANCE_CODES, np.int64)
    green_lengths, far_lengths = code_lengths(counts), code_lengths(far_counts)
    joint_lengths = code_lengths(joint) if not np.isscalar(joint) else None
    other_lengths = [joint_lengths if x is joint else np.zeros(256, np.int64) for x in other]
    w.put((1, 1), (cache_bits, 4)) if cache_bits else w.put((0, 1))
    if main:
        w.put((0, 1))
    _put_code(w, green_lengths, counts)
    written = None
    for lengths, c in zip(other_lengths, other, strict=True):
        if c is joint and written is not None:
            w.values += w.values[written[0] : written[1]]
            w.sizes += w.sizes[written[0] : written[1]]
            continue
        start = len(w.values)
        _put_code(w, lengths, c)
        if c is joint:
            written = start, len(w.values)
    _put_code(w, far_lengths, far_counts)
    value, size = _codes(green_lengths)[symbol], green_lengths[symbol]
    joint_codes = _codes(joint_lengths) if joint_lengths is not None else None
    v, z = (value, size) if whole else (value[plain], size[plain])
    for lengths, c in zip(other_lengths, channels, strict=True):
        if lengths is joint_lengths:
            v = v | joint_codes[c] << z.astype(np.uint64)
            z = z + lengths[c]
    if whole:
        value, size = v, z
    else:
        value[plain], size[plain] = v, z
        if extra is not None:
            far_codes = _codes(far_lengths)
            v, z = value[extra], size[extra]
            for add, bits in ((length_extra, length_bits), (far_codes[far_prefix], far_lengths[far_prefix]), (far_extra, far_bits)):
                v, z = v | add << z.astype(np.uint64), z + bits
            value[extra], size[extra] = v, z
        value, size = value[literal], size[literal]
    w.many(value, size)


#: side of the blocks of transforms, as a power of two
BLOCK_BITS = 4


def _palette(argb: np.ndarray) -> np.ndarray | None:
    """The colours in order if there are few enough of them to be worth a palette."""
    if len(argb) < 16:
        return None
    if len(set(argb[:300].tolist())) > min(128, len(argb) // 3):
        return None
    colours = np.unique(argb)
    return colours if len(colours) <= min(256, len(argb) // 3) else None


def _predicted(px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(differences, modes of blocks): each block takes the mode, of four, with the smallest differences."""
    rows = px.astype(np.int32)
    height, width, _ = rows.shape
    rest = rows.copy()
    rest[0, 0] = rows[0, 0] - [0, 0, 0, 255]
    rest[0, 1:] = rows[0, 1:] - rows[0, :-1]
    modes = np.zeros((-(-height >> BLOCK_BITS), -(-width >> BLOCK_BITS)), np.int64)
    if height > 1:
        rest[1:, 0] = rows[1:, 0] - rows[:-1, 0]
        top, left, corner = rows[:-1, 1:], rows[1:, :-1], rows[:-1, :-1]
        tries = [(1, left), (2, top), (4, corner), (8, (corner + top) >> 1)]
        cost = np.full((len(tries), height, width), 0, np.int64)
        differ = [((rows[1:, 1:] - guess) & 255) for _, guess in tries]
        for i, d in enumerate(differ):
            cost[i, 1:, 1:] = np.minimum(d, 256 - d).sum(axis=2)
        side = 1 << BLOCK_BITS
        full = np.zeros((len(tries), modes.shape[0] * side, modes.shape[1] * side), np.int64)
        full[:, :height, :width] = cost
        best = full.reshape(len(tries), modes.shape[0], side, modes.shape[1], side).sum(axis=(2, 4)).argmin(axis=0)
        modes = np.array([m for m, _ in tries])[best]
        of = best.repeat(side, axis=0).repeat(side, axis=1)[1:height, 1:width]
        rest[1:, 1:] = np.choose(of[..., None], differ) if width > 1 else rest[1:, 1:]
    return (rest & 255).astype(np.uint8), modes


def _cross(px: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int]]:
    """(differences, (green to red, green to blue, red to blue)): the slopes of least squares, in 32nds."""
    b, g, r = (px[..., c].view(np.int8).astype(np.int32) for c in (0, 1, 2))
    slope = lambda x, y: int(np.clip(np.rint(32 * (x * y).sum() / max(1, (x * x).sum())), -128, 127))
    to_red, to_blue, red_to_blue = slope(g, r), slope(g, b), 0
    out = px.copy()
    out[..., 2] -= ((to_red * g) >> 5).astype(np.uint8)
    rest = b - ((to_blue * g) >> 5)
    red_to_blue = slope(r, rest)
    out[..., 0] -= ((to_blue * g) >> 5).astype(np.uint8)
    out[..., 0] -= ((red_to_blue * r) >> 5).astype(np.uint8)
    return out, (to_red, to_blue, red_to_blue)


def encode(samples: np.ndarray, transforms: tuple[int, ...] = ()) -> bytes:
    """A WebP file of samples (height x width x 4 bytes: blue, green, red, alpha).

    A palette is used where it pays, and then alone; else ``transforms`` (of ``PREDICTOR``, ``CROSS_COLOUR`` and ``SUBTRACT_GREEN``,
    each once) are applied in the order given."""
    height, width, _ = samples.shape
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("sides are 1 to 16384")
    w = Writer()
    w.put((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3))
    px = np.ascontiguousarray(samples, np.uint8)
    argb = px.reshape(-1).view("<u4")
    colours = _palette(argb)
    now = width
    if colours is not None:
        w.put((1, 1), (PALETTE, 2), (len(colours) - 1, 8))
        deltas = np.diff(_channels(colours.astype("<u4")), axis=0, prepend=np.zeros((1, 4), np.uint8))
        _put_image(w, np.ascontiguousarray(deltas.astype(np.uint8)).reshape(-1).view("<u4"), len(colours), False)
        index = np.searchsorted(colours, argb).reshape(height, width)
        width_bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        now = -(-width >> width_bits)
        if width_bits:
            per, deep = 1 << width_bits, 8 >> width_bits
            full = np.zeros((height, now * per), np.int64)
            full[:, :width] = index
            index = (full.reshape(height, now, per) << (deep * np.arange(per))).sum(axis=2)
        argb = (index.reshape(-1).astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
    else:
        across, down = -(-width >> BLOCK_BITS), -(-height >> BLOCK_BITS)
        for kind in transforms:
            w.put((1, 1), (kind, 2))
            if kind == SUBTRACT_GREEN:
                px = px.copy()
                px[..., 0] -= px[..., 1]
                px[..., 2] -= px[..., 1]
            elif kind == PREDICTOR:
                px, modes = _predicted(px)
                w.put((BLOCK_BITS - 2, 3))
                _put_image(w, (modes.reshape(-1).astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), across, False)
            else:
                px, (to_red, to_blue, red_to_blue) = _cross(px)
                w.put((BLOCK_BITS - 2, 3))
                element = 0xFF000000 | (red_to_blue & 255) << 16 | (to_blue & 255) << 8 | to_red & 255
                _put_image(w, np.full(across * down, element, np.uint32), across, False)
        argb = np.ascontiguousarray(px).reshape(-1).view("<u4")
    w.put((0, 1))
    _put_image(w, argb, now, True)
    return riff(w.bytes())
