"""A lossless WebP codec: RIFF container, VP8L stream.

``decode`` reads the whole format: prefix codes and prefix-code groups,
back-references, the colour cache, and the predictor, cross-colour,
subtract-green and palette transforms.  Streams with one prefix-code group are
decoded many pixels at a time: what a code would read is looked up for every
bit position at once, a walk over these finds where pixels begin, and pixels
copied from others or from the cache are found by following pointers, halving
the way each time.  Streams with several groups are read symbol by symbol.

``encode`` writes prefix codes by frequency and back-references, and takes a
palette, predictor, cross-colour, subtract-green and a colour cache where their
estimated size is smaller; so equal pixels give equal files.  Each can be asked
for instead.  Pixels are arrays of (n, 4) bytes in the order red, green, blue,
alpha.
"""

from __future__ import annotations

import math
from functools import cache, lru_cache

import numpy as np

MAX_SIDE = 16384
MIN_MATCH, MAX_MATCH = 8, 4096
N_LENGTH_CODES, N_DISTANCE_CODES = 24, 40
CACHE_MULTIPLIER = 0x1E35A7BD
# Fixed values of the format: the order in which code length code lengths are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: (columns left, rows up) of the 120 short distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
WALK_BYTES, CACHED, REFERENCE = 1 << 14, 64, 128
MAX_CACHE, CACHE_SHARE, MAX_TILE_BITS = 10, 3, 9
#: For estimates: bits of a used symbol's code length and of a transform; the share that a cache must gain; multipliers below which cross-colour is not tried.
FEW_PIXELS = 1024
LENGTH_BITS, TRANSFORM_BITS, LEAST_GAIN, LEAST_SLOPE = 4, 64, 16, 4


@cache
def _reversed_range(n: int) -> np.ndarray:
    """The numbers of n bits with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Used symbols in canonical order, how much of all codes each takes, and the longest length; a lone symbol takes no bits."""
    used = np.nonzero(lengths)[0]
    if len(used) <= 1:
        return used, np.ones(len(used), np.int64), 0
    own = lengths[used]
    longest = int(own.max())
    order = np.argsort(own.astype(np.int8), kind="stable")
    shares = np.left_shift(1, longest - own[order])
    if int(shares.sum()) != 1 << longest:
        raise ValueError("a prefix code is not complete")
    return used[order], shares, longest


def code_arrays(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, their first bit lowest, and code lengths by symbol."""
    codes, bits = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.uint64)
    symbols, shares, longest = _by_length(lengths)
    if longest:
        codes[symbols] = _reversed_range(longest)[np.cumsum(shares) - shares]
        bits[symbols] = lengths[symbols]
    return codes, bits


def canonical(lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    """symbol: (code with its first bit lowest, length) of a prefix code."""
    codes, bits = code_arrays(lengths)
    return {int(s): (int(codes[s]), int(bits[s])) for s in np.nonzero(lengths)[0]}


# ---------------------------------------------------------------- decoding


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def window(self, n: int) -> int:
        """The next n bits and some more as a number, the first lowest; zeros after the end."""
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + (n + 14 >> 3)], "little") >> (self.at & 7)

    def peek(self, n: int) -> int:
        return self.window(n) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends too early")

    def read(self, n: int) -> int:
        got = self.peek(n)
        self.skip(n)
        return got


class Code:
    """A prefix code for reading: symbol and length by the next bits, as many as the longest code has."""

    def __init__(self, lengths: np.ndarray):
        symbols, shares, self.longest = _by_length(lengths)
        if not len(symbols):
            symbols, shares = np.zeros(1, np.int64), np.ones(1, np.int64)
        order = _reversed_range(self.longest)
        self.symbols = np.repeat(symbols, shares).take(order)
        self.lengths = lengths.take(self.symbols) if self.longest else np.zeros(1, np.int64)
        self.steps = self.lengths.astype(np.uint8)

    def advance(self) -> np.ndarray:
        """For the walk over a green code: lengths, with a mark for what is no literal."""
        other = self.symbols >= 256
        return self.steps + CACHED * other.view(np.uint8) + (REFERENCE - CACHED) * (other & (self.symbols < 256 + N_LENGTH_CODES)).view(np.uint8)

    def read(self, bits: Bits) -> int:
        if not self.longest:
            return int(self.symbols[0])
        k = bits.peek(self.longest)
        bits.skip(int(self.lengths[k]))
        return int(self.symbols[k])


@lru_cache(maxsize=256)
def _header_table(lengths: bytes) -> tuple[list[tuple[int, int]], int]:
    """(symbol, code length) by the next bits of a header, and their mask."""
    code = Code(np.frombuffer(lengths, np.int64))
    return list(zip(code.symbols.tolist(), code.lengths.tolist())), (1 << code.longest) - 1


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        for s in [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else []):
            lengths[s] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    n = 4 + bits.read(4)
    stored = bits.window(3 * n)
    bits.skip(3 * n)
    for k in range(n):
        own[CODE_LENGTH_ORDER[k]] = stored >> 3 * k & 7
    limit = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, mask = _header_table(own.tobytes())
    ahead, at, k, last = bits.window(14 * min(limit, alphabet) + 16), 0, 0, 8
    out: list[int] = []
    while k < alphabet and limit:
        limit -= 1
        s, n = table[ahead >> at & mask]
        at += n
        if s < 16:
            out.append(s)
            last, k = s or last, k + 1
            continue
        base, extra = ((3, 2), (3, 3), (11, 7))[s - 16]
        n = base + (ahead >> at & ((1 << extra) - 1))
        at += extra
        k += n
        if k > alphabet:
            raise ValueError("too many code lengths")
        out += [last if s == 16 else 0] * n
    bits.skip(at)
    lengths[: len(out)] = out
    return Code(lengths)


def _read_alike(bits: Bits) -> list[Code]:
    """The codes of red, blue and alpha; one that is stored in the same bits as the one before it is the same code."""
    start = bits.at
    codes = [read_code(bits, 256)]
    size = bits.at - start
    own = Bits(bits.data, start).peek(size)
    for _ in (1, 2):
        if bits.at + size <= 8 * len(bits.data) and bits.peek(size) == own:
            bits.skip(size)
            codes.append(codes[-1])
            continue
        start = bits.at
        codes.append(read_code(bits, 256))
        size = bits.at - start
        own = Bits(bits.data, start).peek(size)
    return codes


def _value(code: int, bits: Bits) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _argb(px: np.ndarray) -> np.ndarray:
    return px[:, 3].astype(np.uint32) << 24 | px[:, 0].astype(np.uint32) << 16 | px[:, 1].astype(np.uint32) << 8 | px[:, 2]


def _cache_slot(px, bits: int) -> int:
    r, g, b, a = (int(x) for x in px)
    return ((CACHE_MULTIPLIER * (a << 24 | r << 16 | g << 8 | b)) & 0xFFFFFFFF) >> (32 - bits)


def _reference(bits: Bits, symbol: int, distances: Code, width: int, at: int, n: int) -> tuple[int, int]:
    """(length, distance) of a back-reference at pixel ``at``."""
    length = _value(symbol - 256, bits)
    distance = _value(distances.read(bits), bits)
    if distance > len(NEAR):
        distance -= len(NEAR)
    else:
        dx, dy = NEAR[distance - 1]
        distance = max(1, dx + dy * width)
    if distance > at or at + length > n:
        raise ValueError("a back-reference leaves the image")
    return length, distance


def _tokens(bits: Bits, codes: list[Code], n: int, width: int) -> tuple[list[np.ndarray], list[tuple[int, int, int]]]:
    """Literal pixels and cached colours in order (parts of rows green or cache symbol, red, blue, alpha), and (place, length, distance) of the references."""
    data = np.frombuffer(bits.data + b"\0" * 16, np.uint8)
    green, red, blue, alpha = codes[:4]
    parts, refs, done, advance = [], [], 0, green.advance()
    while done < n:
        base = bits.at & ~7
        first = base >> 3
        bytes_here = data[first : first + WALK_BYTES + 16].astype(np.intp)
        words = bytes_here[:-2] | bytes_here[1:-1] << 8 | bytes_here[2:] << 16
        ahead = (words[:, None] >> np.arange(8)).reshape(-1)
        end = len(ahead) - 64
        # Where the next token begins is looked up in two steps: past green, then past the other three.
        marks = advance.take(ahead & ((1 << green.longest) - 1))
        marks[end:] = 255  # the walk stops here as at a reference
        green_at = marks.tobytes()
        seen, beyond = {}, []
        for code in (red, blue, alpha):
            if id(code) not in seen:
                seen[id(code)] = code.steps.take(ahead & ((1 << code.longest) - 1)).tobytes()
            beyond.append(seen[id(code)])
        red_at, blue_at, alpha_at = beyond
        at, starts = bits.at - base, []
        push = starts.append
        while done < n and at < end:
            count = len(starts)
            for _ in range(n - done):
                step = green_at[at]
                if step < CACHED:
                    push(at)
                    at += step
                    at += red_at[at]
                    at += blue_at[at]
                    at += alpha_at[at]
                elif step < REFERENCE:
                    push(at)
                    at += step - CACHED
                else:
                    break
            done += len(starts) - count
            if at < end and done < n:
                bits.at = base + at
                length, distance = _reference(bits, green.read(bits), codes[4], width, done, n)
                refs.append((done, length, distance))
                done += length
                at = bits.at - base
        bits.at = base + at
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends too early")
        here = np.array(starts, dtype=np.int64)
        rows = np.empty((len(here), 4), np.intp)
        for k, code in enumerate((green, red, blue, alpha)):
            pick = ahead.take(here) & ((1 << code.longest) - 1)
            rows[:, k] = code.symbols.take(pick)
            here += code.lengths.take(pick)  # of a cached colour, the row's other values are never looked at
        parts.append(rows)
    return parts, refs


def _settle(source: np.ndarray, unsettled: np.ndarray) -> None:
    """Follow pointers from the unsettled places until none leads further."""
    while len(unsettled):
        further = source[source[unsettled]]
        moved = further != source[unsettled]
        source[unsettled] = further
        unsettled = unsettled[moved]


def _read_pixels(bits: Bits, codes: list[Code], n: int, width: int, cache_bits: int) -> np.ndarray:
    """The pixels of an image with one group of prefix codes."""
    parts, refs = _tokens(bits, codes, n, width)
    rows = np.concatenate(parts) if len(parts) > 1 else parts[0]
    if not refs and rows[:, 0].max() < 256:
        return rows[:, [1, 0, 2, 3]].astype(np.uint8)
    source, copied = np.arange(n + 1), np.zeros(n, bool)
    for at, length, distance in refs:
        source[at : at + length] -= distance
        copied[at : at + length] = True
    own = np.nonzero(~copied)[0]
    out = np.zeros((n + 1, 4), np.uint8)
    literal = rows[:, 0] < 256
    out[own[literal]] = rows[literal][:, [1, 0, 2, 3]]
    copies = np.nonzero(copied)[0]
    _settle(source, copies)
    hits = own[~literal]
    if len(hits):
        # A copy has the slot of the pixel it leads to; a cached colour is that of the last pixel before it in its slot.
        slots = np.zeros(n, np.int64)
        slots[own[literal]] = _cache_slots(_argb(out[own[literal]]), cache_bits)
        slots[hits] = rows[~literal, 0] - 256 - N_LENGTH_CODES
        slots[copies] = slots[source[copies]]
        source[hits] = _before(slots)[hits]
        source[n] = n
        _settle(source, np.concatenate([hits, copies]))
    return out[source[:n]]


def _cache_slots(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    return ((argb.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)


def _before(slots: np.ndarray) -> np.ndarray:
    """For each pixel the last one before it with the same slot; the number of pixels where there is none."""
    order = np.argsort(slots.astype(np.int16), kind="stable")
    out = np.full(len(slots), len(slots), np.int64)
    same = slots[order[1:]] == slots[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: (width * height, 4) bytes."""
    n = width * height
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache is too large")
    tiles, tile_bits, tiles_across, n_groups = None, 0, 0, 1
    if main and bits.read(1):
        tile_bits = bits.read(3) + 2
        tiles_across = -(-width >> tile_bits)
        entropy = read_image(bits, tiles_across, -(-height >> tile_bits), False)
        tiles = entropy[:, 0].astype(np.int64) << 8 | entropy[:, 1]
        n_groups = int(tiles.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    groups = [[read_code(bits, 256 + N_LENGTH_CODES + cache_size), *_read_alike(bits), read_code(bits, N_DISTANCE_CODES)] for _ in range(n_groups)]
    if n_groups == 1:
        return _read_pixels(bits, groups[0], n, width, cache_bits)
    out, at = np.zeros((n, 4), np.uint8), 0
    cache = np.zeros((cache_size, 4), np.uint8)
    while at < n:
        codes = groups[int(tiles[(at // width >> tile_bits) * tiles_across + (at % width >> tile_bits)])]
        s = codes[0].read(bits)
        if s < 256:
            out[at] = codes[1].read(bits), s, codes[2].read(bits), codes[3].read(bits)
            end = at + 1
        elif s < 256 + N_LENGTH_CODES:
            length, distance = _reference(bits, s, codes[4], width, at, n)
            end = at + length
            out[at:end] = np.resize(out[at - distance : min(at, at - distance + length)], (length, 4))
        else:
            out[at] = cache[s - 256 - N_LENGTH_CODES]
            end = at + 1
        if cache_size:
            for p in out[at:end]:
                cache[_cache_slot(p, cache_bits)] = p
        at = end
    return out


def _average(a, b):
    return (a + b) >> 1


def _select(left, top, top_left):
    return left if int(np.abs(top - top_left).sum()) < int(np.abs(left - top_left).sum()) else top


def _predict(mode: int, left, top, top_left, top_right):
    """Prediction for one pixel, or for a row of pixels if the mode does not use the left one."""
    if mode in (0, 14, 15):
        return np.broadcast_to(np.array([0, 0, 0, 255]), np.shape(top))
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left,
        5: lambda: _average(_average(left, top_right), top), 6: lambda: _average(left, top_left), 7: lambda: _average(left, top),
        8: lambda: _average(top_left, top), 9: lambda: _average(top, top_right), 10: lambda: _average(_average(left, top_left), _average(top, top_right)),
        11: lambda: _select(left, top, top_left),
        12: lambda: np.clip(left + top - top_left, 0, 255),
        13: lambda: np.clip(_average(left, top) + np.trunc((_average(left, top) - top_left) / 2).astype(np.int64), 0, 255),
    }[mode]()


def _predict_along(px: np.ndarray, axis: int, forward: bool) -> np.ndarray:
    """``predictor`` with the left pixel (axis 1) or the upper one (axis 0) everywhere; a first row goes by the left, a first column by the upper one."""
    black = np.array([0, 0, 0, 255], np.uint8)
    if forward:
        out = px.copy()
        if axis:
            out[:, 1:] -= px[:, :-1]
            out[1:, 0] -= px[:-1, 0]
        else:
            out[1:] -= px[:-1]
            out[0, 1:] -= px[0, :-1]
        out[0, 0] -= black
        return out
    out = px.copy()
    out[0, 0] += black
    edge = out[:, 0] if axis else out[0]
    edge[:] = np.cumsum(edge, axis=0, dtype=np.uint8)
    return np.cumsum(out, axis=axis, dtype=np.uint8)


UPPER_ONLY = (0, 2, 3, 4, 8, 9, 14, 15)


def predictor(px: np.ndarray, width: int, height: int, modes: np.ndarray, tile_bits: int, forward: bool) -> np.ndarray:
    """Residuals from pixels (forward) or pixels from residuals; modes by tile."""
    mode = int(modes[0])
    if mode in (1, 2) and (modes == mode).all():
        return _predict_along(px.reshape(height, width, 4), mode % 2, forward).reshape(-1, 4)
    given = px.astype(np.int64).reshape(height, width, 4)
    out = np.zeros_like(given)
    known = given if forward else out
    sign = -1 if forward else 1
    across = -(-width >> tile_bits)

    def put(y: int, x: int, prediction) -> None:
        out[y, x] = (given[y, x] + sign * prediction) & 255

    for y in range(height):
        if y == 0:
            if forward:
                out[0, 0] = (given[0, 0] - [0, 0, 0, 255]) & 255
                out[0, 1:] = (given[0, 1:] - given[0, :-1]) & 255
            else:
                out[0] = (np.cumsum(given[0], axis=0) + [0, 0, 0, 255]) & 255
            continue
        put(y, 0, known[y - 1, 0])
        for tile in range(across):
            mode = int(modes[(y >> tile_bits) * across + tile])
            start, end = max(1, tile << tile_bits), min(width, (tile + 1) << tile_bits)
            if start >= end:
                continue
            if mode in UPPER_ONLY or forward and mode != 11:
                right = np.concatenate([known[y - 1], known[y, :1]])
                prediction = _predict(mode, known[y, start - 1 : end - 1], known[y - 1, start:end], known[y - 1, start - 1 : end - 1], right[start + 1 : end + 1])
                out[y, start:end] = (given[y, start:end] + sign * prediction) & 255
            elif mode == 1:
                out[y, start:end] = (np.cumsum(given[y, start:end], axis=0) + out[y, start - 1]) & 255
            else:
                for x in range(start, end):
                    put(y, x, _predict(mode, known[y, x - 1], known[y - 1, x], known[y - 1, x - 1], known[y - 1, x + 1] if x + 1 < width else known[y, 0]))
    return out.reshape(-1, 4).astype(np.uint8)


def cross_colour(px: np.ndarray, width: int, height: int, elements: np.ndarray, tile_bits: int, forward: bool) -> np.ndarray:
    """elements: by tile, (red to blue, green to blue, green to red) as bytes in red, green, blue."""
    across = -(-width >> tile_bits)
    at = np.arange(width * height)
    own = elements[(at // width >> tile_bits) * across + (at % width >> tile_bits)].astype(np.int8).astype(np.int64)
    out = px.astype(np.int64)
    delta = lambda t, c: (t * c.astype(np.int8).astype(np.int64)) >> 5
    green = px[:, 1]
    sign = -1 if forward else 1
    red = (out[:, 0] + sign * delta(own[:, 2], green)) & 255
    blue = (out[:, 2] + sign * (delta(own[:, 1], green) + delta(own[:, 0], px[:, 0] if forward else red.astype(np.uint8)))) & 255
    out[:, 0], out[:, 2] = red, blue
    return out.astype(np.uint8)


def subtract_green(px: np.ndarray, forward: bool) -> np.ndarray:
    out = px.copy()
    for c in (0, 2):
        out[:, c] = px[:, c] - px[:, 1] if forward else px[:, c] + px[:, 1]
    return out


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, pixels) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25:
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown VP8L version")
    undo, coded_width = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile_bits = bits.read(3) + 2
            sub = read_image(bits, -(-coded_width >> tile_bits), -(-height >> tile_bits), False)
            undo.append((kind, coded_width, tile_bits, sub))
        elif kind == PALETTE:
            colours = bits.read(8) + 1
            table = np.cumsum(read_image(bits, colours, 1, False), axis=0, dtype=np.uint8)
            undo.append((kind, coded_width, bundle_bits(colours), table))
            coded_width = -(-coded_width >> bundle_bits(colours))
        else:
            undo.append((kind, coded_width, 0, None))
    px = read_image(bits, coded_width, height, True)
    for kind, own_width, n, sub in reversed(undo):
        if kind == PREDICTOR:
            px = predictor(px, own_width, height, sub[:, 1], n, False)
        elif kind == CROSS_COLOUR:
            px = cross_colour(px, own_width, height, sub, n, False)
        elif kind == SUBTRACT_GREEN:
            px = subtract_green(px, False)
        else:
            per = 1 << n
            indices = (px[:, 1, None] >> (np.arange(per) * (8 >> n)).astype(np.uint8) & np.uint8((1 << (8 >> n)) - 1)).reshape(height, -1)[:, :own_width].reshape(-1)
            full = np.zeros((256, 4), np.uint8)
            full[: len(sub)] = sub
            px = full[indices]
    return width, height, px


# ---------------------------------------------------------------- encoding


class Writer:
    """Numbers, each in so many bits, one after the other, the lowest bit first."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self.held: list[int] = []
        self.held_widths: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.held.append(value)
        self.held_widths.append(n)

    def put_rows(self, values: np.ndarray, widths: np.ndarray) -> None:
        self._flush()
        self.values.append(values)
        self.widths.append(widths)

    def _flush(self) -> None:
        if self.held:
            self.values.append(np.array(self.held, np.uint64))
            self.widths.append(np.array(self.held_widths, np.uint64))
            self.held, self.held_widths = [], []

    def bytes(self) -> bytes:
        """Every number has less than 64 bits, so in each word of 64 one begins, and at most one goes on in the next."""
        self._flush()
        values, widths = np.concatenate(self.values), np.concatenate(self.widths)
        ends = np.cumsum(widths)
        total = int(ends[-1])
        begins = ends - widths
        word, shift = (begins >> np.uint64(6)).astype(np.int64), begins & np.uint64(63)
        heads = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
        out = np.zeros(len(heads) + 1, np.uint64)
        out[:-1] = np.bitwise_or.reduceat(values << shift, heads)
        last = np.append(heads[1:], len(word)) - 1
        over = shift[last] + widths[last] > 64
        out[1:][over] |= values[last][over] >> (np.uint64(64) - shift[last][over])
        return out.astype("<u8").tobytes()[: -(-total // 8)]


def flat_lengths(used: np.ndarray, alphabet: int) -> np.ndarray:
    """Code lengths: all used symbols, and unused ones up to a power of two, alike; two neighbouring lengths where the alphabet is too small for that."""
    lengths = np.zeros(alphabet, np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    n = int(len(used) - 1).bit_length()
    lengths[used] = n
    if 1 << n > alphabet:
        lengths[used[: (1 << n) - len(used)]] = n - 1
        return lengths
    spare = np.nonzero(lengths == 0)[0][: (1 << n) - len(used)]
    lengths[spare] = n
    return lengths


def huffman_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Code lengths by frequency; counts are flattened until no code is longer than ``most`` bits."""
    used = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    while True:
        order = used[np.argsort(counts[used], kind="stable")]
        # Leaves in order and the sums made of them, which come in order too, are two queues.
        n = len(order)
        none = math.inf
        leaves, sums, parent = [*counts[order].tolist(), none], [none] * n, [0] * (2 * n - 1)
        leaf = inner = 0
        for made in range(n - 1):
            if leaves[leaf] <= sums[inner]:
                total = leaves[leaf]
                parent[leaf] = made + n
                leaf += 1
            else:
                total = sums[inner]
                parent[inner + n] = made + n
                inner += 1
            if leaves[leaf] <= sums[inner]:
                sums[made] = total + leaves[leaf]
                parent[leaf] = made + n
                leaf += 1
            else:
                sums[made] = total + sums[inner]
                parent[inner + n] = made + n
                inner += 1
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            lengths[order] = depth[:n]
            return lengths
        counts = np.where(counts, counts // 2 + 1, 0)


def write_code(w: Writer, lengths: np.ndarray, times: int = 1) -> None:
    """Write a code's lengths, so many times."""
    used = np.nonzero(lengths)[0]
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        for _ in range(times):
            w.put(1 | (len(used) == 2) << 1 | 1 << 2, 3)
            for s in used.tolist() or [0]:
                w.put(s, 8)
        return
    # Lengths one by one, runs of unused symbols by their number; each used symbol and those unused before it are one number.
    own, gaps = lengths[used], used.copy()
    gaps[1:] -= used[:-1] + 1
    (codes, bits), (gap_values, gap_widths, gap_tokens), (head, head_bits) = _header_code(), _gaps(), _header()
    longer = gaps // MAX_GAP if gaps.max() > MAX_GAP else None
    if longer is not None:
        gaps = gaps - longer * MAX_GAP
    values, widths = gap_values[gaps] | codes[own] << gap_widths[gaps], gap_widths[gaps] + bits[own]
    limit = len(own) + int(gap_tokens[gaps].sum())
    if longer is not None:
        limit += int(longer.sum() * gap_tokens[MAX_GAP])
        before = np.repeat(np.arange(len(own)), longer)
        values, widths = np.insert(values, before, gap_values[MAX_GAP]), np.insert(widths, before, gap_widths[MAX_GAP])
    nbits = max(2, -(-(limit - 2).bit_length() // 2) * 2)
    values = np.concatenate([np.array([head, 1 | (nbits - 2) // 2 << 1 | limit - 2 << 4], np.uint64), values])
    widths = np.concatenate([np.array([head_bits, 4 + nbits], np.uint64), widths])
    for _ in range(times):
        w.put_rows(values, widths)


#: Lengths of the codes in which code lengths are written, by symbol: those that pixel data has most are short.
HEADER_LENGTHS = (5, 5, 5, 5, 4, 3, 3, 3, 3, 4, 5, 5, 6, 6, 6, 6, 5, 4, 5)


@cache
def _header_code() -> tuple[np.ndarray, np.ndarray]:
    return code_arrays(np.array(HEADER_LENGTHS))


@cache
def _header() -> tuple[int, int]:
    """The code in which code lengths are written, as a number and its bits."""
    value, n = len(CODE_LENGTH_ORDER) - 4 << 1, 5
    for s in CODE_LENGTH_ORDER:
        value |= HEADER_LENGTHS[s] << n
        n += 3
    return value, n


#: Unused symbols that one number holds: four runs of the greatest length.
MAX_GAP = 4 * 138


@cache
def _gaps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By the number of unused symbols in a row: how they are written, in how many bits and code lengths."""
    codes, bits = (x.tolist() for x in _header_code())
    rows = []
    for gap in range(MAX_GAP + 1):
        value = n = tokens = 0
        while gap:
            run = min(gap, 138) if gap > 2 else 1
            kind, base, more = (0, run, 0) if gap <= 2 else (17, 3, 3) if run < 11 else (18, 11, 7)
            value |= (codes[kind] | run - base << bits[kind]) << n
            n, tokens, gap = n + bits[kind] + more, tokens + 1, gap - run
        rows.append((value, n, tokens))
    values, widths, tokens = zip(*rows)
    return np.array(values, np.uint64), np.array(widths, np.uint64), np.array(tokens)


def _prefix(value: int) -> tuple[int, int, int]:
    """(code, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    second = (value - 1) >> (high - 1) & 1
    return 2 * high + second, (value - 1) & ((1 << (high - 1)) - 1), high - 1


def matches(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, length, distance) of repeats of at least MIN_MATCH pixels, found greedily through hashes of that many."""
    n = len(argb) - MIN_MATCH + 1
    if n < 2:
        return []
    h = argb.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    span = 1
    while span < MIN_MATCH:
        h = h[:-span] * np.uint64(0xD6E8FEB86659FD93) + (h[span:] ^ (h[span:] >> np.uint64(31)))
        span *= 2
    order = np.argsort(h, kind="stable")
    same = np.nonzero(h[order[1:]] == h[order[:-1]])[0]
    if not len(same):
        return []
    before = dict(zip(order[same + 1].tolist(), order[same].tolist()))
    found, at = [], 0
    for i in sorted(before):
        if i < at:
            continue
        j = before[i]
        limit = min(MAX_MATCH, len(argb) - i)
        differ = np.nonzero(argb[i : i + limit] != argb[j : j + limit])[0]
        length = int(differ[0]) if len(differ) else limit
        if length >= MIN_MATCH:
            found.append((i, length, i - j))
            at = i + length
    return found


def _bits_of(counts: np.ndarray) -> np.ndarray:
    """About how many bits symbols with these counts, a row for each code, take; their code lengths among them."""
    sums, used = counts.sum(axis=-1), np.count_nonzero(counts, axis=-1)
    spread = _TIMES_LOGARITHMS.take(counts, mode="clip") if sums.max(initial=0) < len(_TIMES_LOGARITHMS) else counts * np.log2(np.maximum(counts, 1))
    return sums * np.log2(np.maximum(sums, 1)) - spread.sum(axis=-1) + LENGTH_BITS * np.where(used > 1, used, 0)


_TIMES_LOGARITHMS = np.arange(1 << 12) * np.log2(np.maximum(np.arange(1 << 12), 1))


def _literal_bits(counts: list[np.ndarray], n: int) -> float:
    """About how many bits a pixel takes of n that are given in full: ``_bits_of`` its four codes."""
    c = np.concatenate(counts)
    spread = _TIMES_LOGARITHMS.take(c).sum() if n < len(_TIMES_LOGARITHMS) else (c * np.log2(np.maximum(c, 1))).sum()
    used = sum(k for k in map(np.count_nonzero, counts) if k > 1)
    return len(counts) * math.log2(n) + (LENGTH_BITS * used - float(spread)) / n


_CHANNELS = np.array([256, 0, 512, 768])


def _histograms(px: np.ndarray) -> np.ndarray:
    """(4, 256): how often each value stands in green, red, blue and alpha."""
    return np.bincount((px + _CHANNELS).reshape(-1), minlength=1024).reshape(4, 256)


def _counts(px: np.ndarray, literal: np.ndarray, hits: np.ndarray, refs: list[tuple[int, int, int]], cache_size: int) -> list[np.ndarray]:
    """Symbol counts of the five codes. literal: pixels given in full; hits: slots of those that come from the cache."""
    counts = list(_histograms(px[literal]))
    counts[0] = np.concatenate([counts[0], np.zeros(N_LENGTH_CODES, np.int64), np.bincount(hits, minlength=cache_size)[:cache_size].astype(np.int64)])
    counts.append(np.zeros(N_DISTANCE_CODES, np.int64))
    for _, length, distance in refs:
        counts[0][256 + _prefix(length)[0]] += 1
        counts[4][_prefix(distance + len(NEAR))[0]] += 1
    return counts


def write_image(w: Writer, px: np.ndarray, main: bool, cache_bits: int | None = 0, by_frequency: bool = True, references: bool = True) -> None:
    """cache_bits: None lets a colour cache be chosen where it is smaller."""
    argb, n = _argb(px), len(px)
    refs = matches(argb) if references and main else []
    place = single = np.arange(n)
    if refs:
        begins = np.ones(n, bool)  # where a token begins
        for at, length, _ in refs:
            begins[at + 1 : at + length] = False
        place = np.flatnonzero(begins)
        begins[[at for at, _, _ in refs]] = False
        single = np.flatnonzero(begins)

    def from_cache(bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Which single pixels the cache holds when they come, and all pixels' slots."""
        slots = _cache_slots(argb, bits)
        before = _before(slots)
        before = before.take(single)
        return (argb.take(before, mode="clip") == argb.take(single)) & (before < n), slots

    literal, hits, counts, held = single, single[:0], None, None
    if cache_bits is None:
        cache_bits, counts = min(MAX_CACHE, max(2, n.bit_length() - CACHE_SHARE)), _counts(px, single, single[:0], refs, 0)
        held, slots = from_cache(cache_bits)
        each = _literal_bits([counts[0][:256], *counts[1:4]], max(1, len(single)))
        # A cached colour takes about as many bits as the cache's size has, and its slot a code length; less than a sixteenth gained is not worth the time.
        gain = held.sum() * (each - cache_bits - 1) - LENGTH_BITS * np.count_nonzero(np.bincount(slots[single[held]]))
        if gain * LEAST_GAIN <= each * len(single):
            cache_bits, held = 0, None
    elif cache_bits:
        held, slots = from_cache(cache_bits)
    if held is not None:
        literal, hits = single[~held], single[held]
    if counts is None or held is not None:
        counts = _counts(px, literal, slots[hits] if len(hits) else hits, refs, 1 << cache_bits if cache_bits else 0)
    # Samples of one kind of data are alike in red, blue and alpha, so one code serves them where each has several values.
    alike = main and all(np.count_nonzero(c) > 1 for c in counts[1:4])
    own = [counts[0], counts[1] + counts[2] + counts[3], counts[4]] if alike else counts
    lengths = [huffman_lengths(c) if by_frequency else flat_lengths(np.nonzero(c)[0], len(c)) for c in own]
    codes = [code_arrays(one) for one in lengths]
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    for one, times in zip(lengths, (1, 3, 1) if alike else (1,) * 5):
        write_code(w, one, times)
    codes = [codes[0], *codes[1:2] * 3, codes[2]] if alike else codes
    whole = px.T.take(literal, axis=1).astype(np.intp)
    v, k = codes[0][0].take(whole[1]), codes[0][1].take(whole[1])
    for (code, bits), channel in zip(codes[1:], (0, 2, 3)):
        v |= code.take(whole[channel]) << k
        k += bits.take(whole[channel])
    if len(literal) == n:
        w.put_rows(v, k)
        return
    value, wide = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    value[literal], wide[literal] = v, k
    if len(hits):
        symbols = 256 + N_LENGTH_CODES + _cache_slots(argb[hits], cache_bits)
        value[hits], wide[hits] = codes[0][0][symbols], codes[0][1][symbols]
    for at, length, distance in refs:
        v = k = 0
        for (code, bits), base, number in ((codes[0], 256, length), (codes[4], 0, distance + len(NEAR))):
            symbol, extra, more = _prefix(number)
            v |= int(code[base + symbol]) << k
            k += int(bits[base + symbol])
            v |= extra << k
            k += more
        value[at], wide[at] = v, k
    w.put_rows(value[place], wide[place])


Plan = tuple[tuple[int, ...], int, tuple[int, int, int]]


def choose_transforms(images: list[np.ndarray], width: int) -> list[Plan]:
    """For each image, all of one width: (transforms, predictor mode, cross-colour multipliers) with which its pixels are estimated to be smallest."""
    sizes = np.array([len(x) for x in images])
    px, owner = np.concatenate(images), np.repeat(np.arange(len(images)), sizes)
    rows, tops = px.reshape(-1, width, 4), (np.cumsum(sizes) - sizes) // width
    left, upper = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    left[1:, 0] -= rows[:-1, 0]
    left[tops, 0] = rows[tops, 0] - np.array([0, 0, 0, 255], np.uint8)
    upper[1:] -= rows[:-1]
    upper[tops] = left[tops]
    places = (owner * 1024)[:, None] + _CHANNELS

    def estimate(samples: np.ndarray, at: np.ndarray = places) -> np.ndarray:
        counts = np.bincount((samples.reshape(-1, 4) + at).reshape(-1), minlength=1024 * len(images))
        return _bits_of(counts.reshape(-1, 4, 256)).sum(axis=-1)

    bits = np.stack([estimate(px), estimate(left) + TRANSFORM_BITS, estimate(upper) + TRANSFORM_BITS])
    mode = bits.argmin(axis=0)
    plain = px if not mode.any() else np.choose(mode[owner][:, None], [px, left.reshape(-1, 4), upper.reshape(-1, 4)])
    red, green, blue = (plain[:, c].astype(np.int8).astype(np.float64) for c in range(3))
    add = lambda x: np.bincount(owner, weights=x, minlength=len(images))
    total = add(green)
    spread = sizes * add(green * green) - total * total
    slopes = [np.clip(np.rint(32 * (sizes * add(green * c) - total * add(c)) / np.maximum(spread, 1)), -128, 127).astype(np.int64) for c in (blue, red)]
    steep = np.maximum(*np.abs(slopes)) >= LEAST_SLOPE
    tie = np.full(len(images), np.inf)
    if steep.any():
        tried = np.flatnonzero(steep[owner])
        tied, their, greens = plain[tried], owner[tried], green[tried].astype(np.int64)
        for k, channel in zip(slopes, (2, 0)):
            tied[:, channel] -= ((k[their] * greens) >> 5).astype(np.uint8)
        tie[steep] = estimate(tied, places[tried])[steep] + TRANSFORM_BITS
    colour = np.stack([bits.min(axis=0), estimate(subtract_green(plain, True)), tie]).argmin(axis=0)
    return [
        ((PREDICTOR,) * (m > 0) + ((), (SUBTRACT_GREEN,), (CROSS_COLOUR,))[c], max(1, m), (0, to_blue & 255, to_red & 255))
        for m, c, to_blue, to_red in zip(mode.tolist(), colour.tolist(), *(x.tolist() for x in slopes))
    ]


def encode(px: np.ndarray, width: int, height: int, transforms: tuple[int, ...] | None = None, tile_bits: int = 2, modes=None, elements=None, cache_bits: int | None = None, by_frequency: bool = True, plan: Plan | None = None) -> bytes:
    """A lossless WebP file. transforms, cache_bits: None lets them be chosen by their estimated size; plan: what ``choose_transforms`` gave."""
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    colours = None
    if transforms is None or PALETTE in transforms:
        argb = _argb(px)
        early = np.sort(argb[:FEW_PIXELS])
        n = 1 + np.count_nonzero(early[1:] != early[:-1])  # more colours than a palette holds show early as a rule
        if n <= 256:
            colours = np.unique(argb)
            n = len(colours)
        chosen = n <= 256 and (transforms is not None or 40 * n + len(px) * (8 >> bundle_bits(n)) < 26 * len(px))
        if transforms is not None and not chosen:
            raise ValueError("too many colours for a palette")
        if transforms is None and chosen:
            transforms = (PALETTE,)
        elif transforms is None:
            tile_bits = MAX_TILE_BITS
            transforms, mode, elements = plan or choose_transforms([px], width)[0]
            modes = [mode]
    across, down = -(-width >> tile_bits), -(-height >> tile_bits)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            w.put(tile_bits - 2, 3)
            sub = np.zeros((across * down, 4), np.uint8)
            sub[:, 3] = 255
            if kind == PREDICTOR:
                sub[:, 1] = np.resize(modes, across * down)
                px = predictor(px, width, height, sub[:, 1], tile_bits, True)
            else:
                sub[:, :3] = np.resize(np.asarray(elements, np.uint8), (across * down, 3))
                px = cross_colour(px, width, height, sub, tile_bits, True)
            write_image(w, sub, False)
        elif kind == SUBTRACT_GREEN:
            px = subtract_green(px, True)
        else:
            w.put(len(colours) - 1, 8)
            table = np.stack([colours >> 16, colours >> 8, colours, colours >> 24], axis=1).astype(np.uint8)
            write_image(w, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8), False)
            n = bundle_bits(len(colours))
            per, step = 1 << n, 8 >> n
            across_bundled = -(-width >> n)
            grid = np.zeros((height, across_bundled * per), np.uint8)
            grid[:, :width] = np.searchsorted(colours, argb).reshape(height, width)
            px = np.zeros((height * across_bundled, 4), np.uint8)
            px[:, 1] = (grid.reshape(-1, per) << (np.arange(per) * step).astype(np.uint8)).astype(np.uint8).sum(axis=1, dtype=np.uint8)
            px[:, 3] = 255
    w.put(0, 1)
    write_image(w, px, True, cache_bits, by_frequency)
    data = w.bytes()
    padded = data + b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + padded
