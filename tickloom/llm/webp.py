"""Lossless WebP: a decoder for the whole bitstream, an encoder, and media columns made of texts.

The decoder reads prefix codes (simple and coded, several groups by an entropy image), back-references
with their plane codes, and the colour cache, inverts the predictor, cross-colour, subtract-green and
palette transforms, and gives pixel arrays. An image in which green alone varies, as grey pictures are
once their colours are taken away, is read by arrays: what a token would be is looked up at every bit,
then the chain of the tokens that there are is followed, and copies are made run by run.

Texts are stored as grey pictures with back-references: few-valued ones with a palette, small ones with
the cross-colour transform and a colour cache, all others with subtract-green and a predictor.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import cache, cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import id_text, map_rows

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed values of the format: order of the code length codes; plane codes of near distances as (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PLANE = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
OPAQUE = 0xFF000000


class WebpError(ValueError):
    """The bytes are not a lossless WebP image."""


# ---- bits and prefix codes ------------------------------------------------------------------------


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise WebpError("the image data ends too early")
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def peek15(self) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 3], "little") >> (self.at & 7)) & 0x7FFF


@cache
def _mirror(n: int) -> np.ndarray:
    """All numbers of n bits with their bits in reverse order."""
    out = np.zeros(1, np.int32)
    for _ in range(n):
        out = np.concatenate((out << 1, out << 1 | 1))
    return out


def _in_order(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that a canonical code has, in the order of their codes (shorter first, then by symbol), and their lengths."""
    every = np.array(lengths)
    used = np.flatnonzero(every)
    used = used[np.argsort(every[used], kind="stable")]
    return used, every[used]


def _written_codes(lengths: list[int]) -> list[int]:
    """The code of each symbol as it is written, first bit lowest; zero for symbols without one."""
    symbols, sizes = _in_order(lengths)
    width = 1 << (15 - sizes)
    out = np.zeros(len(lengths), np.int32)
    out[symbols] = _mirror(15)[(np.cumsum(width) - width) & 0x7FFF]
    return out.tolist()


class _Code:
    """A prefix code for reading."""

    def __init__(self, lengths: list[int]):
        self.symbols, self.sizes = _in_order(lengths)
        self.only = (int(self.symbols[0]) if len(self.symbols) else 0) if len(self.symbols) < 2 else None
        if self.only is None and int((1 << (15 - self.sizes)).sum()) != 1 << 15:
            raise WebpError("a prefix code is not complete")

    @cached_property
    def array(self) -> np.ndarray:
        """16 times the symbol plus the length, by the next bits, as many as the longest code has."""
        if self.only is not None:
            return np.array([self.only << 4], np.int16)
        straight = np.repeat((self.symbols << 4 | self.sizes).astype(np.int16), 1 << (self.longest - self.sizes))
        return straight[_mirror(self.longest)]

    @cached_property
    def table(self) -> list[int]:
        return self.array.tolist()

    @property
    def mask(self) -> int:
        return 0 if self.only is not None else (1 << self.longest) - 1

    @cached_property
    def longest(self) -> int:
        return int(self.sizes[-1])

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        seen = self.table[bits.peek15() & self.mask]
        bits.at += seen & 15
        if bits.at > bits.end:
            raise WebpError("the image data ends too early")
        return seen >> 4


@cache
def _short_code(symbols: tuple[int, ...]) -> _Code:
    """The code of one symbol, or of two of a bit each."""
    lengths = [0] * 256
    for s in symbols:
        lengths[s] = 1
    return _Code(lengths)


@lru_cache(64)
def _coded(lengths: tuple[int, ...]) -> _Code:
    """Codes that many files share are made once."""
    return _Code(list(lengths))


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        symbols = (first, bits.read(8)) if two else (first,)
        if max(symbols) >= alphabet:
            raise WebpError("a prefix code has a symbol outside its alphabet")
        return _short_code(symbols)
    lengths = [0] * alphabet
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    code = _Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before, data, place = 0, 8, bits.data, bits.at
    table, mask = code.table, code.mask
    while at < alphabet and left:
        left -= 1
        word = int.from_bytes(data[place >> 3 : (place >> 3) + 4], "little") >> (place & 7)
        seen = table[word & mask]
        symbol, n = seen >> 4, seen & 15
        place += n
        if symbol < 16:
            lengths[at] = symbol
            before = symbol or before
            at += 1
            continue
        value, extra, least = ((before, 2, 3), (0, 3, 3), (0, 7, 11))[symbol - 16]
        many = least + ((word >> n) & ((1 << extra) - 1))
        place += extra
        if at + many > alphabet:
            raise WebpError("code lengths run over")
        if value:
            lengths[at : at + many] = [value] * many
        at += many
    if place > bits.end:
        raise WebpError("the image data ends too early")
    bits.at = place
    return _coded(tuple(lengths)) if alphabet == 40 else _Code(lengths)


# ---- decoding -------------------------------------------------------------------------------------


def _value(bits: _Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _cells(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def _image(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels (uint32 ARGB), transforms not inverted."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("the colour cache is too large")
    groups_of, group_bits, n_groups = None, 0, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        groups_of = (_image(bits, _cells(width, group_bits), _cells(height, group_bits), False) >> 8) & 0xFFFF
        n_groups = int(groups_of.max()) + 1
    size = 1 << cache_bits if cache_bits else 0
    groups = [[_read_code(bits, n) for n in (280 + size, 256, 256, 256, 40)] for _ in range(n_groups)]
    first = groups[0]
    if main and n_groups == 1 and not cache_bits and all(c.only is not None for c in first[1:4]) and width * height >= PLANE_PIXELS:
        constant = first[3].only << 24 | first[1].only << 16 | first[2].only
        return (np.uint32(constant) | _green_plane(bits, first[0], first[4], width, height).astype(np.uint32) << np.uint32(8)).reshape(height, width)
    return _pixels(bits, groups, groups_of, group_bits, cache_bits, width, height)


#: Pixels from which an image in which green alone varies is read by arrays.
PLANE_PIXELS = 256
#: Bits at which tokens are looked up at once.
WINDOW = 1 << 18


@cache
def _near_codes(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distance that each plane code stands for, by code; and the smallest code of each near distance, zero where there is none."""
    far = np.array([1, *(max(1, x + y * width) for x, y in PLANE)], np.int64)
    code = np.zeros(int(far.max()) + 1, np.int64)
    for k in range(120, 0, -1):
        code[far[k]] = k
    return far, code


def _lengths_of(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least value of each prefix and the number of its extra bits."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + 1), extra


def _green_plane(bits: _Bits, green: _Code, far: _Code, width: int, height: int) -> np.ndarray:
    """The green samples of an image whose other channels are constant."""
    n = width * height
    if green.only is not None:
        if green.only >= 256:
            raise WebpError("a reference points outside the image")
        return np.full(n, green.only, np.uint8)
    raw = np.frombuffer(bits.data + bytes(8), np.uint8)
    first, last = bits.at, bits.end
    at, out_at, tokens = first, 0, []
    while out_at < n:
        if at >= last:
            raise WebpError("the image data ends too early")
        begin, end = at >> 3, min((at + WINDOW) >> 3, (last + 7) >> 3)
        own = raw[begin : end + 8].astype(np.uint32)
        words = own[:-3] | own[1:-2] << np.uint32(8) | own[2:-1] << np.uint32(16) | own[3:] << np.uint32(24)
        read = lambda p: words[p >> 3] >> (p & 7).astype(np.uint32)  # noqa: E731, B023
        size = (end - begin) * 8
        seen = green.array[((words[: end - begin, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(green.mask)).reshape(-1)]
        follows = np.arange(size + 1, dtype=np.int32)
        follows[:size] += seen & 15
        copies = np.flatnonzero((seen >> 4) >= 256)
        own_seen = seen[copies].astype(np.int64)
        least, extra = _lengths_of((own_seen >> 4) - 256)
        p = copies + (own_seen & 15)
        inside = p + extra < size + 32  # tokens that reach over the end of what was read are read again
        copies, least, extra, p = copies[inside], least[inside], extra[inside], p[inside]
        length = least + (read(p) & ((1 << extra) - 1).astype(np.uint32))
        p = p + extra
        far_seen = far.array.astype(np.int64)[read(np.minimum(p, size + 31)) & np.uint32(far.mask)]
        far_least, far_extra = _lengths_of(far_seen >> 4)
        p = p + (far_seen & 15)
        low = read(np.minimum(p, size + 31)).astype(np.int64) & 0xFFFF
        high = read(np.minimum(p + 16, size + 31)).astype(np.int64) & 0xFFFF
        distance = far_least + ((low | high << 16) & ((1 << far_extra) - 1))
        follows[copies] = p + far_extra
        stop = size if end * 8 >= last else size - 64
        ahead = np.minimum(follows, size)
        for _ in range(3):  # eight tokens on
            ahead = ahead[ahead]
        steps, where, k = memoryview(ahead), [], at - begin * 8
        while k < stop:
            where.append(k)
            k = steps[k]
        chain = [np.array(where, np.int32)]
        for _ in range(7):
            chain.append(follows[np.minimum(chain[-1], size)])
        where = np.stack(chain, axis=1).reshape(-1)
        done = int(np.argmax(where >= stop)) if (where >= stop).any() else len(where)
        k = int(where[done]) if done < len(where) else k
        where = where[:done]
        symbol = seen[where] >> 4
        count = np.ones(len(where), np.int64)
        is_copy = symbol >= 256
        place = np.searchsorted(copies, where[is_copy])
        count[is_copy] = length[place]
        tokens.append((symbol, count, is_copy, distance[place], begin * 8 + follows[where].astype(np.int64)))
        out_at += int(count.sum())
        at = begin * 8 + k
    symbol, count, is_copy, distance, after = map(np.concatenate, zip(*tokens))
    ends = np.cumsum(count)
    kept = int(np.searchsorted(ends, n)) + 1
    if after[kept - 1] > last:
        raise WebpError("the image data ends too early")
    if ends[kept - 1] != n:
        raise WebpError("a reference points outside the image")
    symbol, count, is_copy, starts = symbol[:kept], count[:kept], is_copy[:kept], (ends - count)[:kept]
    distance = distance[: int(is_copy.sum())]
    near, _ = _near_codes(width)
    distance = np.where(distance > 120, distance - 120, near[np.minimum(distance, 120)])
    if (distance > starts[is_copy]).any():
        raise WebpError("a reference points outside the image")
    plane = np.zeros(n, np.uint8)
    plane[starts[~is_copy]] = symbol[~is_copy]
    out = memoryview(plane)
    for a, many, back in zip(starts[is_copy].tolist(), count[is_copy].tolist(), distance.tolist()):
        if back >= many:
            out[a : a + many] = out[a - back : a - back + many]
        else:
            out[a : a + many] = (bytes(out[a - back : a]) * (many // back + 1))[:many]
    return plane


def _pixels(bits: _Bits, groups: list, groups_of: np.ndarray | None, group_bits: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    n, out, at = width * height, [0] * (width * height), 0
    cache, shift, kept = [0] * (1 << cache_bits), 32 - cache_bits, 0
    while at < n:
        codes = groups[0] if groups_of is None else groups[groups_of[(at // width) >> group_bits, (at % width) >> group_bits]]
        green = codes[0].read(bits)
        if green < 256:
            red, blue, alpha = (codes[k].read(bits) for k in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | green << 8 | blue
            at += 1
        elif green < 280:
            length = _value(bits, green - 256)
            far = _value(bits, codes[4].read(bits))
            if far > 120:
                far -= 120
            else:
                x, y = PLANE[far - 1]
                far = max(1, x + y * width)
            if far > at or at + length > n:
                raise WebpError("a reference points outside the image")
            for _ in range(length):
                out[at] = out[at - far]
                at += 1
        else:
            while kept < at:
                cache[(out[kept] * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = out[kept]
                kept += 1
            out[at] = cache[green - 280]
            at += 1
    return np.array(out, np.uint32).reshape(height, width)


def _bytes4(argb: np.ndarray) -> np.ndarray:
    """ARGB words as an array of (blue, green, red, alpha) bytes."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _words(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts, np.uint8).view("<u4")[..., 0]


def _predicted(mode: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Predictions of pixels (rows of four bytes, as int16) by their modes; right: above and to the right, corner: above and to the left."""
    average = lambda a, b: (a + b) >> 1
    full = np.clip(left + top - corner, 0, 255)
    middle = average(left, top)
    off = middle - corner
    half = np.clip(middle + np.where(off < 0, -((-off) >> 1), off >> 1), 0, 255)
    nearer_left = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
    black = np.broadcast_to(np.array([0, 0, 0, 255], np.int16), left.shape)
    all_modes = [black, left, top, right, corner, average(average(left, right), top), average(left, corner), middle, average(corner, top), average(top, right), average(average(left, corner), average(top, right)), np.where(nearer_left, left, top), full, half, black, black]
    return np.choose(np.broadcast_to(mode[..., None], left.shape), all_modes)


def _modes(data: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    spread = ((data >> 8) & 0xF).astype(np.intp)
    return np.repeat(np.repeat(spread, 1 << bits, 0), 1 << bits, 1)[:height, :width]


#: Modes that need the pixel to the left.
LEFTWARD = (1, 5, 6, 7, 10, 11, 12, 13)


def _unpredict(argb: np.ndarray, data: np.ndarray, bits: int) -> np.ndarray:
    """Row by row: stretches of one mode at once, or pixel by pixel where a mode other than `left` needs what is left of it; all rows at once where all pixels are predicted black."""
    height, width = argb.shape
    modes = ((data >> 8) & 0xF).astype(np.intp)
    parts = _bytes4(argb).copy()
    parts[0, :1, 3] += np.uint8(255)
    parts[0] = np.cumsum(parts[0], axis=0, dtype=np.uint8)
    parts[:, 0] = np.cumsum(parts[:, 0], axis=0, dtype=np.uint8)
    if np.isin(modes, (0, 14, 15)).all():
        parts[1:, 1:, 3] += np.uint8(255)
        return _words(parts)
    out = parts.astype(np.int16)
    for y in range(1, height):
        above, own = out[y - 1], out[y]
        right = np.concatenate((above[1:], own[:1]))
        for cell, mode in enumerate(modes[y >> bits].tolist()):
            a, b = max(1, cell << bits), min(width, (cell + 1) << bits)
            if a >= b:
                continue
            if mode == 1:
                own[a - 1 : b] = np.cumsum(own[a - 1 : b], axis=0) & 255
                continue
            if mode in (0, 14, 15):
                own[a:b, 3] = (own[a:b, 3] + 255) & 255
                continue
            if mode == 2:
                own[a:b] = (own[a:b] + above[a:b]) & 255
                continue
            wide = np.full((1, 1), mode)
            if mode not in LEFTWARD:
                own[a:b] = (own[a:b] + _predicted(np.full(b - a, mode), above[a:b], above[a:b], right[a:b], above[a - 1 : b - 1])) & 255
                continue
            for x in range(a, b):
                own[x] = (own[x] + _predicted(wide[0], own[x - 1 : x], above[x : x + 1], right[x : x + 1], above[x - 1 : x])[0]) & 255
    return _words(out)


def _predict(argb: np.ndarray, data: np.ndarray, bits: int) -> np.ndarray:
    """What the predictor leaves: the encoder's side, all pixels at once."""
    height, width = argb.shape
    mode, own = _modes(data, bits, width, height), _bytes4(argb).astype(np.int16)
    flat = np.concatenate((own.reshape(-1, 4), np.zeros((1, 4), np.int16)))
    at = np.arange(width * height)
    take = lambda shift: flat[np.clip(at - shift, 0, None)].reshape(height, width, 4)
    guess = _predicted(mode, take(1), take(width), take(width - 1), take(width + 1))
    guess[0, 1:] = own[0, :-1]
    guess[1:, 0] = own[:-1, 0]
    guess[0, 0] = (0, 0, 0, 255)
    return _words((own - guess) & 255)


def _cross(argb: np.ndarray, data: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    height, width = argb.shape
    factor = np.repeat(np.repeat(_bytes4(data).view(np.int8).astype(np.int32), 1 << bits, 0), 1 << bits, 1)[:height, :width]
    parts = _bytes4(argb).copy()
    signed = lambda x: x.astype(np.int8).astype(np.int32)
    green = signed(parts[..., 1])
    red = parts[..., 2].astype(np.int32)
    to_red = (factor[..., 0] * green) >> 5
    new_red = (red - to_red if forward else red + to_red) & 255
    to_blue = ((factor[..., 1] * green) >> 5) + ((factor[..., 2] * signed((red if forward else new_red).astype(np.uint8))) >> 5)
    blue = parts[..., 0].astype(np.int32)
    parts[..., 2] = new_red
    parts[..., 0] = (blue - to_blue if forward else blue + to_blue) & 255
    return _words(parts)


def _green(argb: np.ndarray, sign: int) -> np.ndarray:
    parts = _bytes4(argb).copy()
    for k in (0, 2):
        parts[..., k] += np.uint8(1) * parts[..., 1] if sign > 0 else np.uint8(255) * parts[..., 1]
    return _words(parts)


def _palette_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpalette(argb: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    bits = _palette_bits(len(colours))
    index = ((argb >> 8) & 0xFF).astype(np.int64)
    if bits:
        each = 8 >> bits
        index = ((index[..., None] >> (np.arange(1 << bits) * each)) & ((1 << each) - 1)).reshape(len(argb), -1)[:, :width]
    return np.concatenate((colours, np.zeros(256, np.uint32)))[index]


def decode_stream(data: bytes) -> np.ndarray:
    """ARGB pixels (height x width, uint32) of a VP8L chunk's content."""
    bits = _Bits(data)
    if bits.read(8) != 0x2F:
        raise WebpError("the signature is missing")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebpError("the version is unknown")
    transforms, own_width = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in {t[0] for t in transforms}:
            raise WebpError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            transforms.append((kind, _image(bits, _cells(own_width, size), _cells(height, size), False), size, own_width))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = _bytes4(_image(bits, n, 1, False))[0]
            colours = _words(np.cumsum(steps, axis=0, dtype=np.uint8))
            transforms.append((kind, colours, 0, own_width))
            own_width = _cells(own_width, _palette_bits(n))
        else:
            transforms.append((kind, None, 0, own_width))
    argb = _image(bits, own_width, height, True)
    for kind, data_, size, before in reversed(transforms):
        argb = _unpredict(argb, data_, size) if kind == PREDICTOR else _cross(argb, data_, size, False) if kind == CROSS_COLOUR else _green(argb, 1) if kind == SUBTRACT_GREEN else _unpalette(argb, data_, before)
    return argb


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels of a WebP file with a VP8L chunk; other chunks are passed over."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebpError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return decode_stream(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise WebpError("no lossless image in the file")


# ---- encoding -------------------------------------------------------------------------------------


class _Out:
    def __init__(self):
        self.value, self.n, self.done = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 512:
            self.done += (self.value & ((1 << 512) - 1)).to_bytes(64, "little")
            self.value >>= 512
            self.n -= 512

    def bits(self) -> np.ndarray:
        raw = bytes(self.done) + self.value.to_bytes(-(-self.n // 8), "little")
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: 8 * len(self.done) + self.n]


def _huffman(counts: list[int], most: int) -> list[int]:
    """Code lengths up to `most`; rare symbols are taken for less rare until the lengths fit."""
    used = [s for s, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    floor = 1
    while True:
        leaves = sorted((max(counts[s], floor), s) for s in used)
        n = len(leaves)
        weight, up = [w for w, _ in leaves], [0] * (2 * n - 1)
        leaf, inner = 0, n
        for new in range(n, 2 * n - 1):  # the two lightest of the leaves and inner nodes that are left
            total = 0
            for _ in range(2):
                if inner >= new or leaf < n and weight[leaf] <= weight[inner]:
                    total, up[leaf], leaf = total + weight[leaf], new, leaf + 1
                else:
                    total, up[inner], inner = total + weight[inner], new, inner + 1
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth[:n]) <= most:
            for (_, s), d in zip(leaves, depth):
                lengths[s] = d
            return lengths
        floor *= 2


def _repeats(steps: list[tuple], before: int) -> list[tuple]:
    """Steps in which 16 marks one more of the length before: three to six of them become one step, fewer the length itself."""
    out, held = [], 0
    for step in [*steps, None]:
        if step is not None and step[0] == 16:
            held += 1
            continue
        while held >= 3:
            out.append((16, min(held, 6) - 3, 2))
            held -= min(held, 6)
        out += [(before, 0, 0)] * held
        held = 0
        if step is not None:
            before = step[0] if 0 < step[0] < 16 else before
            out.append(step)
    return out


@dataclass
class _Writer:
    """A prefix code for writing."""

    lengths: list[int]
    codes: list[int] = field(default_factory=list)

    def __post_init__(self):
        one = sum(map(bool, self.lengths)) <= 1
        self.codes = _written_codes(self.lengths)
        self.sizes = [0] * len(self.lengths) if one else self.lengths

    def put(self, out: _Out, symbol: int) -> None:
        if self.sizes[symbol]:
            out.put(self.codes[symbol], self.sizes[symbol])

    def describe(self, out: _Out) -> None:
        used = [s for s, n in enumerate(self.lengths) if n]
        if len(used) <= 2 and all(s < 256 for s in used):
            used = used or [0]
            out.put(1, 1)
            out.put(len(used) - 1, 1)
            out.put(1, 1)
            for s in used:
                out.put(s, 8)
            return
        out.put(0, 1)
        steps = []  # code lengths, and runs of zeros or of the same length as (symbol, value of the extra bits, their number)
        at, before = 0, 8
        for s in [*used, len(self.lengths)]:
            while (many := min(s - at, 138)) >= 3:
                steps.append((17, many - 3, 3) if many <= 10 else (18, many - 11, 7))
                at += many
            steps += [(0, 0, 0)] * (s - at)
            if s < len(self.lengths):
                n = self.lengths[s]
                steps.append((16, 0, 0) if n == before else (n, 0, 0))
                before, at = n, s + 1
        steps = _repeats(steps, 8)
        counts = [0] * 19
        for k, _, _ in steps:
            counts[k] += 1
        own = _Writer(_huffman(counts, 7))
        out.put(15, 4)
        for s in LENGTH_ORDER:
            out.put(own.lengths[s], 3)
        out.put(0, 1)
        codes, sizes = own.codes, own.sizes
        for k, extra, n in steps:
            out.put(codes[k] | extra << sizes[k], sizes[k] + n)


def _prefix(value: int) -> tuple[int, int, int]:
    """The prefix of a length or distance, its extra bits and their number."""
    if value <= 4:
        return value - 1, 0, 0
    extra = (value - 1).bit_length() - 2
    prefix = 2 * extra + 2 + ((value - 1) >> extra & 1)
    return prefix, (value - 1) & ((1 << extra) - 1), extra


def _tokens(argb: np.ndarray, width: int, cache_bits: int, references: bool) -> list[tuple]:
    """('pixel', argb), ('cache', index) and ('copy', length, plane code), in order, each after its first position."""
    flat, out, at = argb.reshape(-1).tolist(), [], 0
    cache: dict[int, int] = {}
    seen: dict[tuple, int] = {}
    planes = {x + y * width: i + 1 for i, (x, y) in reversed(list(enumerate(PLANE))) if x + y * width >= 1}
    while at < len(flat):
        length = 0
        if references and at + 4 <= len(flat):
            back = seen.get(tuple(flat[at : at + 4]))
            if back is not None:
                while length < 4096 and at + length < len(flat) and flat[back + length] == flat[at + length]:
                    length += 1
        if length >= 4:
            out.append((at, "copy", length, planes.get(at - back, at - back + 120)))
        else:
            length = 1
            place = (flat[at] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else -1
            out.append((at, "cache", place) if cache_bits and cache.get(place) == flat[at] else (at, "pixel", flat[at]))
        for k in range(at, at + length):
            if cache_bits:
                cache[(flat[k] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[k]
            seen[tuple(flat[k : k + 4])] = k
        at += length
    return out


def _put_only(out: _Out, symbol: int) -> None:
    """A prefix code of one symbol."""
    out.put(0b101 | symbol << 3, 11)


def _put_constant(out: _Out, argb: int) -> None:
    """An image, not the main one, whose pixels are all alike: no cache, and codes that take no bits."""
    out.put(0, 1)
    for symbol in (argb >> 8 & 255, argb >> 16 & 255, argb & 255, argb >> 24, 0):
        _put_only(out, symbol)


def _put_image(out: _Out, argb: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, group_bits: int = 0) -> None:
    height, width = argb.shape
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups = np.zeros((1, 1), np.uint32)
    if main:
        out.put(int(group_bits > 0), 1)
        if group_bits:
            shape = _cells(height, group_bits), _cells(width, group_bits)
            groups = (np.arange(shape[0] * shape[1], dtype=np.uint32) % 3).reshape(shape)
            out.put(group_bits - 2, 3)
            _put_image(out, groups << np.uint32(8), False)
    tokens = _tokens(argb, width, cache_bits, references)
    group = lambda at: int(groups[(at // width) >> group_bits, (at % width) >> group_bits]) if group_bits else 0
    counts = [[[0] * n for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(int(groups.max()) + 1)]
    for at, kind, value, *far in tokens:
        own = counts[group(at)]
        if kind == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                own[k][value >> shift & 255] += 1
        elif kind == "cache":
            own[0][280 + value] += 1
        else:
            own[0][256 + _prefix(value)[0]] += 1
            own[4][_prefix(far[0])[0]] += 1
    codes = [[_Writer(_huffman(c, 15)) for c in own] for own in counts]
    for own in codes:
        for code in own:
            code.describe(out)
    for at, kind, value, *far in tokens:
        own = codes[group(at)]
        if kind == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                own[k].put(out, value >> shift & 255)
        elif kind == "cache":
            own[0].put(out, 280 + value)
        else:
            for code, number, first in ((own[0], value, 256), (own[4], far[0], 0)):
                prefix, extra, n = _prefix(number)
                code.put(out, first + prefix)
                out.put(extra, n)


def _wrapped(bits: np.ndarray) -> bytes:
    body = np.packbits(bits, bitorder="little").tobytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def _header(out: _Out, width: int, height: int, alpha: int) -> None:
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(alpha, 1)
    out.put(0, 3)


def _put_palette(out: _Out, argb: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """Write a palette of the sorted colours; returns the image of indices, several in a pixel where the colours are few."""
    height, width = argb.shape
    out.put(1 | PALETTE << 1, 3)
    out.put(len(colours) - 1, 8)
    _put_image(out, _words(np.diff(_bytes4(colours), axis=0, prepend=np.zeros((1, 4), np.uint8)))[None], False)
    bits = _palette_bits(len(colours))
    wide = np.zeros((height, _cells(width, bits) << bits), np.uint32)
    wide[:, :width] = np.searchsorted(colours, argb)
    packed = (wide.reshape(height, -1, 1 << bits) << (np.arange(1 << bits, dtype=np.uint32) * np.uint32(8 >> bits))).sum(-1, dtype=np.uint32)
    return np.uint32(OPAQUE) | packed << np.uint32(8)


def encode(argb: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, references: bool = True, group_bits: int = 0, block_bits: int = 3, cross: int | None = None) -> bytes:
    """A WebP file of ARGB pixels with the transforms asked for, in that order; a palette must come alone or first. cross: the multipliers of the cross-colour transform, else mixed ones."""
    out = _Out()
    height, width = argb.shape
    _header(out, width, height, 1)
    mixed = np.random.default_rng(0)
    for kind in transforms:
        if kind != PALETTE:
            out.put(1, 1)
            out.put(kind, 2)
        cells = _cells(height, block_bits), _cells(argb.shape[1], block_bits)
        if kind == PREDICTOR:
            data = (np.arange(cells[0] * cells[1], dtype=np.uint32) % 14).reshape(cells) << np.uint32(8)
            argb_next = _predict(argb, data, block_bits)
        elif kind == CROSS_COLOUR:
            data = (mixed.integers(0, 1 << 24, cells) if cross is None else np.full(cells, cross)).astype(np.uint32) | np.uint32(OPAQUE)
            argb_next = _cross(argb, data, block_bits, True)
        elif kind == SUBTRACT_GREEN:
            data, argb_next = None, _green(argb, -1)
        else:
            argb = _put_palette(out, argb, np.unique(argb))
            continue
        if data is not None:
            out.put(block_bits - 2, 3)
            _put_image(out, data, False) if (data != data[0, 0]).any() else _put_constant(out, int(data[0, 0]))
        argb = argb_next
    out.put(0, 1)
    _put_image(out, argb, True, cache_bits, references, group_bits)
    return _wrapped(out.bits())


#: Bytes that a copy of encode_samples has in common with what it copies, at least.
MATCH = 8
#: Copies are at most so long; codes of the fast writer too.
LONGEST_COPY, CODE_BITS = 4096, 11
#: Rows up to which encode_samples takes the cross-colour transform and a colour cache.
SMALL_ROWS = 4
FEW_VALUES = 16
#: Predictors' blocks are squares of 1 << PREDICTOR_BITS pixels.
PREDICTOR_BITS = 5
FULL_GREEN = 0x2020  # cross-colour multipliers of one for green to red and green to blue: takes the grey away


def _copies(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of copies, which don't overlap: from the last place that has the next MATCH bytes, for as long as that distance holds."""
    n = len(plane) - MATCH + 1
    nothing = np.array([], np.int64)
    if n < 2:
        return nothing, nothing, nothing
    words = np.ndarray((n,), "<u8", plane.tobytes(), strides=(1,)).copy()
    order = (words * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(0xFFFFF) | np.arange(n, dtype=np.uint64)
    order.sort()
    at = (order & np.uint64(0xFFFFF)).astype(np.int32)
    order >>= np.uint64(20)
    same = order[1:] == order[:-1]
    distance = np.zeros(n + 1, np.int32)
    later, earlier = at[1:][same], at[:-1][same]
    true = words[later] == words[earlier]
    distance[later[true]] = later[true] - earlier[true]
    edge = np.flatnonzero(distance[1:] != distance[:-1]) + 1
    edge = np.concatenate(([0], edge, [n + 1]))
    firsts, lasts = edge[:-1], edge[1:]
    has = distance[firsts] > 0
    starts, far = firsts[has], distance[firsts[has]].astype(np.int64)
    ends = np.minimum(lasts[has] + MATCH - 1, np.append(starts[1:], len(plane)))
    times = -(-(ends - starts) // LONGEST_COPY)
    if (times > 1).any():
        part = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        starts, ends, far = (np.repeat(x, times) for x in (starts, ends, far))
        starts = starts + part * LONGEST_COPY
        ends = np.minimum(ends, starts + LONGEST_COPY)
    kept = ends - starts >= 4
    return starts[kept], (ends - starts)[kept], far[kept]


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix of arrays."""
    less = value - 1
    extra = np.maximum(np.frexp(less.astype(float))[1] - 2, 0)
    extra = np.where(value <= 4, 0, extra)
    return np.where(value <= 4, less, 2 * extra + 2 + (less >> extra & 1)), less & ((1 << extra) - 1), extra


#: Lengths of the distance codes that encode_samples writes: the nearer half and a little more are a bit shorter.
FAR_LENGTHS = (5,) * 24 + (6,) * 16


@cache
def _far_writer() -> _Writer:
    return _Writer(list(FAR_LENGTHS))


@cache
def _far_head() -> tuple[int, int]:
    """The bits that describe the distance code, and their number."""
    out = _Out()
    _far_writer().describe(out)
    own = out.bits()
    return int.from_bytes(np.packbits(own, bitorder="little").tobytes(), "little"), len(own)


def _put_plane(out: _Out, plane: np.ndarray, width: int, alpha: int) -> np.ndarray:
    """Write the head and codes of an image whose green is `plane`, red and blue zero; returns the bits of its tokens."""
    starts, lengths, far = _copies(plane)
    cover = np.zeros(len(plane) + 1, np.int8)
    cover[starts] = 1
    cover[starts + lengths] -= 1
    begins = np.cumsum(cover[:-1], dtype=np.int8) == 0
    begins[starts] = True
    at = np.flatnonzero(begins)
    green = plane[at].astype(np.int64)
    place = np.searchsorted(at, starts)
    prefix, extra, bits = _prefixes(lengths)
    green[place] = 256 + prefix
    near = _near_codes(width)[1]
    code = np.where(far < len(near), near[np.minimum(far, len(near) - 1)], 0)
    far_prefix, far_extra, far_bits = _prefixes(np.where(code > 0, code, far + 120))
    codes = [_Writer(_huffman(np.bincount(green, minlength=280).tolist(), CODE_BITS)), _far_writer()]
    out.put(0, 2)  # no colour cache, one group of codes
    codes[0].describe(out)
    for value in (0, 0, alpha):
        _put_only(out, value)
    out.put(*_far_head())
    # four fields a token: its code, and for copies the extra bits, the distance's code and its extra bits
    value, size = np.zeros((len(at), 4), np.int32), np.zeros((len(at), 4), np.int8)
    value[:, 0], size[:, 0] = np.array(codes[0].codes)[green], np.array(codes[0].sizes)[green]
    for k, (v, s) in enumerate(((extra, bits), (np.array(codes[1].codes)[far_prefix], np.array(codes[1].sizes)[far_prefix]), (far_extra, far_bits)), 1):
        value[place, k], size[place, k] = v, s
    value, size = value.reshape(-1), size.reshape(-1)
    there = np.flatnonzero(size)
    value, size = value[there], size[there].astype(np.int64)
    total = int(size.sum())
    shift = np.arange(total, dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
    return ((np.repeat(value, size) >> shift) & 1).astype(np.uint8)


def _joined(out: _Out, plane: np.ndarray, alpha: int) -> np.ndarray:
    """All bits: what was put before, and the image."""
    tokens = _put_plane(out, plane.reshape(-1), plane.shape[1], alpha)
    return np.concatenate((out.bits(), tokens))


def _block_modes(plane: np.ndarray) -> np.ndarray:
    """Of each block of samples: `left` or `top` where most samples equal that neighbour, else black."""
    height, width = plane.shape
    size = 1 << PREDICTOR_BITS
    shape = _cells(height, PREDICTOR_BITS), _cells(width, PREDICTOR_BITS)
    share = []
    if 2 * max(np.count_nonzero(plane[:, 1:] == plane[:, :-1]), np.count_nonzero(plane[1:] == plane[:-1])) <= size * size:
        return np.zeros(shape, np.uint32)  # not enough for half a block
    for equal in (plane[:, 1:] == plane[:, :-1], plane[1:] == plane[:-1]):
        wide = np.zeros((shape[0] * size, shape[1] * size), np.int32)
        wide[height - equal.shape[0] : height, width - equal.shape[1] : width] = equal
        share.append(wide.reshape(shape[0], size, shape[1], size).sum((1, 3)))
    half = size * size // 2
    return np.where(share[0] > half, 1, np.where(share[1] > half, 2, 0)).astype(np.uint32)


def encode_samples(samples: np.ndarray) -> bytes:
    """A WebP file of 8-bit samples (height x width): a grey picture, red and blue being as green.

    Up to FEW_VALUES values make a palette. Up to SMALL_ROWS rows go through the cross-colour transform and
    a colour cache. All else goes through subtract-green and a predictor. Back-references in all of them.
    """
    height, width = samples.shape
    values = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256))
    grey = lambda v: np.uint32(OPAQUE) | v.astype(np.uint32) * np.uint32(0x010101)
    if len(values) > FEW_VALUES and height <= SMALL_ROWS:
        return encode(grey(samples), (CROSS_COLOUR,), cache_bits=2, cross=FULL_GREEN)
    out = _Out()
    _header(out, width, height, 0)
    if len(values) <= FEW_VALUES:
        packed = _put_palette(out, grey(samples), grey(values))
        out.put(0, 1)
        return _wrapped(_joined(out, ((packed >> 8) & 0xFF).astype(np.uint8), 255))
    out.put(1 | SUBTRACT_GREEN << 1, 3)
    out.put(1 | PREDICTOR << 1, 3)
    out.put(PREDICTOR_BITS - 2, 3)
    modes = _block_modes(samples)
    _put_image(out, modes << np.uint32(8), False) if modes.any() else _put_constant(out, 0)
    out.put(0, 1)
    rest = samples.copy()
    spread = np.repeat(np.repeat(modes, 1 << PREDICTOR_BITS, 0), 1 << PREDICTOR_BITS, 1)[:height, :width]
    if modes.any():
        left, top = np.zeros_like(samples), np.zeros_like(samples)
        left[:, 1:], top[1:] = samples[:, :-1], samples[:-1]
        rest -= np.where(spread == 1, left, np.where(spread == 2, top, np.uint8(0)))
    rest[0, 1:] = samples[0, 1:] - samples[0, :-1]
    rest[0, 0] = samples[0, 0]
    rest[1:, 0] = samples[1:, 0] - samples[:-1, 0]
    return _wrapped(_joined(out, rest, 0))


# ---- media columns --------------------------------------------------------------------------------

ROW = 64
#: Rows of an image: the format's limit. Longer payloads take several files, one after another.
ROWS = 16384


def store(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8, padded with zeros to a positive multiple of 64, as 64 samples a row; returns its unpadded size and the file or files."""
    raw = (text or "").encode()
    samples = np.frombuffer(raw + b"\0" * (-len(raw) % ROW if raw else ROW), np.uint8).reshape(-1, ROW)
    return len(raw), b"".join(encode_samples(samples[a : a + ROWS]) for a in range(0, len(samples), ROWS))


def load(media: bytes) -> np.ndarray:
    """The samples of one file or several."""
    at, found = 0, []
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        found.append(((decode(media[at : at + size]) >> 8) & 0xFF).astype(np.uint8))
        at += size
    return np.concatenate(found)


def feature(samples: np.ndarray) -> str:
    """Size, sum, distinct values, sum of the steps along rows, and a 64-bit hash: which columns are brighter than the mean column."""
    wide = samples.astype(np.int16)
    columns = wide.sum(axis=0, dtype=np.int64)
    mark = int.from_bytes(np.packbits(columns * len(columns) > columns.sum()).tobytes(), "big")
    values = np.count_nonzero(np.bincount(samples.reshape(-1), minlength=256))
    return f"{samples.shape[1]}x{samples.shape[0]};sum={columns.sum()};values={values};steps={np.abs(np.diff(wide, axis=1)).sum(dtype=np.int64)};hash={mark:016x}"


def media_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a lossless WebP of the text) of every row; null texts are empty."""

    def of(part: pa.RecordBatch) -> dict:
        found = [store(t) for t in part.column("text").to_pylist()]
        return {"doc_id": part.column("doc_id"), "n_bytes": [n for n, _ in found], "media": [m for _, m in found]}

    return map_rows(id_text(docs), "text", of, "doc_id long, n_bytes long, media binary")


def pixel_rows(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """The key, width, height and pixels (ARGB, little-endian bytes) of any column of lossless WebP files; null where the file is null or no such image."""

    def of(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("width", "height", "pixels")}
        for raw in part.column("media").to_pylist():
            try:
                argb = decode(raw or b"")
            except WebpError:
                argb = None
            for k, v in zip(out, (None, None, None) if argb is None else (argb.shape[1], argb.shape[0], argb.astype("<u4").tobytes())):
                out[k].append(v)
        return {"doc_id": part.column("doc_id"), **out}

    from pyspark.sql import functions as F

    return map_rows(media.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("media")), "media", of, "doc_id long, width int, height int, pixels binary")


def media_features(media: DataFrame) -> DataFrame:
    """Of media_rows' result: what the stored bytes give when they are read back.

    A null file gives nulls. Rows that repeat give equal rows, an empty table an empty result. A file that is
    no lossless WebP is an error, since these are the operator's own.
    """
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * len(names)
        samples = load(raw)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(samples)

    def of(part: pa.RecordBatch) -> dict:
        found = [one(raw) for raw in part.column("media").to_pylist()]
        return {"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), **{k: [f[i] for f in found] for i, k in enumerate(names)}}

    return map_rows(media.select("doc_id", "n_bytes", "media"), "media", of, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
