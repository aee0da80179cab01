"""WebP files, lossless form (VP8L): all that the format has is read; what is written is predicted from the left, with Huffman codes.

The lossy form (VP8) and animations are errors that say so. Pixels are decoded one by one in Python, so large files are slow.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strata.sources.codecs import MAX_BYTES

# Fixed values of the format.
_LENGTHS_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_CACHE_FACTOR = 0x1E35A7BD
_GREEN, _COLOR, _DISTANCES = 280, 256, 40
_LEFT, _BLOCK_BITS, _MAX_SIDE = 1, 9, 1 << 14
#: Short distances are places near a pixel, the nearest first.
_NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class _Bits:
    """Bits of a stream, the lowest of each byte first."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.end = raw + bytes(8), 0, 8 * len(raw)

    def peek(self, n: int) -> int:
        return int.from_bytes(self.raw[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("too few bits")

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.skip(n)
        return out


def _codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of the given lengths, their bits in the order in which they are written."""
    out, code, before = np.zeros(len(lengths), np.int64), 0, 0
    for s in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
        n = int(lengths[s])
        code <<= n - before
        out[s], code, before = int(f"{code:0{n}b}"[::-1], 2), code + 1, n
    return out


class _Code:
    """A prefix code as a table of the next bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("empty code")
        self.size = 0 if len(used) == 1 else int(lengths.max())
        if len(used) == 1:
            self.table = [(int(used[0]), 0)]
            return
        if sum(1 << (self.size - int(lengths[s])) for s in used) != 1 << self.size:
            raise ValueError("incomplete code")
        codes = _codes(lengths)
        self.table = [(0, 0)] * (1 << self.size)
        for s in used.tolist():
            n = int(lengths[s])
            for i in range(int(codes[s]), 1 << self.size, 1 << n):
                self.table[i] = (s, n)

    def next(self, bits: _Bits) -> int:
        symbol, n = self.table[bits.peek(self.size)]
        bits.skip(n)
        return symbol


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    lengths = np.zeros(max(alphabet, 256), np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return _Code(lengths)
    inner = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        inner[_LENGTHS_ORDER[i]] = bits.read(3)
    code = _Code(inner)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        n = code.next(bits)
        if n < 16:
            lengths[at] = n
            at, last = at + 1, n or last
            continue
        value, run = {16: (last, 2), 17: (0, 3), 18: (0, 7)}[n]
        run = bits.read(run) + (11 if n == 18 else 3)
        if at + run > alphabet:
            raise ValueError("too many code lengths")
        lengths[at : at + run] = value
        at += run
    return _Code(lengths)


def _far(bits: _Bits, symbol: int) -> int:
    """A length or distance: its prefix, and more bits."""
    if symbol < 4:
        return symbol + 1
    more = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << more) + bits.read(more) + 1


def _parts(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _image(bits: _Bits, w: int, h: int, main: bool) -> list[int]:
    """Pixels as ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    which, shift, wide = [0], 14, 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        wide = _parts(w, shift)
        which = [p >> 8 & 0xFFFF for p in _image(bits, wide, _parts(h, shift), False)]
    groups = [[_read_code(bits, n) for n in (_GREEN + len(cache), _COLOR, _COLOR, _COLOR, _DISTANCES)] for _ in range(max(which) + 1)]
    out: list[int] = []
    kept = 0  # pixels that the cache has seen
    while len(out) < w * h:
        y, x = divmod(len(out), w)
        green, red, blue, alpha, distance = groups[which[(y >> shift) * wide + (x >> shift)]]
        s = green.next(bits)
        if s < 256:
            r, b, a = red.next(bits), blue.next(bits), alpha.next(bits)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < _GREEN:
            n, d = _far(bits, s - 256), _far(bits, distance.next(bits))
            if d > len(_NEAR):
                d -= len(_NEAR)
            else:
                d = max(1, _NEAR[d - 1][0] + _NEAR[d - 1][1] * w)
            if d > len(out) or len(out) + n > w * h:
                raise ValueError("copy from outside the image")
            for _ in range(n):
                out.append(out[-d])
        elif s - _GREEN >= len(cache):
            raise ValueError("no such colour")
        else:
            for p in out[kept:]:
                cache[(p * _CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            kept = len(out)
            out.append(cache[s - _GREEN])
    return out


def _channels(pixels: list[int], h: int, w: int) -> np.ndarray:
    """(h, w, ARGB)"""
    return np.array(pixels, ">u4").view(np.uint8).reshape(h, w, 4).astype(np.int64)


def _mean(a, b):
    return [(p + q) >> 1 for p, q in zip(a, b, strict=True)]


def _select(left, top, corner):
    to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
    to_top = sum(abs(p - c) for p, c in zip(left, corner, strict=True))
    return left if to_left < to_top else top


def _clamp(v: int) -> int:
    return min(255, max(0, v))


def _half(mean, corner):
    # the difference is halved towards zero
    return [_clamp(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]


_BLACK = [255, 0, 0, 0]
#: What a pixel is expected to be, by mode, from those to the left, above, above right and above left.
_MODES = [
    lambda l, t, r, c: _BLACK,
    lambda l, t, r, c: l,
    lambda l, t, r, c: t,
    lambda l, t, r, c: r,
    lambda l, t, r, c: c,
    lambda l, t, r, c: _mean(_mean(l, r), t),
    lambda l, t, r, c: _mean(l, c),
    lambda l, t, r, c: _mean(l, t),
    lambda l, t, r, c: _mean(c, t),
    lambda l, t, r, c: _mean(t, r),
    lambda l, t, r, c: _mean(_mean(l, c), _mean(t, r)),
    lambda l, t, r, c: _select(l, t, c),
    lambda l, t, r, c: [_clamp(p + q - s) for p, q, s in zip(l, t, c, strict=True)],
    lambda l, t, r, c: _half(_mean(l, t), c),
    lambda l, t, r, c: _BLACK,
    lambda l, t, r, c: _BLACK,
]


def _unpredicted(px: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w = px.shape[:2]
    flat, out = px.reshape(-1, 4).tolist(), []
    for i, rest in enumerate(flat):
        y, x = divmod(i, w)
        if not i:
            guess = _BLACK
        elif not y:
            guess = out[-1]
        elif not x:
            guess = out[i - w]
        else:  # above right of the last column is the row's own first pixel, the next one in memory
            guess = _MODES[modes[y >> bits, x >> bits]](out[-1], out[i - w], out[i - w + 1], out[i - w - 1])
        out.append([(a + b) & 255 for a, b in zip(rest, guess, strict=True)])
    return np.array(out, np.int64).reshape(h, w, 4)


def _uncolored(px: np.ndarray, blocks: np.ndarray, bits: int) -> np.ndarray:
    signed = lambda v: (v & 255 ^ 128) - 128
    h, w = px.shape[:2]
    by = signed(blocks[np.arange(h)[:, None] >> bits, np.arange(w) >> bits])
    out = px.copy()
    out[..., 1] = (px[..., 1] + (by[..., 3] * signed(px[..., 2]) >> 5)) & 255
    out[..., 3] = (px[..., 3] + (by[..., 2] * signed(px[..., 2]) >> 5) + (by[..., 1] * signed(out[..., 1]) >> 5)) & 255
    return out


def _unindexed(px: np.ndarray, palette: np.ndarray, bits: int, w: int) -> np.ndarray:
    each = 8 >> bits
    x = np.arange(w)
    index = px[:, x >> bits, 2] >> ((x & ((1 << bits) - 1)) * each) & ((1 << each) - 1)
    table = np.zeros((256, 4), np.int64)
    table[: len(palette)] = palette
    return table[index]


def _decode_vp8l(raw: bytes) -> tuple[int, int, bytes]:
    bits = _Bits(raw)
    if bits.read(8) != 0x2F:
        raise ValueError("bad signature")
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    if w * h * 4 > MAX_BYTES:
        raise ValueError("image too large")
    undo, wide, seen = [], w, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind < 2:
            size = bits.read(3) + 2
            bw, bh = _parts(wide, size), _parts(h, size)
            blocks = _channels(_image(bits, bw, bh, False), bh, bw)
            undo.append((lambda px, b=blocks, s=size: _uncolored(px, b, s)) if kind else (lambda px, b=blocks, s=size: _unpredicted(px, b[..., 2] & 15, s)))
        elif kind == 2:
            undo.append(lambda px: (px + px[..., 2:3] * np.array([0, 1, 0, 1])) & 255)
        else:
            n = bits.read(8) + 1
            palette = np.cumsum(_channels(_image(bits, n, 1, False), 1, n)[0], axis=0) & 255
            size = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda px, p=palette, s=size, at=wide: _unindexed(px, p, s, at))
            wide = _parts(wide, size)
    px = _channels(_image(bits, wide, h, True), h, wide)
    for step in reversed(undo):
        px = step(px)
    return w, h, px[..., [1, 2, 3, 0]].astype(np.uint8).tobytes()


def decode_webp(raw: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA) of a lossless WebP file; anything else is a ValueError."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise ValueError("not a WebP")
    at = 12
    while at + 8 <= len(raw):
        kind, (n,) = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])
        if kind == b"VP8L":
            return _decode_vp8l(raw[at + 8 : at + 8 + n])
        if kind in (b"VP8 ", b"ANMF"):
            raise ValueError("no decoder for lossy or moving WebP here")
        at += 8 + n + (n & 1)
    raise ValueError("no image in the file")


def _huffman(counts: np.ndarray) -> np.ndarray:
    """Code lengths of at most 15 bits."""
    counts = counts.copy()
    while True:
        lengths = np.zeros(len(counts), np.int64)
        heap = [(int(c), s, [s]) for s, c in enumerate(counts) if c]
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            lengths[x + y] += 1
            heapq.heappush(heap, (a + b, i, x + y))
        if lengths.max() <= 15:
            return lengths
        counts = np.where(counts, counts // 2 + 1, 0)


def encode_webp(width: int, height: int, rgba: bytes) -> bytes:
    """A lossless WebP file of 1 to 16384 pixels a side; ``decode_webp`` gives the same pixels."""
    if not (0 < width <= _MAX_SIDE and 0 < height <= _MAX_SIDE):
        raise ValueError("a WebP has 1 to 16384 pixels a side")
    px = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).astype(np.int64)
    rest = px.copy()
    rest[:, 1:] -= px[:, :-1]
    rest[1:, 0] -= px[:-1, 0]
    rest[0, 0, 3] -= 255
    rest[..., [0, 2]] -= rest[..., 1:2]
    symbols = (rest & 255).reshape(-1, 4)[:, [1, 0, 2, 3]]
    values: list[int] = []
    sizes: list[int] = []

    def put(*pairs: tuple[int, int]) -> None:
        for v, n in pairs:
            values.append(v)
            sizes.append(n)

    def one(symbol: int) -> None:
        put((1, 1), (0, 1), (1, 1), (symbol, 8))

    put((0x2F, 8), (width - 1, 14), (height - 1, 14), (int((px[..., 3] < 255).any()), 1), (0, 3))
    put((1, 1), (0, 2), (_BLOCK_BITS - 2, 3), (0, 1))
    for symbol in (_LEFT, 0, 0, 0, 0):
        one(symbol)
    put((1, 1), (2, 2), (0, 1), (0, 1), (0, 1))  # green is subtracted; no more transforms, no cache, one group of codes
    code, length = np.zeros_like(symbols), np.zeros_like(symbols)
    for i, alphabet in enumerate((_GREEN, _COLOR, _COLOR, _COLOR)):
        counts = np.bincount(symbols[:, i], minlength=alphabet)
        used = np.flatnonzero(counts)
        lengths = _huffman(counts)
        if len(used) == 1:
            one(int(used[0]))
        elif len(used) == 2:
            put((1, 1), (1, 1), (1, 1), (int(used[0]), 8), (int(used[1]), 8))
        else:  # lengths in four bits each
            put((0, 1), (15, 4), *[(4 if n < 16 else 0, 3) for n in _LENGTHS_ORDER], (0, 1))
            put(*[(int(f"{int(n):04b}"[::-1], 2), 4) for n in lengths])
        code[:, i], length[:, i] = _codes(lengths)[symbols[:, i]], lengths[symbols[:, i]]
    one(0)
    v, n = np.concatenate([values, code.reshape(-1)]), np.concatenate([sizes, length.reshape(-1)])
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    data = np.packbits((np.repeat(v, n) >> place & 1).astype(np.uint8), bitorder="little").tobytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + bytes(len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def to_webp(buffers: DataFrame) -> DataFrame:
    """(image_id, webp) of buffers (image_id, width, height, data)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"image_id": pdf["image_id"], "webp": [encode_webp(w, h, d) for w, h, d in zip(pdf["width"], pdf["height"], pdf["data"], strict=True)]})

    return buffers.select("image_id", "width", "height", "data").mapInPandas(run, "image_id long, webp binary")
