"""JPEG files: baseline, grey or three components of any sampling; whole blocks are transformed at once."""

from __future__ import annotations

import math
import struct

import numpy as np

from strata.sources.codecs import MAX_BYTES

# The format specification's tables of quantities (annex K), in rows of eight.
LUMA = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMA = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99]


def _zigzag() -> list[int]:
    """Places of an 8 by 8 block along its diagonals, there and back."""
    return [y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]


ZIGZAG = np.array(_zigzag())
_DCT = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol, of the number of codes of each length."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, raw: bytes):
        self.raw, self.at, self.held, self.left = raw, 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            self.held = self.held << 8 | (self.raw[self.at] if self.at < len(self.raw) else 0)
            self.at += 1
            self.left += 8
            if self.at > len(self.raw) + 64:
                raise ValueError("cut off")
        self.left -= n
        out = self.held >> self.left
        self.held &= (1 << self.left) - 1
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("bad code")

    def value(self, size: int) -> int:
        """A number of ``size`` bits; those that begin with 0 are negative."""
        if not size:
            return 0
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def decode_jpeg(raw: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA) of a baseline file, alpha 255; progressive, arithmetic or CMYK files are a ValueError."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, codes, frame, every = 2, {}, {}, None, 0
    while True:
        while raw[at] != 0xFF or raw[at + 1] in (0, 0xFF):
            at += 1
        kind, n = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
        body, at = raw[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            while body:
                size = 128 if body[0] >> 4 else 64
                tables[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if size == 128 else np.uint8).astype(np.float64)
                body = body[1 + size :]
        elif kind == 0xC4:
            while body:
                total = sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif kind in (0xC0, 0xC1):
            depth, h, w, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3) or not w or not h:
                raise ValueError("unsupported JPEG")
            if w * h * 4 > MAX_BYTES:
                raise ValueError("image too large")
            frame = (w, h, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC2 <= kind <= 0xCF:
            raise ValueError("unsupported JPEG")
        elif kind == 0xDD:
            (every,) = struct.unpack(">H", body[:2])
        elif kind == 0xDA:
            break
        elif kind == 0xD9:
            raise ValueError("no pixels")
    if frame is None:
        raise ValueError("no frame")
    w, h, parts = frame
    of = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15) for i in range(body[0])}
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-w // (8 * wide)), -(-h // (8 * high))
    blocks = [np.zeros((down * p[2], across * p[1], 64)) for p in parts]
    # runs between restarts, with stuffed zeros taken out
    runs, begin, k = [], at, at
    while k + 1 < len(raw):
        if raw[k] == 0xFF and raw[k + 1] != 0:
            runs.append(raw[begin:k].replace(b"\xff\0", b"\xff"))
            if not 0xD0 <= raw[k + 1] <= 0xD7:
                break
            begin, k = k + 2, k + 2
        else:
            k += 2 if raw[k] == 0xFF else 1
    else:
        runs.append(raw[begin:].replace(b"\xff\0", b"\xff"))
    last, bits = [0] * len(parts), _Bits(runs[0])
    for m in range(across * down):
        if every and m and m % every == 0:
            if m // every >= len(runs):
                raise ValueError("cut off")
            last, bits = [0] * len(parts), _Bits(runs[m // every])
        for i, (name, sx, sy, _) in enumerate(parts):
            dc, ac = of[name]
            for j in range(sx * sy):
                out = blocks[i][m // across * sy + j // sx, m % across * sx + j % sx]
                last[i] += bits.value(bits.symbol(codes[dc]))
                out[0], at = last[i], 1
                while at < 64:
                    s = bits.symbol(codes[ac])
                    if not s & 15:
                        if s != 0xF0:
                            break
                        at += 16
                        continue
                    at += s >> 4
                    if at > 63:
                        raise ValueError("bad block")
                    out[at] = bits.value(s & 15)
                    at += 1
    planes = []
    for b, (_, sx, sy, t) in zip(blocks, parts, strict=True):
        px = np.zeros_like(b)
        px[..., ZIGZAG] = b * tables[t]
        px = _DCT.T @ px.reshape(*b.shape[:2], 8, 8) @ _DCT + 128
        px = px.transpose(0, 2, 1, 3).reshape(b.shape[0] * 8, b.shape[1] * 8)
        planes.append(px.repeat(high // sy, axis=0).repeat(wide // sx, axis=1)[:h, :w])
    y, cb, cr = planes if len(planes) == 3 else (planes[0], np.full((h, w), 128.0), np.full((h, w), 128.0))
    rgb = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=2)
    rgba = np.full((h, w, 4), 255, np.uint8)
    rgba[..., :3] = np.clip(np.round(rgb), 0, 255)
    return w, h, rgba.tobytes()


def _flat_codes(symbols: list[int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """A code of one length for all symbols, all ones left out: counts by length, symbols, and symbol to (length, code)."""
    length = len(symbols).bit_length()
    return bytes([len(symbols) if n == length else 0 for n in range(1, 17)]), bytes(symbols), {s: (length, i) for i, s in enumerate(symbols)}


def encode_jpeg(width: int, height: int, rgba: bytes, quality: int = 85) -> bytes:
    """A baseline file without subsampling; alpha is left out. Codes are of one length a table, so files are larger than they could be."""
    if not 0 < width < 65536 or not 0 < height < 65536:
        raise ValueError("a JPEG is 1 to 65535 pixels each way")
    px = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)[..., :3].astype(np.float64)
    px = np.pad(px, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge")
    r, g, b = px[..., 0], px[..., 1], px[..., 2]
    planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    quality = min(100, max(1, quality))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]
    down, across = px.shape[0] // 8, px.shape[1] // 8
    out = []
    for i, p in enumerate(planes):
        f = _DCT @ p.reshape(down, 8, across, 8).transpose(0, 2, 1, 3) @ _DCT.T
        out.append(np.round(f.reshape(-1, 64) / tables[min(i, 1)])[:, ZIGZAG].astype(np.int64))
    dc = _flat_codes(list(range(12)))
    ac = _flat_codes([0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))])
    bits: list[str] = []

    def put(codes: dict[int, tuple[int, int]], symbol: int, v: int, size: int) -> None:
        length, code = codes[symbol]
        bits.append(format(code, f"0{length}b"))
        if size:
            bits.append(format(v if v > 0 else v + (1 << size) - 1, f"0{size}b"))

    last = [0, 0, 0]
    for m in range(down * across):
        for i, plane in enumerate(out):
            block = plane[m]
            d, last[i] = int(block[0]) - last[i], int(block[0])
            size = abs(d).bit_length()
            put(dc[2], size, d, size)
            zeros = 0
            used = np.flatnonzero(block[1:]) + 1
            at = 1
            for k in used.tolist():
                zeros, at, v = k - at, k + 1, int(block[k])
                for _ in range(zeros // 16):
                    put(ac[2], 0xF0, 0, 0)
                size = abs(v).bit_length()
                put(ac[2], zeros % 16 << 4 | size, v, size)
            if at < 64:
                put(ac[2], 0, 0, 0)
    flat = "".join(bits)
    flat += "1" * (-len(flat) % 8)
    scan = int(flat or "0", 2).to_bytes(len(flat) // 8, "big").replace(b"\xff", b"\xff\0")
    part = lambda kind, body: struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body
    zig = lambda t: bytes(t[ZIGZAG].tolist())
    head = part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, b"\0" + zig(tables[0]) + b"\1" + zig(tables[1]))
    head += part(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(3)))
    head += part(0xC4, b"\0" + dc[0] + dc[1] + b"\x10" + ac[0] + ac[1])
    return b"\xff\xd8" + head + part(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0") + scan + b"\xff\xd9"
