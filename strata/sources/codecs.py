"""Image files: format detection, PNG in and out, flat buffers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decoding more than this is an error.
MAX_BYTES = 512 << 20
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def detect_format(content: Column) -> Column:
    """png, jpeg, webp, gif, psd or unknown, by the first bytes of a binary column."""
    head = lambda i, n: F.hex(F.substring(content, i, n))
    size = F.length(content)
    return (
        F.when((size >= 8) & (head(1, 4) == "89504E47"), "png")
        .when((size >= 3) & (head(1, 3) == "FFD8FF"), "jpeg")
        .when((size >= 12) & (head(1, 4) == "52494646") & (head(9, 4) == "57454250"), "webp")
        .when((size >= 4) & (head(1, 4) == "47494638"), "gif")
        .when((size >= 4) & (head(1, 4) == "38425053"), "psd")
        .otherwise("unknown")
    )


def _predicted(kind: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What each line filter expects of a byte from those to the left, above, and above to the left."""
    d = a + b - c
    da, db, dc = abs(d - a), abs(d - b), abs(d - c)
    near = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
    return np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) // 2, near], 0)


def encode_png(width: int, height: int, rgba: bytes, kinds: Sequence[int] = (0,)) -> bytes:
    """An RGBA file; ``kinds`` are the line filters to use, in turn."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    wide = np.zeros((height + 1, width + 1, 4), np.int16)
    wide[1:, 1:] = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)
    kind = np.resize(np.array(kinds, np.uint8), height)
    lines = (wide[1:, 1:] - _predicted(kind[:, None, None], wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1])).astype(np.uint8)
    packed = np.concatenate([kind[:, None], lines.reshape(height, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(packed)) + chunk(b"IEND", b"")


def _unfiltered(kind: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Pixels of filtered lines (h, w, channels). Along a diagonal no pixel needs another one, so each is one step."""
    h, w, n = lines.shape
    if not kind.any():
        return lines
    out = np.zeros((h + 1, w + 1, n), np.int16)
    for d in range(h + w - 1 if h and w else 0):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        expected = _predicted(kind[y, None], out[y + 1, x], out[y, x + 1], out[y, x])
        out[y + 1, x + 1] = (lines[y, x] + expected) & 255
    return out[1:, 1:].astype(np.uint8)


def decode_png(raw: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA) of an 8-bit PNG that is not indexed or interlaced; anything else is a ValueError."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at + 8 <= len(raw):
        (n,), kind = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        data = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            if len(data) != 13:
                raise ValueError("bad header")
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("unsupported PNG")
    w, h, n = head[0], head[1], _CHANNELS[head[3]]
    if w * h * 4 > MAX_BYTES:
        raise ValueError("image too large")
    # no more is unpacked than the size asks for
    flat = zlib.decompressobj().decompress(b"".join(packed), h * (w * n + 1)) if w and h else b""
    if not w or not h or len(flat) < h * (w * n + 1):
        raise ValueError("too few pixels")
    lines = np.frombuffer(flat, np.uint8).reshape(h, w * n + 1)
    if lines[:, 0].max() > 4:
        raise ValueError("unknown line filter")
    px = _unfiltered(lines[:, 0], lines[:, 1:].reshape(h, w, n))
    rgba = np.full((h, w, 4), 255, np.uint8)
    rgba[..., :3] = px[..., :3] if n > 2 else px[..., :1]
    if n in (2, 4):
        rgba[..., 3] = px[..., -1]
    return w, h, rgba.tobytes()


def to_png(buffers: DataFrame, kinds: Sequence[int] = (0,)) -> DataFrame:
    """(image_id, png) of buffers (image_id, width, height, data)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"image_id": pdf["image_id"], "png": [encode_png(w, h, d, kinds) for w, h, d in zip(pdf["width"], pdf["height"], pdf["data"], strict=True)]})

    return buffers.select("image_id", "width", "height", "data").mapInPandas(run, "image_id long, png binary")


def _files(files: DataFrame, content: str, decode: Callable[[bytes], tuple[int, int, bytes]]) -> DataFrame:
    """(image_id, width, height, data, error): whatever is wrong with a file is that file's error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, raw in zip(pdf["image_id"], pdf[content], strict=True):
                try:
                    rows.append((i, *decode(raw or b""), None))
                except Exception as e:  # a file can be wrong in any way, and must not stop the others
                    rows.append((i, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", "data", "error"])

    return files.select("image_id", content).mapInPandas(run, "image_id long, width int, height int, data binary, error string")


def from_png(files: DataFrame) -> DataFrame:
    """(image_id, width, height, data, error): a file that can't be decoded, or is null, has an error and no data."""
    return _files(files, "png", decode_png)


def decode(raw: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA) of a file of any known format: the first frame of a GIF, the first layer of a PSD (or its empty canvas)."""
    from strata.sources import gif, jpeg, psd, webp

    if raw[:4] == b"\x89PNG" and len(raw) >= 8:
        return decode_png(raw)
    if raw[:3] == b"\xff\xd8\xff":
        return jpeg.decode_jpeg(raw)
    if raw[:4] == b"GIF8":
        frames = gif.decode_gif(raw)
        if not frames:
            raise ValueError("no frames")
        return frames[0][0], frames[0][1], frames[0][3]
    if raw[:4] == b"8BPS":
        w, h, layers = psd.decode_psd(raw)
        return (layers[0]["width"], layers[0]["height"], layers[0]["data"]) if layers else (w, h, bytes(w * h * 4))
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        return webp.decode_webp(raw)
    raise ValueError("unknown format")


def from_files(files: DataFrame, content: str = "content") -> DataFrame:
    """(image_id, width, height, data, error) of files (image_id, content) of any known format."""
    return _files(files, content, decode)


def to_flat(buffers: DataFrame) -> DataFrame:
    """(image_id, flat): width and height in four bytes each, the larger ones first, and the pixels."""
    size = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    return buffers.select("image_id", F.concat(size("width"), size("height"), "data").alias("flat"))


def from_flat(flat: DataFrame) -> DataFrame:
    """(image_id, width, height, data) of what ``to_flat`` gives."""
    size = lambda at: F.conv(F.hex(F.substring("flat", at, 4)), 16, 10).cast("int")
    return flat.select("image_id", size(1).alias("width"), size(5).alias("height"), F.substr(F.col("flat"), F.lit(9)).alias("data"))


def to_buffers(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height, data) of a pixel relation, row-major RGBA."""
    cell = F.unhex(F.concat(*[F.lpad(F.hex(c), 2, "0") for c in "rgba"]))
    rows = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.array_sort(F.collect_list(F.struct("y", "x", cell.alias("v")))).alias("p"))
    return rows.select("image_id", "width", "height", F.unhex(F.array_join(F.transform("p", lambda q: F.hex(q["v"])), "")).alias("data"))


def to_pixels(buffers: DataFrame) -> DataFrame:
    p = buffers.select("image_id", "width", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("p"))
    part = lambda i: F.conv(F.hex(F.substring(F.col("data"), F.col("p") * 4 + i, F.lit(1))), 16, 10).cast("int")
    return p.select("image_id", (F.col("p") % F.col("width")).cast("int").alias("x"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), *[part(i + 1).alias(c) for i, c in enumerate("rgba")])
