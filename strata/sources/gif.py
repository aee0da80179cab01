"""GIF files: every frame as shown, one row a frame."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strata.sources.codecs import MAX_BYTES

SCHEMA = "image_id long, frame int, width int, height int, delay_ms int, data binary, error string"


def unpack_codes(data: bytes, smallest: int, most: int) -> bytes:
    """Palette indices of LZW codes of rising width, at most ``most`` of them."""
    clear, end = 1 << smallest, (1 << smallest) + 1
    words: list[bytes] = []
    out, width, held, bits, last = bytearray(), smallest + 1, 0, 0, None
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code, held, bits = held & ((1 << width) - 1), held >> width, bits - width
            if code == clear:
                words, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], smallest + 1, None
                continue
            if code == end or len(out) >= most:
                return bytes(out[:most])
            if not words:
                words = [bytes([i]) for i in range(clear)] + [b"", b""]
            if code < len(words):
                word = words[code]
            elif last is not None and code == len(words):
                word = last + last[:1]
            else:
                raise ValueError("bad code")
            if last is not None and len(words) < 4096:
                words.append(last + word[:1])
                if len(words) == 1 << width and width < 12:
                    width += 1
            out += word
            last = word
    return bytes(out[:most])


def _blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    out = bytearray()
    while raw[at]:
        out += raw[at + 1 : at + 1 + raw[at]]
        at += 1 + raw[at]
    return bytes(out), at + 1


def decode_gif(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """(width, height, delay in ms, RGBA) of every frame, drawn on what the one before left behind."""
    if raw[:4] != b"GIF8" or len(raw) < 13:
        raise ValueError("not a GIF")
    w, h, flags = struct.unpack("<HHB", raw[6:11])
    if w * h * 4 > MAX_BYTES:
        raise ValueError("image too large")

    def palette(at: int, packed: int) -> tuple[np.ndarray | None, int]:
        n = 2 << (packed & 7)
        return (np.frombuffer(raw[at : at + 3 * n], np.uint8).reshape(-1, 3), at + 3 * n) if packed & 128 else (None, at)

    shared, at = palette(13, flags)
    canvas, frames = np.zeros((h, w, 4), np.uint8), []
    delay, clear, disposal = 0, None, 0
    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21:
            data, after = _blocks(raw, at + 2)
            if raw[at + 1] == 0xF9 and len(data) >= 4:
                delay, disposal, clear = struct.unpack("<H", data[1:3])[0], data[0] >> 2 & 7, data[3] if data[0] & 1 else None
            at = after
        elif raw[at] == 0x2C:
            x, y, fw, fh, packed = struct.unpack("<HHHHB", raw[at + 1 : at + 10])
            if fw * fh * 4 > MAX_BYTES:
                raise ValueError("image too large")
            own, at = palette(at + 10, packed)
            colors = own if own is not None else shared
            codes, after = _blocks(raw, at + 1)
            index = np.frombuffer(unpack_codes(codes, raw[at], fw * fh), np.uint8)
            at = after
            if colors is None or len(index) < fw * fh or index.size and index.max() >= len(colors):
                raise ValueError("bad frame")
            index = index.reshape(fh, fw)
            if packed & 64:  # lines come in four passes
                lines = np.concatenate([np.arange(s, fh, n) for s, n in ((0, 8), (4, 8), (2, 4), (1, 2))])
                index = index[np.argsort(lines)]
            before, area = canvas.copy(), canvas[y : y + fh, x : x + fw]
            index = index[: area.shape[0], : area.shape[1]]
            seen = np.ones(index.shape, bool) if clear is None else index != clear
            area[seen] = np.concatenate([colors[index[seen]], np.full((int(seen.sum()), 1), 255, np.uint8)], axis=1)
            frames.append((w, h, delay * 10, canvas.tobytes()))
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
            delay, clear, disposal = 0, None, 0
        else:
            raise ValueError("bad block")
    return frames


def from_gif(files: DataFrame, content: str = "gif") -> DataFrame:
    """One row a frame of files (image_id, gif); a file that can't be decoded is one row with an error and no data."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, raw in zip(pdf["image_id"], pdf[content], strict=True):
                try:
                    rows += [(i, n, fw, fh, delay, data, None) for n, (fw, fh, delay, data) in enumerate(decode_gif(raw or b""))]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((i, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["image_id", "frame", "width", "height", "delay_ms", "data", "error"])

    return files.select("image_id", content).mapInPandas(run, SCHEMA)
