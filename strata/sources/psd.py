"""PSD files: the layers of an 8-bit RGB file, raw or run-length coded."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strata.sources.codecs import MAX_BYTES

SCHEMA = "image_id long, layer int, name string, x int, y int, width int, height int, opacity double, visible boolean, data binary, error string"


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("cut off")
        self.at += n
        return self.raw[self.at - n : self.at]

    def numbers(self, form: str) -> tuple:
        return struct.unpack(f">{form}", self.take(struct.calcsize(f">{form}")))

    def section(self) -> _Reader:
        return _Reader(self.take(self.numbers("I")[0]))


def unpack_runs(raw: bytes, size: int) -> bytes:
    """A line of bytes from runs: a count below 128 of bytes as they are, or one above of one byte repeated."""
    out, at = bytearray(), 0
    while at < len(raw) and len(out) < size:
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _channel(raw: bytes, w: int, h: int) -> np.ndarray:
    r = _Reader(raw)
    (packing,) = r.numbers("H")
    if packing == 0:
        flat = r.take(w * h)
    elif packing == 1:
        flat = b"".join(unpack_runs(r.take(n), w) for n in r.numbers(f"{h}H"))
    else:
        raise ValueError("unsupported packing")
    if len(flat) != w * h:
        raise ValueError("bad lines")
    return np.frombuffer(flat, np.uint8).reshape(h, w)


def _checked(r: _Reader, channels: int, height: int) -> None:
    """The image data at the end of the file: packing, and whether its lines are there."""
    (packing,) = r.numbers("H")
    if packing == 1:
        r.take(sum(r.numbers(f"{channels * height}H")))
    elif packing:
        raise ValueError("unsupported packing")


def decode_psd(raw: bytes) -> tuple[int, int, list[dict]]:
    """(width, height, layers bottom first); a layer without area is left out, anything unsound is a ValueError."""
    r = _Reader(raw)
    if r.take(4) != b"8BPS":
        raise ValueError("not a PSD")
    version, reserved, channels, height, width, depth, _ = r.numbers("H6sHIIHH")
    if version != 1 or any(reserved) or not 1 <= channels <= 56 or not height or not width or depth not in (8, 16):
        raise ValueError("bad header")
    if depth != 8:
        raise ValueError("unsupported depth")
    if width * height * 4 > MAX_BYTES:
        raise ValueError("image too large")
    r.section()
    r.section()
    about = r.section()
    _checked(r, channels, height)
    layers: list[dict] = []
    if len(about.raw) < 4:
        return width, height, layers
    info = about.section()
    records = []
    for _ in range(abs(info.numbers("h")[0]) if info.raw else 0):
        top, left, bottom, right, n = info.numbers("iiiiH")
        of = [info.numbers("hI") for _ in range(n)]
        mark, _, opacity, _, flags, _ = info.numbers("4s4sBBBB")
        if mark != b"8BIM":
            raise ValueError("bad layer")
        more = info.section()
        more.section()
        more.section()
        name = more.take(more.numbers("B")[0]).decode("latin-1")
        records.append((top, left, bottom - top, right - left, of, opacity, flags, name))
    for top, left, h, w, of, opacity, flags, name in records:
        planes = [(kind, info.take(n)) for kind, n in of]
        if w <= 0 or h <= 0:
            continue
        if w * h * 4 > MAX_BYTES:
            raise ValueError("image too large")
        px = np.zeros((h, w, 4), np.uint8)
        px[..., 3] = 255
        for kind, packed in planes:
            if -1 <= kind <= 2:
                px[..., kind] = _channel(packed, w, h)
        layers.append({"name": name, "x": left, "y": top, "width": w, "height": h, "opacity": opacity / 255, "visible": not flags & 2, "data": px.tobytes()})
    return width, height, layers


def from_psd(files: DataFrame, content: str = "psd") -> DataFrame:
    """One row a layer of files (image_id, psd), bottom first; a file that can't be decoded is one row with an error."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for i, raw in zip(pdf["image_id"], pdf[content], strict=True):
                try:
                    rows += [{"image_id": i, "layer": n} | x for n, x in enumerate(decode_psd(raw or b"")[2])]
                except Exception as e:  # a file can be wrong in any way, and must not stop the others
                    rows.append({"image_id": i, "error": str(e) or type(e).__name__})
            # integers with nulls in plain columns: a nullable frame would come as chunks
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})

    return files.select("image_id", content).mapInPandas(run, SCHEMA)
