"""Whole images as arrays, one group an image: for what reads the pixels around each pixel.

An image's rows meet in one task by one shuffle and leave it as rows again; no pixel is sent to its neighbours and no
pixels are joined. An image is bounded (``MAX_BYTES``, the limit that decoding has too), so a group is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

MAX_BYTES = 512 << 20


def per_image(df: DataFrame, change: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], image: str = "image_id", shape: tuple[int, int] | None = None) -> DataFrame:
    """(image, x, y, r, g, b, a): every image after ``change``, from its pixels (h, w, 4) and which of them have rows to new ones.

    ``shape`` is the width and height of every image; without it they come from the largest coordinates. Rows beyond
    it, or at negative coordinates, are left out.
    """
    names = [image, "x", "y", *"rgba"]

    def run(rows: pa.Table) -> pa.Table:
        x, y = (rows.column(c).to_numpy().astype(np.int64) for c in "xy")
        w, h = shape or (int(x.max()) + 1, int(y.max()) + 1)
        if w * h * 4 > MAX_BYTES:
            raise ValueError(f"an image of {w} by {h} is too large")
        inside = (x >= 0) & (y >= 0) & (x < w) & (y < h)
        x, y = x[inside], y[inside]
        pixels, there = np.zeros((max(h, 0), max(w, 0), 4), np.uint8), np.zeros((max(h, 0), max(w, 0)), bool)
        pixels[y, x] = np.stack([rows.column(c).to_numpy()[inside] for c in "rgba"], axis=1)
        there[y, x] = True
        pixels, there = change(pixels, there)
        y, x = np.nonzero(there)
        key = pa.repeat(rows.column(image)[0], len(x))
        return pa.table([key, pa.array(x, pa.int32()), pa.array(y, pa.int32()), *(pa.array(pixels[y, x, i], pa.int32()) for i in range(4))], names)

    schema = StructType([StructField(image, df.schema[image].dataType), *(StructField(c, IntegerType()) for c in names[1:])])
    return df.select(*names).groupBy(image).applyInArrow(run, schema)


def convolved(pixels: np.ndarray, kernel: list[float]) -> np.ndarray:
    """Colours summed in the kernel's order and truncated, edges repeated; clear pixels stay as they are."""
    side = int(len(kernel) ** 0.5)
    half, (h, w, _) = side // 2, pixels.shape
    wide = np.pad(pixels[..., :3], ((half, half), (half, half), (0, 0)), mode="edge").astype(np.float64) if pixels.size else pixels[..., :3].astype(np.float64)
    total = np.zeros((h, w, 3))
    for i, weight in enumerate(kernel if pixels.size else ()):
        if weight:
            total += wide[i // side : i // side + h, i % side : i % side + w] * weight
    out = pixels.copy()
    live = pixels[..., 3] > 0
    out[live, :3] = np.clip(np.floor(total), 0, 255).astype(np.uint8)[live]
    return out


def turned(pixels: np.ndarray, degrees: float, size: tuple[int, int]) -> np.ndarray:
    """Turned clockwise about the centre onto a canvas of the size (width, height), by four taps."""
    (h, w, _), (new_w, new_h) = pixels.shape, size
    out = np.zeros((new_h, new_w, 4), np.uint8)
    if not pixels.size:
        return out
    co, si = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    rx, ry = np.arange(new_w)[None, :] - new_w / 2, np.arange(new_h)[:, None] - new_h / 2
    fx, fy = rx * co + ry * si + w / 2, rx * -si + ry * co + h / 2
    j, i = np.nonzero((fx >= -0.5) & (fx <= w - 0.5) & (fy >= -0.5) & (fy <= h - 0.5))
    fx, fy = fx[j, i], fy[j, i]
    dx, dy = (fx - np.floor(fx))[:, None], (fy - np.floor(fy))[:, None]
    x0, y0 = np.clip(np.floor(fx).astype(np.int64), 0, w - 1), np.clip(np.floor(fy).astype(np.int64), 0, h - 1)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    total = np.zeros((len(i), 4))
    for y, v in ((y0, 1 - dy), (y1, dy)):
        for x, u in ((x0, 1 - dx), (x1, dx)):
            total += pixels[y, x].astype(np.float64) * u * v
    out[j, i] = np.clip(np.floor(np.round(total, 6)), 0, 255).astype(np.uint8)
    return out


def region(like: np.ndarray, x: int, y: int) -> np.ndarray:
    """Places that sides shared by places in ``like`` connect to (x, y), by labels that halve the way at every step."""
    h, w = like.shape
    if not (0 <= x < w and 0 <= y < h and like[y, x]):
        return np.zeros_like(like)
    at = np.arange(h * w).reshape(h, w)
    right, below = like[:, 1:] & like[:, :-1], like[1:] & like[:-1]
    a = np.concatenate([at[:, :-1][right], at[:-1][below]])
    b = np.concatenate([at[:, 1:][right], at[1:][below]])
    low = np.arange(h * w)
    while True:
        new, m = low.copy(), np.minimum(low[a], low[b])
        for side in (low[a], low[b]):
            np.minimum.at(new, side, m)
        while not np.array_equal(further := new[new], new):
            new = further
        if np.array_equal(new, low):
            return (low == low[y * w + x]).reshape(h, w) & like
        low = new
