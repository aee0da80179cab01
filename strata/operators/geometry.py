"""Geometry as projections of coordinates. Sizes are those of the whole image (every pixel has a row)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.color import byte, lit
from strata.operators import grids


def flip(df: DataFrame, w: int, h: int, across_x: bool = False, across_y: bool = False) -> DataFrame:
    return df.withColumns({"x": F.lit(w - 1) - F.col("x") if across_x else F.col("x"), "y": F.lit(h - 1) - F.col("y") if across_y else F.col("y")})


def rotate90(df: DataFrame, w: int, h: int, quarter_turns: int) -> DataFrame:
    """Clockwise quarter turns."""
    x, y = F.col("x"), F.col("y")
    to = [(x, y), (F.lit(h - 1) - y, x), (F.lit(w - 1) - x, F.lit(h - 1) - y), (y, F.lit(w - 1) - x)][quarter_turns % 4]
    return df.withColumns({"x": to[0], "y": to[1]})


def crop(df: DataFrame, x: int, y: int, w: int, h: int, image: str = "image_id") -> DataFrame:
    """A w by h window; what lies outside the image is transparent."""
    inside = df.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})
    cells = df.select(image).distinct().select(image, F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("p")) if w * h else df.select(image, F.lit(0).alias("p")).limit(0)
    grid = cells.select(image, (F.col("p") % w).cast("int").alias("x"), F.floor(F.col("p") / w).cast("int").alias("y"))
    return grid.join(inside, [image, "x", "y"], "left").select(image, "x", "y", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgba"])


def _targets(at: Column, old: int, new: int) -> Column:
    """The new coordinates that nearest sampling takes from an old one."""
    takers: list[list[int]] = [[] for _ in range(old)]
    for i in range(new):
        takers[min(old - 1, int((i + 0.5) * old / new))].append(i)
    return F.element_at(F.array(*[F.array(*[F.lit(i) for i in t]).cast("array<int>") for t in takers]), at + 1)


def resize_nearest(df: DataFrame, w: int, h: int, new_w: int, new_h: int) -> DataFrame:
    """Each pixel is copied to the places that sample it: two generators, no join and no shuffle."""
    rest = [c for c in df.columns if c not in "xy"]
    wide = df.withColumn("_x", F.explode(_targets(F.col("x"), w, new_w)))
    return wide.withColumn("_y", F.explode(_targets(F.col("y"), h, new_h))).select(*rest, F.col("_x").alias("x"), F.col("_y").alias("y"))


def pixel_scale(df: DataFrame, factor: int) -> DataFrame:
    steps = F.sequence(F.lit(0), F.lit(max(1, factor) - 1))
    out = df.withColumn("_x", F.explode(steps)).withColumn("_y", F.explode(steps))
    return out.withColumns({"x": F.col("x") * max(1, factor) + F.col("_x"), "y": F.col("y") * max(1, factor) + F.col("_y")}).drop("_x", "_y")


def _resampled(df: DataFrame, w: int, h: int, weights: list[np.ndarray | None], between: bool, image: str) -> DataFrame:
    """Every image through matrices of weights (new by old) of its columns and rows; truncated to bytes, in ``between`` too where asked for."""
    across, down = weights
    size = (h if down is None else len(down), w if across is None else len(across))

    def change(pixels, there):
        out = pixels.astype(np.float64)
        for k, m in enumerate((across, down)):
            if m is not None:
                out = np.einsum("nw,hwc->hnc" if not k else "nh,hwc->nwc", m, out, optimize=True)
                if between or k:
                    out = np.clip(np.floor(np.round(out, 6)), 0, 255)
        return np.clip(np.floor(np.round(out, 6)), 0, 255).astype(np.uint8), np.ones(size, bool)

    return grids.per_image(df, change, image, (w, h))


def bilinear_weights(old: int, new: int) -> np.ndarray:
    at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0.0, old - 1.0)
    low = at.astype(np.int64)
    out = np.zeros((new, old))
    np.add.at(out, (np.arange(new), low), 1 - (at - low))
    np.add.at(out, (np.arange(new), np.minimum(low + 1, old - 1)), at - low)
    return out


def resize_bilinear(df: DataFrame, w: int, h: int, new_w: int, new_h: int, image: str = "image_id") -> DataFrame:
    """Four-tap interpolation of every channel."""
    return _resampled(df, w, h, [bilinear_weights(w, new_w), bilinear_weights(h, new_h)], False, image)


def _lanczos(x: float) -> float:
    """Windowed sinc with three lobes."""
    if abs(x) >= 3:
        return 0.0
    return 1.0 if abs(x) < 1e-10 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3)


def lanczos_weights(old: int, new: int) -> list[dict[int, float]]:
    """For each old coordinate, the new ones that read it and their shares; taps beyond the edge read the edge."""
    takers: list[dict[int, float]] = [{} for _ in range(old)]
    for i in range(new):
        c = (i + 0.5) * old / new - 0.5
        taps = [(min(max(k, 0), old - 1), _lanczos(c - k)) for k in range(math.ceil(c - 3), math.floor(c + 3) + 1)]
        total = sum(w for _, w in taps)
        for k, w in taps:
            takers[k][i] = takers[k].get(i, 0.0) + w / total
    return takers


def resize_lanczos(df: DataFrame, w: int, h: int, new_w: int, new_h: int, image: str = "image_id") -> DataFrame:
    """Rows, then columns, truncated to bytes in between; a length that stays is not resampled."""

    def matrix(old: int, new: int) -> np.ndarray | None:
        if old == new:
            return None
        out = np.zeros((new, old))
        for k, takers in enumerate(lanczos_weights(old, new)):
            for i, v in takers.items():
                out[i, k] = v
        return out

    return _resampled(df, w, h, [matrix(w, new_w), matrix(h, new_h)], True, image)


def turned_size(w: int, h: int, degrees: float) -> tuple[int, int]:
    """Size of the box around a turned image."""
    co, si = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    xs, ys = zip(*[((px - w / 2) * co - (py - h / 2) * si + w / 2, (px - w / 2) * si + (py - h / 2) * co + h / 2) for px in (0, w) for py in (0, h)], strict=True)
    return math.ceil(max(xs) - min(xs)), math.ceil(max(ys) - min(ys))


def rotate(df: DataFrame, w: int, h: int, degrees: float, image: str = "image_id") -> DataFrame:
    """Turned clockwise about the centre with four-tap sampling; every pixel of the new box, clear where nothing lands."""
    size = turned_size(w, h, degrees)

    def change(pixels, there):
        out = grids.turned(pixels, degrees, size)
        return out, np.ones(out.shape[:2], bool)

    return grids.per_image(df, change, image, (w, h))


def trim(df: DataFrame, image: str = "image_id") -> DataFrame:
    """The box of the visible pixels, moved to the origin; an image without any has no rows left."""
    live = F.col("a") > 0
    box = df.groupBy(image).agg(*[f(F.when(live, F.col(c))).alias(f"_{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"])
    inside = df.join(box, image).where(F.col("x").between(F.col("_lox"), F.col("_hix")) & F.col("y").between(F.col("_loy"), F.col("_hiy")))
    return inside.withColumns({c: F.col(c) - F.col(f"_lo{c}") for c in "xy"}).select(*df.columns)


def scaled(length: int, scale: float) -> int:
    """Rounded half up, one at least."""
    return max(1, math.floor(length * abs(scale) + 0.5))


def transform(df: DataFrame, w: int, h: int, flip_x: bool = False, flip_y: bool = False, scale_x: float = 1.0, scale_y: float = 1.0, degrees: float = 0.0, image: str = "image_id") -> tuple[DataFrame, int, int]:
    """Flip, scale, then turn; the image and its new size. Steps that change nothing add nothing to the plan."""
    if flip_x or flip_y:
        df = flip(df, w, h, flip_x, flip_y)
    new_w, new_h = scaled(w, scale_x), scaled(h, scale_y)
    if (new_w, new_h) != (w, h):
        df, w, h = resize_bilinear(df, w, h, new_w, new_h, image), new_w, new_h
    if abs(degrees) > 2.0**-52:
        df, (w, h) = rotate(df, w, h, degrees, image), turned_size(w, h, degrees)
    return df, w, h


def fit(w: Column, h: Column, max_w: Column, max_h: Column) -> tuple[Column, Column]:
    """The largest size within a box at the same proportions, never enlarged and one at least; 0 if any length is 0."""
    none = (w <= 0) | (h <= 0) | (max_w <= 0) | (max_h <= 0)
    safe = lambda v: F.greatest(v, F.lit(1)).cast("double")
    s = F.least(max_w / safe(w), max_h / safe(h), lit(1))
    return tuple(F.when(none, 0).otherwise(F.greatest(F.lit(1), F.floor(v * s + 0.5))).cast("int") for v in (w, h))


def quarter(degrees: Column) -> Column:
    """The nearest quarter turn, 0 to 270; halves go away from zero."""
    turns = F.signum(degrees) * F.floor(F.abs(degrees) / 90.0 + 0.5)
    return ((turns.cast("int") * 90) % 360 + 360) % 360


def corner(position: Column, size: Column, centred: Column) -> Column:
    """Top or left of a layer from its position, which is its centre or its corner."""
    v = position - size / 2.0
    return F.when(centred, F.signum(v) * F.floor(F.abs(v) + 0.5)).otherwise(position).cast("int")
