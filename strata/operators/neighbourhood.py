"""Convolution: every pixel with the pixels around it, edges repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.color import byte
from strata.operators import grids

_GAUSS5 = [1, 4, 6, 4, 1]
#: Weights, row by row.
KERNELS: dict[str, list[float]] = {
    "identity": [1.0],
    "box3": [1 / 9] * 9,
    "box5": [1 / 25] * 25,
    "gauss3": [v / 16 for v in (1, 2, 1, 2, 4, 2, 1, 2, 1)],
    "gauss5": [p * q / 256 for p in _GAUSS5 for q in _GAUSS5],
    "sharpen": [0.0, -1.0, 0.0, -1.0, 5.0, -1.0, 0.0, -1.0, 0.0],
    "edge_detect": [-1.0] * 4 + [8.0] + [-1.0] * 4,
    "emboss": [-2.0, -1.0, 0.0, -1.0, 1.0, 1.0, 0.0, 1.0, 2.0],
}


def convolve(df: DataFrame, kernel: list[float], image: str = "image_id", shape: tuple[int, int] | None = None) -> DataFrame:
    """(image, x, y, r, g, b, a) convolved; products are added in the kernel's order, and the sum is truncated.

    ``shape`` is the width and height of every image; without it they come from the largest coordinates.
    """
    return grids.per_image(df, lambda pixels, there: (grids.convolved(pixels, kernel), there), image, shape)


def box_blur(df: DataFrame, radius: int, image: str = "image_id", shape: tuple[int, int] | None = None) -> DataFrame:
    """Mean of the square around each pixel."""
    side = 2 * radius + 1
    return convolve(df, [1 / side**2] * side**2, image, shape) if radius > 0 else df


def gaussian_blur(df: DataFrame, radius: int, image: str = "image_id", shape: tuple[int, int] | None = None) -> DataFrame:
    """A kernel of its own up to a radius of 2; beyond, as many passes of the smallest, truncated in between, in one group."""
    if radius <= 0:
        return df
    kernel, passes = (KERNELS[f"gauss{2 * radius + 1}"], 1) if radius <= 2 else (KERNELS["gauss3"], radius)

    def blurred(pixels, there):
        for _ in range(passes):
            pixels = grids.convolved(pixels, kernel)
        return pixels, there

    return grids.per_image(df, blurred, image, shape)


def unsharp(df: DataFrame, strength: float, image: str = "image_id") -> DataFrame:
    """Visible pixels moved away from the mean of the visible pixels around them (themselves too) by 1.2 x strength.

    Visible pixels are sent to the nine places they touch and summed there with partial aggregates; sums are of
    integers, so their order doesn't matter.
    """
    near = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = df.where("a > 0").select(image, "x", "y", "r", "g", "b", F.explode(near).alias("t"))
    mean = sent.groupBy(image, (F.col("x") + F.col("t.dx")).alias("x"), (F.col("y") + F.col("t.dy")).alias("y")).agg(*[(F.sum(c) / F.count(F.lit(1)).cast("double")).alias(f"_{c}") for c in "rgb"])
    sharp = lambda c: byte(F.col(c) + (F.col(c) - F.col(f"_{c}")) * (min(1.0, max(0.0, strength)) * 1.2))
    return df.join(mean, [image, "x", "y"], "left").select(*[F.when(F.col("a") > 0, sharp(c)).otherwise(F.col(c)).alias(c) if c in "rgb" and len(c) == 1 else F.col(c) for c in df.columns])
