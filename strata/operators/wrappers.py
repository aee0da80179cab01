"""Operators on one layer's pixels, in place: the other layers' rows go through untouched.

Pixels are (layer, x, y, r, g, b, a). A layer that isn't there, or has no pixels, changes nothing. Filters on the
layer's id reach the scan on both sides, so the layer is all that is shuffled, if anything is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import analysis, filters, geometry, neighbourhood


def on_layer(pixels: DataFrame, layer_id: int, change: Callable[[DataFrame], DataFrame], layer: str = "layer_id") -> DataFrame:
    columns = [layer, "x", "y", *"rgba"]
    rest = pixels.where(F.col(layer) != layer_id).select(*columns)
    return rest.unionAll(change(pixels.where(F.col(layer) == layer_id)).select(*columns))


def _size(pixels: DataFrame, layer_id: int, layer: str) -> tuple[int, int]:
    """Width and height of the layer, 0 where it has no pixels."""
    own = pixels.where(F.col(layer) == layer_id).agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    return (0, 0) if own["x"] is None else (own["x"] + 1, own["y"] + 1)


def resize_nearest(pixels: DataFrame, layer_id: int, w: int, h: int, layer: str = "layer_id") -> DataFrame:
    size = _size(pixels, layer_id, layer)
    return on_layer(pixels, layer_id, lambda p: geometry.resize_nearest(p, *size, w, h), layer) if all(size) else pixels


def resize_bilinear(pixels: DataFrame, layer_id: int, w: int, h: int, layer: str = "layer_id") -> DataFrame:
    size = _size(pixels, layer_id, layer)
    return on_layer(pixels, layer_id, lambda p: geometry.resize_bilinear(p, *size, w, h, layer), layer) if all(size) else pixels


def resize_lanczos(pixels: DataFrame, layer_id: int, w: int, h: int, layer: str = "layer_id") -> DataFrame:
    size = _size(pixels, layer_id, layer)
    return on_layer(pixels, layer_id, lambda p: geometry.resize_lanczos(p, *size, w, h, layer), layer) if all(size) else pixels


def crop(pixels: DataFrame, layer_id: int, x: int, y: int, w: int, h: int, layer: str = "layer_id") -> DataFrame:
    return on_layer(pixels, layer_id, lambda p: geometry.crop(p, x, y, w, h, layer), layer)


def trim(pixels: DataFrame, layer_id: int, layer: str = "layer_id") -> DataFrame:
    return on_layer(pixels, layer_id, lambda p: geometry.trim(p, layer), layer)


def rotate(pixels: DataFrame, layer_id: int, degrees: float, layer: str = "layer_id") -> DataFrame:
    size = _size(pixels, layer_id, layer)
    return on_layer(pixels, layer_id, lambda p: geometry.rotate(p, *size, degrees, layer), layer) if all(size) else pixels


def box_blur(pixels: DataFrame, layer_id: int, radius: int, layer: str = "layer_id") -> DataFrame:
    return on_layer(pixels, layer_id, lambda p: neighbourhood.box_blur(p, radius, layer), layer)


def gaussian_blur(pixels: DataFrame, layer_id: int, radius: int, layer: str = "layer_id") -> DataFrame:
    return on_layer(pixels, layer_id, lambda p: neighbourhood.gaussian_blur(p, radius, layer), layer)


def _kernel(name: str):
    def run(pixels: DataFrame, layer_id: int, layer: str = "layer_id") -> DataFrame:
        return on_layer(pixels, layer_id, lambda p: neighbourhood.convolve(p, neighbourhood.KERNELS[name], layer), layer)

    return run


sharpen, edge_detect, emboss = (_kernel(k) for k in ("sharpen", "edge_detect", "emboss"))


def invert(pixels: DataFrame, layer_id: int, layer: str = "layer_id") -> DataFrame:
    return on_layer(pixels, layer_id, filters.invert, layer)


def posterize(pixels: DataFrame, layer_id: int, levels: int, layer: str = "layer_id") -> DataFrame:
    return on_layer(pixels, layer_id, lambda p: filters.posterize(p, levels), layer)


def threshold(pixels: DataFrame, layer_id: int, at: int, layer: str = "layer_id") -> DataFrame:
    return on_layer(pixels, layer_id, lambda p: filters.threshold(p, at), layer)


def levels(pixels: DataFrame, layer_id: int, in_black: int, in_white: int, gamma: float, out_black: int, out_white: int, layer: str = "layer_id") -> DataFrame:
    return on_layer(pixels, layer_id, lambda p: filters.levels(p, in_black, in_white, gamma, out_black, out_white), layer)


def gradient_map(pixels: DataFrame, layer_id: int, stops: list[tuple[float, tuple[int, int, int]]], layer: str = "layer_id") -> DataFrame:
    return on_layer(pixels, layer_id, lambda p: filters.gradient_map(p, stops), layer)


def quantize(pixels: DataFrame, layer_id: int, palette: list[tuple[int, int, int]], layer: str = "layer_id") -> DataFrame:
    return on_layer(pixels, layer_id, lambda p: analysis.quantize(p, palette), layer)


def bucket_fill(pixels: DataFrame, layer_id: int, x: int, y: int, color: tuple[int, int, int, int], contiguous: bool = True, tolerance: int = 0, locked: bool = False, layer: str = "layer_id") -> DataFrame:
    """In the layer's own coordinates; a start beside the layer changes nothing."""
    fill = analysis.fill_region if contiguous else analysis.fill_all
    return on_layer(pixels, layer_id, lambda p: fill(p, x, y, color, tolerance, layer, locked), layer)


def paint(pixels: DataFrame, layer_id: int, points: DataFrame, brush, locked: bool = False, layer: str = "layer_id") -> DataFrame:
    """A stroke of points (stroke_id, seq, x, y, pressure, …) on the layer, in its own coordinates; all strokes of ``points`` in the order of their ids."""
    from strata.operators import brush as B

    dabs = B.dabs(B.stamps(points, brush), brush).select(F.lit(layer_id).alias(layer), F.struct("stroke_id", "n").alias("n"), "x", "y", "alpha")
    return on_layer(pixels, layer_id, lambda p: B.paint(p, dabs, brush, layer, locked), layer)
