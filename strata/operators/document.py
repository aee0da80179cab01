"""A document's layer tree, compiled to one plan for any number of documents that share it.

Every leaf (an image or a mask) is a relation (doc_id, x, y, r, g, b, a). Leaves are tagged and united, one hash
aggregate by (doc_id, x, y) turns them into columns, and the tree becomes projections over those columns: layers from
bottom to top, groups on canvases of their own, filters on what lies below them. Only sharpening reads other pixels
and shuffles again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators import filters, geometry, neighbourhood, shapes
from strata.operators.compose import mixed_onto, pack, unpack

KEYS = ["doc_id", "x", "y"]


@dataclass(frozen=True)
class Layer:
    """``kind`` is image, paint, text, svg, shape, solid, gradient, filter or group. A filter uses only its knobs, sharpening and visibility.

    ``pixels`` are an image's, a paint layer's, a text's (functions.text.raster) or what an SVG was drawn to (none: it
    is clear), placed on the canvas already or moved there by (x, y); ``shape`` is what a shape layer draws. Both are
    flipped, scaled and turned first, for which pixels need their ``size`` (width, height); (x, y) is the top left
    corner of the result, or its centre. ``fill`` is a solid's colour or a gradient's stops; ``mask`` scales alpha by
    its red channel where it has pixels, in canvas coordinates.
    """

    kind: str
    pixels: DataFrame | None = None
    x: int = 0
    y: int = 0
    fill: tuple = (0, 0, 0, 0)
    direction: str = "horizontal"
    opacity: float = 1.0
    visible: bool = True
    mode: str = "normal"
    clip_to_below: bool = False
    mask: DataFrame | None = None
    mask_inverted: bool = False
    knobs: filters.Adjust = filters.Adjust()
    sharpen: float = 0.0
    children: tuple[Layer, ...] = ()
    shape: Shape | None = None
    size: tuple[int, int] | None = None
    anchor: str = "top-left"
    flip_x: bool = False
    flip_y: bool = False
    scale_x: float = 1.0
    scale_y: float = 1.0
    degrees: float = 0.0


@dataclass(frozen=True)
class Shape:
    """``kind`` is rectangle, ellipse, line or polygon; without a fill or a stroke that part isn't drawn."""

    kind: str
    w: int
    h: int
    radius: int = 0
    fill: tuple[int, int, int, int] | None = None
    stroke: tuple[int, int, int, int] | None = None
    stroke_width: int = 1
    points: tuple[tuple[int, int], ...] = ()


#: Kinds with pixels of their own.
PIXELS = ("image", "paint", "text", "svg")


def _drawn(documents: DataFrame, shape: Shape) -> DataFrame:
    """A shape's pixels in every document, at the origin."""
    w, h, stroke = max(1, shape.w), max(1, shape.h), max(1, shape.stroke_width) if shape.stroke else 0
    at = documents.select(F.col("doc_id").alias("shape"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    if shape.kind == "rectangle":
        parts = shapes.rectangle(at, stroke, shape.radius)
    elif shape.kind == "ellipse":
        parts = shapes.ellipse(at, stroke)
    elif shape.kind == "line":
        parts = shapes.line(at, stroke)
    elif shape.kind == "polygon":
        corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in shape.points]).cast("array<struct<x:int,y:int>>")
        parts = shapes.polygon(at.withColumn("points", corners), stroke)
    else:
        raise ValueError(f"no such shape: {shape.kind}")
    colors = {k: c for k, c in (("fill", shape.fill), ("stroke", shape.stroke)) if c}
    value = lambda i: F.when(F.col("part") == "fill", colors.get("fill", (0,) * 4)[i]).otherwise(colors.get("stroke", (0,) * 4)[i])
    return parts.where(F.col("part").isin(*colors)).select(F.col("shape").alias("doc_id"), "x", "y", *[value(i).alias(c) for i, c in enumerate("rgba")])


def _placed(layer: Layer, documents: DataFrame) -> DataFrame | None:
    """The layer's pixels on the canvas."""
    if layer.kind == "shape":
        px, size = _drawn(documents, layer.shape), (max(1, layer.shape.w), max(1, layer.shape.h))
    else:
        px, size = layer.pixels, layer.size
    if px is None:
        return None
    x, y, changed = layer.x, layer.y, layer.flip_x or layer.flip_y or layer.scale_x != 1 or layer.scale_y != 1 or layer.degrees
    if (changed or layer.anchor == "center") and size is None:
        raise ValueError("pixels that are transformed or centred need their size")
    if changed:
        if (layer.scale_x, layer.scale_y, layer.degrees) != (1, 1, 0):  # resampling needs a row for every pixel
            px = _whole(px, documents, *size)
        px, *size = geometry.transform(px, *size, layer.flip_x, layer.flip_y, layer.scale_x, layer.scale_y, layer.degrees, "doc_id")
    if layer.anchor == "center":
        x, y = (_away(v - s / 2) for v, s in zip((x, y), size, strict=True))
    return px.withColumns({"x": F.col("x") + x, "y": F.col("y") + y}) if x or y else px


def _away(v: float) -> int:
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def _whole(px: DataFrame, documents: DataFrame, w: int, h: int) -> DataFrame:
    cells = documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("p")).select("doc_id", (F.col("p") % w).cast("int").alias("x"), F.floor(F.col("p") / w).cast("int").alias("y"))
    return cells.join(px, KEYS, "left").select(*KEYS, *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgba"])


def _leaves(layers: tuple[Layer, ...], documents: DataFrame, path: str = "l") -> Iterator[tuple[str, DataFrame]]:
    """Leaf relations of visible layers, with the names of their columns."""
    for i, layer in enumerate(layers):
        name = f"{path}{i}"
        if not layer.visible or layer.kind == "filter":
            continue
        if layer.kind in (*PIXELS, "shape") and (px := _placed(layer, documents)) is not None:
            yield name, px
        if layer.mask is not None:
            yield f"{name}m", layer.mask
        yield from _leaves(layer.children, documents, f"{name}_")


def _scaled(alpha: Column, level: Column | int) -> Column:
    return F.floor((alpha * level + 127) / 255).cast("int")


def _filtered(df: DataFrame, layer: Layer, at: str) -> DataFrame:
    """The filter's knobs on the composite in the columns with prefix ``at``: colour and alpha, sharpening, then tone."""
    out = df.withColumnsRenamed({f"{at}{c}": c for c in "rgba"})
    rest = dict(brightness=0.0, contrast=0.0, temperature=0.0, tint=0.0)
    if layer.sharpen > 0:
        out = filters.adjust(out, replace(layer.knobs, **rest))
        out = neighbourhood.unsharp(out, layer.sharpen, "doc_id")
        out = filters.adjust(out, replace(layer.knobs, hue=0.0, saturation=0.0, lightness=0.0, alpha=0.0))
    else:
        out = filters.adjust(out, layer.knobs)
    return out.withColumnsRenamed({c: f"{at}{c}" for c in "rgba"})


def _gradient(layer: Layer, w: int, h: int) -> dict[str, Column]:
    return shapes.gradient_at(F.col("x"), F.col("y"), F.lit(w), F.lit(h), list(layer.fill), layer.direction)


def _fold(df: DataFrame, layers: tuple[Layer, ...], at: str, path: str, w: int, h: int, isolated: bool) -> DataFrame:
    """Composite layers into the columns {at}r, {at}g, {at}b and {at}a; {at}k is the alpha that the next one clips to."""
    df = df.withColumns({f"{at}{c}": F.lit(0) for c in "rgbak"})
    late = []
    for i, layer in enumerate(layers):
        if not layer.visible:
            continue
        name, s = f"{path}{i}", f"{at}s"
        if layer.kind == "filter":
            if isolated:  # a group's filters see all of its layers
                late.append(layer)
            else:
                df = _filtered(df, layer, at).withColumn(f"{at}k", F.col(f"{at}a"))
            continue
        if layer.kind == "group":
            df = _fold(df, layer.children, s, f"{name}_", w, h, True)
            got = {c: F.col(f"{s}{c}") for c in "rgba"}
        elif layer.kind in (*PIXELS, "shape"):
            got = unpack(F.coalesce(F.col(name), F.lit(0))) if name in df.columns else {c: F.lit(0) for c in "rgba"}
        elif layer.kind == "solid":
            got = {c: F.lit(v) for c, v in zip("rgba", layer.fill, strict=True)}
        elif layer.kind == "gradient":
            got = _gradient(layer, w, h)
        else:
            raise ValueError(f"no such kind of layer: {layer.kind}")
        df = df.withColumns({f"{s}{c}": got[c] for c in "rgba"})
        a = F.col(f"{s}a")
        if layer.opacity < 1:
            a = _scaled(a, int(max(0.0, layer.opacity) * 255 + 0.5))
        if layer.mask is not None:
            red = unpack(F.col(f"{name}m"))["r"]
            a = F.when(F.col(f"{name}m").isNull(), a).otherwise(_scaled(a, F.lit(255) - red if layer.mask_inverted else red))
        if layer.clip_to_below:
            a = _scaled(a, F.col(f"{at}k"))
        df = df.withColumn(f"{s}a", a)
        df = mixed_onto(df, at, s, layer.mode).withColumn(f"{at}k", F.col(f"{s}a")).drop(*[f"{s}{c}" for c in "rgbak"])
    for layer in late:
        df = _filtered(df, layer, at)
    return df


def render(documents: DataFrame, layers: tuple[Layer, ...], w: int, h: int) -> DataFrame:
    """(doc_id, x, y, r, g, b, a): every pixel of a w by h canvas for every document (doc_id); the tree is the same for all."""
    spots = documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("p")) if w * h else documents.select("doc_id", F.lit(0).alias("p")).where("false")
    cells = spots.select("doc_id", (F.col("p") % w).cast("int").alias("x"), F.floor(F.col("p") / max(w, 1)).cast("int").alias("y"))
    tagged, names = cells.select(*KEYS, F.lit(-1).alias("_z"), F.lit(0).cast("long").alias("_p")), []
    for name, leaf in _leaves(layers, documents):
        inside = leaf.where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
        tagged = tagged.unionAll(inside.select(*KEYS, F.lit(len(names)).alias("_z"), pack(*[F.col(c) for c in "rgba"]).alias("_p")))
        names.append(name)
    if names:  # a pixel of no document has no canvas cell and goes
        wide = tagged.groupBy(*KEYS).agg(F.max(F.when(F.col("_z") == -1, 1)).alias("_cell"), *[F.max(F.when(F.col("_z") == z, F.col("_p"))).alias(n) for z, n in enumerate(names)])
        wide = wide.where("_cell = 1").drop("_cell")
    else:
        wide = cells
    return _fold(wide, layers, "c", "l", w, h, False).select(*KEYS, *[F.col(f"c{c}").alias(c) for c in "rgba"])


def flattened(documents: DataFrame, group: Layer, w: int, h: int) -> Layer:
    """The group as one image at the origin; what it has in common with other layers stays as it is."""
    inner = replace(group, opacity=1.0, visible=True, mode="normal", clip_to_below=False, mask=None)
    return replace(group, kind="image", pixels=render(documents, (inner,), w, h), x=0, y=0, children=())
