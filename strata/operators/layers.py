"""The layer table: one row a layer, of any number of documents, and edits of it as DataFrame operations.

A layer is named by (doc_id, layer_id); layer ids need only be unique within a document, so an edit of a layer id
applies to every document that has it. ``idx`` is the place among siblings, bottom first. Setters of a layer that
isn't there, or of a field that its kind doesn't have, change nothing. Payloads (pixels, masks, fills, shapes, texts,
markup, filter knobs) are columns, so an edit that doesn't touch them never reads them from Parquet.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.blend import MODES
from strata.sources.shared import checkpointed

KNOBS = ["hue", "saturation", "lightness", "alpha", "brightness", "contrast", "temperature", "tint", "sharpen"]
DDL = (
    "doc_id long, layer_id long, parent_id long, idx int, kind string, name string, visible boolean, opacity double, x int, y int, w int, h int, "
    "anchor string, flip_x boolean, flip_y boolean, rotation double, scale_x double, scale_y double, blend_mode string, clip_to_below boolean, "
    "mask binary, mask_w int, mask_h int, mask_inverted boolean, alpha_locked boolean, rgba binary, "
    "fill array<struct<position:double,r:int,g:int,b:int,a:int>>, direction string, "
    f"filter struct<{','.join(f'{k}:double' for k in KNOBS)}>, "
    "shape struct<type:string,radius:int,fill:array<int>,stroke:array<int>,stroke_width:int,points:array<struct<x:int,y:int>>>, "
    "text struct<text:string,color:array<int>,family:string,weight:int,style:string,size:int,line_height:int,letter_spacing:int,align:string,wrap:boolean,box_width:int>, "
    "svg string"
)
#: Kinds that have a transform, and so an extent.
TRANSFORMED = ["raster", "shape", "text", "svg"]
DIRECTIONS = ["horizontal", "vertical", "diagonal_down", "diagonal_up"]
_DEFAULTS = {"visible": True, "opacity": 1.0, "x": 0, "y": 0, "blend_mode": "normal", "clip_to_below": False, "mask_inverted": False, "anchor": "top-left", "flip_x": False, "flip_y": False, "rotation": 0.0, "scale_x": 1.0, "scale_y": 1.0, "alpha_locked": False}
_TINY = 2.0**-52


def blend_mode(name: str) -> str:
    """A mode by its name in any spelling; an unknown one is normal."""
    plain = re.sub("[-_ ]", "", name.lower())
    return next((m for m in MODES if m.replace("-", "") == plain), "normal")


def _put(layers: DataFrame, layer_id: int, kinds: Sequence[str] | None = None, **fields) -> DataFrame:
    hit = F.col("layer_id") == layer_id
    if kinds:
        hit = hit & F.col("kind").isin(*kinds)
    types = dict(layers.dtypes)
    new = {c: F.when(hit, (v if isinstance(v, Column) else F.lit(v)).cast(types[c])).otherwise(F.col(c)) for c, v in fields.items()}
    return layers.withColumns(new)


def set_opacity(layers: DataFrame, layer_id: int, opacity: float) -> DataFrame:
    return _put(layers, layer_id, opacity=min(1.0, max(0.0, opacity)))


def set_visible(layers: DataFrame, layer_id: int, visible: bool) -> DataFrame:
    return _put(layers, layer_id, visible=visible)


def set_position(layers: DataFrame, layer_id: int, x: int, y: int) -> DataFrame:
    return _put(layers, layer_id, x=x, y=y)


def set_blend_mode(layers: DataFrame, layer_id: int, mode: str) -> DataFrame:
    return _put(layers, layer_id, blend_mode=blend_mode(mode))


def set_mask(layers: DataFrame, layer_id: int, rgba: bytes, w: int, h: int) -> DataFrame:
    """The mask's red channel scales alpha; bytes of another length than the size asks for change nothing."""
    return _put(layers, layer_id, mask=bytes(rgba), mask_w=w, mask_h=h) if len(rgba) == w * h * 4 else layers


def remove_mask(layers: DataFrame, layer_id: int) -> DataFrame:
    """Without a mask; whether masks are inverted stays."""
    return _put(layers, layer_id, mask=None, mask_w=None, mask_h=None)


def set_mask_inverted(layers: DataFrame, layer_id: int, inverted: bool) -> DataFrame:
    return _put(layers, layer_id, mask_inverted=inverted)


def set_clip_to_below(layers: DataFrame, layer_id: int, clip: bool) -> DataFrame:
    return _put(layers, layer_id, clip_to_below=clip)


def set_alpha_locked(layers: DataFrame, layer_id: int, locked: bool) -> DataFrame:
    return _put(layers, layer_id, ["raster"], alpha_locked=locked)


def set_flip(layers: DataFrame, layer_id: int, flip_x: bool, flip_y: bool) -> DataFrame:
    return _put(layers, layer_id, TRANSFORMED, flip_x=flip_x, flip_y=flip_y)


def set_rotation(layers: DataFrame, layer_id: int, degrees: float) -> DataFrame:
    return _put(layers, layer_id, TRANSFORMED, rotation=degrees)


def set_anchor(layers: DataFrame, layer_id: int, anchor: int) -> DataFrame:
    """1 is the centre, anything else the top left corner."""
    return _put(layers, layer_id, TRANSFORMED, anchor="center" if anchor == 1 else "top-left")


def set_filter_config(layers: DataFrame, layer_id: int, **knobs: float) -> DataFrame:
    """All nine knobs; those not named are at rest."""
    return _put(layers, layer_id, ["filter"], filter=F.struct(*[F.lit(float(knobs.get(k, 0.0))).alias(k) for k in KNOBS]))


def updated(layers: DataFrame, layer_id: int, **patch) -> DataFrame:
    """A sparse patch: fields of layers, knobs of filters as ``filter={…}``, fields of texts as ``text={…}``."""
    known = dict.fromkeys(["name", "visible", "opacity", "x", "y", "blend_mode", "mask_inverted", "clip_to_below"]) | {"alpha_locked": ["raster"]} | dict.fromkeys(["anchor", "flip_x", "flip_y", "rotation", "scale_x", "scale_y"], TRANSFORMED)
    limit = {"opacity": lambda v: min(1.0, max(0.0, v)), "blend_mode": blend_mode, "scale_x": lambda v: max(abs(v), _TINY), "scale_y": lambda v: max(abs(v), _TINY)}
    least = {"weight": 1, "size": 1, "line_height": 1, "box_width": 1}
    for field, value in patch.items():
        if value is None:
            continue
        if field in ("filter", "text"):
            type_ = layers.schema[field].dataType
            new = []
            for f in type_.fields:
                v = value.get(f.name)
                v = max(least[f.name], v) if v is not None and f.name in least else v
                new.append((F.col(field).getField(f.name) if v is None else F.lit(v).cast(f.dataType)).alias(f.name))
            layers = _put(layers, layer_id, [field], **{field: F.struct(*new)})
        elif field in known:
            layers = _put(layers, layer_id, known[field], **{field: limit.get(field, lambda v: v)(value)})
        else:
            raise ValueError(f"layers have no field {field} that can be patched")
    return layers


def added(layers: DataFrame, documents: DataFrame, kind: str, name: str, parent_id: int | None = None, **payload) -> DataFrame:
    """The tables' layers and a new one on top of every document (doc_id[, next_id]), or as the last child of a group.

    Its id is one above the document's largest (or ``next_id``, if that is more). A parent that isn't a group of one
    of the documents is an error.
    """
    slim = layers.select("doc_id", "layer_id", "parent_id", "kind")
    if parent_id is not None and not documents.select("doc_id").join(slim.where((F.col("layer_id") == parent_id) & (F.col("kind") == "group")), "doc_id", "left_anti").isEmpty():
        raise ValueError(f"no group {parent_id} in every document")
    here = F.col("parent_id").eqNullSafe(F.lit(parent_id).cast("long"))
    about = slim.groupBy("doc_id").agg(F.max("layer_id").alias("_last"), F.count(F.when(here, 1)).alias("_n"))
    start = F.col("next_id") if "next_id" in documents.columns else F.lit(1)
    place = documents.join(about, "doc_id", "left").select("doc_id", F.greatest(start.cast("long"), F.coalesce(F.col("_last") + 1, F.lit(1).cast("long"))).alias("_id"), F.coalesce("_n", F.lit(0)).alias("_n"))
    given = _DEFAULTS | {"kind": kind, "name": name} | payload
    fixed = {"layer_id": F.col("_id"), "parent_id": F.lit(parent_id), "idx": F.col("_n")}
    value = lambda c: given[c] if isinstance(given.get(c), Column) else F.lit(given.get(c))
    new = place.select(*[(F.col("doc_id") if f.name == "doc_id" else fixed.get(f.name, value(f.name) if f.name not in fixed else None)).cast(f.dataType).alias(f.name) for f in layers.schema.fields])
    return layers.unionByName(new)


def add_image(layers: DataFrame, documents: DataFrame, name: str, rgba: bytes, w: int, h: int, x: int = 0, y: int = 0, parent_id: int | None = None) -> DataFrame:
    if len(rgba) != w * h * 4:
        raise ValueError(f"{len(rgba)} bytes are no {w} by {h} RGBA image")
    return added(layers, documents, "raster", name, parent_id, rgba=bytes(rgba), w=w, h=h, x=x, y=y)


def add_paint(layers: DataFrame, documents: DataFrame, name: str, w: int, h: int, parent_id: int | None = None) -> DataFrame:
    """A clear raster."""
    clear = F.unhex(F.repeat(F.lit("00000000"), F.lit(w * h)))
    return added(layers, documents, "raster", name, parent_id, rgba=clear, w=w, h=h)


def add_filter(layers: DataFrame, documents: DataFrame, name: str, parent_id: int | None = None) -> DataFrame:
    """A filter with all knobs at rest."""
    return added(layers, documents, "filter", name, parent_id, filter=F.struct(*[F.lit(0.0).alias(k) for k in KNOBS]))


def add_group(layers: DataFrame, documents: DataFrame, name: str, parent_id: int | None = None) -> DataFrame:
    return added(layers, documents, "group", name, parent_id)


def _stops(stops: Sequence[tuple[float, tuple[int, int, int, int]]]) -> Column:
    one = lambda p, c: F.struct(F.lit(float(p)).alias("position"), *[F.lit(v).alias(k) for k, v in zip("rgba", c, strict=True)])
    return F.array(*[one(p, c) for p, c in stops])


def add_solid(layers: DataFrame, documents: DataFrame, name: str, color: tuple[int, int, int, int], parent_id: int | None = None) -> DataFrame:
    return added(layers, documents, "solid", name, parent_id, fill=_stops([(0.0, color)]))


def add_gradient(layers: DataFrame, documents: DataFrame, name: str, stops: Sequence[tuple[float, tuple[int, int, int, int]]], direction: int = 0, parent_id: int | None = None) -> DataFrame:
    """``direction`` is a code, 0 to 3; any other is horizontal."""
    return added(layers, documents, "gradient", name, parent_id, fill=_stops(stops), direction=DIRECTIONS[direction] if 0 <= direction < 4 else DIRECTIONS[0])


def _ints(values: Sequence[int] | None) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>") if values is not None else F.lit(None).cast("array<int>")


def add_shape(layers: DataFrame, documents: DataFrame, name: str, type: str, w: int, h: int, radius: int = 0, fill: Sequence[int] | None = None, stroke: Sequence[int] | None = None, stroke_width: int = 1, points: Sequence[tuple[int, int]] = (), x: int = 0, y: int = 0, parent_id: int | None = None) -> DataFrame:
    """A shape of one pixel at least; a stroke is one pixel wide at least."""
    corners = F.array(*[F.struct(F.lit(p).alias("x"), F.lit(q).alias("y")) for p, q in points]).cast("array<struct<x:int,y:int>>")
    shape = F.struct(F.lit(type).alias("type"), F.lit(radius).alias("radius"), _ints(fill).alias("fill"), _ints(stroke).alias("stroke"), F.lit(max(1, stroke_width) if stroke is not None else None).cast("int").alias("stroke_width"), corners.alias("points"))
    return added(layers, documents, "shape", name, parent_id, shape=shape, w=max(1, w), h=max(1, h), x=x, y=y)


def add_text(layers: DataFrame, documents: DataFrame, name: str, text: str, size: int = 16, line_height: int = 16, letter_spacing: int = 0, color: Sequence[int] | None = None, x: int = 0, y: int = 0, parent_id: int | None = None) -> DataFrame:
    """Black unless a colour is given."""
    values = {"text": F.lit(text), "color": _ints((0, 0, 0, 255) if color is None else color), "family": F.lit("sans-serif"), "weight": F.lit(400), "style": F.lit("normal"), "size": F.lit(max(1, size)), "line_height": F.lit(max(1, line_height)), "letter_spacing": F.lit(letter_spacing), "align": F.lit("left"), "wrap": F.lit(False), "box_width": F.lit(None).cast("int")}
    return added(layers, documents, "text", name, parent_id, text=F.struct(*[v.alias(k) for k, v in values.items()]), x=x, y=y)


def add_svg(layers: DataFrame, documents: DataFrame, name: str, markup: str, w: int, h: int, x: int = 0, y: int = 0, parent_id: int | None = None) -> DataFrame:
    """Markup that is refused (functions.text.svg_fault) is an error."""
    from strata.functions.text import svg_fault

    fault = layers.sparkSession.range(1).select(svg_fault(F.lit(markup)).alias("f")).first()["f"]
    if fault:
        raise ValueError(f"SVG refused: {fault}")
    return added(layers, documents, "svg", name, parent_id, svg=markup, w=max(1, w), h=max(1, h), x=x, y=y)


def found(layers: DataFrame, layer_id: int) -> DataFrame:
    """The layer, wherever in the tree it is; no row where there is none."""
    return layers.where(F.col("layer_id") == layer_id)


def listed(layers: DataFrame, parent_id: int | None = None, recursive: bool = True) -> DataFrame:
    """The layers below a group (or all), with depth and the places on the way to them, which sort them bottom first.

    One join a level, of the ids only; levels are written, so none is computed twice. A parent that isn't there or
    isn't a group lists nothing.
    """
    slim = layers.select("doc_id", "layer_id", "parent_id", "idx", "kind")
    if parent_id is None:
        level = slim.where("parent_id is null")
    else:
        groups = slim.where((F.col("layer_id") == parent_id) & (F.col("kind") == "group")).select("doc_id")
        level = slim.where(F.col("parent_id") == parent_id).join(groups, "doc_id", "left_semi")
    level = level.select("doc_id", "layer_id", F.lit(0).alias("depth"), F.array("idx").alias("path"))
    levels = []
    while True:
        level = checkpointed(level)
        levels.append(level)
        if not recursive or level.isEmpty():
            break
        up = level.select("doc_id", F.col("layer_id").alias("parent_id"), F.col("depth").alias("_d"), F.col("path").alias("_p"))
        level = slim.join(up, ["doc_id", "parent_id"]).select("doc_id", "layer_id", (F.col("_d") + 1).alias("depth"), F.concat("_p", F.array("idx")).alias("path"))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return layers.join(out, ["doc_id", "layer_id"]).select(*layers.columns, "depth", "path")


def snapshot(layers: DataFrame, layer_id: int) -> DataFrame:
    """One row a document: where the layer is, what all layers have, and what its kind has (null for others)."""
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    only = {c: is_(*TRANSFORMED) for c in ("anchor", "flip_x", "flip_y", "rotation", "scale_x", "scale_y", "w", "h")} | {"alpha_locked": is_("raster"), "filter": is_("filter"), "text": is_("text"), "shape": is_("shape"), "fill": is_("solid", "gradient"), "direction": is_("gradient")}
    place = listed(layers.select("doc_id", "layer_id", "parent_id", "idx", "kind")).where(F.col("layer_id") == layer_id).select("doc_id", "depth")
    drop = {"rgba", "mask", "mask_w", "mask_h", "svg"}
    own = found(layers, layer_id).join(place, "doc_id")
    return own.select(*[(F.when(only[c], F.col(c)) if c in only else F.col(c)).alias(c) for c in layers.columns if c not in drop], "depth", F.col("mask").isNotNull().alias("has_mask"))


def closed(layers: DataFrame) -> DataFrame:
    """Places among siblings without gaps."""
    order = Window.partitionBy("doc_id", "parent_id").orderBy("idx", "layer_id")
    return layers.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))


def removed(layers: DataFrame, layer_id: int) -> DataFrame:
    """Without the layer and all that is below it."""
    slim = layers.select("doc_id", "layer_id", "parent_id")
    gone = level = checkpointed(slim.where(F.col("layer_id") == layer_id).select("doc_id", "layer_id"))
    while not level.isEmpty():
        level = checkpointed(slim.join(level.select("doc_id", F.col("layer_id").alias("parent_id")), ["doc_id", "parent_id"]).select("doc_id", "layer_id"))
        gone = gone.union(level)
    return closed(layers.join(gone, ["doc_id", "layer_id"], "left_anti")).select(*layers.columns)


def removed_child(layers: DataFrame, group_id: int, child_id: int) -> DataFrame:
    """As ``removed``, where the layer is a direct child of the group."""
    if layers.where((F.col("layer_id") == child_id) & (F.col("parent_id") == group_id)).isEmpty():
        return layers
    return removed(layers, child_id)


def moved(layers: DataFrame, layer_id: int, parent_id: int | None = None, index: int | None = None) -> DataFrame:
    """The layer as a child of a group, or on top level, at an index among what is there (none: at the end).

    Within one parent the index counts the layer itself, so places behind it close up. Documents where the layer isn't
    there, or the parent is no group, is the layer or is below it, stay as they are.
    """
    slim = checkpointed(layers.select("doc_id", "layer_id", "parent_id", "idx", "kind"))
    able = slim.where(F.col("layer_id") == layer_id).select("doc_id", F.col("parent_id").alias("_from"), F.col("idx").alias("_at"))
    if parent_id is not None:
        groups = slim.where((F.col("layer_id") == parent_id) & (F.col("kind") == "group"))
        able = able.join(groups.select("doc_id"), "doc_id", "left_semi")
        # from the parent upwards: the layer must not be met
        way = checkpointed(groups.select("doc_id", "layer_id", "parent_id"))
        above = way
        while not way.isEmpty():
            way = checkpointed(slim.join(way.select("doc_id", F.col("parent_id").alias("layer_id")), ["doc_id", "layer_id"]).select("doc_id", "layer_id", "parent_id"))
            above = above.union(way)
        able = able.join(above.where(F.col("layer_id") == layer_id).select("doc_id"), "doc_id", "left_anti")
    to = F.lit(parent_id).cast("long")
    met = layers.join(able.withColumn("_able", F.lit(True)), "doc_id", "left").withColumn("_able", F.coalesce("_able", F.lit(False)))
    mine = F.col("_able") & (F.col("layer_id") == layer_id)
    met = met.withColumns({"_mine": mine, "_to": F.when(mine, to).otherwise(F.col("parent_id"))})
    beside = Window.partitionBy("doc_id", "_to")
    met = met.withColumns({"_rest": F.row_number().over(Window.partitionBy("doc_id", "_to", "_mine").orderBy("idx")) - 1, "_n": F.count(F.when(~F.col("_mine"), 1)).over(beside)})
    if index is None:
        place = F.col("_n")
    else:
        shift = F.col("_from").eqNullSafe(to) & (F.lit(index) > F.col("_at"))
        place = F.least(F.col("_n"), F.lit(index) - shift.cast("int"))
    room = F.col("_able") & F.col("_to").eqNullSafe(to) & (F.col("_rest") >= place)
    idx = F.when(F.col("_mine"), place).otherwise(F.col("_rest") + F.coalesce(room, F.lit(False)).cast("int")).cast("int")
    out = met.withColumn("_idx", F.when(F.col("_able"), idx).otherwise(F.col("idx")))
    return out.select(*[{"parent_id": F.col("_to").alias("parent_id"), "idx": F.col("_idx").alias("idx")}.get(c, F.col(c)) for c in layers.columns])


def extent(w: Column, h: Column, scale_x: Column, scale_y: Column, degrees: Column) -> tuple[Column, Column]:
    """Size of a layer once it is scaled and turned."""
    scaled = [F.greatest(F.lit(1.0), F.floor(v * F.abs(s) + 0.5).cast("double")) for v, s in ((w, scale_x), (h, scale_y))]
    co, si = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    turned = [F.ceil(F.round(p * co + q * si, 9)) for p, q in (scaled, scaled[::-1])]
    return tuple(F.when(F.abs(degrees) > _TINY, t).otherwise(s).cast("int") for t, s in zip(turned, scaled, strict=True))


def _away(v: Column) -> Column:
    """Rounded, halves away from zero."""
    return (F.signum(v) * F.floor(F.abs(v) + 0.5)).cast("int")


def aligned(layers: DataFrame, ids: Sequence[int], mode: str, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The layers after some were lined up in their common box, or in the canvas of ``documents`` (doc_id, width, height), and (doc_id, moved).

    Filters, groups and fills have no extent and stay; an id named twice counts once.
    """
    modes = {"left": ("x", 0), "horizontal-center": ("x", 1), "right": ("x", 2), "top": ("y", 0), "vertical-center": ("y", 1), "bottom": ("y", 2)}
    axis, to = modes[mode]
    size = extent(*[F.col(c) for c in ("w", "h", "scale_x", "scale_y", "rotation")])[axis == "y"]
    named = F.col("layer_id").isin(*sorted(set(ids))) & F.col("kind").isin(*TRANSFORMED)
    centred = F.col("anchor") == "center"
    met = layers.withColumns({"_named": named, "_size": size})
    met = met.withColumn("_lo", F.when(F.col("_named"), F.when(centred, _away(F.col(axis) - F.col("_size") / 2.0)).otherwise(F.col(axis))))
    if documents is None:
        box = met.where("_named").groupBy("doc_id").agg(F.min("_lo").alias("_first"), F.max(F.col("_lo") + F.col("_size")).alias("_last"))
    else:
        box = documents.select("doc_id", F.lit(0).alias("_first"), F.col("width" if axis == "x" else "height").cast("int").alias("_last"))
    met = met.join(box, "doc_id", "left")
    at = [F.col("_first"), _away((F.col("_first") + F.col("_last") - F.col("_size")) / 2.0), F.col("_last") - F.col("_size")][to]
    new = F.when(F.col("_named") & F.col("_first").isNotNull(), F.when(centred, _away(at + F.col("_size") / 2.0)).otherwise(at)).otherwise(F.col(axis)).cast("int")
    out = met.withColumn("_new", new)
    count = out.groupBy("doc_id").agg(F.count(F.when(F.col("_new") != F.col(axis), 1)).alias("moved"))
    return out.withColumn(axis, F.col("_new")).select(*layers.columns), count


def resized_canvas(documents: DataFrame, doc_id: int, width: int, height: int) -> DataFrame:
    """The size of a document changes, its layers stay where they are."""
    hit = F.col("doc_id") == doc_id
    return documents.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)).cast("int") for c, v in (("width", width), ("height", height))})


def about(layers: DataFrame) -> DataFrame:
    """(doc_id, top, layers, last_id, has_svg): counts, the largest id and whether there is markup, without payloads."""
    return layers.groupBy("doc_id").agg(F.count(F.when(F.col("parent_id").isNull(), 1)).alias("top"), F.count(F.lit(1)).alias("layers"), F.max("layer_id").alias("last_id"), F.max(F.col("kind") == "svg").alias("has_svg"))


def rasterized(layers: DataFrame, layer_id: int, draw=None) -> DataFrame:
    """The SVG layer as a raster that keeps its transform. ``draw(markup, w, h)`` gives RGBA bytes; without it, or where it fails, the raster is clear."""

    def run(batches):
        for pdf in batches:
            for i, markup, w, h in zip(pdf.index, pdf["svg"], pdf["w"], pdf["h"], strict=True):
                try:
                    rgba = draw(markup, int(w), int(h)) if draw else None
                except Exception:  # a renderer's fault is a clear layer, as it is when rendering
                    rgba = None
                pdf.at[i, "rgba"] = rgba if rgba is not None and len(rgba) == w * h * 4 else bytes(int(w) * int(h) * 4)
            yield pdf[["doc_id", "layer_id", "rgba"]]

    hit = (F.col("layer_id") == layer_id) & (F.col("kind") == "svg")
    drawn = layers.where(hit).select("doc_id", "layer_id", "svg", "w", "h", "rgba").mapInPandas(run, "doc_id long, layer_id long, rgba binary").withColumnRenamed("rgba", "_rgba")
    met = layers.join(drawn, ["doc_id", "layer_id"], "left")
    new = {"kind": F.when(hit, F.lit("raster")).otherwise(F.col("kind")), "svg": F.when(~hit, F.col("svg")), "rgba": F.when(hit, F.col("_rgba")).otherwise(F.col("rgba"))}
    return met.select(*[new.get(c, F.col(c)).alias(c) for c in layers.columns])
