"""Layer stacks: fold the layers of a document, bottom to top, pixel by pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.blend import HSL_MODES, composite, over
from strata.functions.color import hsl_to_rgb, rgb_to_hsl, unit

_CHANNELS = "rgba"


def _pixel(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in _CHANNELS}


def pack(r: Column, g: Column, b: Column, a: Column) -> Column:
    """A pixel as one number: aggregates over numbers stay hash aggregates, those over structs are sorted."""
    return (a.cast("long") * 256 + r) * 65536 + g * 256 + b


def unpack(p: Column) -> dict[str, Column]:
    return {c: F.shiftright(p, 8 * "bgra".index(c)).bitwiseAND(F.lit(255)).cast("int") for c in _CHANNELS}


def render(stack: DataFrame, depth: int, keys: list[str]) -> DataFrame:
    """Composite a stack (keys, z, r, g, b, a, clipped[, opacity]) of at most ``depth`` layers, z from 0.

    A clipped layer's alpha is scaled by that of the layer below it, as that one was clipped itself; without one it
    doesn't show. One hash aggregate turns layers into columns, and the fold is a chain of projections.
    """
    has_opacity = "opacity" in stack.columns
    at = lambda z, v: F.max(F.when(F.col("z") == z, v))
    packed = pack(*[F.col(c) for c in _CHANNELS]) * 2 + F.coalesce(F.col("clipped"), F.lit(False)).cast("long")
    opacity = [at(z, F.floor(F.col("opacity") * 255 + 0.5)).alias(f"o{z}") for z in range(depth)] if has_opacity else []
    out = stack.groupBy(*keys).agg(*[at(z, packed).alias(f"z{z}") for z in range(depth)], *opacity)
    out = out.withColumns({f"c{c}": F.lit(0) for c in _CHANNELS} | {"below": F.lit(0)})
    for z in range(depth):
        layer = F.coalesce(F.col(f"z{z}"), F.lit(0))
        s = unpack(F.shiftright(layer, 1))
        alpha = s["a"]
        if has_opacity:
            alpha = F.floor((alpha * F.coalesce(F.col(f"o{z}"), F.lit(0)) + 127) / 255).cast("int")
        clipped = F.when(layer.bitwiseAND(F.lit(1)) == 1, F.floor((alpha * F.col("below") + 127) / 255)).otherwise(alpha).cast("int")
        out = out.withColumns({f"s{c}": s[c] for c in "rgb"} | {"sa": clipped})
        out = out.withColumns({f"c{c}": v for c, v in over(_pixel("c"), _pixel("s")).items()} | {"below": F.col("sa")})
    return out.select(*keys, *[F.col(f"c{c}").alias(c) for c in _CHANNELS])


def mixed_onto(df: DataFrame, d: str, s: str, mode: str) -> DataFrame:
    """Blend the pixel in columns with prefix s onto that with prefix d, in place."""
    mixed, steps = None, []
    if mode in HSL_MODES:  # a projection a step keeps the expressions small
        for p in (d, s):
            df = df.withColumns(dict(zip((f"_{p}h", f"_{p}s", f"_{p}l"), rgb_to_hsl(*[F.col(f"{p}{c}") for c in "rgb"]), strict=True)))
        h, sat, light = (F.col(f"_{s if of == 't' else d}{x}") for of, x in zip(HSL_MODES[mode], "hsl", strict=True))
        df = df.withColumns(dict(zip(("_nr", "_ng", "_nb"), hsl_to_rgb(h, sat, light), strict=True)))
        mixed = {c: unit(F.col(f"_n{c}")) for c in "rgb"}
        steps = [*[f"_{p}{x}" for p in (d, s) for x in "hsl"], "_nr", "_ng", "_nb"]
    return df.withColumns({f"{d}{c}": v for c, v in composite(_pixel(d), _pixel(s), mode, mixed).items()}).drop(*steps)


def blend_images(backdrop: DataFrame, source: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Blend the source's pixels onto the backdrop's; where the source has none, the backdrop stays."""
    s = source.select(*keys, *[F.col(c).alias(f"s{c}") for c in _CHANNELS])
    met = backdrop.join(s, keys, "left").withColumns({f"s{c}": F.coalesce(f"s{c}", F.lit(0)) for c in _CHANNELS})
    return mixed_onto(met, "", "s", mode).select(*keys, *_CHANNELS)


def render_groups(stack: DataFrame, depth: int, groups: int, keys: list[str]) -> DataFrame:
    """Composite groups of layers on canvases of their own, then those canvases (group, group_opacity) bottom to top."""
    each = render(stack, depth, [*keys, "group"])
    about = stack.groupBy(*keys, "group").agg(F.max("group_opacity").alias("opacity"))
    canvases = each.join(about, [*keys, "group"]).select(*keys, F.col("group").alias("z"), *_CHANNELS, F.lit(False).alias("clipped"), "opacity")
    return render(canvases, groups, keys)


def blit(target: DataFrame, placed: DataFrame, dx: int, dy: int, opacity: float, keys: list[str]) -> DataFrame:
    """Source-over of an image whose top left corner is at (dx, dy), scaled in alpha; what falls outside is cut off."""
    level = int(min(1.0, max(0.0, opacity)) * 255 + 0.5)
    moved = placed.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "a": F.floor((F.col("a") * level + 127) / 255).cast("int")})
    return blend_images(target, moved, "normal", keys)
