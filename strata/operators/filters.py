"""Per-pixel filters on a pixel relation (… x, y, r, g, b, a). Transparent pixels are left as they are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.color import byte, hsl_to_rgb, lit, luminance, rgb_to_hsl


def _live(df: DataFrame, **to: Column) -> DataFrame:
    return df.withColumns({c: F.when(F.col("a") > 0, v).otherwise(F.col(c)) for c, v in to.items()})


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


@dataclass(frozen=True)
class Adjust:
    """Knobs of the adjustment filter; tone knobs are clamped to -1..1 and hue is in degrees."""

    hue: float = 0.0
    saturation: float = 0.0
    lightness: float = 0.0
    alpha: float = 0.0
    brightness: float = 0.0
    contrast: float = 0.0
    temperature: float = 0.0
    tint: float = 0.0

    def tone(self) -> tuple[float, float, float, float]:
        return tuple(max(-1.0, min(1.0, v)) for v in (self.brightness, self.contrast, self.temperature, self.tint))


def adjust(df: DataFrame, knobs: Adjust) -> DataFrame:
    """Hue, saturation and lightness, then alpha, then tone; a knob at rest adds nothing to the plan."""
    if knobs.hue or knobs.saturation or knobs.lightness:
        # one projection a step, so that Spark shares the terms
        h, s, light = rgb_to_hsl(*_rgb())
        df = df.withColumns({"_h": h, "_s": s, "_l": light})
        clamp = lambda v: F.least(lit(1), F.greatest(lit(0), v))
        r, g, b = hsl_to_rgb(F.col("_h") + knobs.hue, clamp(F.col("_s") + knobs.saturation), clamp(F.col("_l") + knobs.lightness))
        df = _live(df, r=r, g=g, b=b).drop("_h", "_s", "_l")
    if knobs.alpha:
        df = _live(df, a=byte(F.col("a") + lit(int(abs(knobs.alpha) * 255 + 0.5) * (1 if knobs.alpha > 0 else -1))))
    brightness, contrast, temperature, tint = knobs.tone()
    if not any((brightness, contrast, temperature, tint)):
        return df
    factor = 1 + contrast * 3 if contrast >= 0 else 1 / (1 + abs(contrast) * 3)
    out = {}
    for c in "rgb":
        v = F.col(c).cast("double")
        if brightness:
            v = v + brightness * 180.0
        if contrast:
            v = (v - 128.0) * factor + 128.0
        if temperature and c != "g":
            v = v + temperature * 90.0 if c == "r" else v - temperature * 90.0
        if tint:
            v = v + tint * 80.0 if c == "g" else v - tint * 80.0 * 0.35
        out[c] = byte(v)
    return _live(df, **out)


def invert(df: DataFrame) -> DataFrame:
    return _live(df, **{c: F.lit(255) - F.col(c) for c in "rgb"})


def posterize(df: DataFrame, levels: int) -> DataFrame:
    """``levels`` steps a channel; 0 or 256 and more change nothing, and 1 makes black."""
    if levels == 0 or levels >= 256:
        return df
    if levels == 1:
        return _live(df, r=F.lit(0), g=F.lit(0), b=F.lit(0))
    n = float(levels - 1)
    return _live(df, **{c: byte(F.floor(F.col(c) / 255.0 * n + 0.5) / n * 255.0) for c in "rgb"})


def threshold(df: DataFrame, at: int) -> DataFrame:
    v = F.when(F.floor(luminance(*_rgb())) >= at, 255).otherwise(0)
    return df.withColumn("_v", v).transform(lambda d: _live(d, r=F.col("_v"), g=F.col("_v"), b=F.col("_v"))).drop("_v")


def _table(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def levels(df: DataFrame, in_black: int = 0, in_white: int = 255, gamma: float = 1.0, out_black: int = 0, out_white: int = 255) -> DataFrame:
    """Input range to output range along a gamma curve, by a table of 256 folded into the plan."""
    span = max(float(in_white - in_black), 1.0)
    power = 1 / gamma if gamma > 0 else 1.0
    lut = [int(max(0.0, min(255.0, out_black + (max(0.0, min(span, i - in_black)) / span) ** power * (out_white - out_black)))) for i in range(256)]
    return _live(df, **{c: _table(lut, F.col(c)) for c in "rgb"})


def gradient_map(df: DataFrame, stops: list[tuple[float, tuple[int, int, int]]]) -> DataFrame:
    """Luminance to the colours of a gradient; fewer than two stops change nothing."""
    if len(stops) < 2:
        return df
    luts: list[list[int]] = [[], [], []]
    for i in range(256):
        t = i / 255.0
        above = [j for j, s in enumerate(stops) if s[0] >= t]
        hi = min(above[0], len(stops) - 1) if above else len(stops) - 1
        below = [j for j, s in enumerate(stops[: hi + 1]) if s[0] <= t]
        lo = below[-1] if below else 0
        width = stops[hi][0] - stops[lo][0]
        f = (t - stops[lo][0]) / width if lo != hi and width > 0 else 0.0
        for lut, p, q in zip(luts, stops[lo][1], stops[hi][1], strict=True):
            lut.append(int(max(0.0, min(255.0, p + (q - p) * f))))
    lum = F.floor(luminance(*_rgb()))
    return df.withColumn("_l", lum).transform(lambda d: _live(d, **{c: _table(lut, F.col("_l")) for c, lut in zip("rgb", luts, strict=True)})).drop("_l")


def scale_alpha(df: DataFrame, opacity: float) -> DataFrame:
    if opacity >= 1:
        return df
    return df.withColumn("a", F.floor((F.col("a") * int(max(0.0, opacity) * 255 + 0.5) + 127) / 255).cast("int"))


def apply_mask(df: DataFrame, mask: DataFrame, keys: list[str], inverted: bool = False) -> DataFrame:
    """Scale alpha by the mask's red; pixels that the mask doesn't cover stay as they are."""
    m = mask.select(*keys, F.col("r").alias("_m"))
    level = F.lit(255) - F.col("_m") if inverted else F.col("_m")
    return df.join(m, keys, "left").withColumn("a", F.when(F.col("_m").isNull(), F.col("a")).otherwise(F.floor((F.col("a") * level + 127) / 255)).cast("int")).drop("_m")
