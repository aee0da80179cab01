"""Brush dabs: points to stamps along a stroke, stamps to mask pixels, mask pixels onto a canvas.

Numbers are doubles throughout. The walk along a stroke carries what is left of the spacing from point to point, so a
stroke is one group; all the rest is projections, one generator and one aggregate by pixel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.blend import over
from strata.functions.color import lit

#: The grain of a textured tip, row by row.
GRAIN = [
    [255, 196, 255, 140, 255, 176, 240, 120],
    [168, 248, 150, 232, 160, 255, 148, 224],
    [255, 132, 220, 176, 255, 128, 208, 160],
    [156, 236, 144, 255, 184, 255, 140, 232],
    [255, 176, 232, 128, 255, 188, 246, 150],
    [184, 255, 138, 224, 170, 255, 152, 244],
    [240, 154, 220, 182, 236, 136, 255, 166],
    [144, 228, 160, 255, 150, 236, 170, 255],
]
STAMPS = "stroke_id long, n long, x double, y double, pressure double, tilt_x double, tilt_y double"
_AXES = ["x", "y", "pressure", "tilt_x", "tilt_y"]


@dataclass(frozen=True)
class Brush:
    size: float = 10.0
    opacity: float = 1.0
    flow: float = 1.0
    hardness: float = 1.0
    spacing: float = 0.25
    pressure_size: float = 0.0
    pressure_opacity: float = 0.0
    color: tuple[int, int, int, int] = (0, 0, 0, 255)
    grain: bool = False
    erase: bool = False


def _unit(v: float) -> float:
    return min(1.0, max(0.0, v))


def packed_points(values: list[float], stride: int) -> list[tuple[float, ...]]:
    """Points (x, y, pressure[, tilt_x, tilt_y, time]) of a flat list; none, another stride or a remainder is an error."""
    if stride not in (3, 6) or not values or len(values) % stride:
        raise ValueError("points need a stride of 3 or 6 and no remainder")
    return [tuple(values[i : i + stride]) for i in range(0, len(values), stride)]


def times(stroke: pd.Series) -> list[float]:
    """Milliseconds that rise: a late time is one after the last, a missing one 16 after it."""
    out: list[float] = []
    for t in stroke.astype(float):
        if math.isfinite(t) and t > 0:
            out.append(out[-1] + 1 if out and t <= out[-1] else t)
        else:
            out.append(out[-1] + 16 if out else 0.0)
    return out


def walk(points: list[tuple[float, ...]], brush: Brush, state: tuple | None = None) -> tuple[list[tuple[float, ...]], tuple | None]:
    """Stamps of points (x, y, pressure, tilt_x, tilt_y) after ``state``, and the state after them.

    The state is the last point, the last stamp, and how far along the next segment the next stamp lies. A point that
    is half a pixel or more from the last stamp gets one of its own.
    """
    out = []
    for p in points:
        if state is None:
            out.append(p)
            state = (p, p, 0.0)
            continue
        last, stamp, ahead = state
        length = math.hypot(p[0] - last[0], p[1] - last[1])
        if length > 2.0**-23:
            mean = _unit((last[2] + p[2]) / 2)
            influence = _unit(brush.pressure_size)
            step = max(1.0, max(brush.size, 1.0) * (1 - influence + mean * influence) * max(brush.spacing, 0.01))
            at = ahead if ahead > 0 else step
            while at <= length:
                stamp = tuple(a + (b - a) * at / length for a, b in zip(last, p, strict=True))
                out.append(stamp)
                at += step
            ahead = at - length
        if math.hypot(p[0] - stamp[0], p[1] - stamp[1]) >= 0.5:
            stamp = p
            out.append(p)
        state = (p, stamp, ahead)
    return out, state


def stamps(points: DataFrame, brush: Brush) -> DataFrame:
    """(stroke_id, n, x, y, pressure, tilt_x, tilt_y) of points (stroke_id, seq, x, y, pressure[, tilt_x, tilt_y])."""
    slim = points.select("stroke_id", "seq", *[F.col(c).cast("double").alias(c) if c in points.columns else F.lit(0.0).alias(c) for c in _AXES])

    def run(stroke: pd.DataFrame) -> pd.DataFrame:
        made, _ = walk(list(stroke.sort_values("seq")[_AXES].itertuples(index=False, name=None)), brush)
        out = pd.DataFrame(made, columns=_AXES, dtype=float)
        out.insert(0, "n", range(len(out)))
        out.insert(0, "stroke_id", stroke["stroke_id"].iloc[0])
        return out

    return slim.groupBy("stroke_id").applyInPandas(run, STAMPS)


def _half_up(v: Column) -> Column:
    return F.floor(v + 0.5).cast("int")


def dabs(marks: DataFrame, brush: Brush) -> DataFrame:
    """(stroke_id, n, x, y, alpha): the pixels that stamps cover, softened from the hard core to the rim."""
    pressure = F.least(lit(1), F.greatest(lit(0), F.col("pressure")))
    share = lambda base, influence: lit(base) * (lit(1 - _unit(influence)) + pressure * _unit(influence))
    tilt = [F.least(lit(1), F.greatest(lit(-1), F.col(c))) for c in ("tilt_x", "tilt_y")]
    lean = F.least(lit(1), F.sqrt(tilt[0] * tilt[0] + tilt[1] * tilt[1]))
    # shapes are kept in 64ths of aspect and 255ths of a turn
    aspect = F.when(lean <= 0.01, lit(1)).otherwise(lit(1) + _half_up(lean * 0.75 * 64.0) / 64.0)
    turn = F.when(lean <= 0.01, lit(0)).otherwise(F.pmod(F.atan2(tilt[1], tilt[0]), lit(math.tau)))
    angle = _half_up(turn / math.tau * 255.0) / 255.0 * math.tau
    level = F.least(lit(1), share(_unit(brush.opacity), brush.pressure_opacity) * _unit(brush.flow))
    at = marks.select("stroke_id", "n", "x", "y", F.greatest(F.lit(1), _half_up(share(max(brush.size, 1.0), brush.pressure_size))).alias("_d"), aspect.alias("_a"), angle.alias("_t"), level.alias("_l"))
    at = at.where("_l > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_d") * F.col("_d") - 1)))
    d = F.col("_d")
    at = at.withColumns({"_mx": (F.col("_i") % d).cast("int"), "_my": F.floor(F.col("_i") / d).cast("int")})
    radius = d / 2.0
    dx, dy = F.col("_mx") + 0.5 - radius, F.col("_my") + 0.5 - radius
    u, v = dx * F.cos("_t") + dy * F.sin("_t"), dy * F.cos("_t") - dx * F.sin("_t")
    away = F.sqrt(F.pow(u / (radius * F.col("_a")), lit(2)) + F.pow(v / F.greatest(radius / F.col("_a"), lit(0.5)), lit(2)))
    hardness = math.floor(_unit(brush.hardness) * 255 + 0.5) / 255
    rim = F.greatest(lit(0), F.least(lit(1), (lit(1) - away) / max(1 - hardness, 1e-9)))
    sample = F.when(away >= 1, lit(0)).when((away * radius <= radius * hardness) | F.lit(hardness >= 0.999), lit(1)).otherwise(rim)
    if brush.grain:
        grain = F.array(*[F.lit(v) for row in GRAIN for v in row])
        cell = lambda c: F.least(F.lit(7), _half_up(F.col(c) / d * 7.0))
        sample = sample * (lit(0.55) + F.element_at(grain, cell("_my") * 8 + cell("_mx") + 1) / 255.0 * 0.45)
    mask = _half_up(sample * 255.0)
    alpha = _half_up(F.col("_l") * (brush.color[3] / 255) * (mask / 255.0) * 255.0)
    place = {c: (F.floor(F.col(c) - radius) + F.col(f"_m{c}")).cast("int") for c in "xy"}
    return at.select("stroke_id", "n", *[e.alias(c) for c, e in place.items()], alpha.alias("alpha")).where("alpha > 0")


def paint(canvas: DataFrame, dab_pixels: DataFrame, brush: Brush, image: str = "image_id", locked: bool = False) -> DataFrame:
    """The canvas after the dabs (image, n, x, y, alpha), in the order of n at each pixel; dabs beside the canvas do nothing.

    With ``locked`` alpha, clear pixels stay clear and erasing does nothing.
    """
    if brush.erase and locked:
        return canvas
    ordered = dab_pixels.groupBy(image, "x", "y").agg(F.array_sort(F.collect_list(F.struct("n", "alpha"))).alias("_dabs"))
    state = F.struct(*[F.col(c).cast("int").alias(c) for c in "rgba"])
    fields = lambda v: F.struct(*[v[c].cast("int").alias(c) for c in "rgba"])

    def onto(s: Column, dab: Column) -> Column:
        if brush.erase:
            left = F.floor((s["a"] * (F.lit(255) - dab["alpha"]) + 127) / 255)
            return fields({c: F.when((left == 0) & (s["a"] > 0), 0).otherwise(s[c]) for c in "rgb"} | {"a": left})
        top = {c: F.lit(v) for c, v in zip("rgb", brush.color[:3], strict=True)} | {"a": dab["alpha"]}
        return fields(over({c: s[c] for c in "rgba"}, top))

    drawn = F.aggregate("_dabs", state, onto)
    skip = F.col("_dabs").isNull() | F.lit(locked) & (F.col("a") == 0)
    met = canvas.join(ordered, [image, "x", "y"], "left").withColumn("_new", F.when(~skip, drawn))
    return met.select(*[F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in ("r", "g", "b", "a") else F.col(c) for c in canvas.columns])
