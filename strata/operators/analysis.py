"""Image analysis: histograms, dominant colours, bounding boxes, palettes and fills."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import grids


def histogram(df: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, channel, value, n): 256 counts a channel of all pixels, of values that don't occur too.

    Counts come from partial aggregates; the 1024 places of an image are joined to them by one aggregate more.
    """
    channels = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("int").alias("value")) for c in "rgba"])
    found = df.select(image, F.inline(channels)).groupBy(image, "channel", "value").agg(F.count(F.lit(1)).alias("n"))
    places = F.array(*[F.struct(F.lit(c).alias("channel"), F.sequence(F.lit(0), F.lit(255)).alias("values")) for c in "rgba"])
    zeros = df.select(image).distinct().select(image, F.inline(places)).select(image, "channel", F.explode("values").alias("value"), F.lit(0).cast("long").alias("n"))
    return found.unionByName(zeros).groupBy(image, "channel", "value").agg(F.sum("n").alias("n"))


def dominant(df: DataFrame, image: str = "image_id", max_samples: int | None = None) -> DataFrame:
    """(image, r, g, b): centre of the fullest of 32 bins a channel among visible pixels; ties go to the lowest bin.

    With ``max_samples`` (a feature: an estimate from about as many pixels) every n-th column of every n-th row of an
    image counts, n being the root of its pixels by the samples. An image without visible pixels has no row.
    """
    if max_samples is not None:
        size = df.groupBy(image).agg(((F.max("x") + 1) * (F.max("y") + 1)).alias("_n"))
        step = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("_n") / float(max(1, max_samples)))).cast("int"))
        df = df.join(size, image).where((F.col("x") % step == 0) & (F.col("y") % step == 0)).drop("_n")
    bins = df.where("a > 0").select(image, (F.shiftright("r", 3) * 1024 + F.shiftright("g", 3) * 32 + F.shiftright("b", 3)).alias("bin"))
    best = bins.groupBy(image, "bin").agg(F.count(F.lit(1)).alias("n")).groupBy(image).agg(F.max(F.struct(F.col("n"), (-F.col("bin")).alias("m"))).alias("top")).withColumn("bin", -F.col("top.m"))
    part = lambda shift: (F.shiftright("bin", shift).bitwiseAND(F.lit(31)) * 8 + 4).cast("int")
    return best.select(image, part(10).alias("r"), part(5).alias("g"), part(0).alias("b"))


def alpha_bounds(df: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, x, y, w, h) of the visible pixels; all transparent is 0 by 0."""
    live = F.col("a") > 0
    box = df.groupBy(image).agg(*[f(F.when(live, F.col(c))).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return box.select(image, zero(F.col("lox")).alias("x"), zero(F.col("loy")).alias("y"), zero(F.col("hix") - F.col("lox") + 1).alias("w"), zero(F.col("hiy") - F.col("loy") + 1).alias("h"))


def palette_box(df: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, channel bounds, widest range, integer averages) of the visible pixels: one box of a median cut."""
    live = df.where("a > 0").groupBy(image)
    out = live.agg(*[f(c).alias(f"{n}_{c}") for c in "rgb" for n, f in (("min", F.min), ("max", F.max))], *[F.floor(F.sum(c) / F.count(F.lit(1))).cast("int").alias(f"avg_{c}") for c in "rgb"])
    return out.withColumn("widest", F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "rgb"]))


def extract_palette(df: DataFrame, colors: int, image: str = "image_id") -> DataFrame:
    """(image, idx, r, g, b, a): median cut of each image's visible pixels, by rising luminance.

    Each cut depends on the one before it, so an image is one group; pixels that are equal in colour are kept apart,
    since medians count them. An image without visible pixels gets one transparent colour.
    """
    import pandas as pd

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pixels = pdf.sort_values(["y", "x"])
        pixels = pixels.loc[pixels["a"] > 0, ["r", "g", "b"]].to_numpy()
        if not len(pixels):
            out = [(0, 0, 0, 0)]
        else:
            boxes = [pixels]
            while len(boxes) < max(1, colors):
                widths = [int(np.ptp(b, axis=0).max()) for b in boxes]
                at = len(widths) - 1 - int(np.argmax(widths[::-1]))
                box = boxes.pop(at)
                if widths[at] == 0 or len(box) < 2:
                    boxes.append(box)
                    break
                box = box[np.argsort(box[:, int(np.argmax(np.ptp(box, axis=0)))], kind="stable")]
                boxes += [box[: len(box) // 2], box[len(box) // 2 :]]
            means = [tuple(int(v) for v in b.sum(axis=0) // len(b)) for b in boxes]
            out = [(*m, 255) for m in sorted(means, key=lambda m: 0.299 * m[0] + 0.587 * m[1] + 0.114 * m[2])]
        res = pd.DataFrame(out, columns=["r", "g", "b", "a"], dtype="int32")
        res.insert(0, "idx", np.arange(len(res), dtype="int32"))
        res.insert(0, image, pdf[image].iloc[0])
        return res

    return df.select(image, "x", "y", *"rgba").groupBy(image).applyInPandas(cut, f"{image} long, idx int, r int, g int, b int, a int")


def quantize(df: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """Visible pixels to the nearest palette colour, the first of equals; the palette is a literal of the plan."""
    if not palette:
        return df
    dist = lambda p: (F.col("r") - p[0]) * (F.col("r") - p[0]) + (F.col("g") - p[1]) * (F.col("g") - p[1]) + (F.col("b") - p[2]) * (F.col("b") - p[2])
    near = F.least(*[F.struct(dist(p).alias("d"), F.lit(i).alias("i"), *[F.lit(v).alias(c) for c, v in zip("rgb", p, strict=True)]) for i, p in enumerate(palette)]) if len(palette) > 1 else F.struct(dist(palette[0]).alias("d"), *[F.lit(v).alias(c) for c, v in zip("rgb", palette[0], strict=True)])
    out = df.withColumn("_n", near)
    return out.withColumns({c: F.when(F.col("a") > 0, F.col(f"_n.{c}")).otherwise(F.col(c)) for c in "rgb"}).drop("_n")


def _same(seed: str, tolerance: int):
    cond = F.lit(True)
    for c in "rgba":
        cond = cond & (F.abs(F.col(c) - F.col(f"{seed}{c}")) <= tolerance)
    return cond


def _seeded(df: DataFrame, x: int, y: int, image: str, locked: bool) -> DataFrame:
    """The pixels with their image's seed (_r, _g, _b, _a); with ``locked`` alpha clear seeds and pixels are out."""
    seed = df.where((F.col("x") == x) & (F.col("y") == y)).select(image, *[F.col(c).alias(f"_{c}") for c in "rgba"])
    return df.join(seed.where("_a > 0") if locked else seed, image, "left")


def fill_all(df: DataFrame, x: int, y: int, color: tuple[int, int, int, int], tolerance: int, image: str = "image_id", locked: bool = False) -> DataFrame:
    """Pixels within tolerance of the seed's colour, anywhere in the image, get the colour; a seed outside does nothing.

    With ``locked`` alpha, clear pixels stay clear.
    """
    hit = F.coalesce(_same("_", tolerance), F.lit(False))
    if locked:
        hit = hit & (F.col("a") > 0)
    return _seeded(df, x, y, image, locked).select(image, "x", "y", *[F.when(hit, v).otherwise(F.col(c)).alias(c) for c, v in zip("rgba", color, strict=True)])


def fill_region(df: DataFrame, x: int, y: int, color: tuple[int, int, int, int], tolerance: int, image: str = "image_id", locked: bool = False) -> DataFrame:
    """Pixels that can be reached from the seed through sides shared with pixels within tolerance of its colour.

    An image is one group, and its region is found by labels in a number of steps that grows with the logarithm of its
    pixels, so a long winding region takes hardly more steps than a square one.
    """

    def change(pixels, there):
        h, w, _ = pixels.shape
        if not (0 <= x < w and 0 <= y < h and there[y, x]) or (locked and not pixels[y, x, 3]):
            return pixels, there
        near = (np.abs(pixels.astype(np.int16) - pixels[y, x].astype(np.int16)) <= tolerance).all(axis=2) & there
        if locked:
            near &= pixels[..., 3] > 0
        out = pixels.copy()
        out[grids.region(near, x, y)] = color
        return out, there

    return grids.per_image(df, change, image)
