"""Sprite sheets: shelf packing and contact sheets, as places, pixels and JSON."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from strata.functions.color import lit
from strata.operators.geometry import fit


def pack(sprites: DataFrame, sheet: str, max_width: int, padding: int = 0) -> DataFrame:
    """(sheet, idx, x, y, w, h): tallest first on shelves of max_width; a sprite that doesn't fit opens a new shelf.

    A shelf's state depends on all before it, so a sheet's sprites are read in order by one task, which holds the state
    alone; sheets are independent of each other.
    """

    def run(batches):
        held = (None, 0, 0, 0)
        for b in batches:
            xs, ys, (of, x, y, shelf) = [], [], held
            keys, w, h = (b.column(i).to_pylist() for i in (0, 2, 3))
            for k, wide, high in zip(keys, w, h, strict=True):
                if k != of:
                    of, x, y, shelf = k, 0, 0, 0
                if x + wide > max_width:
                    x, y, shelf = 0, y + shelf + padding, 0
                xs.append(x)
                ys.append(y)
                x, shelf = x + wide + padding, max(shelf, high)
            held = (of, x, y, shelf)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(xs, pa.int32()), pa.array(ys, pa.int32()), b.column(2), b.column(3)], [sheet, "idx", "x", "y", "w", "h"])

    slim = sprites.select(sheet, F.col("idx").cast("long").alias("idx"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))
    schema = StructType([StructField(sheet, sprites.schema[sheet].dataType), StructField("idx", LongType()), *(StructField(c, IntegerType()) for c in "xywh")])
    return slim.repartition(sheet).sortWithinPartitions(sheet, F.desc("h"), "idx").mapInArrow(run, schema)


def _power(v: Column) -> Column:
    """The next power of two, one at least."""
    return F.pow(lit(2), F.ceil(F.log2(F.greatest(v, F.lit(1)).cast("double")))).cast("int")


def atlas(placed: DataFrame, sheet: str, max_width: int, power_of_two: bool = False) -> DataFrame:
    """(sheet, width, height) of packed sprites: what they reach, if asked for up to a power of two, at most max_width each way."""
    reach = placed.groupBy(sheet).agg(F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"))
    size = lambda c: F.least(F.lit(max_width), _power(F.col(c)) if power_of_two else F.col(c)).cast("int")
    return reach.select(sheet, size("width").alias("width"), size("height").alias("height"))


def packed_pixels(pixels: DataFrame, placed: DataFrame, sizes: DataFrame, sheet: str) -> DataFrame:
    """(sheet, x, y, r, g, b, a) of the sprites' pixels (sheet, idx, x, y, …) at their places; what the atlas doesn't reach is cut off.

    Sprites don't overlap, so places are copied; places without a row are clear.
    """
    at = placed.select(sheet, "idx", F.col("x").alias("_x"), F.col("y").alias("_y"))
    met = pixels.join(at, [sheet, "idx"]).join(sizes, sheet)
    moved = met.withColumns({"x": F.col("x") + F.col("_x"), "y": F.col("y") + F.col("_y")})
    return moved.where("x < width and y < height").select(sheet, "x", "y", *"rgba")


def packed_json(placed: DataFrame, sizes: DataFrame, sheet: str) -> DataFrame:
    """(sheet, json): the sprites by their numbers, and the atlas's size."""
    sprite = F.struct(F.col("idx").alias("index"), *"xywh")
    rows = placed.groupBy(sheet).agg(F.array_sort(F.collect_list(sprite)).alias("sprites"))
    return rows.join(sizes, sheet).select(sheet, F.to_json(F.struct("sprites", "width", "height")).alias("json"))


def contact_sheet(sprites: DataFrame, sheet: str, columns: int = 0, padding: int = 0, cell: tuple[int, int] | None = None) -> DataFrame:
    """(sheet, idx, x, y): cells of the largest sprite's size, row by row; 0 columns is a square.

    With a ``cell`` size of its own, (sheet, idx, x, y, w, h): sprites are shrunk to fit, never enlarged.
    """
    group = Window.partitionBy(sheet)
    size = {"_w": F.lit(cell[0]), "_h": F.lit(cell[1])} if cell else {"_w": F.max("w").over(group), "_h": F.max("h").over(group)}
    at = sprites.withColumns(size | {"_n": F.count(F.lit(1)).over(group), "_i": F.row_number().over(group.orderBy("idx")) - 1})
    w, h = fit(F.col("w"), F.col("h"), F.col("_w"), F.col("_h")) if cell else (F.col("w"), F.col("h"))
    cols = F.lit(columns) if columns else F.ceil(F.sqrt(F.col("_n").cast("double"))).cast("int")
    at = at.withColumns({"_c": F.greatest(cols, F.lit(1)), "_fw": w, "_fh": h})
    # a sprite is centred in its cell
    x = (F.col("_i") % F.col("_c")) * (F.col("_w") + padding) + F.floor((F.col("_w") - F.col("_fw")) / 2)
    y = F.floor(F.col("_i") / F.col("_c")) * (F.col("_h") + padding) + F.floor((F.col("_h") - F.col("_fh")) / 2)
    more = [F.col("_fw").alias("w"), F.col("_fh").alias("h")] if cell else []
    return at.select(sheet, "idx", x.cast("int").alias("x"), y.cast("int").alias("y"), *more)


def sheet_pixels(pixels: DataFrame, placed: DataFrame, sheet: str, background: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """(sheet, x, y, r, g, b, a) of sprites' pixels at their places on a background, mixed in doubles and truncated.

    ``pixels`` (sheet, idx, x, y, …) have the size of their places, shrunk before if they must be. Cells don't
    overlap, so each place has one pixel; only places with a sprite have rows.
    """
    at = placed.select(sheet, "idx", F.col("x").alias("_x"), F.col("y").alias("_y"))
    met = pixels.join(at, [sheet, "idx"]).withColumns({"x": F.col("x") + F.col("_x"), "y": F.col("y") + F.col("_y")})
    share = F.col("a") / lit(255)
    ground = dict(zip("rgba", background if background[3] else (0, 0, 0, 0), strict=True))
    mixed = {c: F.floor(F.col(c) * share + lit(ground[c]) * (lit(1) - share)) for c in "rgb"} | {"a": F.floor(F.col("a") + lit(ground["a"]) * (lit(1) - share))}
    new = {c: F.when(F.col("a") == 255, F.col(c)).when(F.col("a") > 0, mixed[c]).otherwise(F.lit(ground[c])).cast("int") for c in "rgba"}
    return met.select(sheet, "x", "y", *[v.alias(c) for c, v in new.items()])
