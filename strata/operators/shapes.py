"""Generators: pixels of shapes and gradients over a grid, by predicates on pixel centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.color import lit

#: Most pixels of a tile, and about as many as arrays hold at a time.
TILE = 1 << 16


def grid(spark: SparkSession, w: int, h: int) -> DataFrame:
    p = spark.range(w * h)
    return p.select((F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y"))


def in_ellipse(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Whether a point lies in the ellipse of a w by h box at the origin."""
    dx, dy = (x - w / 2.0) / (w / 2.0), (y - h / 2.0) / (h / 2.0)
    return dx * dx + dy * dy <= 1.0


def ellipse(shapes: DataFrame, stroke: int = 0) -> DataFrame:
    """(shape, x, y, part) of shapes (shape, w, h): part is ``stroke`` or ``fill``; pixels outside have no row."""
    at = shapes.select("shape", "w", "h", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("p"))
    cell = at.select("shape", "w", "h", (F.col("p") % F.col("w")).cast("int").alias("x"), F.floor(F.col("p") / F.col("w")).cast("int").alias("y"))
    x, y, w, h = F.col("x") + 0.5, F.col("y") + 0.5, F.col("w").cast("double"), F.col("h").cast("double")
    iw, ih = w - 2.0 * stroke, h - 2.0 * stroke
    safe = lambda v: F.when(v <= 0, lit(1)).otherwise(v)
    inner = (iw > 0) & (ih > 0) & in_ellipse(x - stroke, y - stroke, safe(iw), safe(ih))
    part = F.when(inner, "fill").otherwise("stroke") if stroke else F.lit("fill")
    return cell.where(in_ellipse(x, y, w, h)).select("shape", "x", "y", part.alias("part"))


def gradient(cells: DataFrame, stops: list[tuple[float, tuple[int, int, int, int]]], direction: str) -> DataFrame:
    """Colour (x, y) cells of shapes (w, h) along a gradient: horizontal, vertical, diagonal_down or diagonal_up."""
    return cells.withColumns(gradient_at(F.col("x"), F.col("y"), F.col("w"), F.col("h"), stops, direction))


def gradient_at(x: Column, y: Column, w: Column, h: Column, stops: list[tuple[float, tuple[int, int, int, int]]], direction: str) -> dict[str, Column]:
    """Channels of a gradient's pixel; a place outside all pairs of stops runs from the first stop to the last."""
    fx, fy = x / F.greatest(w - 1, F.lit(1)).cast("double"), y / F.greatest(h - 1, F.lit(1)).cast("double")
    t = {"horizontal": fx, "vertical": fy, "diagonal_down": (fx + fy) / 2.0, "diagonal_up": (fx + (lit(1) - fy)) / 2.0}[direction]
    out = {}
    for i, c in enumerate("rgba"):
        pairs = [*zip(stops, stops[1:], strict=False), (stops[0], stops[-1])]
        value = None
        for n, ((p, a), (q, b)) in enumerate(pairs):
            f = (t - p) / (q - p) if q > p else lit(0)
            here, inside = F.floor(lit(a[i]) * (lit(1) - f) + lit(b[i]) * f + 0.5), (t >= p) & (t <= q)
            if n == len(pairs) - 1:
                value = here if value is None else value.otherwise(here)
            else:
                value = F.when(inside, here) if value is None else value.when(inside, here)
        out[c] = value.cast("int")
    return out


def _tiles(shapes: DataFrame) -> DataFrame:
    """Shapes by tiles (_x0, _x1, _y0, _y1, ends included), dealt to all tasks: few rows, which become many pixels."""
    w, h = (F.greatest(F.col(c), F.lit(1)).cast("long") for c in "wh")
    sized = shapes.withColumns({"_wide": w, "_high": h, "_tw": F.least(w, F.lit(TILE))})
    sized = sized.withColumn("_th", F.expr(f"{TILE} div _tw")).withColumn("_nx", F.expr("(_wide + _tw - 1) div _tw"))
    at = sized.withColumn("_t", F.explode(F.expr("sequence(0L, _nx * ((_high + _th - 1) div _th) - 1)")))
    at = at.withColumns({"_x0": F.expr("_t % _nx * _tw"), "_y0": F.expr("_t div _nx * _th")})
    ends = {"_x0": "_x0", "_x1": "least(_x0 + _tw, _wide) - 1", "_y0": "_y0", "_y1": "least(_y0 + _th, _high) - 1"}
    at = at.select(*shapes.columns, *[F.expr(f"cast({v} as int)").alias(k) for k, v in ends.items()])
    spark = shapes.sparkSession
    return at.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _lines(tiles: DataFrame) -> DataFrame:
    """The lines y of tiles. Places come from generators: a predicate that is moved below a projection repeats what it
    computes, and methods of over 8000 bytes are not compiled."""
    return tiles.withColumn("y", F.explode(F.sequence("_y0", "_y1")))


def _places(rows: DataFrame, first: str, last: str) -> DataFrame:
    """The places x of lines, from column first to column last, which may be empty."""
    return rows.where(F.col(first) <= F.col(last)).withColumn("x", F.explode(F.sequence(first, last)))


def _in_rounded(x: Column, y: Column, w: Column, h: Column, radius: Column) -> Column:
    """Corners are quarter discs; a radius of 0 or less is a plain rectangle, and a box without area holds nothing."""
    dx = x - F.least(F.greatest(x, radius), w - radius)
    dy = y - F.least(F.greatest(y, radius), h - radius)
    plain = x.between(lit(0), w) & y.between(lit(0), h)
    return (w > 0) & (h > 0) & F.when(radius <= 0, plain).otherwise(dx * dx + dy * dy <= radius * radius)


def rectangle(shapes: DataFrame, stroke: int = 0, radius: int = 0) -> DataFrame:
    """(shape, x, y, part) of shapes (shape, w, h), with rounded corners; the stroke runs along the inside of the edge."""
    sides = {f"_{c}": F.greatest(F.col(c), F.lit(1)).cast("double") for c in "wh"}
    corner = F.least(F.lit(radius), F.floor(F.col("w") / 2), F.floor(F.col("h") / 2)).cast("double")
    sized = shapes.select("shape", "w", "h", *[v.alias(k) for k, v in sides.items()], corner.alias("_r"))
    cell = _places(_lines(_tiles(sized)), "_x0", "_x1")
    x, y, w, h, r = F.col("x") + 0.5, F.col("y") + 0.5, *(F.col(c) for c in ("_w", "_h", "_r"))
    if radius:
        inner = _in_rounded(x - stroke, y - stroke, w - 2.0 * stroke, h - 2.0 * stroke, F.greatest(r - stroke, lit(0)))
        edge = ~inner
    else:
        edge = (x <= stroke) | (x >= w - stroke) | (y <= stroke) | (y >= h - stroke)
    part = F.when(edge, "stroke").otherwise("fill") if stroke else F.lit("fill")
    return cell.where(_in_rounded(x, y, w, h, r)).select("shape", "x", "y", part.alias("part"))


def _distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment, squared; a segment of no length is a point."""
    vx, vy = bx - ax, by - ay
    long = vx * vx + vy * vy
    t = F.when(long <= 0, lit(0)).otherwise(F.least(lit(1), F.greatest(lit(0), ((x - ax) * vx + (y - ay) * vy) / F.when(long <= 0, lit(1)).otherwise(long))))
    dx, dy = x - ax - vx * t, y - ay - vy * t
    return dx * dx + dy * dy


def line(shapes: DataFrame, width: int = 1) -> DataFrame:
    """(shape, x, y, part) of the diagonals of boxes (shape, w, h), from the first pixel's centre to the last's."""
    reach = max(width, 1) / 2.0
    w, h = (F.greatest(F.col(c).cast("double") - 0.5, lit(0.5)) for c in "wh")
    rows = _lines(_tiles(shapes.select("shape", w.alias("_bx"), h.alias("_by"), "w", "h"))).withColumn("_fy", F.col("y") + 0.5)
    # where the segment is within reach of a row of pixels, and a little more; distances are taken of what is there only
    bx, by, y = (F.col(c) for c in ("_bx", "_by", "_fy"))
    along = lambda v: lit(0.5) + (bx - 0.5) * F.least(lit(1), F.greatest(lit(0), (v - 0.5) / (by - 0.5)))
    slack = reach + 0.01
    low, high = (F.when(by > 0.5, along(y + k * slack)).otherwise(end) + k * slack for k, end in ((-1, lit(0.5)), (1, bx)))
    ends = {"_lo": F.greatest(F.col("_x0").cast("long"), F.ceil(low - 0.5)), "_hi": F.least(F.col("_x1").cast("long"), F.floor(high - 0.5))}
    cell = _places(rows.withColumns({k: v.cast("int") for k, v in ends.items()}), "_lo", "_hi")
    near = _distance(F.col("x") + 0.5, y, lit(0.5), lit(0.5), bx, by) <= reach**2
    return cell.where(near).select("shape", "x", "y", F.lit("stroke").alias("part"))


def _polygon_cells(stroke: int):
    """Batches of tiles (shape, _x0, _x1, _y0, _y1, _xs, _ys) to their pixels (shape, at): x, y and edge in 31, 31 and 1 bits."""

    def cells(b: pa.RecordBatch) -> pa.RecordBatch:
        x0, x1, y0, y1 = (b.column(c).to_numpy() for c in ("_x0", "_x1", "_y0", "_y1"))
        n, first = b.column("_xs").value_lengths().to_numpy(), b.column("_xs").offsets.to_numpy()[:-1]
        xs, ys = (b.column(c).values.to_numpy(zero_copy_only=False) for c in ("_xs", "_ys"))
        tall, wide = y1 - y0 + 1, x1 - x0 + 1
        tile = np.repeat(np.arange(len(n)), tall)  # of a line of pixels
        begin = np.cumsum(tall) - tall
        line = np.arange(len(tile)) - begin[tile] + y0[tile]
        long = wide[tile]
        end = np.cumsum(long)
        x = np.arange(end[-1]) + np.repeat(x0[tile] - (end - long), long)
        fx, fy = x + 0.5, line + 0.5
        inside, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for k in range(n[0]):
            some = np.searchsorted(-n, -k)  # tiles come by falling numbers of corners
            rows = begin[some - 1] + tall[some - 1]
            at, to, size = first[:some] + (k or n[:some]) - 1, first[:some] + k, long[:rows]
            t, cut = tile[:rows], end[rows - 1]
            ax, ay, by = xs[at], ys[at], ys[to][t]
            vx, vy = xs[to] - ax, ys[to] - ay
            dy, v = fy[:rows] - ay[t], vy[t]
            spans = (ay[t] > fy[:rows]) != (by > fy[:rows])
            inside[:cut] ^= fx[:cut] < np.repeat(np.where(spans, vx[t] * dy / np.where(spans, v, 1.0) + ax[t], -np.inf), size)
            if stroke:
                total = vx * vx + vy * vy
                dx, v_x = fx[:cut] - np.repeat(ax[t], size), np.repeat(vx[t], size)
                share = np.clip((dx * v_x + np.repeat(dy * v, size)) / np.repeat(np.where(total <= 0, 1.0, total)[t], size), 0.0, 1.0)
                dx -= v_x * share
                off = np.repeat(dy, size) - np.repeat(v, size) * share
                edge[:cut] |= dx * dx + off * off <= (stroke / 2.0) ** 2
        kept = np.flatnonzero(inside | edge)
        counts = np.bincount(np.repeat(tile, long)[kept], minlength=len(n))
        at = x[kept] << 32 | np.repeat(line, long)[kept] << 1 | edge[kept]
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([b.column("shape"), pa.ListArray.from_arrays(pa.array(ends), pa.array(at))], ["shape", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for b in batches:
                size = np.cumsum((b.column("_x1").to_numpy().astype(np.int64) - b.column("_x0").to_numpy() + 1) * (b.column("_y1").to_numpy() - b.column("_y0").to_numpy() + 1))
                n = b.column("_xs").value_lengths().to_numpy()
                group = size // TILE
                order = np.lexsort((-n, group))
                for g in np.split(order, np.flatnonzero(np.diff(group)) + 1):
                    if len(g):
                        yield cells(b.take(pa.array(g)))

    return run


def polygon(shapes: DataFrame, stroke: int = 0) -> DataFrame:
    """(shape, x, y, part) of shapes (shape, w, h, points): even-odd inside, stroke on both sides of the edges.

    ``points`` is an array of structs (x, y); fewer than three draw nothing, nor does an edge at a corner without numbers.
    """
    tiles = _tiles(shapes.where(F.size("points") >= 3).select("shape", "w", "h", *[F.col("points")[c].cast("array<double>").alias(f"_{c}s") for c in "xy"]))
    schema = T.StructType([tiles.schema["shape"], T.StructField("at", T.ArrayType(T.LongType()))])
    at = tiles.drop("w", "h").mapInArrow(_polygon_cells(stroke), schema).select("shape", F.explode("at").alias("at"))
    x, y = F.shiftright("at", 32).cast("int"), F.shiftright("at", 1).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    part = F.when(F.col("at").bitwiseAND(F.lit(1)) == 1, "stroke").otherwise("fill")
    return at.select("shape", x.alias("x"), y.alias("y"), part.alias("part"))
