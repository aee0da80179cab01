"""Pixels of shapes against plain loops, and how tables of shapes are dealt out."""

import re

import pytest
from pyspark.sql import functions as F

from strata.operators import shapes

BOXES = "shape long, w int, h int"
#: No area, one pixel, small, more pixels than a tile, longer than a tile is wide.
SIZES = [(0, -3), (1, 1), (7, 5), (2, 9), (300, 260), (70_000, 2)]


def far(x, y, ax, ay, bx, by):
    vx, vy = bx - ax, by - ay
    long = vx * vx + vy * vy
    t = min(1.0, max(0.0, ((x - ax) * vx + (y - ay) * vy) / long)) if long else 0.0
    return (x - ax - vx * t) ** 2 + (y - ay - vy * t) ** 2


def parted(df):
    """Pixels, each once."""
    rows = df.collect()
    out = {(r.shape, r.x, r.y): r.part for r in rows}
    assert len(out) == len(rows)
    return out


def is_dealt(df):
    """Whether the pixels of one partition of shapes come from several tasks."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def many(spark):
    return spark.range(2000).coalesce(1).select(F.col("id").alias("shape"), F.lit(9).alias("w"), F.lit(6).alias("h"))


@pytest.mark.parametrize("stroke", [0, 2])
def test_polygons(spark, stroke):
    star = [(4, 0), (6, 9), (0, 3), (9, 3), (2, 9)]
    rings = [[(0, 0), (5, 1), (2, 6)], [(1, 1), (6, 1), (6, 4), (1, 4)], star, [(0, 0), (250, 40), (90, 255), (90, 20)], [(0, 0), (69_990, 1), (3, 2)], [(2, 2), (2, 2), (2, 2)], [(0, 0), (3, 3)], None]
    boxes = [(8, 8), (7, 5), (10, 10), (300, 260), (70_000, 2), (5, 5), (9, 9), (9, 9)]
    rows = [(i, w, h, ring) for i, ((w, h), ring) in enumerate(zip(boxes, rings, strict=True))]
    want = {}
    for i, w, h, ring in rows:
        edges = [tuple(map(float, (*a, *b))) for a, b in zip(ring[-1:] + ring[:-1], ring, strict=True)] if ring and len(ring) > 2 else []
        for y in range(h if edges else 0):
            for x in range(w):
                fx, fy = x + 0.5, y + 0.5
                inside = sum((ay > fy) != (by > fy) and fx < (bx - ax) * (fy - ay) / (by - ay) + ax for ax, ay, bx, by in edges) % 2
                near = stroke and any(far(fx, fy, *e) <= (stroke / 2) ** 2 for e in edges)
                if inside or near:
                    want[i, x, y] = "stroke" if near else "fill"
    df = spark.createDataFrame(rows, f"{BOXES}, points array<struct<x: int, y: int>>").coalesce(1)
    assert parted(shapes.polygon(df, stroke)) == want
    # a corner without numbers takes its edges away, and no others
    one = spark.createDataFrame([(1, 6, 4, [(0, 0), (6, 0), (None, 2), None])], f"{BOXES}, points array<struct<x: int, y: int>>")
    assert {k[2] for k in parted(shapes.polygon(one, stroke))} == ({0} if stroke else set())


def test_polygons_are_dealt(spark):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    assert is_dealt(shapes.polygon(many(spark).withColumn("points", F.array(corner(0, 0), corner(9, 1), corner(3, 6))), 2))


def method_sizes(df):
    """Bytes of the largest methods that a plan's stages are compiled from; the JVM only interprets those over 8000."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        said = spark._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said)]


@pytest.mark.parametrize("width", [1, 3, 10])
def test_lines(spark, width):
    rows = [(i, w, h) for i, (w, h) in enumerate([*SIZES, (3, 40), (40, 3), (12, 1), (1, 12), (9, 2)])]
    want = set()
    for i, w, h in rows:
        w, h = max(w, 1), max(h, 1)
        end = (w - 0.5, h - 0.5)
        want |= {(i, x, y) for y in range(h) for x in range(w) if far(x + 0.5, y + 0.5, 0.5, 0.5, *end) <= (width / 2) ** 2}
    got = parted(shapes.line(spark.createDataFrame(rows, BOXES), width))
    assert set(got) == want and set(got.values()) == {"stroke"}


def test_lines_are_dealt_and_compiled(spark):
    df = shapes.line(many(spark), 3)
    assert is_dealt(df)
    assert max(method_sizes(df)) < 8000
    # a box of more pixels than an int counts
    long = shapes.line(spark.createDataFrame([(1, 50_000, 50_000)], BOXES), 1).agg(F.count("*"), F.sum((F.col("x") == F.col("y")).cast("int")), F.max("x")).first()
    assert tuple(long) == (50_000, 50_000, 49_999)


@pytest.mark.parametrize(("stroke", "radius"), [(0, 0), (2, 0), (0, 3), (2, 4)])
def test_rectangles(spark, stroke, radius):
    def rounded(x, y, w, h, r):
        if w <= 0 or h <= 0:
            return False
        if r <= 0:
            return 0 <= x <= w and 0 <= y <= h
        return (x - min(max(x, r), w - r)) ** 2 + (y - min(max(y, r), h - r)) ** 2 <= r * r

    rows, want, n = [(i, w, h) for i, (w, h) in enumerate(SIZES)], {}, stroke
    for i, w, h in rows:
        w, h, r = max(w, 1), max(h, 1), min(radius, w // 2, h // 2)
        for fx, fy in ((x + 0.5, y + 0.5) for y in range(h) for x in range(w)):
            if radius:
                edge = not rounded(fx - n, fy - n, w - 2 * n, h - 2 * n, max(r - n, 0))
            else:
                edge = fx <= n or fx >= w - n or fy <= n or fy >= h - n
            if rounded(fx, fy, w, h, r):
                want[i, int(fx), int(fy)] = "stroke" if n and edge else "fill"
    assert parted(shapes.rectangle(spark.createDataFrame(rows[1:], BOXES), stroke, radius)) == {k: v for k, v in want.items() if k[0]}
    # a box without area counts as one pixel; its corners are cut by its own sizes
    assert shapes.rectangle(spark.createDataFrame(rows[:1], BOXES), stroke).count() == 1


def test_rectangles_are_dealt_and_compiled(spark):
    for radius in (0, 4):
        df = shapes.rectangle(many(spark), 2, radius)
        assert is_dealt(df)
        assert max(method_sizes(df)) < 8000
