"""Image operators on hand-made pixels, and the driver's contract."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strata.functions.blend import MODES
from strata.operators import analysis, compose, filters, geometry, neighbourhood, strokes, tree
from strata.sources import codecs
from strata.streaming import strokes as streamed

DDL = "image_id long, x int, y int, r int, g int, b int, a int"


def image(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], DDL)


def over(d, s):
    """Source-over of two pixels, in Python's integers."""
    sa, da = s[3], d[3]
    if sa == 0:
        return d
    if sa == 255 or da == 0:
        return s
    out = sa + (da * (255 - sa) + 127) // 255
    return (*[(s[i] * sa + (d[i] * da * (255 - sa) + 127) // 255 + out // 2) // out for i in range(3)], out)


def test_source_over(spark):
    levels = [0, 1, 127, 128, 254, 255]
    cases = [((10, 200, 255, da), (250, 0, 90, sa)) for da in levels for sa in levels]
    back = image(spark, [(i, 0, *d) for i, (d, _) in enumerate(cases)])
    top = image(spark, [(i, 0, *s) for i, (_, s) in enumerate(cases)])
    out = compose.blend_images(back, top, "normal", ["image_id", "x", "y"]).orderBy("x").collect()
    assert [(r.r, r.g, r.b, r.a) for r in out] == [over(d, s) for d, s in cases]


@pytest.mark.parametrize("mode", MODES)
def test_transparent_source_keeps_backdrop(spark, mode):
    back = image(spark, [(0, 0, 9, 8, 7, 200)])
    out = compose.blend_images(back, image(spark, [(0, 0, 255, 255, 255, 0)]), mode, ["image_id", "x", "y"]).first()
    assert (out.r, out.g, out.b, out.a) == (9, 8, 7, 200)


def test_clipping_needs_a_layer_below(spark):
    stack = spark.createDataFrame([(1, 0, 0, 0, 255, 0, 0, 255, True), (1, 1, 0, 0, 0, 255, 0, 255, False)], "z int, x int, y int, doc_id int, r int, g int, b int, a int, clipped boolean")
    stack = stack.withColumn("z", F.lit(0)).limit(1)
    out = compose.render(stack, 2, ["doc_id", "x", "y"]).first()
    assert out.a == 0


def test_filters_leave_transparent_pixels(spark):
    px = image(spark, [(0, 0, 10, 20, 30, 0), (1, 0, 10, 20, 30, 255)])
    for f in (filters.invert, lambda p: filters.posterize(p, 1), lambda p: filters.threshold(p, 5), lambda p: filters.adjust(p, filters.Adjust(brightness=1))):
        clear, seen = f(px).orderBy("x").collect()
        assert (clear.r, clear.g, clear.b) == (10, 20, 30) != (seen.r, seen.g, seen.b)
    assert filters.adjust(px, filters.Adjust()) is px


def test_convolution_of_a_flat_image(spark):
    flat = image(spark, [(x, y, 80, 80, 80, 255) for x in range(3) for y in range(3)])
    assert {r.r for r in neighbourhood.convolve(flat, neighbourhood.KERNELS["edge_detect"]).collect()} == {0}
    assert {r.r for r in neighbourhood.gaussian_blur(flat, 3).collect()} == {80}


def test_fill_stops_at_walls(spark):
    wall = [(x, y, 0, 0, 0, 255) if x == 1 else (x, y, 255, 255, 255, 255) for x in range(3) for y in range(3)]
    out = analysis.fill_region(image(spark, wall), 0, 0, (1, 2, 3, 255), 0)
    assert {(r.x, r.r) for r in out.collect()} == {(0, 1), (1, 0), (2, 255)}
    assert out.where("r = 1").count() == 3
    assert analysis.fill_all(image(spark, wall), 0, 0, (1, 2, 3, 255), 0).where("r = 1").count() == 6


def test_turns_and_flips_undo_themselves(spark):
    px = image(spark, [(x, y, x * 40, y * 40, 0, 255) for x in range(4) for y in range(2)])
    same = geometry.rotate90(geometry.rotate90(px, 4, 2, 1), 2, 4, 3)
    assert sorted(map(tuple, same.select(*px.columns).collect())) == sorted(map(tuple, px.collect()))
    twice = geometry.flip(geometry.flip(px, 4, 2, True, True), 4, 2, True, True)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, px.collect()))


def test_png(spark):
    raw = bytes(range(48))
    assert codecs.decode_png(codecs.encode_png(4, 3, raw)) == (4, 3, raw)
    bad = spark.createDataFrame([(1, bytearray(b"no")), (2, bytearray(codecs.encode_png(1, 1, b"abcd")[:-30]))], "image_id long, png binary")
    assert all(r.data is None and r.error for r in codecs.from_png(bad).collect())


def test_stream_equals_batch(spark, tmp_path):
    points = pd.DataFrame({"stroke_id": [1] * 6 + [2] * 6, "seq": [*range(6)] * 2, "x": range(12), "y": range(0, 24, 2), "pressure": [0.5] * 12})
    batch = strokes.smoothed(spark.createDataFrame(points).selectExpr("stroke_id", "cast(seq as long) seq", "x", "y", "pressure"), 0.4)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("stroke_id long, seq long, x long, y long, pressure double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, part in enumerate((points[points.seq < 3], points[points.seq >= 3])):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not i:
            query = streamed.smoothed(source, 0.4).writeStream.outputMode("append").format("memory").queryName("smoothed").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
    query.stop()
    key = lambda r: (r.stroke_id, r.seq)
    assert sorted(map(tuple, spark.table("smoothed").collect())) == sorted(map(tuple, sorted(batch.collect(), key=key)))


def test_contract(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() > 0
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names


def test_palette(spark):
    px = image(spark, [(0, 0, 10, 0, 0, 255), (1, 0, 20, 0, 0, 255), (2, 0, 200, 0, 0, 255), (3, 0, 250, 0, 0, 255), (4, 0, 99, 99, 99, 0)])
    assert [(r.idx, r.r, r.a) for r in analysis.extract_palette(px, 2).orderBy("idx").collect()] == [(0, 15, 255), (1, 225, 255)]
    assert analysis.extract_palette(px, 9).count() == 4
    assert [(r.r, r.a) for r in analysis.extract_palette(px.where("a = 0"), 3).collect()] == [(0, 0)]


def test_layers_of_any_depth(spark):
    rows = [(f"l{i}", f"l{i - 1}" if i else None, 0) for i in range(17)] + [("x", None, 1)]
    layers = spark.createDataFrame(rows, "id string, parent string, idx int").coalesce(1).cache()
    assert {r.id: r.depth for r in tree.listed(layers).select("id", "depth").collect()} == {"x": 0} | {f"l{i}": i for i in range(17)}
