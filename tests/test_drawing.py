"""Documents, brushes, text and GIF frames on small cases."""

import struct

import pytest
from pyspark.sql import functions as F

from strata.functions import text
from strata.operators import brush, document, filters, geometry, neighbourhood
from strata.operators.document import Layer
from strata.sources import gif

PIXELS = "doc_id long, x int, y int, r int, g int, b int, a int"


def canvas(spark, rgba, w=3, h=3):
    return spark.createDataFrame([(1, x, y, *rgba) for x in range(w) for y in range(h)], PIXELS)


def shown(df):
    return {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in df.collect()}


def test_document(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    red, one = canvas(spark, (200, 0, 0, 255)), spark.createDataFrame([(1, 0, 0, 0, 0, 0, 255)], PIXELS)
    assert set(shown(document.render(docs, (), 2, 2)).values()) == {(0, 0, 0, 0)}
    assert document.render(docs, (), 0, 2).count() == 0
    # a mask counts only where it has pixels, and moving an image cuts off what leaves the canvas
    masked = shown(document.render(docs.where("doc_id = 1"), (Layer("image", red, mask=one),), 2, 2))
    assert masked[0, 0][3] == 0 and masked[1, 1] == (200, 0, 0, 255)
    moved = shown(document.render(docs.where("doc_id = 1"), (Layer("image", red, x=1),), 2, 2))
    assert moved[0, 0][3] == 0 and moved[1, 0] == (200, 0, 0, 255)
    # a group's filter sees all of the group, the document's only what is below
    bright = Layer("filter", knobs=filters.Adjust(brightness=1.0), sharpen=0.3)
    solid = Layer("solid", fill=(10, 10, 10, 255))
    docs = docs.where("doc_id = 1")
    assert shown(document.render(docs, (bright, solid), 1, 1))[0, 0] == (10, 10, 10, 255)
    group = Layer("group", children=(bright, solid))
    assert shown(document.render(docs, (group,), 1, 1))[0, 0] == (190, 190, 190, 255)
    assert shown(document.render(docs, (document.flattened(docs, group, 1, 1),), 1, 1))[0, 0] == (190, 190, 190, 255)
    # clipping without a layer below shows nothing; a hidden layer doesn't count as below
    clipped = Layer("solid", fill=(1, 2, 3, 255), clip_to_below=True)
    hidden = Layer("solid", fill=(9, 9, 9, 255), visible=False)
    assert shown(document.render(docs, (hidden, clipped), 1, 1))[0, 0][3] == 0


def test_transforms(spark):
    px = canvas(spark, (40, 80, 120, 255), 4, 2).withColumnRenamed("doc_id", "image_id")
    same, w, h = geometry.transform(px, 4, 2)
    assert same is px and (w, h) == (4, 2)
    flat, w, h = geometry.transform(px, 4, 2, scale_x=0.5, scale_y=2.0)
    assert (w, h) == (2, 4) and set(shown(flat).values()) == {(40, 80, 120, 255)}
    assert set(shown(geometry.resize_lanczos(px, 4, 2, 9, 1)).values()) == {(40, 80, 120, 255)}
    turned, w, h = geometry.transform(px, 4, 2, degrees=45)
    assert turned.count() == w * h and turned.where("a = 255").count() > 0
    assert geometry.trim(px.withColumn("a", F.lit(0))).count() == 0
    # the sum of the products may fall just short of the whole number before it is truncated, channel by channel
    blurred = set(shown(neighbourhood.box_blur(px, 2)).values())
    assert all(0 <= v - b <= 1 for p in blurred for v, b in zip((40, 80, 120, 255), p, strict=True))


def test_brush(spark):
    pen = brush.Brush(size=2, spacing=1.0, color=(9, 8, 7, 255))
    made, state = brush.walk([(0.0, 0.0, 1.0, 0.0, 0.0), (5.0, 0.0, 1.0, 0.0, 0.0)], pen)
    assert [p[0] for p in made] == [0, 2, 4, 5]
    # points that come in two parts leave the same stamps
    again, state = brush.walk([(0.0, 0.0, 1.0, 0.0, 0.0)], pen)
    assert again + brush.walk([(5.0, 0.0, 1.0, 0.0, 0.0)], pen, state)[0] == made
    points = spark.createDataFrame([(1, 0, 2.0, 2.0, 1.0), (1, 1, 4.0, 2.0, 1.0)], "stroke_id long, seq long, x double, y double, pressure double")
    dabs = brush.dabs(brush.stamps(points, pen), pen).withColumnRenamed("stroke_id", "image_id")
    clear = canvas(spark, (0, 0, 0, 0), 6, 4).withColumnRenamed("doc_id", "image_id")
    out = shown(brush.paint(clear, dabs, pen))
    assert {p for p, v in out.items() if v == (9, 8, 7, 255)} == {(x, y) for x in range(1, 5) for y in (1, 2)}
    assert set(shown(brush.paint(clear, dabs, pen, locked=True)).values()) == {(0, 0, 0, 0)}
    full = canvas(spark, (5, 5, 5, 255), 6, 4).withColumnRenamed("doc_id", "image_id")
    gone = shown(brush.paint(full, dabs, brush.Brush(size=2, spacing=1.0, erase=True)))
    assert gone[1, 1] == (0, 0, 0, 0) and gone[0, 0] == (5, 5, 5, 255)
    soft = brush.Brush(size=9, hardness=0.2, opacity=0.5, grain=True)
    alphas = [r.alpha for r in brush.dabs(brush.stamps(points.limit(1), soft), soft).collect()]
    assert 0 < min(alphas) < max(alphas) <= 128
    import pandas as pd

    assert brush.times(pd.Series([10.0, 5.0, float("nan"), 40.0])) == [10, 11, 27, 40]
    assert brush.packed_points([1, 2, 3], 3) == [(1, 2, 3)]
    for bad in ([], [1, 2], [1.0] * 4):
        with pytest.raises(ValueError):
            brush.packed_points(bad, 3)


def test_text(spark):
    df = spark.createDataFrame([("one two three\n\nabcdefghij k",)], "t string")
    lines = text.wrapped(F.col("t"), 8 * 7, 8)
    row = df.select(lines.alias("l"), *[c.alias(n) for n, c in zip("wh", text.measured(lines, 56, 8, line_height=10), strict=True)]).first()
    assert row.l == ["one two", "three", "", "abcdefg", "hij", "k"] and (row.w, row.h) == (56, 58)
    free = text.wrapped(F.col("t"), None, 9)
    row = df.select(free.alias("l"), *[c.alias(n) for n, c in zip("wh", text.measured(free, None, 9, 1), strict=True)]).first()
    assert len(row.l) == 3 and (row.w, row.h) == (13 * 16 + 12, 48)
    marks = ["<svg><rect/></svg>", "<svg><script>x</script></svg>", "<svg><animateMotion/></svg>", '<svg><image href="http://a"/></svg>', '<svg><image href="data:x"/></svg>', "no", "<svg><settings/></svg>"]
    got = [r.f for r in spark.createDataFrame(list(enumerate(marks)), "i int, m string").orderBy("i").select(text.svg_fault(F.col("m")).alias("f")).collect()]
    assert got == [None, "holds scripts", "holds animations", "refers to images elsewhere", None, "not well formed", None]
    css = "@font-face { font-family: 'Some Sans'; font-weight: 700; src: url(https://x/y.woff2) format('woff2'); }"
    face = spark.createDataFrame([(css,)], "c string").select(F.explode(text.font_faces(F.col("c")))).first()[0]
    assert tuple(face) == ("Some Sans", "700", "normal", "https://x/y.woff2")


def _gif(frames):
    """A GIF of 2 by 1 pixels; codes are never compressed: a clear code before each index."""
    out = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x80, 0, 0) + bytes([255, 0, 0, 0, 0, 255])
    for indices, disposal in frames:
        bits = "".join(f"{c:03b}"[::-1] for i in indices for c in (4, i)) + f"{5:03b}"[::-1]
        data = int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | 1, 7, 0, 1]) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 1, 0) + b"\x02" + bytes([len(data)]) + data + b"\0"
    return out + b"\x3b"


def test_gif(spark):
    raw = _gif([([0, 1], 1), ([1, 0], 2), ([1, 0], 3), ([1, 1], 0)])
    red, none = (255, 0, 0, 255), (0, 0, 0, 0)
    want = [[red, none], [red, red], [none, red], [none, none]]
    rows = gif.from_gif(spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"GIF8")), (3, None)], "image_id long, gif binary")).collect()
    frames = sorted((r for r in rows if r.image_id == 1), key=lambda r: r.frame)
    assert [[tuple(r.data[i : i + 4]) for i in (0, 4)] for r in frames] == want
    assert {r.delay_ms for r in frames} == {70}
    assert all(r.data is None and r.error for r in rows if r.image_id > 1)
