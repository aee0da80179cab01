"""The layer table, its files and its renderer on small cases; the same trees compiled and as data."""

import itertools
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.functions import checks, text
from strata.functions.blend import MODES
from strata.functions.fonts import Fonts, families_in
from strata.operators import brush, compose, document, filters, renderer, wrappers
from strata.operators import layers as L
from strata.operators.document import Layer, Shape
from strata.sources import documents, imports
from strata.streaming import strokes as streamed

PIXELS = "doc_id long, x int, y int, r int, g int, b int, a int"


def table(spark, *rows):
    """Layers (layer_id, fields) of document 1, in their order unless they have an idx."""
    names = [c.split(" ", 1)[0] for c in L.DDL.split(", ")]
    full = [{"doc_id": 1, "layer_id": i, "idx": n, "name": f"l{i}"} | L._DEFAULTS | fields for n, (i, fields) in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in full], L.DDL)


def order(layers, parent=None):
    rows = layers.where(F.col("parent_id").eqNullSafe(F.lit(parent))).orderBy("idx").select("layer_id", "idx").collect()
    assert [r.idx for r in rows] == list(range(len(rows)))
    return [r.layer_id for r in rows]


def tree(spark):
    group = {"kind": "group"}
    return table(spark, (1, {"kind": "raster"}), (2, group), (3, {"kind": "raster"}), (4, group | {"parent_id": 2, "idx": 0}), (5, {"kind": "raster", "parent_id": 4, "idx": 0}), (6, {"kind": "raster", "parent_id": 2, "idx": 1}))


def test_moves(spark):
    t = tree(spark)
    assert order(L.moved(t, 1, None, 2)) == [2, 1, 3] and order(L.moved(t, 1, None, 3)) == [2, 3, 1]
    assert order(L.moved(t, 3, None, 0)) == [3, 1, 2] and order(L.moved(t, 2)) == [1, 3, 2]
    into = L.moved(t, 1, 2, 1)
    assert order(into) == [2, 3] and order(into, 2) == [4, 1, 6]
    assert order(L.moved(t, 5, None, 9)) == [1, 2, 3, 5] and order(L.moved(t, 3, 4)) == [1, 2] and order(L.moved(t, 3, 4), 4) == [5, 3]
    for refused in (L.moved(t, 2, 2), L.moved(t, 2, 4), L.moved(t, 3, 1), L.moved(t, 99, 2), L.moved(t, 3, 99)):
        assert sorted(map(tuple, refused.select("layer_id", "parent_id", "idx").fillna(0).collect())) == sorted(map(tuple, t.select("layer_id", "parent_id", "idx").fillna(0).collect()))


def test_tree_edits(spark):
    t, docs = tree(spark), spark.createDataFrame([(1, 4, 4, 50), (2, 4, 4, 1)], "doc_id long, width int, height int, next_id long")
    assert {r.layer_id: r.depth for r in L.listed(t).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 6: 1, 5: 2}
    assert [r.layer_id for r in L.listed(t, 2).orderBy("path").collect()] == [4, 5, 6] and L.listed(t, 1).count() == L.listed(t, 99).count() == 0
    gone = L.removed(t, 2)
    assert {r.layer_id for r in gone.collect()} == {1, 3} and order(gone) == [1, 3]
    assert L.removed_child(t, 2, 5).count() == 6 and {r.layer_id for r in L.removed_child(t, 2, 4).collect()} == {1, 2, 3, 6}
    more = L.add_solid(t, docs, "s", (1, 2, 3, 4))
    assert {(r.doc_id, r.layer_id, r.idx) for r in more.where("name = 's'").collect()} == {(1, 50, 3), (2, 1, 0)}
    with pytest.raises(ValueError, match="no group"):
        L.add_group(t, docs, "g", 2)
    assert L.add_group(t, docs.where("doc_id = 1"), "g", 4).where("name = 'g'").first().idx == 1
    with pytest.raises(ValueError):
        L.add_image(t, docs, "i", b"123", 1, 1)
    with pytest.raises(ValueError, match="scripts"):
        L.add_svg(t, docs, "v", "<svg><script/></svg>", 1, 1)
    with pytest.raises(ValueError):
        L.updated(t, 1, colour="red")
    same = L.updated(t, 1, opacity=None, scale_x=0.0)
    assert same.where("layer_id = 1").first().scale_x == 2.0**-52 and same.where("layer_id = 1").first().opacity == 1.0
    one = L.about(t).first()
    assert (one.top, one.layers, one.last_id, one.has_svg) == (3, 6, 6, False)


def test_modes_as_data(spark):
    """Every mode on whole arrays gives what the expressions give."""
    rng = np.random.default_rng(6)
    back, top = (rng.integers(0, 256, (300, 4), dtype=np.uint8) for _ in range(2))
    back[::5, 3], top[::7, 3], top[::11, 3] = 0, 0, 255
    rows = lambda px: spark.createDataFrame([(1, i, 0, *map(int, p)) for i, p in enumerate(px)], PIXELS).coalesce(1)
    d, s = rows(back).cache(), rows(top).cache()
    for mode in MODES:
        out = {r.x: (r.r, r.g, r.b, r.a) for r in compose.blend_images(d, s, mode, ["doc_id", "x", "y"]).collect()}
        assert [out[i] for i in range(300)] == list(map(tuple, renderer.blended(back, top, mode).tolist())), mode


def _image(spark, px):
    return spark.createDataFrame([(1, x, y, *map(int, px[y, x])) for y in range(px.shape[0]) for x in range(px.shape[1])], PIXELS)


def _fill(stops):
    return [{"position": p} | dict(zip("rgba", c, strict=True)) for p, c in stops]


@pytest.mark.parametrize("case", ["mask", "flip", "turn", "shapes", "filter", "group"])
def test_compiled_and_as_data(spark, case):
    """Small trees, compiled to a plan and as rows, give the same pixels."""
    rng = np.random.default_rng(len(case))
    w, h, full = 7, 5, {k: 0.0 for k in L.KNOBS}
    px, mask = rng.integers(0, 256, (4, 6, 4), dtype=np.uint8), rng.integers(0, 256, (3, 5, 4), dtype=np.uint8)
    px[rng.random((4, 6)) < 0.3, 3] = 0
    raster = {"kind": "raster", "rgba": bytearray(px.tobytes()), "w": 6, "h": 4}
    image = Layer("image", _image(spark, px), size=(6, 4))
    compiled, data, inner = [Layer("solid", fill=(90, 60, 30, 200))], [{"kind": "solid", "fill": _fill([(0.0, (90, 60, 30, 200))])}], []
    if case == "mask":
        compiled += [replace(image, x=1, mask=_image(spark, mask), mask_inverted=True, mode="overlay"), replace(image, clip_to_below=True, opacity=0.4)]
        data += [raster | {"x": 1, "mask": bytearray(mask.tobytes()), "mask_w": 5, "mask_h": 3, "mask_inverted": True, "blend_mode": "overlay"}, raster | {"clip_to_below": True, "opacity": 0.4}]
    elif case == "flip":
        compiled.append(replace(image, flip_x=True, flip_y=True, anchor="center", x=3, y=3))
        data.append(raster | {"flip_x": True, "flip_y": True, "anchor": "center", "x": 3, "y": 3})
    elif case == "turn":
        compiled.append(replace(image, scale_x=0.75, scale_y=1.25, degrees=30.0, x=-1))
        data.append(raster | {"scale_x": 0.75, "scale_y": 1.25, "rotation": 30.0, "x": -1})
    elif case == "shapes":
        for s in (Shape("rectangle", 5, 4, 2, (9, 99, 200, 255), (200, 20, 2, 128), 1), Shape("ellipse", 5, 4, 0, (9, 99, 200, 99)), Shape("line", 6, 4, stroke=(1, 2, 3, 255), stroke_width=2), Shape("polygon", 7, 5, fill=(5, 5, 5, 200), stroke=(250, 1, 1, 255), points=((0, 0), (6, 1), (3, 5)))):
            compiled.append(Layer("shape", shape=s, x=1))
            data.append({"kind": "shape", "w": s.w, "h": s.h, "x": 1, "shape": {"type": s.kind, "radius": s.radius, "fill": list(s.fill) if s.fill else None, "stroke": list(s.stroke) if s.stroke else None, "stroke_width": s.stroke_width, "points": [{"x": x, "y": y} for x, y in s.points]}})
    elif case == "filter":
        knobs = dict(hue=40.0, saturation=0.2, lightness=-0.1, alpha=-0.05, brightness=0.1, contrast=-0.3, temperature=0.2, tint=-0.1)
        compiled, data = [image, Layer("filter", knobs=filters.Adjust(**knobs), sharpen=0.4)], [raster, {"kind": "filter", "filter": full | knobs | {"sharpen": 0.4}}]
    else:
        stops = [(0.0, (255, 0, 0, 255)), (0.5, (0, 255, 0, 128)), (1.0, (0, 0, 255, 255))]
        compiled.append(Layer("group", opacity=0.6, mode="multiply", children=(Layer("gradient", fill=tuple(stops), direction="diagonal_up"), Layer("filter", knobs=filters.Adjust(brightness=0.2)), Layer("solid", fill=(8, 8, 8, 90), mode="screen"))))
        data.append({"kind": "group", "opacity": 0.6, "blend_mode": "multiply"})
        inner = [{"kind": "gradient", "fill": _fill(stops), "direction": "diagonal_up"}, {"kind": "filter", "filter": full | {"brightness": 0.2}}, {"kind": "solid", "fill": _fill([(0.0, (8, 8, 8, 90))]), "blend_mode": "screen"}]
    numbered = [(n + 1, row) for n, row in enumerate(data)] + [(100 + n, row | {"parent_id": len(data), "idx": n}) for n, row in enumerate(inner)]
    docs = spark.createDataFrame([(1, w, h)], "doc_id long, width int, height int")
    got = np.frombuffer(renderer.render(docs, table(spark, *numbered)).first().data, np.uint8).reshape(h, w, 4)
    want = np.zeros((h, w, 4), np.uint8)
    for r in document.render(docs, tuple(compiled), w, h).collect():
        want[r.y, r.x] = (r.r, r.g, r.b, r.a)
    assert (got == want).all()


def test_texts_of_both_kinds(spark):
    glyphs = {"a": [255, 129, 129, 129, 129, 129, 129, 255], "b": [1, 2, 4, 8, 16, 32, 64, 128], "?": [24] * 8}
    face = spark.createDataFrame(list(glyphs.items()), "glyph string, bits array<int>")
    for align, size, wrap in itertools.product(("left", "center", "right"), (8, 12), (None, 60)):
        about = {"text": "ab b\nbxa aaaaaaaaa\n\nb", "color": [1, 2, 3, 255], "size": size, "line_height": 20, "letter_spacing": 1, "align": align, "wrap": wrap is not None, "box_width": wrap}
        px = renderer.text_pixels(about, glyphs)
        lines = spark.createDataFrame([(1, about["text"])], "k int, t string").select("k", text.wrapped(F.col("t"), wrap, size, 1).alias("lines"))
        got = np.zeros_like(px)
        for r in text.raster(lines, "k", face, size, 20, 1, (1, 2, 3, 255), align, wrap).collect():
            got[r.y, r.x] = (r.r, r.g, r.b, r.a)
        assert (got == px).all()
        if (align, size) == ("left", 8):
            wide, high = lines.select(*text.measured(F.col("lines"), wrap, size, 1, 20)).first()
            assert (high, wide) == px.shape[:2]


def test_files(spark, tmp_path):
    layers = table(spark, (1, {"kind": "raster", "rgba": bytearray(b"abcd"), "w": 1, "h": 1}), (2, {"kind": "svg", "svg": "<svg>é\"\\</svg>", "mask": bytearray(b"wxyz"), "mask_w": 1, "mask_h": 1}), (3, {"kind": "filter", "filter": {k: 0.5 for k in L.KNOBS}}))
    docs = spark.createDataFrame([(1, 4, 3), (2, 5, 6)], "doc_id long, width int, height int")
    saved = documents.saved(docs, layers)
    opened = documents.opened(saved).collect()
    assert {(r.doc_id, r.width, r.height, len(r.layers), r.error) for r in opened} == {(1, 4, 3, 3, None), (2, 5, 6, 0, None)}
    back = sorted(documents.layers_of(documents.opened(saved)).collect(), key=lambda r: r.layer_id)
    assert back == sorted(layers.collect(), key=lambda r: r.layer_id)
    whole = {r.doc_id: bytes(r.content) for r in saved.collect()}[1]
    spoilt = {"too short": whole[:3], "metadata cut off": whole[:30], "no document": whole[:4] + b"?" + whole[5:], "version 7 is not supported": whole[:10] + b"\x07" + whole[11:], "metadata not readable": whole[:11] + b"[" + whole[12:], "pixels out of range": whole[:-1]}
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(spoilt.values())], "doc_id long, content binary")
    assert [r.error for r in documents.opened(rows).orderBy("doc_id").collect()] == list(spoilt)
    assert documents.layers_of(documents.opened(rows)).count() == 0
    assert {(r.doc_id, r.has_svg) for r in documents.has_svg(saved).collect()} == {(1, True), (2, False)}
    documents.write(docs, layers, str(tmp_path / "d"))
    again = documents.read(spark, str(tmp_path / "d"))
    assert again[0].count() == 2 and sorted(again[1].collect(), key=lambda r: r.layer_id) == back
    raster = L.rasterized(layers.withColumns({"w": F.lit(1), "h": F.lit(1)}), 2, lambda *_: 1 / 0)
    assert bytes(raster.where("layer_id = 2 and kind = 'raster'").first().rgba) == bytes(4)


def test_imports(spark):
    frames = spark.createDataFrame([(1, 1, 2, 1, 70, bytearray(8), None), (1, 0, 2, 1, 70, bytearray(8), None), (2, None, None, None, None, None, "bad")], "image_id long, frame int, width int, height int, delay_ms int, data binary, error string")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    out = imports.imported(table(spark, (4, {"kind": "group"})), docs, imports.gif_frames(frames))
    assert {(r.doc_id, r.layer_id, r.idx, r.name) for r in out.collect()} == {(1, 4, 0, "l4"), (1, 5, 1, "frame_0"), (1, 6, 2, "frame_1")}


def test_sessions(spark, tmp_path):
    """Brush sessions as a stream stamp what one walk over all points does; a cancelled one leaves nothing."""
    pen = brush.Brush(size=4, spacing=0.5)
    rng = np.random.default_rng(1)
    points = [(float(x), float(y), float(p)) for x, y, p in zip(*rng.random((3, 12)) * 20, strict=True)]
    events = [(1, 0, "begin", None, None, None, None)] + [(1, i + 1, "push", *p, None) for i, p in enumerate(points)] + [(1, 13, "end", None, None, None, None), (1, 14, "push", 0.0, 0.0, 1.0, None)]
    events += [(2, 0, "push", 1.0, 1.0, 1.0, None), (2, 1, "begin", None, None, None, None), (2, 2, "push", 1.0, 1.0, 1.0, 5.0), (2, 3, "cancel", None, None, None, None)]
    frame = pd.DataFrame(events, columns=["stroke_id", "seq", "action", "x", "y", "pressure", "time"])
    ddl = "stroke_id long, seq long, action string, x double, y double, pressure double, time double"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, part in enumerate((frame[frame.seq < 6], frame[frame.seq >= 6])):
        spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in part.itertuples(index=False)], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not i:
            query = streamed.sessions(source, pen, 0.5).writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
    query.stop()
    smooth, last = [], None
    for p in points:
        last = p if last is None else tuple(a + (b - a) * 0.5 for a, b in zip(last, p, strict=True))
        smooth.append((*last, 0.0, 0.0))
    want, _ = brush.walk(smooth, pen)
    came = spark.createDataFrame(spark.table("sessions").collect(), spark.table("sessions").schema)
    stamps = streamed.kept(came)
    got = [(r.x, r.y, r.pressure, r.tilt_x, r.tilt_y) for r in stamps.orderBy("n").collect()]
    assert got == want and {r.stroke_id for r in stamps.collect()} == {1}
    assert came.where("stroke_id = 2 and cancelled").count() == 1
    assert [streamed.next_time(t, last) for t, last in ((None, None), (None, 4.0), (3.0, 4.0), (9.0, 4.0), (float("nan"), 1.0))] == [0, 20, 5, 9, 17]


def test_painting_a_layer(spark):
    pen = brush.Brush(size=2, spacing=1.0, color=(9, 8, 7, 255))
    px = spark.createDataFrame([(i, x, y, 0, 0, 0, 0) for i in (1, 2) for x in range(6) for y in range(4)], "layer_id long, x int, y int, r int, g int, b int, a int")
    points = spark.createDataFrame([(1, 0, 2.0, 2.0, 1.0), (1, 1, 4.0, 2.0, 1.0)], "stroke_id long, seq long, x double, y double, pressure double")
    out = wrappers.paint(px, 2, points, pen)
    assert out.count() == 48 and {r.layer_id for r in out.where("a > 0").collect()} == {2} and out.where("a > 0").count() == 8
    assert wrappers.paint(px, 2, points, pen, locked=True).where("a > 0").count() == 0
    assert wrappers.resize_nearest(px, 99, 2, 2).count() == 48


def test_fonts_and_checks(spark):
    import struct

    name = "Pläin".encode("utf-16-be")
    body = struct.pack(">HHH", 0, 1, 18) + struct.pack(">6H", 3, 1, 1033, 1, len(name), 0) + name
    raw = b"\0\1\0\0" + struct.pack(">4H", 1, 0, 0, 0) + b"name" + struct.pack(">III", 0, 28, len(body)) + body
    assert families_in(raw) == ["Pläin"] and families_in(b"no font") == families_in(raw[:20]) == []
    fonts = Fonts()
    assert fonts.register_bytes(raw, " heading ") == 1 and fonts.register_bytes(b"") == 0 and fonts.register(["Other One", "OTHER ONE"]) == 1 and len(fonts) == 2
    names = ["Heading", "other-one", "pläin", "x"]
    got = spark.createDataFrame(list(enumerate(names)), "i int, n string").orderBy("i").select(fonts.resolve(F.col("n")).alias("f")).collect()
    assert [r.f for r in got] == ["Pläin", "Other One", "Pläin", None]
    fonts.clear()
    assert len(fonts) == 0
    assert checks.integer(-2.7, "v") == -2 and checks.byte(255.9, "v") == 255 and checks.unit(1, "v") == 1
    for rule, value in ((checks.finite, float("inf")), (checks.finite, "1"), (checks.integer, None)):
        with pytest.raises(TypeError):
            rule(value, "v")
    for rule, value in ((checks.non_negative, -1), (checks.positive, 0), (checks.positive_integer, 0.5), (checks.unit, 1.01), (checks.byte, 256)):
        with pytest.raises(ValueError):
            rule(value, "v")
