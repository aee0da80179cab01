"""Queries for whole documents, shapes and resampling, each beside its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import checks, text
from strata.functions.fonts import Fonts
from strata.operators import document, filters, geometry, neighbourhood, shapes, tree
from strata.operators.document import Layer
from strata.plans import oracle as O
from strata.sources.views import layers, pixels, table

P = O.PIXELS
_P = f"with {P}"
TURN = 30.0


def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Images by their place in a document of five."""
    px = pixels(spark, sf_dir)
    return [px.where(F.col("image_id") % 5 == z).select(F.floor(F.col("image_id") / 5).alias("doc_id"), "x", "y", *"rgba") for z in range(5)]


def render_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image, a filter on it, a masked multiply, a clipped screen, a hidden layer, and a group with a filter of its own."""
    p = _parts(spark, sf_dir)
    group = Layer("group", opacity=0.8, mode="screen", children=(Layer("image", p[3], x=1), Layer("filter", knobs=filters.Adjust(brightness=0.1)), Layer("solid", fill=(10, 20, 30, 128), mode="multiply")))
    tree_ = (
        Layer("image", p[0]),
        Layer("filter", knobs=filters.Adjust(brightness=-0.1, contrast=0.2)),
        Layer("image", p[1], opacity=0.5, mode="multiply", mask=p[4], mask_inverted=True),
        Layer("image", p[2], clip_to_below=True, mode="screen"),
        Layer("image", p[4], visible=False),
        group,
    )
    documents = pixels(spark, sf_dir).select(F.floor(F.col("image_id") / 5).alias("doc_id")).distinct()
    return document.render(documents, tree_, 4, 4)


def _step(ctes: list[str], name: str, source: str, at: str, s: dict[str, str], mode: str, keep: str) -> None:
    """Add the CTEs that blend the pixel s (expressions over the source) onto the columns with prefix at; keep goes along."""
    ctes.append(f"{name}_s as (select *, {', '.join(f'{v} s{c}' for c, v in s.items())} from {source})")
    if mode == "normal":
        out = O.over_sql(at, "s")
    else:
        alpha = f"(sa / 255e0 + {at}a / 255e0 * (1e0 - sa / 255e0))"
        near = lambda v: f"cast(floor(least(1e0, greatest(0e0, {v})) * 255e0 + 0.5e0) as int)"
        mixed = {c: O._SEPARABLE[mode].format(d=f"({at}{c} / 255e0)", s=f"(s{c} / 255e0)") for c in "rgb"}
        out = {c: near(f"(({mixed[c]}) * (sa / 255e0) + {at}{c} / 255e0 * ({at}a / 255e0) * (1e0 - sa / 255e0)) / {alpha}") for c in "rgb"} | {"a": near(alpha)}
        out = {c: f"case when sa = 0 then {at}{c} else {v} end" for c, v in out.items()}
    ctes.append(f"{name} as (select doc_id, x, y, {keep}, {', '.join(f'{v} {at}{c}' for c, v in out.items())}, sa {at}k from {name}_s)")


def _tree_sql() -> str:
    ctes = [P, "st as (select image_id // 5 doc_id, image_id % 5 z, x, y, r, g, b, a from px)"]
    sides = "".join(f" left join st l{z} on l{z}.doc_id = d.doc_id and l{z}.x = d.x{' - 1' if z == 3 else ''} and l{z}.y = d.y and l{z}.z = {z}" for z in range(5))
    cols = ", ".join(f"coalesce(l{z}.{c}, 0) l{z}{c}" for z in range(5) for c in "rgba")
    ctes.append(f"w as (select d.doc_id, d.x, d.y, {cols}, l4.r mask from (select distinct doc_id, x, y from st) d{sides})")
    keep = ", ".join([f"l{z}{c}" for z in range(5) for c in "rgba"] + ["mask"])
    ctes.append(f"k0 as (select *, {', '.join(f'0 c{c}' for c in 'rgbak')}, {', '.join(f'0 g{c}' for c in 'rgbak')} from w)")
    g = ", ".join(f"g{c}" for c in "rgbak")
    at = ", ".join(f"c{c}" for c in "rgbak")
    of = lambda z, a=None: {c: f"l{z}{c}" for c in "rgb"} | {"a": a or f"l{z}a"}
    _step(ctes, "k1", "k0", "c", of(0), "normal", f"{keep}, {g}")
    tone = lambda c: O.byte(f"((c{c}::double + -0.1e0 * 180e0) - 128e0) * (1e0 + 0.2e0 * 3e0) + 128e0")
    ctes.append(f"k2 as (select doc_id, x, y, {keep}, {g}, {', '.join(f'case when ca > 0 then {tone(c)} else c{c} end c{c}' for c in 'rgb')}, ca, ca ck from k1)")
    half = "((l1a * 128 + 127) // 255)"
    _step(ctes, "k3", "k2", "c", of(1, f"cast(case when mask is null then {half} else ({half} * (255 - mask) + 127) // 255 end as int)"), "multiply", f"{keep}, {g}")
    _step(ctes, "k4", "k3", "c", of(2, "cast((l2a * ck + 127) // 255 as int)"), "screen", f"{keep}, {g}")
    _step(ctes, "k5", "k4", "g", of(3), "normal", f"{keep}, {at}")
    _step(ctes, "k6", "k5", "g", dict(zip("rgba", ("10", "20", "30", "128"), strict=True)), "multiply", f"{keep}, {at}")
    bright = lambda c: f"case when ga > 0 then {O.byte(f'g{c}::double + 0.1e0 * 180e0')} else g{c} end"
    _step(ctes, "k7", "k6", "c", {c: bright(c) for c in "rgb"} | {"a": "cast((ga * 204 + 127) // 255 as int)"}, "screen", f"{keep}, {g}")
    return f"with {', '.join(ctes)} select doc_id, x, y, cr r, cg g, cb b, ca a from k7"


def render_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image, a centred shape with a stroke, a mirrored image at half its alpha, and an SVG that could not be drawn."""
    p = _parts(spark, sf_dir)
    tree_ = (
        Layer("image", p[0]),
        Layer("shape", shape=document.Shape("rectangle", 3, 3, fill=(200, 10, 10, 255), stroke=(0, 0, 200, 128)), x=2, y=2, anchor="center"),
        Layer("paint", p[1], size=(4, 4), flip_x=True, opacity=0.5),
        Layer("svg"),
    )
    documents = pixels(spark, sf_dir).select(F.floor(F.col("image_id") / 5).alias("doc_id")).distinct()
    return document.render(documents, tree_, 4, 4)


def _kinds_sql() -> str:
    ctes = [P, "st as (select image_id // 5 doc_id, image_id % 5 z, x, y, r, g, b, a from px)"]
    cols = ", ".join(f"coalesce(l{z}.{c}, 0) l{z}{c}" for z in range(2) for c in "rgba")
    ctes.append(f"k0 as (select d.doc_id, d.x, d.y, {cols}, {', '.join(f'0 c{c}' for c in 'rgbak')} from (select distinct doc_id, x, y from st) d left join st l0 on l0.doc_id = d.doc_id and l0.x = d.x and l0.y = d.y and l0.z = 0 left join st l1 on l1.doc_id = d.doc_id and l1.x = 3 - d.x and l1.y = d.y and l1.z = 1)")
    keep = ", ".join(f"l{z}{c}" for z in range(2) for c in "rgba")
    shape = lambda fill, stroke: f"case when x = 2 and y = 2 then {fill} when x between 1 and 3 and y between 1 and 3 then {stroke} else 0 end"
    _step(ctes, "k1", "k0", "c", {c: f"l0{c}" for c in "rgba"}, "normal", keep)
    _step(ctes, "k2", "k1", "c", {c: shape(f, t) for c, f, t in zip("rgba", (200, 10, 10, 255), (0, 0, 200, 128), strict=True)}, "normal", keep)
    _step(ctes, "k3", "k2", "c", {c: f"l1{c}" for c in "rgb"} | {"a": "cast((l1a * 128 + 127) // 255 as int)"}, "normal", keep)
    return f"with {', '.join(ctes)} select doc_id, x, y, cr r, cg g, cb b, ca a from k3"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("shape"), (F.col("p_partkey") % 24 + 3).cast("int").alias("w"), (F.col("p_size") % 17 + 2).cast("int").alias("h"))


_BOXES = "bo as (select p_partkey shape, cast(p_partkey % 24 + 3 as int) w, cast(p_size % 17 + 2 as int) h from part), ce as (select shape, w, h, cast(p % w as int) x, cast(p // w as int) y, p % w + 0.5e0 fx, p // w + 0.5e0 fy from (select *, unnest(range(0, w * h)) p from bo))"


def _rounded_sql() -> str:
    inside = lambda x, y, w, h, r: f"({w} > 0 and {h} > 0 and case when {r} <= 0 then {x} between 0 and {w} and {y} between 0 and {h} else pow({x} - least(greatest({x}, {r}), {w} - {r}), 2) + pow({y} - least(greatest({y}, {r}), {h} - {r}), 2) <= {r} * {r} end)"
    r = "least(4, w // 2, h // 2)::double"
    inner = inside("(fx - 2)", "(fy - 2)", "(w - 4e0)", "(h - 4e0)", f"greatest({r} - 2, 0e0)")
    return f"with {_BOXES} select shape, x, y, case when {inner} then 'fill' else 'stroke' end part from ce where {inside('fx', 'fy', 'w::double', 'h::double', r)}"


def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    return _boxes(spark, sf_dir).withColumn("points", F.array(corner(F.lit(0), F.lit(0)), corner(F.col("w"), F.lit(1)), corner(F.floor(F.col("w") / 3), F.col("h"))))


def _segment(ax: str, ay: str, bx: str, by: str) -> str:
    t = f"least(1e0, greatest(0e0, ((fx - {ax}) * ({bx} - {ax}) + (fy - {ay}) * ({by} - {ay})) / (({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))))"
    return f"(pow(fx - {ax} - ({bx} - {ax}) * {t}, 2) + pow(fy - {ay} - ({by} - {ay}) * {t}, 2))"


def _polygon_sql() -> str:
    points = [("0e0", "0e0"), ("w::double", "1e0"), ("(w // 3)::double", "h::double")]
    edges = [(points[i - 1], points[i]) for i in range(3)]
    cross = " + ".join(f"(case when ({a[1]} > fy) <> ({b[1]} > fy) then (fx < ({b[0]} - {a[0]}) * (fy - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]})::int else 0 end)" for a, b in edges)
    near = " or ".join(f"{_segment(*a, *b)} <= 1e0" for a, b in edges)
    return f"with {_BOXES}, e as (select *, ({cross}) % 2 = 1 inside, ({near}) near from ce) select shape, x, y, case when near then 'stroke' else 'fill' end part from e where near or inside"


def _lanczos_sql(new_w: int, new_h: int) -> str:
    ctes, source = [P], "px"
    for c, new in (("x", new_w), ("y", new_h)):
        rows = ", ".join(f"({k}, {i}, {v!r}::double)" for k, t in enumerate(geometry.lanczos_weights(4, new)) for i, v in t.items())
        ctes.append(f"w{c}(k, i, v) as (values {rows})")
        place = "w.i x, p.y y" if c == "x" else "p.x x, w.i y"
        sums = ", ".join(O.byte(f"round(sum(p.{q} * w.v), 6)") + f" {q}" for q in "rgba")
        ctes.append(f"q{c} as (select image_id, {place}, {sums} from {source} p join w{c} w on w.k = p.{c} group by all)")
        source = f"q{c}"
    return f"with {', '.join(ctes)} select image_id, x::int x, y::int y, r, g, b, a from {source}"


def _rotate_sql() -> str:
    nw, nh = geometry.turned_size(4, 4, TURN)
    co, si = (f"{v!r}::double" for v in (math.cos(math.radians(TURN)), math.sin(math.radians(TURN))))
    ctes = [P, f"g as (select distinct image_id, i x, j y, (i - {nw / 2}::double) * {co} + (j - {nh / 2}::double) * {si} + 2e0 fx, (i - {nw / 2}::double) * -({si}) + (j - {nh / 2}::double) * {co} + 2e0 fy from px, range({nw}) t(i), range({nh}) u(j))"]
    ctes.append("k as (select *, greatest(0, least(3, floor(fx)::int)) x0, greatest(0, least(3, floor(fy)::int)) y0, fx - floor(fx) dx, fy - floor(fy) dy, fx between -0.5e0 and 3.5e0 and fy between -0.5e0 and 3.5e0 seen from g)")
    tap = lambda c: "round(" + " + ".join(f"p{i}{j}.{c}::double * {'dx' if i else '(1e0 - dx)'} * {'dy' if j else '(1e0 - dy)'}" for j in (0, 1) for i in (0, 1)) + ", 6)"
    joins = " ".join(f"join px p{i}{j} on p{i}{j}.image_id = k.image_id and p{i}{j}.x = least(3, x0 + {i}) and p{i}{j}.y = least(3, y0 + {j})" for j in (0, 1) for i in (0, 1))
    return f"with {', '.join(ctes)} select k.image_id, k.x::int x, k.y::int y, {', '.join(f'case when seen then {O.byte(tap(c))} else 0 end {c}' for c in 'rgba')} from k {joins}"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("layer"), F.col("p_size").alias("w"), (F.col("p_partkey") % 31).cast("int").alias("h"), (F.col("p_partkey") * 7 % 1000 - 500).cast("int").alias("at"), (F.col("p_size") % 2 == 0).alias("centred"), (F.col("p_partkey") * 13 % 1440 - 720).cast("double").alias("degrees"))
    fit = geometry.fit(F.col("w"), F.col("h"), F.lit(20), F.lit(15))
    return p.select("layer", fit[0].alias("fit_w"), fit[1].alias("fit_h"), geometry.corner(F.col("at"), F.col("w"), F.col("centred")).alias("corner"), geometry.quarter(F.col("degrees")).alias("turn"))


_BOX = ", ".join(f"{f}(case when a > 0 then {c} end) {n}{c}" for n, f in (("lo", "min"), ("hi", "max")) for c in "xy")


def _on_tree(f):
    return lambda s, d: f(tree.numbered(layers(s, d)).select("id", "parent", "kind", "idx"))


#: A made-up typeface: the bits of a character's eight rows follow from its code.
def _glyphs(spark: SparkSession) -> DataFrame:
    code = F.col("id")
    return spark.range(32, 127).where("id % 7 <> 0 or id = 63").select(F.char(code).alias("glyph"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((code * 7 + i * 13) % 256).cast("int")).alias("bits"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("label"), F.array(F.concat(F.lit("No "), F.col("n_nationkey").cast("string")), F.lit("q?z")).alias("lines"))


_TEXT_SQL = """with t as (select n_nationkey label, ['No ' || n_nationkey, 'q?z'] l from nation), w as (select label, unnest(l) line, generate_subscripts(l, 1) - 1 n from t),
c as (select label, n, unnest(string_split(line, '')) ch, unnest(range(len(line))) k, len(line) size from w),
m as (select label, max(len(line)) * 16 + (max(len(line)) - 1) * 2 width from w group by label),
g as (select label, n, k, size, case when ascii(ch) % 7 <> 0 or ch = '?' then ascii(ch) else 63 end code from c),
b as (select g.*, width, i, j from g join m using (label), range(8) r(i), range(8) s(j) where ((code * 7 + i * 13) % 256) >> j & 1 = 1)
select label, ((width - (size * 16 + (size - 1) * 2)) // 2 + k * 18 + j * 2 + sx)::int x, (n * 20 + i * 2 + sy)::int y, 9 r, 8 g, 7 b, 255 a from b, range(2) t(sx), range(2) u(sy)"""


def _fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fonts = Fonts()
    fonts.register(["Some Sans", "Some Sans Light"], "body")
    fonts.register(["Other-Serif"])
    n = table(spark, sf_dir, "nation")
    asked = F.element_at(F.array(*[F.lit(x) for x in ("BODY", "some sans light", "otherserif", "nothing", "Other Serif")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return n.select("n_nationkey", fonts.resolve(asked).alias("family"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ((F.col("c_custkey") % 601 - 200) / 2.0).cast("double")
    v = F.when(F.col("c_custkey") % 50 == 0, F.lit(float("nan"))).otherwise(v)
    return table(spark, sf_dir, "customer").select("c_custkey", *[checks.fault(rule, v).alias(rule) for rule in checks.RULES])


QUERIES: dict = {
    "text_pixels": lambda s, d: text.raster(_labels(s, d), "label", _glyphs(s), 12, 20, 2, (9, 8, 7, 255), "center"),
    "font_families": _fonts,
    "validators": _checked,
    "render_tree": render_tree,
    "render_kinds": render_kinds,
    "box_blur2": lambda s, d: neighbourhood.box_blur(pixels(s, d), 2, shape=(4, 4)),
    "resize_lanczos": lambda s, d: geometry.resize_lanczos(pixels(s, d), 4, 4, 6, 3),
    "rotate_free": lambda s, d: geometry.rotate(pixels(s, d), 4, 4, TURN),
    "trim": lambda s, d: geometry.trim(pixels(s, d)),
    "rounded_rectangle": lambda s, d: shapes.rectangle(_boxes(s, d), 2, 4),
    "rectangle": lambda s, d: shapes.rectangle(_boxes(s, d), 2),
    "line": lambda s, d: shapes.line(_boxes(s, d), 3),
    "polygon": lambda s, d: shapes.polygon(_triangles(s, d), 2),
    "placement": _placed,
    "layer_location": _on_tree(lambda t: tree.listed(t).select("id", "parent", "idx", "depth")),
    "append_layer": _on_tree(lambda t: tree.appended(t, "new", "n1", "raster")),
    "layer_counts": _on_tree(tree.counts),
    "align_layers": lambda s, d: tree.aligned(_boxes(s, d).select(F.col("shape").alias("id"), (F.col("shape") * 7 % 100 - 50).cast("int").alias("x"), (F.col("shape") * 11 % 90).cast("int").alias("y"), "w", "h", (F.col("shape") % 2 == 0).alias("centred")), "horizontal-center"),
}

ORACLE_SQL: dict[str, str] = {
    "text_pixels": _TEXT_SQL,
    "font_families": "select n_nationkey, ['Some Sans', 'Some Sans Light', 'Other-Serif', null, 'Other-Serif'][n_nationkey % 5 + 1] family from nation",
    "validators": "with v as (select c_custkey, (c_custkey % 601 - 200) / 2e0 v, c_custkey % 50 = 0 bad from customer) select c_custkey, case when bad then 'not finite' end finite, case when bad then 'not finite' when trunc(v) < 0 then 'below 0' end non_negative, case when bad then 'not finite' when v <= 0 then 'not above 0' end positive, case when bad then 'not finite' when trunc(v) <= 0 then 'not above 0' end positive_integer, case when bad then 'not finite' when v < 0 or v > 1 then 'not in 0 to 1' end \"unit\", case when bad then 'not finite' when trunc(v) < 0 or trunc(v) > 255 then 'not a byte' end byte from v",
    "render_tree": _tree_sql(),
    "render_kinds": _kinds_sql(),
    "box_blur2": O.convolve_sql([1 / 25] * 25),
    "resize_lanczos": _lanczos_sql(6, 3),
    "rotate_free": _rotate_sql(),
    "trim": f"{_P}, b as (select image_id, {_BOX} from px group by image_id) select image_id, x - lox x, y - loy y, r, g, b, a from px join b using (image_id) where x between lox and hix and y between loy and hiy".replace("r, g, b, a from px join b", "px.r, px.g, px.b, px.a from px join b"),
    "rounded_rectangle": _rounded_sql(),
    "rectangle": f"with {_BOXES} select shape, x, y, case when fx <= 2 or fx >= w - 2 or fy <= 2 or fy >= h - 2 then 'stroke' else 'fill' end part from ce",
    "line": f"with {_BOXES} select shape, x, y, 'stroke' part from ce where {_segment('0.5e0', '0.5e0', '(w - 0.5e0)', '(h - 0.5e0)')} <= 2.25e0",
    "polygon": _polygon_sql(),
    "placement": "with p as (select p_partkey layer, p_size w, cast(p_partkey % 31 as int) h, cast(p_partkey * 7 % 1000 - 500 as int) p, p_partkey * 13 % 1440 - 720 d, p_size % 2 = 0 c from part), s as (select *, case when w * h = 0 then 0 else least(20 / w::double, 15 / h::double, 1e0) end k from p) select layer, cast(case when w * h = 0 then 0 else greatest(1, floor(w * k + 0.5e0)) end as int) fit_w, cast(case when w * h = 0 then 0 else greatest(1, floor(h * k + 0.5e0)) end as int) fit_h, cast(case when c then round(p - w / 2::double) else p end as int) corner, cast((round(d / 90::double)::int * 90 % 360 + 360) % 360 as int) turn from s",
    "layer_location": f"with recursive {O.LAYERS} select id, parent, idx, depth from ls",
    "append_layer": f"with recursive {O.LAYERS} select id, parent, kind, idx from nl union all select 'new', 'n1', 'raster', cast(count(*) as int) from nl where parent = 'n1'",
    "layer_counts": f"with recursive {O.LAYERS} select count(*) filter (parent is null) top, count(*) layers, count(*) filter (kind = 'filter') filters from nl",
    "align_layers": f"with {_BOXES}, l as (select shape id, cast(shape * 7 % 100 - 50 as int) x, cast(shape * 11 % 90 as int) y, w, h, shape % 2 = 0 centred from bo), t as (select *, case when centred then cast(round(x - w / 2::double) as int) else x end lx from l), r as (select min(lx) lo, max(lx + w) hi from t), m as (select *, cast(round((lo + hi - w) / 2::double) as int) nl from t, r) select id, case when centred then cast(round(nl + w / 2::double) as int) else nl end x, y, w, h, centred from m",
}
