"""Queries on one layer's pixels, on sheets, palettes and files, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import analysis, filters, geometry, neighbourhood, sheets
from strata.operators import layers as L
from strata.operators import wrappers as W
from strata.plans import documents
from strata.plans import oracle as O
from strata.plans.drawing import _BOX, _lanczos_sql, _rotate_sql
from strata.sources import codecs, imports
from strata.sources.views import canvases, layer_table, pixels, table

#: The layer that is changed; ids are those of the vectors.
LAYER = 3
_P = f"with {O.PIXELS}"
_STOPS = [(0.0, (10, 20, 30)), (0.4, (200, 100, 0)), (1.0, (255, 255, 200))]
_PALETTE = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128)]


def _on(change, *args):
    return lambda s, d: change(pixels(s, d), LAYER, *args, layer="image_id")


def _also(sql: str) -> str:
    """SQL over all layers, of which only LAYER's rows are taken; the others stay."""
    c = "image_id, x, y, r, g, b, a"
    return f"select {c} from ({sql}) where image_id = {LAYER} union all select {c} from ({_P} select * from px) where image_id <> {LAYER}"


def _lut(c: str, f) -> str:
    return f"case {' '.join(f'when {c} = {i} then {f(i)}' for i in range(256))} end"


def _level(gamma: float):
    return lambda i: int(max(0.0, min(255.0, 10 + (max(0.0, min(210.0, i - 20)) / 210.0) ** (1 / gamma) * 230.0)))


def _ramp(k: int):
    def value(i: int) -> int:
        t, ((p, a), (q, b)) = i / 255.0, (_STOPS[0], _STOPS[1]) if i / 255.0 <= 0.4 else (_STOPS[1], _STOPS[2])
        return int(a[k] + (b[k] - a[k]) * ((t - p) / (q - p)))

    return value


_BEST = "list_position(dd, list_min(dd)) - 1"
_DIST = "[" + ", ".join(f"(r - {p[0]}) * (r - {p[0]}) + (g - {p[1]}) * (g - {p[1]}) + (b - {p[2]}) * (b - {p[2]})" for p in _PALETTE) + "]"
_SAME = " and ".join(f"abs(p.{c} - s.{c}) <= 60" for c in "rgba")
_COLOR = dict(zip("rgba", (1, 2, 3, 255), strict=True))


def _fill_sql(locked: bool) -> str:
    open_ = " and p.a > 0" if locked else ""
    return f"with recursive {O.PIXELS}, s as (select * from px where x = 0 and y = 0{' and a > 0' if locked else ''}), k as (select p.image_id, p.x, p.y from px p join s using (image_id) where {_SAME}{open_}), w as (select image_id, x, y from s union select k.image_id, k.x, k.y from k join w on k.image_id = w.image_id and abs(k.x - w.x) + abs(k.y - w.y) = 1) select p.image_id, p.x, p.y, " + ", ".join(f"case when w.x is not null then {v} else p.{c} end {c}" for c, v in _COLOR.items()) + " from px p left join w using (image_id, x, y)"


_RESIZE = f"{_P}, e as (select i, least(3e0, greatest(0e0, (i + 0.5e0) * 4 / 6 - 0.5e0)) c from range(6) t(i)), k as (select i, floor(c)::int q, 1 - (c - floor(c)) w from e union all select i, least(3, floor(c)::int + 1), c - floor(c) from e) select image_id, cast(kx.i as int) x, cast(ky.i as int) y, " + ", ".join(f"{O.byte(f'round(sum({c} * (kx.w * ky.w)), 6)')} {c}" for c in "rgba") + " from px, k kx, k ky where px.x = kx.q and px.y = ky.q group by all"
_TRIM = f"{_P}, b as (select image_id, {_BOX} from px group by image_id) select image_id, x - lox x, y - loy y, px.r, px.g, px.b, px.a from px join b using (image_id) where x between lox and hix and y between loy and hiy"
_CROP = f"{_P}, i as (select distinct image_id from px), g as (select image_id, cast(p % 4 as int) x, cast(p // 4 as int) y from i, range(12) t(p)) select g.image_id, g.x, g.y, " + ", ".join(f"coalesce(px.{c}, 0) {c}" for c in "rgba") + " from g left join px on px.image_id = g.image_id and px.x = g.x + 1 and px.y = g.y + 2"
_QUANT = f"{_P}, q as (select *, {_DIST} dd from px) select image_id, x, y, " + ", ".join(f"case when a > 0 then case {_BEST} " + " ".join(f"when {i} then {p[k]}" for i, p in enumerate(_PALETTE)) + f" end else {c} end {c}" for k, c in enumerate("rgb")) + ", a from q"


def _thrice(kernel: list[float], passes: int) -> str:
    """A kernel over and over, truncated in between."""
    side = int(len(kernel) ** 0.5)
    half = side // 2
    taps = ", ".join(f"({i}, {i % side - half}, {i // side - half}, {w!r}::double)" for i, w in enumerate(kernel))
    total = lambda c: O.byte(f"list_reduce(list_prepend(0e0, list(s.{c}::double * k.w order by k.i)), lambda p, q: p + q)")
    ctes, last = [O.PIXELS, f"k(i, dx, dy, w) as (values {taps})"], "px"
    for n in range(passes):
        ctes.append(f"t{n} as (select d.image_id, d.x, d.y, {', '.join(f'{total(c)} {c}' for c in 'rgb')} from {last} d, k, {last} s where s.image_id = d.image_id and s.x = greatest(0, least(3, d.x + k.dx)) and s.y = greatest(0, least(3, d.y + k.dy)) group by all)")
        ctes.append(f"p{n} as (select d.image_id, d.x, d.y, {', '.join(f'case when d.a = 0 then d.{c} else t.{c} end {c}' for c in 'rgb')}, d.a from {last} d join t{n} t using (image_id, x, y))")
        last = f"p{n}"
    return f"with {', '.join(ctes)} select * from {last}"


_SPRITES = "sp as (select p_brand sheet, p_partkey idx, cast(p_partkey % 40 + 8 as int) w, cast(p_size as int) h from part)"
_PACKED = f"""recursive {_SPRITES}, o as (select *, row_number() over (partition by sheet order by -h, idx) k from sp),
p as (select sheet, idx, k, w, h, 0 x, 0 y, w + 2 nx, h shelf from o where k = 1
union all select o.sheet, o.idx, o.k, o.w, o.h, case when p.nx + o.w > 256 then 0 else p.nx end, case when p.nx + o.w > 256 then p.y + p.shelf + 2 else p.y end, case when p.nx + o.w > 256 then o.w + 2 else p.nx + o.w + 2 end, case when p.nx + o.w > 256 then o.h else greatest(p.shelf, o.h) end from p join o on o.sheet = p.sheet and o.k = p.k + 1),
sz as (select sheet, least(256, max(x + w))::int width, least(256, max(y + h))::int height from p group by sheet)"""


def _sprites(s, d) -> DataFrame:
    return table(s, d, "part").select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("idx"), (F.col("p_partkey") % 40 + 8).cast("int").alias("w"), F.col("p_size").cast("int").alias("h"))


def _small(s, d) -> DataFrame:
    """Images of 4 by 4 in sheets of seven."""
    return pixels(s, d).select(F.floor(F.col("image_id") / 7).alias("sheet"), F.col("image_id").alias("idx"), "x", "y", *"rgba")


def _small_places(s, d) -> DataFrame:
    own = _small(s, d).select("sheet", "idx").distinct()
    return own.select("sheet", "idx", F.lit(4).alias("w"), F.lit(4).alias("h"))


def _packed_small(s, d) -> DataFrame:
    placed = sheets.pack(_small_places(s, d), "sheet", 14, 1)
    return sheets.packed_pixels(_small(s, d), placed, sheets.atlas(placed, "sheet", 14), "sheet")


_SMALL = f"{_P}, n as (select *, image_id // 7 sheet, row_number() over (partition by image_id // 7, x, y order by image_id) - 1 i from px)"


def _sheet(s, d) -> DataFrame:
    placed = sheets.contact_sheet(_small_places(s, d), "sheet", 3, 2)
    return sheets.sheet_pixels(_small(s, d), placed, "sheet", (200, 100, 50, 128))


def _on_ground(c: str, ground: int) -> str:
    return f"cast(case when a = 255 then {c} when a > 0 then floor({c} * (a / 255e0) + {ground}e0 * (1e0 - a / 255e0)) else {ground} end as int) {c}"


def _imported(s, d) -> DataFrame:
    px = pixels(s, d).where("image_id < 15")
    png = codecs.to_png(codecs.to_buffers(px))
    rows = codecs.from_files(png.withColumnRenamed("png", "content")).select((F.col("image_id") % 5).alias("doc_id"), F.floor(F.col("image_id") / 5).alias("seq"), F.concat(F.lit("image "), F.col("image_id").cast("string")).alias("name"), "width", "height", "data")
    return documents.flat(imports.imported(layer_table(s, d), canvases(s, d), rows))


def _imported_sql() -> str:
    base = {"visible": "true", "opacity": "1e0", "x": "0", "y": "0", "anchor": "'top-left'", "flip_x": "false", "flip_y": "false", "rotation": "0e0", "scale_x": "1e0", "scale_y": "1e0", "blend_mode": "'normal'", "clip_to_below": "false", "mask_inverted": "false", "alpha_locked": "false"}
    base |= {"doc_id": "i % 5", "name": "'image ' || i", "kind": "'raster'", "w": "4", "h": "4", "rgba_n": "64", "rgba_head": "(select printf('%02X%02X%02X%02X', r, g, b, a) from px where image_id = i and x = 0 and y = 0)"}
    base |= {"layer_id": "(select max(layer_id) from lt where doc_id = i % 5) + i // 5 + 1", "idx": "((select count(*) from lt where doc_id = i % 5 and parent_id is null) + i // 5)::int"}
    return f"with {documents.LAYERS}, {O.PIXELS} select * from lt union all select {', '.join(base.get(c, 'null') for c in documents._COLUMNS)} from range(15) t(i)"


def _any_files(s, d) -> DataFrame:
    """Whole PNG files, files cut off, and bytes of no format."""
    png = codecs.to_png(codecs.to_buffers(pixels(s, d)), (0, 1, 2, 3, 4))
    kind = F.col("image_id") % 4
    return png.select("image_id", F.when(kind == 1, F.substr(F.col("png"), F.lit(1), F.lit(40))).when(kind == 2, F.lit(b"nothing")).when(kind == 3, F.lit(None).cast("binary")).otherwise(F.col("png")).alias("content"))


_MODES = ["multiply", "screen", "difference"]


def _trees(s, d) -> DataFrame:
    """Five layers a document, of which the third's mode and alpha and the fourth's knob are the document's own; odd documents have a group."""
    from strata.operators import renderer

    px = pixels(s, d)
    raw = codecs.to_buffers(px)
    doc, z = F.floor(F.col("image_id") / 5), F.col("image_id") % 5
    own = {"doc_id": doc, "layer_id": z + 1, "idx": F.when(z == 4, 5).otherwise(z), "kind": F.lit("raster"), "rgba": F.col("data"), "w": F.lit(4), "h": F.lit(4)}
    own |= {"parent_id": F.when((doc % 2 == 1) & (z < 2), F.lit(9)), "blend_mode": F.when(z == 2, F.element_at(F.array(*[F.lit(m) for m in _MODES]), (doc % 3 + 1).cast("int"))).otherwise(F.lit("normal")), "opacity": F.when(z == 2, doc % 4 / 4.0 + 0.25).otherwise(F.lit(1.0)), "clip_to_below": z == 3}
    value = {c: F.lit(v) for c, v in L._DEFAULTS.items()} | own
    schema = s.createDataFrame([], L.DDL).schema
    images = raw.select(*[value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    documents_ = images.select("doc_id").distinct()
    knob = {"doc_id": F.col("doc_id"), "layer_id": F.lit(8), "idx": F.lit(4), "kind": F.lit("filter"), "filter": F.struct(*[((F.col("doc_id") % 5 / 10.0) if k == "brightness" else F.lit(0.0)).alias(k) for k in L.KNOBS])}
    group = {"doc_id": F.col("doc_id"), "layer_id": F.lit(9), "idx": F.lit(0), "kind": F.lit("group"), "opacity": F.lit(0.5)}
    more = lambda rows, v: rows.select(*[({c: F.lit(x) for c, x in L._DEFAULTS.items()} | v).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    layers = images.unionAll(more(documents_, knob)).unionAll(more(documents_.where("doc_id % 2 = 1"), group))
    sized = documents_.select("doc_id", F.lit(4).alias("width"), F.lit(4).alias("height"))
    out = renderer.render(sized, layers)
    return codecs.to_pixels(out.withColumnRenamed("doc_id", "image_id")).withColumnRenamed("image_id", "doc_id")


def _trees_sql() -> str:
    from strata.plans.drawing import _step

    ctes = [O.PIXELS, "st as (select image_id // 5 doc_id, image_id % 5 z, x, y, r, g, b, a from px)"]
    cols = ", ".join(f"coalesce(l{z}.{c}, 0) l{z}{c}" for z in range(5) for c in "rgba")
    ctes.append(f"w as (select d.doc_id, d.x, d.y, {cols} from (select distinct doc_id, x, y from st) d " + " ".join(f"left join st l{z} on l{z}.doc_id = d.doc_id and l{z}.x = d.x and l{z}.y = d.y and l{z}.z = {z}" for z in range(5)) + ")")
    keep = ", ".join(f"l{z}{c}" for z in range(5) for c in "rgba")
    ctes.append(f"k0 as (select *, {', '.join(f'0 c{c}' for c in 'rgbak')} from w)")
    of = lambda z, a=None: {c: f"l{z}{c}" for c in "rgb"} | {"a": a or f"l{z}a"}
    _step(ctes, "k1", "k0", "c", of(0), "normal", keep)
    _step(ctes, "k2", "k1", "c", of(1), "normal", keep)
    # a group of its own at half its alpha, on a clear canvas
    ctes.append("k3 as (select * replace (case when doc_id % 2 = 1 then (ca * 128 + 127) // 255 else ca end::int as ca) from k2)")
    ctes.append("k4 as (select * replace (case when ca = 0 and doc_id % 2 = 1 then 0 else cr end as cr, case when ca = 0 and doc_id % 2 = 1 then 0 else cg end as cg, case when ca = 0 and doc_id % 2 = 1 then 0 else cb end as cb) from k3)")
    level = "cast(case when doc_id % 4 = 3 then l2a else (l2a * floor((doc_id % 4 / 4e0 + 0.25e0) * 255e0 + 0.5e0)::int + 127) // 255 end as int)"
    for i, mode in enumerate(_MODES):
        _step(ctes, f"m{i}", "k4", "c", of(2, level), mode, keep)
    ctes.append("k5 as (" + " union all ".join(f"select * from m{i} where doc_id % 3 = {i}" for i in range(3)) + ")")
    _step(ctes, "k6", "k5", "c", of(3, "cast((l3a * ck + 127) // 255 as int)"), "normal", keep)
    tone = lambda c: f"case when ca > 0 then {O.byte(f'c{c}::double + (doc_id % 5 / 10e0) * 180e0')} else c{c} end c{c}"
    ctes.append(f"k7 as (select doc_id, x, y, {keep}, {', '.join(tone(c) for c in 'rgb')}, ca, ca ck from k6)")
    _step(ctes, "k8", "k7", "c", of(4), "normal", keep)
    return f"with {', '.join(ctes)} select doc_id, x, y, cr r, cg g, cb b, ca a from k8"


QUERIES: dict = {
    "render_table": _trees,
    "layer_resize_nearest": _on(W.resize_nearest, 7, 3),
    "layer_resize_bilinear": _on(W.resize_bilinear, 6, 6),
    "layer_resize_lanczos": _on(W.resize_lanczos, 6, 3),
    "layer_crop": _on(W.crop, 1, 2, 4, 3),
    "layer_trim": _on(W.trim),
    "layer_rotate": _on(W.rotate, 30.0),
    "layer_box_blur": _on(W.box_blur, 2),
    "layer_gaussian_blur": _on(W.gaussian_blur, 3),
    "layer_sharpen": _on(W.sharpen),
    "layer_edge_detect": _on(W.edge_detect),
    "layer_emboss": _on(W.emboss),
    "layer_invert": _on(W.invert),
    "layer_posterize": _on(W.posterize, 4),
    "layer_threshold": _on(W.threshold, 128),
    "layer_levels": _on(W.levels, 20, 230, 2.2, 10, 240),
    "layer_gradient_map": _on(W.gradient_map, _STOPS),
    "layer_quantize": _on(W.quantize, _PALETTE),
    "layer_bucket_fill": _on(W.bucket_fill, 0, 0, (1, 2, 3, 255), True, 60),
    "levels_gamma": lambda s, d: filters.levels(pixels(s, d), 20, 230, 0.5, 10, 240),
    "gaussian_blur3": lambda s, d: neighbourhood.gaussian_blur(pixels(s, d), 3),
    "fill_region_locked": lambda s, d: analysis.fill_region(pixels(s, d), 0, 0, (1, 2, 3, 255), 60, locked=True),
    "fill_all_locked": lambda s, d: analysis.fill_all(pixels(s, d), 0, 0, (1, 2, 3, 255), 60, locked=True),
    "dominant_sampled": lambda s, d: analysis.dominant(pixels(s, d), max_samples=4),
    "pack_padded": lambda s, d: sheets.pack(_sprites(s, d), "sheet", 256, 2),
    "pack_atlas": lambda s, d: sheets.atlas(sheets.pack(_sprites(s, d), "sheet", 256, 2), "sheet", 4096, True),
    "pack_json": lambda s, d: sheets.packed_json(sheets.pack(_sprites(s, d), "sheet", 256, 2), sheets.atlas(sheets.pack(_sprites(s, d), "sheet", 256, 2), "sheet", 256), "sheet"),
    "pack_pixels": _packed_small,
    "contact_sheet_cells": lambda s, d: sheets.contact_sheet(_sprites(s, d), "sheet", 5, 3, (20, 15)),
    "contact_sheet_pixels": _sheet,
    "import_layers": _imported,
    "png_filters": lambda s, d: codecs.to_pixels(codecs.from_png(codecs.to_png(codecs.to_buffers(pixels(s, d)), (4, 3, 2, 1, 0)))),
    "decode_auto": lambda s, d: codecs.from_files(_any_files(s, d)).select("image_id", "width", "height", F.hex(F.substring("data", 1, 4)).alias("head"), F.col("error").isNull().alias("good")),
    "decode_flat": lambda s, d: codecs.to_flat(codecs.to_buffers(pixels(s, d))).select("image_id", F.hex(F.substring("flat", 1, 12)).alias("head")),
    "flat_round_trip": lambda s, d: codecs.to_pixels(codecs.from_flat(codecs.to_flat(codecs.to_buffers(pixels(s, d))))),
}

ORACLE_SQL: dict[str, str] = {
    "render_table": _trees_sql(),
    "layer_resize_nearest": _also(f"{_P} select image_id, cast(i as int) x, cast(j as int) y, r, g, b, a from px, range(7) t(i), range(3) u(j) where px.x = least(3, floor((i + 0.5e0) * 4 / 7)) and px.y = least(3, floor((j + 0.5e0) * 4 / 3))"),
    "layer_resize_bilinear": _also(_RESIZE),
    "layer_resize_lanczos": _also(_lanczos_sql(6, 3)),
    "layer_crop": _also(_CROP),
    "layer_trim": _also(_TRIM),
    "layer_rotate": _also(_rotate_sql()),
    "layer_box_blur": _also(O.convolve_sql([1 / 25] * 25)),
    "layer_gaussian_blur": _also(_thrice(neighbourhood.KERNELS["gauss3"], 3)),
    "layer_sharpen": _also(O.convolve_sql(neighbourhood.KERNELS["sharpen"])),
    "layer_edge_detect": _also(O.convolve_sql(neighbourhood.KERNELS["edge_detect"])),
    "layer_emboss": _also(O.convolve_sql(neighbourhood.KERNELS["emboss"])),
    "layer_invert": _also(O.live_sql({c: f"255 - {c}" for c in "rgb"})),
    "layer_posterize": _also(O.live_sql({c: O.byte(f"floor({c} / 255e0 * 3e0 + 0.5e0) / 3e0 * 255e0") for c in "rgb"})),
    "layer_threshold": _also(O.live_sql({c: f"case when floor({O.LUM}) >= 128 then 255 else 0 end" for c in "rgb"})),
    "layer_levels": _also(O.live_sql({c: _lut(c, _level(2.2)) for c in "rgb"})),
    "layer_gradient_map": _also(O.live_sql({c: _lut(f"cast(floor({O.LUM}) as int)", _ramp(k)) for k, c in enumerate("rgb")})),
    "layer_quantize": _also(_QUANT),
    "layer_bucket_fill": _also(_fill_sql(False)),
    "levels_gamma": O.live_sql({c: O.byte(f"10e0 + pow(least(210e0, greatest(0e0, {c} - 20e0)) / 210e0, 2e0) * 230e0") for c in "rgb"}),
    "gaussian_blur3": _thrice(neighbourhood.KERNELS["gauss3"], 3),
    "fill_region_locked": _fill_sql(True),
    "fill_all_locked": f"{_P}, s as (select * from px where x = 0 and y = 0 and a > 0) select p.image_id, p.x, p.y, " + ", ".join(f"case when p.a > 0 and s.a is not null and {_SAME} then {v} else p.{c} end {c}" for c, v in _COLOR.items()) + " from px p left join s using (image_id)",
    "dominant_sampled": f"{_P}, c as (select image_id, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) bin, count(*) n from px where a > 0 and x % 2 = 0 and y % 2 = 0 group by all), t as (select *, row_number() over (partition by image_id order by n desc, bin) k from c) select image_id, cast((bin >> 10) * 8 + 4 as int) r, cast(((bin >> 5) & 31) * 8 + 4 as int) g, cast((bin & 31) * 8 + 4 as int) b from t where k = 1",
    "pack_padded": f"with {_PACKED} select sheet, idx, x, y, w, h from p",
    "pack_atlas": f"with {_PACKED} select sheet, least(4096, pow(2, ceil(log2(greatest(1, max(x + w))))))::int width, least(4096, pow(2, ceil(log2(greatest(1, max(y + h))))))::int height from p group by sheet",
    "pack_json": f"with {_PACKED} select sheet, '{{\"sprites\":[' || string_agg(printf('{{\"index\":%d,\"x\":%d,\"y\":%d,\"w\":%d,\"h\":%d}}', idx, x, y, w, h), ',' order by idx) || printf('],\"width\":%d,\"height\":%d}}', any_value(width), any_value(height)) json from p join sz using (sheet) group by sheet",
    "pack_pixels": f"{_SMALL} select sheet, (x + i % 3 * 5)::int x, (y + i // 3 * 5)::int y, r, g, b, a from n where y + i // 3 * 5 < 14",
    "contact_sheet_cells": f"with {_SPRITES}, c as (select *, row_number() over (partition by sheet order by idx) - 1 i, least(20 / w::double, 15 / h::double, 1e0) k from sp), f as (select *, greatest(1, floor(w * k + 0.5e0))::int fw, greatest(1, floor(h * k + 0.5e0))::int fh from c) select sheet, idx, (i % 5 * 23 + (20 - fw) // 2)::int x, (i // 5 * 18 + (15 - fh) // 2)::int y, fw w, fh h from f",
    "contact_sheet_pixels": f"{_SMALL} select sheet, (x + i % 3 * 6)::int x, (y + i // 3 * 6)::int y, {', '.join(_on_ground(c, v) for c, v in zip('rgb', (200, 100, 50), strict=True))}, cast(case when a = 255 then 255 when a > 0 then floor(a + 128e0 * (1e0 - a / 255e0)) else 128 end as int) a from n",
    "import_layers": _imported_sql(),
    "png_filters": f"{_P} select * from px",
    "decode_auto": f"{_P} select image_id, case when image_id % 4 = 0 then 4 end width, case when image_id % 4 = 0 then 4 end height, case when image_id % 4 = 0 then printf('%02X%02X%02X%02X', r, g, b, a) end head, image_id % 4 = 0 good from px where x = 0 and y = 0",
    "decode_flat": f"{_P} select image_id, '0000000400000004' || printf('%02X%02X%02X%02X', r, g, b, a) head from px where x = 0 and y = 0",
    "flat_round_trip": f"{_P} select * from px",
}
