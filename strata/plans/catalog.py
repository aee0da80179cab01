"""All queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import color
from strata.functions.blend import MODES, mode_code
from strata.operators import analysis, compose, filters, geometry, neighbourhood, shapes, sheets, strokes, tree
from strata.plans import documents, drawing, wrappers
from strata.plans import oracle as O
from strata.sources import codecs, webp
from strata.sources.views import layers, pixels, plane, table

DEPTH = 5
ADJUST = filters.Adjust(hue=30.0, saturation=0.1, lightness=0.05, alpha=-0.1, brightness=0.1, contrast=0.2, temperature=0.1, tint=-0.05)
STOPS = [(0.0, (10, 20, 30)), (0.4, (200, 100, 0)), (1.0, (255, 255, 200))]
FILL_STOPS = [(0.0, (255, 0, 0, 255)), (0.5, (0, 255, 0, 128)), (1.0, (0, 0, 255, 255))]
PALETTE = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128)]
KEYS = ["image_id", "x", "y"]


def _stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    z = F.col("image_id") % DEPTH
    return px.select(F.floor(F.col("image_id") / DEPTH).alias("doc_id"), z.alias("z"), "x", "y", *"rgba", (z % 2 == 1).alias("clipped"))


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    px = pixels(spark, sf_dir)
    return px, px.withColumn("image_id", F.col("image_id") - 1)


def _sprites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("idx"), (F.col("p_partkey") % 40 + 8).cast("int").alias("w"), F.col("p_size").cast("int").alias("h"))


def _strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("stroke_id"), seq.cast("long").alias("seq"), (F.col("event_id") * 37 % 512).cast("int").alias("x"), (F.col("event_id") * 91 % 512).cast("int").alias("y"), F.least(F.lit(1.0), F.col("value") / 200.0).alias("pressure"))


def _colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.format_string("#%06x", F.col("c_custkey") * 7919 % 16777216).alias("hex"))
    return c.withColumn("c", color.parse_hex(F.col("hex")))


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _colors(spark, sf_dir)
    rgb = [F.col(f"c.{x}") for x in "rgb"]
    return c.select("c_custkey", *[F.col(f"c.{x}").alias(x) for x in "rgb"], color.to_hex(*rgb).alias("hex"), F.round(color.relative_luminance(*rgb), 9).alias("luminance"), F.round(color.contrast_ratio(color.relative_luminance(*rgb), F.lit(1.0)), 9).alias("contrast"), color.readable_text(color.relative_luminance(*rgb)).alias("text"))


def _tree(f):
    return lambda spark, sf_dir: f(tree.numbered(layers(spark, sf_dir)).select("id", "parent", "kind", "idx"))


def _filter(f):
    return lambda spark, sf_dir: f(pixels(spark, sf_dir))


def _patch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    of = lambda kind, v: F.when(F.col("event_type") == kind, v)
    log = e.select(F.col("user_id").alias("layer_id"), "event_id", of("view", F.least(F.lit(1.0), F.col("value") / 300.0)).alias("opacity"), of("click", F.floor("value").cast("int")).alias("x"), of("purchase", F.floor("value").cast("int")).alias("y"))
    return tree.patched(log, "layer_id", "event_id", ["opacity", "x", "y"])


def _shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sprites(spark, sf_dir).select(F.col("idx").alias("shape"), "w", "h").where("h > 0")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 7 + 1).cast("int").alias("w"), (F.col("n_nationkey") % 5 + 1).cast("int").alias("h"))
    at = n.select("*", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("p"))
    return at.select("n_nationkey", "w", "h", (F.col("p") % F.col("w")).cast("int").alias("x"), F.floor(F.col("p") / F.col("w")).cast("int").alias("y"))


def _gradient(direction: str):
    return lambda spark, sf_dir: shapes.gradient(_cells(spark, sf_dir), FILL_STOPS, direction)


def _base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    # three bytes at a time keep the text on one line whatever the session's chunking
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "").alias("b64"))
    return d.select("doc_id", "b64", F.decode(F.unbase64("b64"), "UTF-8").alias("text"))


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ["89504E470D0A1A0A00", "FFD8FFE0", "52494646000000005745425000", "4749463839", "38425053", "89504E47", "00"]
    pick = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("page_id") % len(heads) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", codecs.detect_format(F.unhex(pick)).alias("format"))


def _png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.to_pixels(codecs.from_png(codecs.to_png(codecs.to_buffers(pixels(spark, sf_dir)))))


def _webp_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = webp.to_webp(codecs.to_buffers(pixels(spark, sf_dir)))
    return codecs.to_pixels(codecs.from_files(files, "webp"))


QUERIES: dict = {
    "render_documents": lambda s, d: compose.render(_stack(s, d), DEPTH, ["doc_id", "x", "y"]),
    **{f"blend_{m.replace('-', '_')}": (lambda s, d, m=m: compose.blend_images(*_pair(s, d), m, KEYS)) for m in MODES},
    "mode_codes": lambda s, d: table(s, d, "nation").select("n_nationkey", mode_code(F.element_at(F.array(*[F.lit(x) for x in ("Color Dodge", "SOFT_LIGHT", "nothing", "hue")]), (F.col("n_nationkey") % 4 + 1).cast("int"))).alias("code")),
    "adjust": _filter(lambda p: filters.adjust(p, ADJUST)),
    "invert": _filter(filters.invert),
    "posterize": _filter(lambda p: filters.posterize(p, 4)),
    "threshold": _filter(lambda p: filters.threshold(p, 128)),
    "levels": _filter(lambda p: filters.levels(p, 20, 230, 1.0, 10, 240)),
    "gradient_map": _filter(lambda p: filters.gradient_map(p, STOPS)),
    "scale_alpha": _filter(lambda p: filters.scale_alpha(p, 0.3)),
    "apply_mask": lambda s, d: filters.apply_mask(*_pair(s, d), KEYS, inverted=True),
    **{f"convolve_{k}": _filter(lambda p, k=k: neighbourhood.convolve(p, neighbourhood.KERNELS[k], shape=(4, 4))) for k in ("box3", "gauss3", "gauss5", "sharpen", "edge_detect", "emboss")},
    "unsharp": _filter(lambda p: neighbourhood.unsharp(p, 0.5)),
    "blit": lambda s, d: compose.blit(pixels(s, d), geometry.rotate90(_pair(s, d)[1], 4, 4, 3), 1, -1, 0.7, KEYS),
    "render_groups": lambda s, d: compose.render_groups(_stack(s, d).withColumns({"group": F.floor(F.col("z") / 3).cast("int"), "z": F.col("z") % 3, "group_opacity": F.lit(0.6)}), 3, 2, ["doc_id", "x", "y"]),
    "extract_palette": _filter(lambda p: analysis.extract_palette(p, 4)),
    "histogram": lambda s, d: analysis.histogram(plane(s, d)),
    "dominant": lambda s, d: analysis.dominant(plane(s, d)),
    "palette_box": lambda s, d: analysis.palette_box(plane(s, d)),
    "alpha_bounds": _filter(analysis.alpha_bounds),
    "quantize": _filter(lambda p: analysis.quantize(p, PALETTE)),
    "fill_all": _filter(lambda p: analysis.fill_all(p, 0, 0, (1, 2, 3, 255), 60)),
    "fill_region": _filter(lambda p: analysis.fill_region(p, 0, 0, (1, 2, 3, 255), 60)),
    "flip": _filter(lambda p: geometry.flip(p, 4, 4, across_x=True)),
    "rotate90": _filter(lambda p: geometry.rotate90(p, 4, 4, 1)),
    "crop": _filter(lambda p: geometry.crop(p, 1, 2, 4, 3)),
    "resize_nearest": _filter(lambda p: geometry.resize_nearest(p, 4, 4, 7, 3)),
    "resize_bilinear": _filter(lambda p: geometry.resize_bilinear(p, 4, 4, 6, 6)),
    "pixel_scale": _filter(lambda p: geometry.pixel_scale(p, 2)),
    "list_layers": _tree(tree.listed),
    "remove_layer": _tree(lambda t: tree.without(t, "n3")),
    "move_layer": _tree(lambda t: tree.moved(t, "n3", "g0", 1)),
    "patch_log": _patch_log,
    "pack_sprites": lambda s, d: sheets.pack(_sprites(s, d), "sheet", 256),
    "contact_sheet": lambda s, d: sheets.contact_sheet(_sprites(s, d), "sheet"),
    "ellipse": lambda s, d: shapes.ellipse(_shape(s, d), 2),
    **{f"gradient_{g}": _gradient(g) for g in ("horizontal", "vertical", "diagonal_down", "diagonal_up")},
    "dab_size": lambda s, d: strokes.dab_size(_strokes(s, d), 24.0, 0.5),
    "stroke_length": lambda s, d: strokes.travelled(_strokes(s, d)).select("stroke_id", "seq", F.round("travelled", 6).alias("travelled")),
    "stroke_smoothing": lambda s, d: strokes.smoothed(_strokes(s, d), 0.4).select("stroke_id", "seq", *[F.round(c, 6).alias(c) for c in ("x", "y", "pressure")]),
    "colours": _colours,
    "base64": _base64,
    "detect_format": _formats,
    "png_round_trip": _png_round_trip,
    "webp_round_trip": _webp_round_trip,
}

_P = O.PIXELS
_px = f"with {_P} select "
_hsl = lambda: ", ".join([_P, O.hsl_sql("h1", "px", "r", "g", "b", "h_"), O.rgb_sql("h2", "h1", "(h_h + 30e0)", "least(1e0, greatest(0e0, h_s + 0.1e0))", "least(1e0, greatest(0e0, h_l + 0.05e0))", "n"), "h3 as (select image_id, x, y, case when a > 0 then nr else r end r, case when a > 0 then ng else g end g, case when a > 0 then nb else b end b, case when a > 0 then greatest(0, a - 26) else a end a from h2)"])
_tone = {c: O.byte(e) for c, e in {c: f"(({c}::double + 0.1e0 * 180e0 - 128e0) * 1.6e0 + 128e0)" for c in "rgb"}.items()}
_tone = {"r": O.byte("((r::double + 18e0 - 128e0) * 1.6e0 + 128e0) + 9e0 - (-4e0 * 0.35e0)"), "g": O.byte("((g::double + 18e0 - 128e0) * 1.6e0 + 128e0) + (-4e0)"), "b": O.byte("((b::double + 18e0 - 128e0) * 1.6e0 + 128e0) - 9e0 - (-4e0 * 0.35e0)")}
_lut = lambda c, f: f"case {' '.join(f'when {c} = {i} then {f(i)}' for i in range(256))} end"
_SPRITES = "sp as (select p_brand sheet, p_partkey idx, cast(p_partkey % 40 + 8 as int) w, cast(p_size as int) h from part)"
_STROKES = "sk as (select user_id stroke_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) seq, cast(event_id * 37 % 512 as int) x, cast(event_id * 91 % 512 as int) y, least(1e0, value / 200e0) pressure from events)"
_CELLS = "n as (select n_nationkey, cast(n_nationkey % 7 + 1 as int) w, cast(n_nationkey % 5 + 1 as int) h from nation), ce as (select n_nationkey, w, h, cast(p % w as int) x, cast(p // w as int) y from (select *, unnest(range(0, w * h)) p from n))"
_t = {"horizontal": "x / greatest(w - 1, 1)::double", "vertical": "y / greatest(h - 1, 1)::double"}
_t |= {"diagonal_down": f"({_t['horizontal']} + {_t['vertical']}) / 2e0", "diagonal_up": f"({_t['horizontal']} + (1e0 - {_t['vertical']})) / 2e0"}
_stop = lambda i: f"cast(case when t <= 0.5e0 then floor({FILL_STOPS[0][1][i]}e0 * (1e0 - t / 0.5e0) + {FILL_STOPS[1][1][i]}e0 * (t / 0.5e0) + 0.5e0) else floor({FILL_STOPS[1][1][i]}e0 * (1e0 - (t - 0.5e0) / 0.5e0) + {FILL_STOPS[2][1][i]}e0 * ((t - 0.5e0) / 0.5e0) + 0.5e0) end as int)"
_near = " ".join(f"when {i} then {{{i}}}" for i in range(len(PALETTE)))
_best = "list_position(dd, list_min(dd)) - 1"
_dist = "[" + ", ".join(f"(r - {p[0]}) * (r - {p[0]}) + (g - {p[1]}) * (g - {p[1]}) + (b - {p[2]}) * (b - {p[2]})" for p in PALETTE) + "]"
_same = " and ".join(f"abs(p.{c} - s.{c}) <= 60" for c in "rgba")
_lin = lambda c: f"case when {c} / 255e0 <= 0.04045e0 then {c} / 255e0 / 12.92e0 else pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) end"
_gm = lambda k: _lut(f"cast(floor({O.LUM}) as int)", lambda i: int(STOPS[0][1][k] + (STOPS[1][1][k] - STOPS[0][1][k]) * ((i / 255.0 - 0.0) / 0.4)) if i / 255.0 <= 0.4 else int(STOPS[1][1][k] + (STOPS[2][1][k] - STOPS[1][1][k]) * ((i / 255.0 - 0.4) / (1.0 - 0.4))))

ORACLE_SQL: dict[str, str] = {
    "render_documents": O.render_sql(DEPTH),
    **{f"blend_{m.replace('-', '_')}": O.blend_sql(m) for m in MODES},
    "mode_codes": "select n_nationkey, case n_nationkey % 4 when 0 then 6 when 1 then 9 when 2 then 0 else 12 end code from nation",
    "adjust": O.live_sql(_tone, "h3", _hsl()),
    "invert": O.live_sql({c: f"255 - {c}" for c in "rgb"}),
    "posterize": O.live_sql({c: O.byte(f"floor({c} / 255e0 * 3e0 + 0.5e0) / 3e0 * 255e0") for c in "rgb"}),
    "threshold": O.live_sql({c: f"case when floor({O.LUM}) >= 128 then 255 else 0 end" for c in "rgb"}),
    "levels": O.live_sql({c: O.byte(f"10e0 + least(210e0, greatest(0e0, {c} - 20e0)) / 210e0 * 230e0") for c in "rgb"}),
    "gradient_map": O.live_sql({c: _gm(k) for k, c in enumerate("rgb")}),
    "scale_alpha": _px + "image_id, x, y, r, g, b, cast((a * 77 + 127) // 255 as int) a from px",
    "apply_mask": f"with {O.PAIR} select image_id, x, y, m.r, m.g, m.b, cast(case when s.image_id is null then m.a else (m.a * (255 - m.sr) + 127) // 255 end as int) a from m left join (select image_id, x, y from s) s using (image_id, x, y)",
    **{f"convolve_{k}": O.convolve_sql(neighbourhood.KERNELS[k]) for k in ("box3", "gauss3", "gauss5", "sharpen", "edge_detect", "emboss")},
    "unsharp": f"with {_P}, m as (select p.image_id, p.x, p.y, " + ", ".join(f"sum(q.{c}) / count(*)::double m{c}" for c in "rgb") + " from px p join px q on q.image_id = p.image_id and abs(q.x - p.x) <= 1 and abs(q.y - p.y) <= 1 where q.a > 0 group by all) select image_id, x, y, " + ", ".join(f"case when a > 0 then {O.byte(f'{c} + ({c} - m{c}) * 0.6e0')} else {c} end {c}" for c in "rgb") + ", a from px left join m using (image_id, x, y)",
    "blit": f"with {_P}, t as (select image_id - 1 image_id, y + 1 x, 3 - x - 1 y, r, g, b, cast((a * 179 + 127) // 255 as int) a from px), m as (select p.*, coalesce(t.r, 0) sr, coalesce(t.g, 0) sg, coalesce(t.b, 0) sb, coalesce(t.a, 0) sa from px p left join t using (image_id, x, y)) select image_id, x, y, " + ", ".join(f"{v} {c}" for c, v in O.over_sql("", "s").items()) + " from m",
    "render_groups": O.groups_sql(),
    "histogram": f"with {O.PLANE}, v as (select image_id, unnest(['r', 'g', 'b', 'a']) channel, unnest([r, g, b, a]) \"value\", 1 k from pl union all select distinct image_id, channel, i::int, 0 from pl, (values ('r'), ('g'), ('b'), ('a')) c(channel), range(256) t(i)) select image_id, channel, \"value\", sum(k)::bigint n from v group by all",
    "dominant": f"with {O.PLANE}, c as (select image_id, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) bin, count(*) n from pl where a > 0 group by all), t as (select *, row_number() over (partition by image_id order by n desc, bin) k from c) select image_id, cast((bin >> 10) * 8 + 4 as int) r, cast(((bin >> 5) & 31) * 8 + 4 as int) g, cast((bin & 31) * 8 + 4 as int) b from t where k = 1",
    "palette_box": f"with {O.PLANE}, b as (select image_id, " + ", ".join(f"min({c}) min_{c}, max({c}) max_{c}, cast(sum({c}) // count(*) as int) avg_{c}" for c in "rgb") + " from pl where a > 0 group by image_id) select *, greatest(max_r - min_r, max_g - min_g, max_b - min_b) widest from b",
    "alpha_bounds": _px + "image_id, " + ", ".join(f"coalesce(min({c}) filter (a > 0), 0) {c}, coalesce(max({c}) filter (a > 0) - min({c}) filter (a > 0) + 1, 0) {n}" for c, n in (("x", "w"), ("y", "h"))) + " from px group by image_id",
    "quantize": f"with {_P}, q as (select *, {_dist} dd from px) select image_id, x, y, " + ", ".join(f"case when a > 0 then case {_best} {_near.format(*[p[k] for p in PALETTE])} end else {c} end {c}" for k, c in enumerate("rgb")) + ", a from q",
    "fill_all": f"with {_P}, s as (select * from px where x = 0 and y = 0) select p.image_id, p.x, p.y, " + ", ".join(f"case when {_same} then {v} else p.{c} end {c}" for c, v in zip("rgba", (1, 2, 3, 255), strict=True)) + " from px p join s using (image_id)",
    "fill_region": f"with recursive {_P}, s as (select * from px where x = 0 and y = 0), k as (select p.image_id, p.x, p.y from px p join s using (image_id) where {_same}), w as (select image_id, x, y from s union select k.image_id, k.x, k.y from k join w on k.image_id = w.image_id and abs(k.x - w.x) + abs(k.y - w.y) = 1) select p.image_id, p.x, p.y, " + ", ".join(f"case when w.x is not null then {v} else p.{c} end {c}" for c, v in zip("rgba", (1, 2, 3, 255), strict=True)) + " from px p left join w using (image_id, x, y)",
    "flip": _px + "image_id, 3 - x x, y, r, g, b, a from px",
    "rotate90": _px + "image_id, 3 - y x, x y, r, g, b, a from px",
    "crop": f"with {_P}, i as (select distinct image_id from px), g as (select image_id, cast(p % 4 as int) x, cast(p // 4 as int) y from i, range(12) t(p)) select g.image_id, g.x, g.y, " + ", ".join(f"coalesce(px.{c}, 0) {c}" for c in "rgba") + " from g left join px on px.image_id = g.image_id and px.x = g.x + 1 and px.y = g.y + 2",
    "resize_nearest": f"with {_P} select image_id, cast(i as int) x, cast(j as int) y, r, g, b, a from px, range(7) t(i), range(3) u(j) where px.x = least(3, floor((i + 0.5e0) * 4 / 7)) and px.y = least(3, floor((j + 0.5e0) * 4 / 3))",
    "resize_bilinear": f"with {_P}, e as (select i, least(3e0, greatest(0e0, (i + 0.5e0) * 4 / 6 - 0.5e0)) c from range(6) t(i)), k as (select i, floor(c)::int q, 1 - (c - floor(c)) w from e union all select i, least(3, floor(c)::int + 1), c - floor(c) from e) select image_id, cast(kx.i as int) x, cast(ky.i as int) y, " + ", ".join(f"{O.byte(f'round(sum({c} * (kx.w * ky.w)), 6)')} {c}" for c in "rgba") + " from px, k kx, k ky where px.x = kx.q and px.y = ky.q group by all",
    "pixel_scale": f"with {_P} select image_id, cast(x * 2 + i as int) x, cast(y * 2 + j as int) y, r, g, b, a from px, range(2) t(i), range(2) u(j)",
    "list_layers": f"with recursive {O.LAYERS} select * from ls",
    "remove_layer": f"with recursive {O.LAYERS} select id, parent, kind, cast(row_number() over (partition by parent order by idx) - 1 as int) idx from ls where not starts_with(path, (select path from ls where id = 'n3'))",
    "move_layer": f"with recursive {O.LAYERS}, m as (select id, case when id = 'n3' then 'g0' else parent end parent, kind, idx from nl), o as (select *, row_number() over (partition by parent order by (id = 'n3')::int, idx) - 1 k from m) select id, parent, kind, cast(row_number() over (partition by parent order by case when id = 'n3' then 1 else k * 2 end) - 1 as int) idx from o",
    "patch_log": "select user_id layer_id, arg_max(least(1e0, value / 300e0), event_id) filter (event_type = 'view') opacity, arg_max(cast(floor(value) as int), event_id) filter (event_type = 'click') x, arg_max(cast(floor(value) as int), event_id) filter (event_type = 'purchase') y from events group by 1",
    "contact_sheet": f"with {_SPRITES}, c as (select *, max(w) over (partition by sheet) mw, max(h) over (partition by sheet) mh, count(*) over (partition by sheet) n, row_number() over (partition by sheet order by idx) - 1 i from sp), d as (select *, ceil(sqrt(n))::int k from c) select sheet, idx, cast(i % k * mw + (mw - w) // 2 as int) x, cast(i // k * mh + (mh - h) // 2 as int) y from d",
    "pack_sprites": f"""with recursive {_SPRITES}, o as (select *, row_number() over (partition by sheet order by -h, idx) k from sp),
p as (select sheet, idx, k, w, h, case when w > 256 then 0 else 0 end x, 0 y, w nx, h shelf from o where k = 1
union all select o.sheet, o.idx, o.k, o.w, o.h, case when p.nx + o.w > 256 then 0 else p.nx end, case when p.nx + o.w > 256 then p.y + p.shelf else p.y end, case when p.nx + o.w > 256 then o.w else p.nx + o.w end, case when p.nx + o.w > 256 then o.h else greatest(p.shelf, o.h) end from p join o on o.sheet = p.sheet and o.k = p.k + 1)
select sheet, idx, x, y, w, h from p""",
    "ellipse": f"with {_SPRITES}, c as (select idx shape, w, h, cast(p % w as int) x, cast(p // w as int) y from (select *, unnest(range(0, w * h)) p from sp)), e as (select *, x + 0.5e0 fx, y + 0.5e0 fy from c) select shape, x, y, case when w > 4 and h > 4 and pow((fx - 2 - (w - 4) / 2e0) / ((w - 4) / 2e0), 2) + pow((fy - 2 - (h - 4) / 2e0) / ((h - 4) / 2e0), 2) <= 1e0 then 'fill' else 'stroke' end part from e where pow((fx - w / 2e0) / (w / 2e0), 2) + pow((fy - h / 2e0) / (h / 2e0), 2) <= 1e0",
    **{f"gradient_{g}": f"with {_CELLS}, q as (select *, {e} t from ce) select n_nationkey, w, h, x, y, {', '.join(f'{_stop(i)} {c}' for i, c in enumerate('rgba'))} from q" for g, e in _t.items()},
    "dab_size": f"with {_STROKES} select *, 24e0 * (0.5e0 + least(1e0, greatest(0e0, pressure)) * 0.5e0) dab from sk",
    "stroke_length": f"with {_STROKES}, l as (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0) d from sk window w as (partition by stroke_id order by seq)) select stroke_id, seq, round(sum(d) over (partition by stroke_id order by seq rows unbounded preceding), 6) travelled from l",
    "stroke_smoothing": f"with recursive {_STROKES}, r as (select stroke_id, seq, x::double x, y::double y, pressure from sk where seq = 0 union all select s.stroke_id, s.seq, r.x + (s.x - r.x) * (1e0 - 0.4e0), r.y + (s.y - r.y) * (1e0 - 0.4e0), r.pressure + (s.pressure - r.pressure) * (1e0 - 0.4e0) from r join sk s on s.stroke_id = r.stroke_id and s.seq = r.seq + 1) select stroke_id, seq, round(x, 6) x, round(y, 6) y, round(pressure, 6) pressure from r",
    "colours": f"with h as (select c_custkey, c_custkey * 7919 % 16777216 v from customer), c as (select c_custkey, cast(v >> 16 as int) r, cast((v >> 8) & 255 as int) g, cast(v & 255 as int) b from h), l as (select *, ({_lin('r')}) * 0.2126e0 + ({_lin('g')}) * 0.7152e0 + ({_lin('b')}) * 0.0722e0 lum from c) select c_custkey, r, g, b, printf('#%02x%02x%02x', r, g, b) hex, round(lum, 9) luminance, round(1.05e0 / (lum + 0.05e0), 9) contrast, case when lum > 0.179e0 then '#000000' else '#ffffff' end \"text\" from l",
    "base64": "select doc_id, to_base64(encode(text)) b64, text from documents",
    "detect_format": "select page_id, case page_id % 7 when 0 then 'png' when 1 then 'jpeg' when 2 then 'webp' when 3 then 'gif' when 4 then 'psd' else 'unknown' end format from pages",
    "png_round_trip": _px + "* from px",
    "webp_round_trip": _px + "* from px",
}
for part in (drawing, documents, wrappers):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
