"""Queries on the layer table: listing, setters, patches, new layers, moves, alignment, files; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import layers as L
from strata.operators import tree
from strata.sources import documents as files
from strata.sources.shared import checkpointed
from strata.sources.views import KINDS, canvases, layer_table, table

_HAS = "kind in ('raster', 'shape', 'text', 'svg')"
#: The layer table of views.layer_table, payloads as ``flat`` shows them.
LAYERS = f"""b0 as (select n_regionkey::bigint doc_id, (n_nationkey + 1)::bigint layer_id, null::bigint parent_id, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int idx, 'group' kind, 'nation ' || n_nationkey name, 5::bigint k from nation
union all select n_regionkey, s_suppkey + 100, n_nationkey + 1, (row_number() over (partition by s_nationkey order by s_suppkey) - 1)::int, {KINDS!r}[s_suppkey % 8 + 1], 'layer ' || s_suppkey, s_suppkey from supplier join nation on s_nationkey = n_nationkey),
lt as (select doc_id, layer_id, parent_id, idx, kind, name, k % 6 <> 0 visible, (k % 10) / 10e0 opacity, (k * 7 % 100 - 50)::int x, (k * 11 % 90)::int y, case when {_HAS} then (k % 24 + 3)::int end w, case when {_HAS} then (k % 17 + 2)::int end h,
 case when {_HAS} and k % 2 = 0 then 'center' else 'top-left' end anchor, false flip_x, false flip_y, case when {_HAS} then (k % 4) * 90e0 else 0e0 end rotation, case when {_HAS} then (k % 3) / 2e0 + 1e0 else 1e0 end scale_x, 1e0 scale_y, 'normal' blend_mode, false clip_to_below,
 case when k % 5 = 0 then '80FF00FF' end mask, false mask_inverted, false alpha_locked, case when kind = 'raster' then ((k % 24 + 3) * (k % 17 + 2) * 4)::int end rgba_n, case when kind = 'raster' then printf('%02X', k % 256) || 'A0B0FF' end rgba_head,
 case when kind = 'solid' then 1 when kind = 'gradient' then 2 end stops, case when kind = 'gradient' then 'vertical' end direction, case when kind = 'filter' then (k % 7) / 10e0 end brightness, case when kind = 'filter' then 0e0 end sharpen,
 case kind when 'shape' then 'rectangle' when 'text' then 'text ' || k when 'svg' then '<svg/>' end content, case when kind = 'text' then 16 end text_size from b0)"""
_COLUMNS = "doc_id layer_id parent_id idx kind name visible opacity x y w h anchor flip_x flip_y rotation scale_x scale_y blend_mode clip_to_below mask mask_inverted alpha_locked rgba_n rgba_head stops direction brightness sharpen content text_size".split()


def flat(df: DataFrame) -> DataFrame:
    """Layers with their payloads as plain columns."""
    new = {
        "mask": F.hex("mask"), "rgba_n": F.length("rgba"), "rgba_head": F.hex(F.substring("rgba", 1, 4)), "stops": F.when(F.col("fill").isNotNull(), F.size("fill")),
        "brightness": F.col("filter.brightness"), "sharpen": F.col("filter.sharpen"), "content": F.coalesce("text.text", "shape.type", "svg"), "text_size": F.col("text.size"),
    }
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in _COLUMNS])


def _edit(f):
    return lambda s, d: flat(f(layer_table(s, d)))


def _docs(s, d, only: int | None = None) -> DataFrame:
    docs = canvases(s, d).select("doc_id")
    return docs if only is None else docs.where(F.col("doc_id") == only)


def _add(f, only: int | None = None, parent: int | None = None):
    more = {} if parent is None else {"parent_id": parent}
    return lambda s, d: flat(f(layer_table(s, d), _docs(s, d, only), "new", **more))


def _set(layer: int, kinds: str = "true", **values: str) -> str:
    return f"with {LAYERS} select * replace ({', '.join(f'case when layer_id = {layer} and {kinds} then {v} else {c} end as {c}' for c, v in values.items())}) from lt"


def _new(only: int | None = None, parent: int | None = None, **values: str) -> str:
    base = {"visible": "true", "opacity": "1e0", "x": "0", "y": "0", "anchor": "'top-left'", "flip_x": "false", "flip_y": "false", "rotation": "0e0", "scale_x": "1e0", "scale_y": "1e0", "blend_mode": "'normal'", "clip_to_below": "false", "mask_inverted": "false", "alpha_locked": "false", "name": "'new'"}
    base |= {"doc_id": "r_regionkey", "layer_id": "(select coalesce(max(layer_id), 0) + 1 from lt where doc_id = r_regionkey)", "parent_id": "null" if parent is None else str(parent)}
    base["idx"] = f"(select count(*)::int from lt where doc_id = r_regionkey and parent_id is not distinct from {base['parent_id']})"
    where = "" if only is None else f" where r_regionkey = {only}"
    return f"with {LAYERS} select * from lt union all select {', '.join((base | values).get(c, 'null') for c in _COLUMNS)} from region{where}"


_SVG = "<svg><rect/></svg>"
_KINDS = {
    "image": (lambda t, d, n, **k: L.add_image(t, d, n, bytes(range(24)), 3, 2, 5, -6, **k), {"kind": "'raster'", "w": "3", "h": "2", "x": "5", "y": "-6", "rgba_n": "24", "rgba_head": "'00010203'"}),
    "paint": (lambda t, d, n, **k: L.add_paint(t, d, n, 4, 2, **k), {"kind": "'raster'", "w": "4", "h": "2", "rgba_n": "32", "rgba_head": "'00000000'"}),
    "filter": (L.add_filter, {"kind": "'filter'", "brightness": "0e0", "sharpen": "0e0"}),
    "group": (L.add_group, {"kind": "'group'"}),
    "solid": (lambda t, d, n, **k: L.add_solid(t, d, n, (1, 2, 3, 4), **k), {"kind": "'solid'", "stops": "1"}),
    "gradient": (lambda t, d, n, **k: L.add_gradient(t, d, n, [(0.0, (0, 0, 0, 255)), (0.5, (9, 9, 9, 9)), (1.0, (255, 0, 0, 255))], 7, **k), {"kind": "'gradient'", "stops": "3", "direction": "'horizontal'"}),
    "shape": (lambda t, d, n, **k: L.add_shape(t, d, n, "ellipse", 0, 9, stroke=(1, 1, 1, 255), stroke_width=0, x=2, y=3, **k), {"kind": "'shape'", "w": "1", "h": "9", "x": "2", "y": "3", "content": "'ellipse'"}),
    "text": (lambda t, d, n, **k: L.add_text(t, d, n, "naïve", 0, 0, x=1, y=1, **k), {"kind": "'text'", "x": "1", "y": "1", "content": "'naïve'", "text_size": "1"}),
    "svg": (lambda t, d, n, **k: L.add_svg(t, d, n, _SVG, 12, 0, 4, 4, **k), {"kind": "'svg'", "w": "12", "h": "1", "x": "4", "y": "4", "content": f"'{_SVG}'"}),
}


def _moves(*steps: tuple[int, int, int]) -> str:
    """Top-level places of document 1 after its groups are moved: (layer, index among the others, parent or -1)."""
    ctes, last = [LAYERS, "o0 as (select list(layer_id order by idx) v from lt where doc_id = 1 and parent_id is null)"], "o0"
    for i, (layer, at, _) in enumerate(steps, 1):
        ctes.append(f"o{i} as (select list_concat(list_concat(w[:{at}], [{layer}]), w[{at + 1}:]) v from (select list_filter(v, lambda x: x <> {layer}) w from {last}))")
        last = f"o{i}"
    return f"with {', '.join(ctes)} select * replace (case when doc_id = 1 and parent_id is null then (list_position((select v from {last}), layer_id) - 1)::int else idx end as idx) from lt"


_INTO = f"with {LAYERS} select * replace (case when layer_id = 7 then 2 else parent_id end as parent_id, (case when layer_id = 7 then 0 when parent_id = 2 then idx + 1 when doc_id = 1 and parent_id is null and idx > 1 then idx - 1 else idx end)::int as idx) from lt"


def _align_sql(ids: str, axis: str, at: str, box: str, out: str) -> str:
    size, scale = ("w", "h")[axis == "y"], lambda c, s: f"greatest(1e0, floor({c} * {s} + 0.5e0))"
    wide, high = scale("w", "scale_x"), scale("h", "scale_y")
    turned = {"w": f"case when rotation in (90, 270) then {high} else {wide} end", "h": f"case when rotation in (90, 270) then {wide} else {high} end"}[size]
    ctes = f"{LAYERS}, e as (select *, layer_id in ({ids}) and {_HAS} named, ({turned})::int sz from lt), f as (select *, case when anchor = 'center' then round({axis} - sz / 2e0)::int else {axis} end lo from e), bx as ({box}), g as (select f.*, ({at})::int nl, b0 is not null as boxed from f left join bx using (doc_id)), h as (select *, case when named and boxed then case when anchor = 'center' then round(nl + sz / 2e0)::int else nl end else {axis} end nw from g)"
    return f"with {ctes} {out}"


_IDS = [104, 105, 106, 108, 108, 101, 112, 116]
_LIST = ", ".join(map(str, sorted(set(_IDS))))
_SELECTION = "select doc_id, min(lo) b0, max(lo + sz) b1 from f where named group by doc_id"
_CANVAS = "select r_regionkey doc_id, 0 b0, {} b1 from region"
_show = lambda axis: f"select {', '.join(f'nw {c}' if c == axis else c for c in _COLUMNS)} from h"


def _chain(s, d) -> DataFrame:
    """A tree as deep as there are nations."""
    n = table(s, d, "nation")
    text = lambda v: F.concat(F.lit("n"), v.cast("string"))
    return n.select(text(F.col("n_nationkey")).alias("id"), F.when(F.col("n_nationkey") > 0, text(F.col("n_nationkey") - 1)).alias("parent"), F.lit("group").alias("kind"), F.lit(0).alias("idx"))


def _refused(t: DataFrame) -> DataFrame:
    """A move, and then moves that must change nothing: below itself, into itself, into a layer that is no group or isn't there."""
    t = checkpointed(L.moved(t, 7, 2, 0))
    for parent in (7, 2, 104, 999):
        t = checkpointed(L.moved(t, 2, parent))
    return t


_knob = {"brightness": 0.5, "sharpen": 0.25}
_PATCH = dict(name="patched", opacity=-2.0, x=9, blend_mode="soft_light", mask_inverted=True, alpha_locked=True, anchor="center", flip_x=True, rotation=45.0, scale_x=-2.5)

QUERIES: dict = {
    "set_opacity": _edit(lambda t: L.set_opacity(t, 108, 1.7)),
    "set_visible": _edit(lambda t: L.set_visible(t, 106, True)),
    "set_position": _edit(lambda t: L.set_position(t, 104, -3, 12)),
    "set_blend_mode": _edit(lambda t: L.set_blend_mode(L.set_blend_mode(t, 102, "Color Dodge"), 103, "no such mode")),
    "set_layer_mask": _edit(lambda t: L.set_mask(L.set_mask(t, 103, bytes(8), 2, 1), 104, bytes(7), 2, 1)),
    "remove_layer_mask": _edit(lambda t: L.remove_mask(t, 105)),
    "set_mask_inverted": _edit(lambda t: L.set_mask_inverted(t, 105, True)),
    "set_clip_to_below": _edit(lambda t: L.set_clip_to_below(t, 108, True)),
    "set_alpha_locked": _edit(lambda t: L.set_alpha_locked(L.set_alpha_locked(t, 108, True), 104, True)),
    "set_flip": _edit(lambda t: L.set_flip(L.set_flip(t, 104, True, False), 101, True, True)),
    "set_rotation": _edit(lambda t: L.set_rotation(t, 105, 33.5)),
    "set_anchor": _edit(lambda t: L.set_anchor(L.set_anchor(t, 105, 1), 104, 7)),
    "set_filter_config": _edit(lambda t: L.set_filter_config(L.set_filter_config(t, 101, **_knob), 108, **_knob)),
    "update_layer": _edit(lambda t: L.updated(t, 108, **_PATCH)),
    "update_filter_layer": _edit(lambda t: L.updated(t, 101, visible=False, rotation=5.0, filter={"sharpen": 0.75}, text={"text": "no"})),
    "update_text_layer": _edit(lambda t: L.updated(t, 105, text={"text": "after", "size": 0}, clip_to_below=True)),
    **{f"add_{k}_layer": _add(f) for k, (f, _) in _KINDS.items()},
    **{f"add_{k}_to_group": _add(_KINDS[k][0], 1, 2) for k in ("image", "filter", "group", "shape", "text", "svg")},
    "find_layer": _edit(lambda t: L.found(t, 108)),
    "get_layer": lambda s, d: L.snapshot(layer_table(s, d), 108).select("doc_id", "layer_id", "parent_id", "depth", "kind", "w", "h", "rotation", "alpha_locked", "has_mask", F.col("text.text").alias("content")),
    "list_group": lambda s, d: L.listed(layer_table(s, d), 2, False).select("doc_id", "layer_id", "idx", "depth"),
    "list_documents": lambda s, d: L.listed(layer_table(s, d)).select("doc_id", "layer_id", "depth", F.array_join(F.transform("path", lambda v: v.cast("string")), "/").alias("path")),
    "list_deep": lambda s, d: tree.listed(_chain(s, d)).select("id", "depth"),
    "remove_deep": lambda s, d: tree.without(_chain(s, d), "n20"),
    "remove_group": _edit(lambda t: L.removed(t, 2)),
    "remove_child": lambda s, d: flat(L.removed_child(L.removed_child(layer_table(s, d), 999, 108), layer_table(s, d).where("layer_id = 108").first()["parent_id"], 108)),
    "move_up": _edit(lambda t: L.moved(t, 2, None, 3)),
    "move_down": _edit(lambda t: L.moved(t, 17, None, 1)),
    "move_to_end": _edit(lambda t: L.moved(t, 7)),
    "move_into_group": _edit(lambda t: L.moved(t, 7, 2, 0)),
    "move_refused": _edit(_refused),
    "move_in_tree": lambda s, d: tree.moved(tree.moved(_chain(s, d).withColumns({"parent": F.lit(None).cast("string"), "idx": F.substring("id", 2, 9).cast("int")}), "n2", None, 6), "n9", "n9"),
    "align_left": lambda s, d: flat(L.aligned(layer_table(s, d), _IDS, "left")[0]),
    "align_middle": lambda s, d: flat(L.aligned(layer_table(s, d), _IDS, "vertical-center", canvases(s, d))[0]),
    "align_moved": lambda s, d: L.aligned(layer_table(s, d), _IDS, "right")[1],
    "resize_canvas": lambda s, d: L.resized_canvas(canvases(s, d), 2, 640, 480),
    "document_about": lambda s, d: L.about(layer_table(s, d)),
    "rasterize_svg_layer": _edit(lambda t: L.rasterized(L.rasterized(t, 106, lambda m, w, h: b"\x09" * (w * h * 4)), 114)),
    "document_round_trip": lambda s, d: flat(files.layers_of(files.opened(checkpointed(files.saved(canvases(s, d), layer_table(s, d)))))),
    "document_faults": lambda s, d: files.opened(files.damaged(checkpointed(files.saved(canvases(s, d), layer_table(s, d))))).select("doc_id", "error"),
    "document_has_svg": lambda s, d: files.has_svg(checkpointed(files.saved(canvases(s, d), layer_table(s, d)))),
}

ORACLE_SQL: dict[str, str] = {
    "set_opacity": _set(108, opacity="1e0"),
    "set_visible": _set(106, visible="true"),
    "set_position": _set(104, x="-3", y="12"),
    "set_blend_mode": _set(102, blend_mode="'color-dodge'"),
    "set_layer_mask": _set(103, mask="'0000000000000000'"),
    "remove_layer_mask": _set(105, mask="null"),
    "set_mask_inverted": _set(105, mask_inverted="true"),
    "set_clip_to_below": _set(108, clip_to_below="true"),
    "set_alpha_locked": _set(108, alpha_locked="true"),
    "set_flip": _set(104, flip_x="true"),
    "set_rotation": _set(105, rotation="33.5e0"),
    "set_anchor": f"with {LAYERS} select * replace (case layer_id when 105 then 'center' when 104 then 'top-left' else anchor end as anchor) from lt",
    "set_filter_config": _set(101, brightness="0.5e0", sharpen="0.25e0"),
    "update_layer": _set(108, name="'patched'", opacity="0e0", x="9", blend_mode="'soft-light'", mask_inverted="true", alpha_locked="true", anchor="'center'", flip_x="true", rotation="45e0", scale_x="2.5e0"),
    "update_filter_layer": _set(101, visible="false", sharpen="0.75e0"),
    "update_text_layer": _set(105, content="'after'", text_size="1", clip_to_below="true"),
    **{f"add_{k}_layer": _new(**v) for k, (_, v) in _KINDS.items()},
    **{f"add_{k}_to_group": _new(1, 2, **_KINDS[k][1]) for k in ("image", "filter", "group", "shape", "text", "svg")},
    "find_layer": f"with {LAYERS} select * from lt where layer_id = 108",
    "get_layer": f"with {LAYERS} select doc_id, layer_id, parent_id, 1 depth, kind, w, h, rotation, alpha_locked, mask is not null has_mask, null::varchar content from lt where layer_id = 108",
    "list_group": f"with {LAYERS} select doc_id, layer_id, idx, 0 depth from lt where parent_id = 2",
    "list_documents": f"with {LAYERS} select c.doc_id, c.layer_id, case when c.parent_id is null then 0 else 1 end depth, coalesce(p.idx || '/', '') || c.idx path from lt c left join lt p on p.layer_id = c.parent_id and p.doc_id = c.doc_id",
    "list_deep": "select 'n' || n_nationkey id, n_nationkey::int depth from nation",
    "remove_deep": "select 'n' || n_nationkey id, case when n_nationkey > 0 then 'n' || (n_nationkey - 1) end parent, 'group' kind, 0 idx from nation where n_nationkey < 20",
    "remove_group": f"with {LAYERS} select * replace ((row_number() over (partition by doc_id, parent_id order by idx) - 1)::int as idx) from lt where layer_id <> 2 and parent_id is distinct from 2",
    "remove_child": f"with {LAYERS} select * replace ((row_number() over (partition by doc_id, parent_id order by idx) - 1)::int as idx) from lt where layer_id <> 108",
    "move_up": _moves((2, 2, -1)),
    "move_down": _moves((17, 1, -1)),
    "move_to_end": _moves((7, 4, -1)),
    "move_into_group": _INTO,
    "move_refused": _INTO,
    "move_in_tree": "with o as (select list('n' || n_nationkey order by n_nationkey) v from nation), m as (select list_concat(list_concat(w[:5], ['n2']), w[6:]) v from (select list_filter(v, lambda x: x <> 'n2') w from o)) select 'n' || n_nationkey id, null::varchar parent, 'group' kind, (list_position((select v from m), 'n' || n_nationkey) - 1)::int idx from nation",
    "align_left": _align_sql(_LIST, "x", "b0", _SELECTION, _show("x")),
    "align_middle": _align_sql(_LIST, "y", "round((b0 + b1 - sz) / 2e0)", _CANVAS.format("80"), _show("y")),
    "align_moved": _align_sql(_LIST, "x", "b1 - sz", _SELECTION, "select doc_id, count(*) filter (nw <> x) moved from h group by doc_id"),
    "resize_canvas": "select r_regionkey::bigint doc_id, case when r_regionkey = 2 then 640 else (r_regionkey * 10 + 100)::int end width, case when r_regionkey = 2 then 480 else 80 end height from region",
    "document_about": f"with {LAYERS} select doc_id, count(*) filter (parent_id is null) top, count(*) layers, max(layer_id) last_id, bool_or(kind = 'svg') has_svg from lt group by doc_id",
    "rasterize_svg_layer": f"with {LAYERS} select * replace (case when hit then 'raster' else kind end as kind, case when hit then w * h * 4 else rgba_n end as rgba_n, case when hit then case layer_id when 106 then '09090909' else '00000000' end else rgba_head end as rgba_head, case when hit then null else content end as content) from (select *, layer_id in (106, 114) hit from lt)".replace("select * replace", "select * exclude (hit) replace"),
    "document_round_trip": f"with {LAYERS} select * from lt",
    "document_faults": "select r_regionkey::bigint doc_id, ['too short', 'metadata cut off', 'no document', 'version 9 is not supported', 'pixels out of range'][r_regionkey + 1] error from region",
    "document_has_svg": f"with {LAYERS} select r_regionkey::bigint doc_id, coalesce(bool_or(kind = 'svg'), false) has_svg, null::varchar error from region left join lt on doc_id = r_regionkey group by all",
}
