"""SQL over the driver's tables that says what the queries of ``catalog`` should return."""

from __future__ import annotations

from strata.functions.blend import MODES

PIXELS = """px as (select vec_id image_id, cast(p % 4 as int) x, cast(p // 4 as int) y, """ + ", ".join(
    f"cast(least(255e0, greatest(0e0, floor((cast(embedding[4 * p + {i}] as double) + 0.15e0) / 0.3e0 * 256e0))) as int) {c}" for i, c in enumerate("rgba", 1)
) + " from (select vec_id, embedding, unnest(range(0, 16)) p from embeddings))"
PLANE = "pl as (select l_suppkey image_id, cast(l_partkey % 256 as int) r, cast(l_orderkey % 256 as int) g, cast(l_quantity * 5 as int) b, cast(least(255, l_linenumber * 40) as int) a from lineitem)"
PAIR = PIXELS + ", d as (select * from px), s as (select image_id - 1 image_id, x, y, r, g, b, a from px), m as (select d.*, coalesce(s.r, 0) sr, coalesce(s.g, 0) sg, coalesce(s.b, 0) sb, coalesce(s.a, 0) sa from d left join s using (image_id, x, y))"


def byte(e: str) -> str:
    return f"cast(floor(least(255e0, greatest(0e0, {e}))) as int)"


def over_sql(d: str, s: str) -> dict[str, str]:
    """Integer source-over of columns named with the prefixes d and s."""
    back = f"(({d}a * (255 - {s}a) + 127) // 255)"
    alpha = f"({s}a + {back})"
    out = {}
    for c in "rgb":
        mixed = f"(({s}{c} * {s}a + ({d}{c} * {d}a * (255 - {s}a) + 127) // 255 + {alpha} // 2) // greatest({alpha}, 1) % 256)"
        out[c] = f"cast(case when {s}a = 0 then {d}{c} when {s}a = 255 or {d}a = 0 then {s}{c} else {mixed} end as int)"
    out["a"] = f"cast(case when {s}a = 0 then {d}a when {s}a = 255 or {d}a = 0 then {s}a else {alpha} end as int)"
    return out


def render_sql(depth: int = 5) -> str:
    steps = [PIXELS, f"st as (select image_id // {depth} doc_id, image_id % {depth} z, x, y, r, g, b, a from px)", "k0 as (select distinct doc_id, x, y, 0 cr, 0 cg, 0 cb, 0 ca, 0 below from st)"]
    for z in range(depth):
        alpha = "(coalesce(l.a, 0) * below + 127) // 255" if z % 2 else "coalesce(l.a, 0)"
        steps.append(f"j{z} as (select k.*, coalesce(l.r, 0) sr, coalesce(l.g, 0) sg, coalesce(l.b, 0) sb, {alpha} sa from k{z} k left join st l on l.doc_id = k.doc_id and l.x = k.x and l.y = k.y and l.z = {z})")
        steps.append(f"k{z + 1} as (select doc_id, x, y, {', '.join(f'{v} c{c}' for c, v in over_sql('c', 's').items())}, sa below from j{z})")
    return f"with {', '.join(steps)} select doc_id, x, y, cr r, cg g, cb b, ca a from k{depth}"


_SEPARABLE = {
    "multiply": "{d} * {s}",
    "screen": "{d} + {s} - {d} * {s}",
    "overlay": "case when {d} <= 0.5e0 then {d} * 2e0 * {s} else 1e0 - (1e0 - {d}) * 2e0 * (1e0 - {s}) end",
    "darken": "least({d}, {s})",
    "lighten": "greatest({d}, {s})",
    "color-dodge": "case when {d} <= 0 then 0e0 when {s} >= 1 then 1e0 else least(1e0, {d} / (1e0 - {s})) end",
    "color-burn": "case when {d} >= 1 then 1e0 when {s} <= 0 then 0e0 else 1e0 - least(1e0, (1e0 - {d}) / {s}) end",
    "hard-light": "case when {s} <= 0.5e0 then {d} * 2e0 * {s} else 1e0 - (1e0 - {d}) * 2e0 * (1e0 - {s}) end",
    "soft-light": "case when {s} <= 0.5e0 then {d} - (1e0 - {s} * 2e0) * {d} * (1e0 - {d}) else {d} + ({s} * 2e0 - 1e0) * (case when {d} <= 0.25e0 then (({d} * 16e0 - 12e0) * {d} + 4e0) * {d} else sqrt({d}) end - {d}) end",
    "difference": "abs({d} - {s})",
    "exclusion": "{d} + {s} - {d} * 2e0 * {s}",
}


def hsl_sql(name: str, source: str, r: str, g: str, b: str, p: str) -> str:
    """CTE ``name``: the source with columns {p}h, {p}s and {p}l."""
    return f"""{name}_0 as (select *, {r} / 255e0 r_, {g} / 255e0 g_, {b} / 255e0 b_ from {source}),
{name}_1 as (select *, greatest(r_, g_, b_) t_, least(r_, g_, b_) w_ from {name}_0),
{name}_2 as (select *, t_ - w_ d_, (t_ + w_) / 2e0 l_ from {name}_1),
{name} as (select * exclude (r_, g_, b_, t_, w_, d_, l_), l_ {p}l, case when d_ = 0 then 0e0 else d_ / (1e0 - abs(l_ * 2e0 - 1e0)) end {p}s,
 case when h_ < 0 then h_ + 360e0 else h_ end {p}h from (select *, 60e0 * case when d_ = 0 then 0e0 when t_ = r_ then (g_ - b_) / d_ when t_ = g_ then (b_ - r_) / d_ + 2e0 else (r_ - g_) / d_ + 4e0 end h_ from {name}_2) exclude_h)""".replace("* exclude (r_", "* exclude (h_, r_").replace(" exclude_h)", ")")


def rgb_sql(name: str, source: str, h: str, s: str, light: str, p: str) -> str:
    """CTE ``name``: the source with int columns {p}r, {p}g and {p}b."""
    pick = lambda v: "case " + " ".join(f"when hh_ < {i + 1} then {x}" for i, x in enumerate(v[:5])) + f" else {v[5]} end"
    six = {"r": ("c_", "x_", "0e0", "0e0", "x_", "c_"), "g": ("x_", "c_", "c_", "x_", "0e0", "0e0"), "b": ("0e0", "0e0", "x_", "c_", "c_", "x_")}
    return f"""{name}_0 as (select *, (1e0 - abs(({light}) * 2e0 - 1e0)) * ({s}) c_, fmod(fmod({h}, 360e0) + 360e0, 360e0) / 60e0 hh_, ({light}) l_ from {source}),
{name}_1 as (select *, c_ * (1e0 - abs(fmod(hh_, 2e0) - 1e0)) x_, l_ - c_ / 2e0 m_ from {name}_0),
{name} as (select * exclude (c_, hh_, l_, x_, m_), {', '.join(f'{byte(f"({pick(v)} + m_) * 255e0")} {p}{c}' for c, v in six.items())} from {name}_1)"""


def blend_sql(mode: str) -> str:
    if mode == "normal":
        o = over_sql("", "s")
        return f"with {PAIR} select image_id, x, y, {', '.join(f'{v} {c}' for c, v in o.items())} from m"
    ctes, source, mixed = [PAIR], "m", {}
    if mode in _SEPARABLE:
        mixed = {c: "(" + _SEPARABLE[mode].format(d=f"({c} / 255e0)", s=f"(s{c} / 255e0)") + ")" for c in "rgb"}
    else:
        ctes += [hsl_sql("hb", "m", "r", "g", "b", "b_"), hsl_sql("ht", "hb", "sr", "sg", "sb", "t_")]
        h, s, light = {"hue": "tbb", "saturation": "btb", "color": "ttb", "luminosity": "bbt"}[mode]
        ctes.append(rgb_sql("hr", "ht", f"{h}_h", f"{s}_s", f"{light}_l", "n"))
        source, mixed = "hr", {c: f"(n{c} / 255e0)" for c in "rgb"}
    sa, da = "(sa / 255e0)", "(a / 255e0)"
    alpha = f"({sa} + {da} * (1e0 - {sa}))"
    near = lambda v: f"cast(floor(least(1e0, greatest(0e0, {v})) * 255e0 + 0.5e0) as int)"
    cols = {c: near(f"({mixed[c]} * {sa} + {c} / 255e0 * {da} * (1e0 - {sa})) / {alpha}") for c in "rgb"} | {"a": near(alpha)}
    return f"with {', '.join(ctes)} select image_id, x, y, {', '.join(f'case when sa = 0 then {c} else {v} end {c}' for c, v in cols.items())} from {source}"


def live_sql(cols: dict[str, str], source: str = "px", ctes: str = PIXELS) -> str:
    rest = {c: c for c in "rgba"} | {c: f"case when a > 0 then {v} else {c} end" for c, v in cols.items()}
    return f"with {ctes} select image_id, x, y, {', '.join(f'{v} {c}' for c, v in rest.items())} from {source}"


LUM = "(r * 0.299e0 + g * 0.587e0 + b * 0.114e0)"


def convolve_sql(kernel: list[float]) -> str:
    side = int(len(kernel) ** 0.5)
    half = side // 2
    taps = ", ".join(f"({i}, {i % side - half}, {i // side - half}, {w!r}::double)" for i, w in enumerate(kernel))
    total = lambda c: byte(f"list_reduce(list_prepend(0e0, list(s.{c}::double * k.w order by k.i)), lambda p, q: p + q)")
    return f"""with {PIXELS}, k(i, dx, dy, w) as (values {taps}),
t as (select d.image_id, d.x, d.y, {', '.join(f'{total(c)} {c}' for c in 'rgb')} from px d, k, px s where s.image_id = d.image_id and s.x = greatest(0, least(3, d.x + k.dx)) and s.y = greatest(0, least(3, d.y + k.dy)) group by all)
select d.image_id, d.x, d.y, {', '.join(f'case when d.a = 0 then d.{c} else t.{c} end {c}' for c in 'rgb')}, d.a from px d join t using (image_id, x, y)"""


LAYERS = """ly as (select 'g' || r_regionkey id, null::varchar parent, r_regionkey::bigint k, 'group' kind from region union all select 'n' || n_nationkey, 'g' || n_regionkey, n_nationkey, 'group' from nation
union all select 's' || s_suppkey, 'n' || s_nationkey, s_suppkey, case when s_suppkey % 5 = 0 then 'filter' else 'raster' end from supplier),
nl as (select id, parent, kind, cast(row_number() over (partition by parent order by k) - 1 as int) idx from ly),
ls as (select id, parent, kind, idx, 0 depth, printf('%06d', idx) path from nl where parent is null union all select c.id, c.parent, c.kind, c.idx, depth + 1, path || '/' || printf('%06d', c.idx) from nl c join ls on c.parent = ls.id)"""


def groups_sql() -> str:
    """Documents of five layers in two groups (z 0 to 2, 3 and 4), each group at 0.6 of its alpha."""
    steps = [PIXELS, "st as (select image_id // 5 doc_id, image_id % 5 z, x, y, r, g, b, a from px)"]
    steps.append("k0 as (select distinct doc_id, x, y, 0 cr, 0 cg, 0 cb, 0 ca from st)")
    over = ", ".join(f"{v} c{c}" for c, v in over_sql("c", "s").items())
    for g, layers in enumerate(((0, 1, 2), (3, 4))):
        name = f"g{g}_"
        steps.append(f"{name}0 as (select doc_id, x, y, 0 cr, 0 cg, 0 cb, 0 ca, 0 below from k0)")
        for i, z in enumerate(layers):
            alpha = "(coalesce(l.a, 0) * below + 127) // 255" if z % 2 else "coalesce(l.a, 0)"
            steps.append(f"{name}j{i} as (select k.*, coalesce(l.r, 0) sr, coalesce(l.g, 0) sg, coalesce(l.b, 0) sb, {alpha} sa from {name}{i} k left join st l on l.doc_id = k.doc_id and l.x = k.x and l.y = k.y and l.z = {z})")
            steps.append(f"{name}{i + 1} as (select doc_id, x, y, {over}, sa below from {name}j{i})")
        steps.append(f"h{g} as (select k.*, s.cr sr, s.cg sg, s.cb sb, cast((s.ca * 153 + 127) // 255 as int) sa from k{g} k join {name}{len(layers)} s using (doc_id, x, y))")
        steps.append(f"k{g + 1} as (select doc_id, x, y, {over} from h{g})")
    return f"with {', '.join(steps)} select doc_id, x, y, cr r, cg g, cb b, ca a from k2"
