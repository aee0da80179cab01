"""Documents of any number, each with a tree of its own, rendered from the layer table: the tree is data, not plan.

A document is one group: its layer rows meet in one task by one shuffle and are folded there, whole canvases at a time.
``operators.document`` compiles one tree to one plan for all documents that share it; this is for tables whose
documents differ. Both give the same pixels. A canvas is bounded (grids.MAX_BYTES), and so are its layers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.blend import HSL_MODES
from strata.operators.geometry import scaled, turned_size
from strata.operators.grids import MAX_BYTES, turned
from strata.operators.layers import KNOBS, TRANSFORMED

SCHEMA = "doc_id long, width int, height int, data binary"


def over(d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Source-over in integers, of pixels (…, 4)."""
    d, s = d.astype(np.int64), s.astype(np.int64)
    da, sa = d[..., 3:], s[..., 3:]
    back = (da * (255 - sa) + 127) // 255
    alpha = sa + back
    color = (s[..., :3] * sa + (d[..., :3] * da * (255 - sa) + 127) // 255 + alpha // 2) // np.maximum(alpha, 1)
    mixed = np.concatenate([color, alpha], axis=-1)
    return np.where(sa == 0, d, np.where((sa == 255) | (da == 0), s, mixed)).astype(np.uint8)


def _soft(d: np.ndarray, s: np.ndarray) -> np.ndarray:
    bright = np.where(d <= 0.25, ((d * 16 - 12) * d + 4) * d, np.sqrt(d))
    return np.where(s <= 0.5, d - (1 - s * 2) * d * (1 - d), d + (s * 2 - 1) * (bright - d))


def _lit(key: np.ndarray, d: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(key <= 0.5, d * 2 * s, 1 - (1 - d) * 2 * (1 - s))


SEPARABLE: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "multiply": lambda d, s: d * s,
    "screen": lambda d, s: d + s - d * s,
    "overlay": lambda d, s: _lit(d, d, s),
    "darken": np.minimum,
    "lighten": np.maximum,
    "color-dodge": lambda d, s: np.where(d <= 0, 0, np.where(s >= 1, 1, np.minimum(1, d / np.where(s >= 1, 1, 1 - s)))),
    "color-burn": lambda d, s: np.where(d >= 1, 1, np.where(s <= 0, 0, 1 - np.minimum(1, (1 - d) / np.where(s <= 0, 1, s)))),
    "hard-light": lambda d, s: _lit(s, d, s),
    "soft-light": _soft,
    "difference": lambda d, s: np.abs(d - s),
    "exclusion": lambda d, s: d + s - d * 2 * s,
}


def to_hsl(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, g, b = (rgb[..., i] / 255 for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d, light = top - low, (top + low) / 2
    safe = np.where(d == 0, 1, d)
    sat = np.where(d == 0, 0, d / np.where(d == 0, 1, 1 - np.abs(light * 2 - 1)))
    sixth = np.where(d == 0, 0, np.where(top == r, np.fmod((g - b) / safe, 6), np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)))
    hue = sixth * 60
    return np.where(hue < 0, hue + 360, hue), sat, light


def to_rgb(h: np.ndarray, s: np.ndarray, light: np.ndarray) -> np.ndarray:
    c = (1 - np.abs(light * 2 - 1)) * s
    hh = np.fmod(np.fmod(h, 360) + 360, 360) / 60
    x, m, zero = c * (1 - np.abs(np.fmod(hh, 2) - 1)), light - c / 2, np.zeros_like(c)
    place = np.minimum(hh.astype(np.int64), 5)
    parts = [np.choose(place, v) for v in ((c, x, zero, zero, x, c), (x, c, c, x, zero, zero), (zero, zero, x, c, c, x))]
    return _bytes(np.stack([(p + m) * 255 for p in parts], axis=-1))


def _bytes(v: np.ndarray) -> np.ndarray:
    """Cut to a byte, without rounding."""
    return np.floor(np.clip(v, 0, 255)).astype(np.uint8)


def blended(d: np.ndarray, s: np.ndarray, mode: str) -> np.ndarray:
    """Pixels s onto pixels d."""
    if mode == "normal":
        return over(d, s)
    ds, ss = d[..., :3] / 255, s[..., :3] / 255
    if mode in HSL_MODES:
        bottom, top = to_hsl(d), to_hsl(s)
        mixed = to_rgb(*[(top if of == "t" else bottom)[i] for i, of in enumerate(HSL_MODES[mode])]) / 255
    else:
        mixed = SEPARABLE[mode](ds, ss)
    sa, da = s[..., 3:] / 255, d[..., 3:] / 255
    alpha = sa + da * (1 - sa)
    near = lambda v: np.floor(np.clip(v, 0, 1) * 255 + 0.5)
    out = np.concatenate([near((mixed * sa + ds * da * (1 - sa)) / np.where(alpha <= 0, 1, alpha)), near(alpha)], axis=-1)
    return np.where(s[..., 3:] == 0, d, out).astype(np.uint8)


def adjusted(px: np.ndarray, knobs: dict[str, float]) -> np.ndarray:
    """A filter: hue, saturation and lightness, alpha, sharpening, then tone, of the pixels that can be seen."""
    out = px.copy()
    if knobs["hue"] or knobs["saturation"] or knobs["lightness"]:
        live = out[..., 3] > 0
        h, s, light = to_hsl(out)
        new = to_rgb(h + knobs["hue"], np.clip(s + knobs["saturation"], 0, 1), np.clip(light + knobs["lightness"], 0, 1))
        out[live, :3] = new[live]
    if knobs["alpha"]:
        live = out[..., 3] > 0
        shift = int(abs(knobs["alpha"]) * 255 + 0.5) * (1 if knobs["alpha"] > 0 else -1)
        out[live, 3] = np.clip(out[..., 3].astype(np.int64) + shift, 0, 255)[live]
    if knobs["sharpen"] > 0:
        live = out[..., 3] > 0
        wide = np.pad(np.where(live[..., None], out[..., :3], 0).astype(np.float64), ((1, 1), (1, 1), (0, 0)))
        seen = np.pad(live.astype(np.float64), 1)
        h, w = live.shape
        total = sum(wide[j : j + h, i : i + w] for j in range(3) for i in range(3))
        count = sum(seen[j : j + h, i : i + w] for j in range(3) for i in range(3))
        mean = total / np.maximum(count, 1)[..., None]
        color = out[..., :3].astype(np.float64)
        out[live, :3] = _bytes(color + (color - mean) * (min(1.0, knobs["sharpen"]) * 1.2))[live]
    b, c, t, tint = (max(-1.0, min(1.0, knobs[k])) for k in ("brightness", "contrast", "temperature", "tint"))
    if b or c or t or tint:
        live, v = out[..., 3] > 0, out[..., :3].astype(np.float64)
        v = v + b * 180 if b else v
        v = (v - 128) * (1 + c * 3 if c >= 0 else 1 / (1 + abs(c) * 3)) + 128 if c else v
        if t:
            v[..., 0] += t * 90
            v[..., 2] -= t * 90
        if tint:
            v[..., 1] += tint * 80
            v[..., 0] -= tint * 80 * 0.35
            v[..., 2] -= tint * 80 * 0.35
        out[live, :3] = _bytes(v)[live]
    return out


def _bilinear(px: np.ndarray, w: int, h: int) -> np.ndarray:
    def taps(old: int, new: int):
        c = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        lo = c.astype(np.int64)
        return lo, np.minimum(lo + 1, old - 1), c - lo

    (x0, x1, fx), (y0, y1, fy) = taps(px.shape[1], w), taps(px.shape[0], h)
    total = np.zeros((h, w, 4))
    for y, v in ((y0, 1 - fy), (y1, fy)):
        for x, u in ((x0, 1 - fx), (x1, fx)):
            total += px[np.ix_(y, x)] * (v[:, None] * u[None, :])[..., None]
    return _bytes(np.round(total, 6))


def _local(row: dict, glyphs: dict[str, list[int]], draw) -> np.ndarray | None:
    """What a layer draws, before it is transformed."""
    if row["kind"] == "raster":
        w, h = row["w"] or 0, row["h"] or 0
        return np.frombuffer(row["rgba"], np.uint8).reshape(h, w, 4) if row["rgba"] is not None and len(row["rgba"]) == w * h * 4 else None
    if row["kind"] == "shape":
        return shape_pixels(row["shape"], max(1, row["w"]), max(1, row["h"]))
    if row["kind"] == "text":
        return text_pixels(row["text"], glyphs)
    try:
        w, h = scaled(row["w"], row["scale_x"]), scaled(row["h"], row["scale_y"])
        raw = draw(row["svg"], w, h) if draw else None
    except Exception:  # what can't be drawn is clear
        raw = None
    return np.frombuffer(raw, np.uint8).reshape(h, w, 4) if raw is not None and len(raw) == w * h * 4 else None


def shape_pixels(shape: dict, w: int, h: int) -> np.ndarray:
    """A shape's fill and stroke by the centres of its pixels; the stroke hides the fill."""
    x, y = np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)
    n = max(1, shape["stroke_width"] or 1) if shape["stroke"] else 0

    def rounded(x, y, w, h, r):
        if w <= 0 or h <= 0:
            return np.zeros(x.shape, bool)
        if r <= 0:
            return (x >= 0) & (x <= w) & (y >= 0) & (y <= h)
        return (x - np.minimum(np.maximum(x, r), w - r)) ** 2 + (y - np.minimum(np.maximum(y, r), h - r)) ** 2 <= r * r

    def oval(x, y, w, h):
        return (((x - w / 2) / (w / 2)) ** 2 + ((y - h / 2) / (h / 2)) ** 2 <= 1) if w > 0 and h > 0 else np.zeros(x.shape, bool)

    def far(ax, ay, bx, by):
        vx, vy = bx - ax, by - ay
        long = vx * vx + vy * vy
        t = np.clip(((x - ax) * vx + (y - ay) * vy) / long, 0, 1) if long > 0 else 0.0
        return (x - ax - vx * t) ** 2 + (y - ay - vy * t) ** 2

    if shape["type"] == "ellipse":
        inside = oval(x, y, w, h)
        edge = ~oval(x - n, y - n, w - 2 * n, h - 2 * n) if n else np.zeros_like(inside)
    elif shape["type"] == "line":
        inside, n = far(0.5, 0.5, max(w - 0.5, 0.5), max(h - 0.5, 0.5)) <= (max(n, 1) / 2) ** 2, max(n, 1)
        edge = inside
    elif shape["type"] == "polygon":
        corners = [(float(p["x"]), float(p["y"])) for p in shape["points"] or []]
        inside, edge = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
        for (ax, ay), (bx, by) in zip(corners[-1:] + corners[:-1], corners, strict=True) if len(corners) > 2 else ():
            spans = (ay > y) != (by > y)
            inside ^= spans & (x < (bx - ax) * (y - ay) / (by - ay if by != ay else 1.0) + ax)
            edge |= far(ax, ay, bx, by) <= (n / 2) ** 2 if n else False
        inside = inside | edge
    else:
        r = min(shape["radius"] or 0, w // 2, h // 2)
        inside = rounded(x, y, w, h, r)
        if r:
            edge = ~rounded(x - n, y - n, w - 2 * n, h - 2 * n, max(r - n, 0)) if n else np.zeros_like(inside)
        else:
            edge = (x <= n) | (x >= w - n) | (y <= n) | (y >= h - n) if n else np.zeros_like(inside)
    out = np.zeros((h, w, 4), np.uint8)
    if shape["fill"]:
        out[inside & ~edge] = shape["fill"]
    if shape["stroke"]:
        out[inside & edge] = shape["stroke"]
    return out


def text_pixels(text: dict, glyphs: dict[str, list[int]]) -> np.ndarray:
    """Lines of glyphs of 8 by 8 bits, wrapped by words where asked for; a character that isn't there looks like ``?``."""
    scale = -(-max(text["size"], 1) // 8)
    side, gap = scale * 8, text["letter_spacing"] or 0
    most = 0
    if text["box_width"] and text["wrap"]:
        most = 1 if text["box_width"] <= side else max(1, (text["box_width"] + gap) // (side + gap))
    lines: list[str] = []
    for line in (text["text"] or "").split("\n"):
        if not most:
            lines.append(line)
            continue
        now, first = "", len(lines)
        for word in line.split():
            if now and len(now) + 1 + len(word) <= most:
                now += " " + word
                continue
            lines += [now] if now else []
            pieces = [word[i : i + most] for i in range(0, len(word), most)]
            lines, now = (lines + pieces, "") if len(word) > most else (lines, word)
        lines += [now] if now or len(lines) == first else []
    long = [len(x) * side + max(len(x) - 1, 0) * gap for x in lines]
    w, step = max(1, text["box_width"] or max(long)), max(text["line_height"] or 0, side)
    out = np.zeros((side + step * (len(lines) - 1), w, 4), np.uint8)
    for n, (line, size) in enumerate(zip(lines, long, strict=True)):
        x = {"center": max(0, w - size) // 2, "right": max(0, w - size)}.get(text["align"], 0)
        for ch in line:
            bits = np.array(glyphs.get(ch, glyphs.get("?", [0] * 8)), np.uint8)
            block = np.unpackbits(bits[:, None], axis=1, bitorder="little").repeat(scale, axis=0).repeat(scale, axis=1).astype(bool)
            area = out[n * step : n * step + side, x : x + side]
            area[block[: area.shape[0], : area.shape[1]]] = text["color"]
            x += side + gap
    return out


def _placed(px: np.ndarray, row: dict, w: int, h: int) -> np.ndarray:
    """A layer's pixels, transformed, on a clear canvas."""
    if row["flip_x"]:
        px = px[:, ::-1]
    if row["flip_y"]:
        px = px[::-1]
    if row["kind"] != "svg" and px.size:
        size = scaled(px.shape[1], row["scale_x"]), scaled(px.shape[0], row["scale_y"])
        px = _bilinear(px, *size) if size != px.shape[1::-1] else px
    if abs(row["rotation"]) > 2.0**-52 and px.size:
        px = turned(px, row["rotation"], turned_size(px.shape[1], px.shape[0], row["rotation"]))
    x, y = row["x"], row["y"]
    if row["anchor"] == "center":
        x, y = (int(math.copysign(math.floor(abs(v) + 0.5), v)) for v in (x - px.shape[1] / 2, y - px.shape[0] / 2))
    out = np.zeros((h, w, 4), np.uint8)
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + px.shape[1], w), min(y + px.shape[0], h)
    if x0 < x1 and y0 < y1:
        out[y0:y1, x0:x1] = px[y0 - y : y1 - y, x0 - x : x1 - x]
    return out


def _gradient(row: dict, w: int, h: int) -> np.ndarray:
    stops = [(s["position"], [s[c] for c in "rgba"]) for s in row["fill"]]
    x, y = np.meshgrid(np.arange(w) / max(w - 1, 1), np.arange(h) / max(h - 1, 1))
    t = {"vertical": y, "diagonal_down": (x + y) / 2, "diagonal_up": (x + (1 - y)) / 2}.get(row["direction"], x)
    out, done = np.zeros((h, w, 4), np.uint8), np.zeros((h, w), bool)
    for p, a, q, b, last in [*((*s, *e, False) for s, e in zip(stops, stops[1:], strict=False)), (*stops[0], *stops[-1], True)]:
        here = ~done & ((t >= p) & (t <= q) | last)
        f = ((t - p) / (q - p) if q > p else np.zeros_like(t))[here][:, None]
        out[here] = np.floor(np.array(a, float) * (1 - f) + np.array(b, float) * f + 0.5).astype(np.int64).astype(np.uint8)
        done |= here
    return out


def _scaled(alpha: np.ndarray, level) -> np.ndarray:
    return ((alpha.astype(np.int64) * level + 127) // 255).astype(np.uint8)


def folded(rows: list[dict], below: dict, w: int, h: int, group: bool, glyphs: dict, draw) -> np.ndarray:
    """Siblings, bottom first, on a clear canvas; ``below`` has the children of each id. A group's filters see all of its layers."""
    canvas, under = np.zeros((h, w, 4), np.uint8), np.zeros((h, w), np.uint8)
    late = []
    for row in rows:
        if not row["visible"]:
            continue
        if row["kind"] == "filter":
            knobs = {k: (row["filter"] or {}).get(k) or 0.0 for k in KNOBS}
            if group:
                late.append(knobs)
            else:
                canvas = adjusted(canvas, knobs)
                under = canvas[..., 3]
            continue
        if row["kind"] == "group":
            px = folded(below.get(row["layer_id"], []), below, w, h, True, glyphs, draw)
        elif row["kind"] == "solid":
            px = np.full((h, w, 4), [row["fill"][0][c] for c in "rgba"], np.uint8)
        elif row["kind"] == "gradient":
            px = _gradient(row, w, h)
        else:
            local = _local(row, glyphs, draw)
            px = np.zeros((h, w, 4), np.uint8) if local is None else _placed(local, row, w, h)
        px = px.copy()
        if row["opacity"] < 1:
            px[..., 3] = _scaled(px[..., 3], int(max(0.0, row["opacity"]) * 255 + 0.5))
        if row["mask"] is not None:
            red = np.frombuffer(row["mask"], np.uint8).reshape(row["mask_h"], row["mask_w"], 4)[:h, :w, 0].astype(np.int64)
            area = px[: red.shape[0], : red.shape[1], 3]
            area[:] = _scaled(area, 255 - red if row["mask_inverted"] else red)
        if row["clip_to_below"]:
            px[..., 3] = _scaled(px[..., 3], under.astype(np.int64))
        canvas, under = blended(canvas, px, row["blend_mode"]), px[..., 3]
    for knobs in late:
        canvas = adjusted(canvas, knobs)
    return canvas


def render(documents: DataFrame, layers: DataFrame, glyphs: dict[str, list[int]] | None = None, draw: Callable[[str, int, int], bytes] | None = None) -> DataFrame:
    """(doc_id, width, height, data): RGBA of every document (doc_id, width, height) from its layers.

    ``glyphs`` is a typeface (character to eight rows of bits) for text layers, ``draw(markup, w, h)`` renders SVG;
    without them such layers are clear or made of ``?``.
    """
    glyphs = glyphs or {}

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        doc, w, h = (rows[0][c] for c in ("doc_id", "width", "height"))
        if w * h * 4 > MAX_BYTES:
            raise ValueError(f"a canvas of {w} by {h} is too large")
        below: dict[int | None, list[dict]] = {}
        for row in sorted((r for r in rows if r["layer_id"] is not None), key=lambda r: (r["idx"], r["layer_id"])):
            below.setdefault(row["parent_id"], []).append(row)
        px = folded(below.get(None, []), below, w, h, False, glyphs, draw)
        return pa.table({"doc_id": pa.array([doc], pa.int64()), "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32()), "data": pa.array([px.tobytes()], pa.binary())})

    met = documents.select("doc_id", "width", "height").join(layers, "doc_id", "left")
    return met.groupBy("doc_id").applyInArrow(run, SCHEMA)


def extents(layers: DataFrame) -> DataFrame:
    """(doc_id, layer_id, w, h) of the layers that have an extent, once scaled and turned."""
    from strata.operators.layers import extent

    w, h = extent(*[F.col(c) for c in ("w", "h", "scale_x", "scale_y", "rotation")])
    return layers.where(F.col("kind").isin(*TRANSFORMED)).select("doc_id", "layer_id", w.alias("w"), h.alias("h"))
