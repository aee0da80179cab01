"""The sixteen blend modes. d is the backdrop and s the source, both 0..1; alpha compositing is in ``composite``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.color import lit, unit

#: Names by code, in the order of their codes.
MODES = ["normal", "multiply", "screen", "overlay", "darken", "lighten", "color-dodge", "color-burn", "hard-light", "soft-light", "difference", "exclusion", "hue", "saturation", "color", "luminosity"]


def _overlay(key: Column, d: Column, s: Column) -> Column:
    return F.when(key <= 0.5, d * 2.0 * s).otherwise(lit(1) - (lit(1) - d) * 2.0 * (lit(1) - s))


def _soft(d: Column, s: Column) -> Column:
    bright = F.when(d <= 0.25, ((d * 16.0 - 12.0) * d + 4.0) * d).otherwise(F.sqrt(d))
    return F.when(s <= 0.5, d - (lit(1) - s * 2.0) * d * (lit(1) - d)).otherwise(d + (s * 2.0 - 1.0) * (bright - d))


SEPARABLE = {
    "multiply": lambda d, s: d * s,
    "screen": lambda d, s: d + s - d * s,
    "overlay": lambda d, s: _overlay(d, d, s),
    "darken": F.least,
    "lighten": F.greatest,
    "color-dodge": lambda d, s: F.when(d <= 0, lit(0)).when(s >= 1, lit(1)).otherwise(F.least(lit(1), d / F.when(s >= 1, lit(1)).otherwise(lit(1) - s))),
    "color-burn": lambda d, s: F.when(d >= 1, lit(1)).when(s <= 0, lit(0)).otherwise(lit(1) - F.least(lit(1), (lit(1) - d) / F.when(s <= 0, lit(1)).otherwise(s))),
    "hard-light": lambda d, s: _overlay(s, d, s),
    "soft-light": _soft,
    "difference": lambda d, s: F.abs(d - s),
    "exclusion": lambda d, s: d + s - d * 2.0 * s,
}


def mode_code(name: Column) -> Column:
    """Code of a mode's name; case, ``-``, ``_`` and spaces don't matter, and an unknown name is normal."""
    plain = F.regexp_replace(F.lower(name), "[-_ ]", "")
    codes = F.create_map(*[F.lit(x) for i, m in enumerate(MODES) for x in (m.replace("-", ""), i)])
    return F.coalesce(F.try_element_at(codes, plain), F.lit(0))


def over(d: dict[str, Column], s: dict[str, Column]) -> dict[str, Column]:
    """Source-over in integers; a channel that rounding lifts to 256 wraps to 0, as bytes do."""
    inv = F.lit(255) - s["a"]
    back = F.floor((d["a"] * inv + 127) / 255).cast("int")
    alpha = s["a"] + back
    safe = F.greatest(alpha, F.lit(1))
    channel = lambda c: F.floor((s[c] * s["a"] + F.floor((d[c] * d["a"] * inv + 127) / 255) + F.floor(alpha / 2)) / safe).cast("int").bitwiseAND(F.lit(255))
    whole = (s["a"] == 255) | (d["a"] == 0)
    pick = lambda c, mixed: F.when(s["a"] == 0, d[c]).when(whole, s[c]).otherwise(mixed)
    return {c: pick(c, channel(c)) for c in "rgb"} | {"a": pick("a", alpha)}


#: Which pixel gives hue, saturation and lightness: t(op) or b(ottom).
HSL_MODES = {"hue": "tbb", "saturation": "btb", "color": "ttb", "luminosity": "bbt"}


def composite(d: dict[str, Column], s: dict[str, Column], mode: str, mixed: dict[str, Column] | None = None) -> dict[str, Column]:
    """Blend pixel s onto pixel d; the HSL modes are given the mixed colour (0..1), which takes projections of its own."""
    if mode == "normal":
        return over(d, s)
    sa, da = unit(s["a"]), unit(d["a"])
    alpha = sa + da * (lit(1) - sa)
    if mixed is None:
        mixed = {c: SEPARABLE[mode](unit(d[c]), unit(s[c])) for c in "rgb"}
    near = lambda v: F.floor(F.least(lit(1), F.greatest(lit(0), v)) * 255.0 + 0.5).cast("int")
    safe = F.when(alpha <= 0, lit(1)).otherwise(alpha)
    out = {c: near((mixed[c] * sa + unit(d[c]) * da * (lit(1) - sa)) / safe) for c in "rgb"} | {"a": near(alpha)}
    return {c: F.when(s["a"] == 0, d[c]).otherwise(v) for c, v in out.items()}
