"""Colour arithmetic as Column expressions. Channels are ints 0-255; byte conversions truncate unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x: float) -> Column:
    return F.lit(float(x))


def byte(x: Column) -> Column:
    """Truncating, saturating conversion to a channel."""
    return F.floor(F.least(lit(255), F.greatest(lit(0), x))).cast("int")


def unit(c: Column) -> Column:
    return c.cast("double") / 255.0


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * lit(0.299) + g * lit(0.587) + b * lit(0.114)


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and lightness in 0..1; ties of the largest channel go to red, then green."""
    r, g, b = unit(r), unit(g), unit(b)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    light = (top + low) / 2.0
    safe = F.when(d == 0, lit(1)).otherwise(d)
    sat = F.when(d == 0, lit(0)).otherwise(d / F.when(d == 0, lit(1)).otherwise(lit(1) - F.abs(light * 2.0 - 1.0)))
    sixth = F.when(d == 0, lit(0)).when(top == r, ((g - b) / safe) % 6.0).when(top == g, (b - r) / safe + 2.0).otherwise((r - g) / safe + 4.0)
    hue = sixth * 60.0
    return F.when(hue < 0, hue + 360.0).otherwise(hue), sat, light


def hsl_to_rgb(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    c = (lit(1) - F.abs(light * 2.0 - 1.0)) * s
    hh = ((h % 360.0 + 360.0) % 360.0) / 60.0
    x = c * (lit(1) - F.abs(hh % 2.0 - 1.0))
    zero, m = lit(0), light - c / 2.0
    sextants = {"r": (c, x, zero, zero, x, c), "g": (x, c, c, x, zero, zero), "b": (zero, zero, x, c, c, x)}
    pick = lambda v: F.when(hh < 1, v[0]).when(hh < 2, v[1]).when(hh < 3, v[2]).when(hh < 4, v[3]).when(hh < 5, v[4]).otherwise(v[5])
    return tuple(byte((pick(v) + m) * 255.0) for v in sextants.values())


def parse_hex(text: Column) -> Column:
    """struct(r, g, b), or null: leading ``#`` are dropped, three digits are doubled."""
    digits = F.lower(F.regexp_replace(F.trim(text), "^#+", ""))
    six = F.when(digits.rlike("^[0-9a-f]{6}$"), digits).when(digits.rlike("^[0-9a-f]{3}$"), F.regexp_replace(digits, "(.)", "$1$1"))
    channel = lambda i: F.conv(F.substring(six, i, 2), 16, 10).cast("int")
    return F.when(six.isNotNull(), F.struct(channel(1).alias("r"), channel(3).alias("g"), channel(5).alias("b")))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def linear(c: Column) -> Column:
    v = unit(c)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, lit(2.4)))


def relative_luminance(r: Column, g: Column, b: Column) -> Column:
    return linear(r) * 0.2126 + linear(g) * 0.7152 + linear(b) * 0.0722


def contrast_ratio(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def readable_text(lum: Column) -> Column:
    return F.when(lum > 0.179, "#000000").when(lum.isNotNull(), "#ffffff").otherwise("#000000")
