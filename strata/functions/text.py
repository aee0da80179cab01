"""Text layers on a fixed grid of glyphs, font families, and checks of markup, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a glyph before it is scaled.
GLYPH = 8
#: Characters of a typeface, which is a literal of the plan.
MOST_GLYPHS = 1024


def glyph_side(size: Column) -> Column:
    """Side of a glyph at a font size: a whole multiple of eight."""
    return F.ceil(F.greatest(size, F.lit(1)) / GLYPH).cast("int") * GLYPH


def wrapped(text: Column, width: int | None, size: int, spacing: int = 0) -> Column:
    """Lines of a text, as an array; with a box ``width`` words are wrapped greedily and longer words are cut."""
    lines = F.split(text, "\n", -1)
    if width is None:
        return lines
    side = -(-max(size, 1) // GLYPH) * GLYPH
    most = 1 if max(width, 1) <= side else max(1, (max(width, 1) + spacing) // (side + spacing))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def put(s: Column, word: Column) -> Column:
        fits = (s["now"] != "") & (F.length(s["now"]) + 1 + F.length(word) <= most)
        # a word that doesn't fit closes the line; pieces of a long word are lines of their own
        closed = F.when((s["now"] != "") & ~fits, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(word), F.lit(1)) - 1) / most).cast("int")), lambda i: F.substring(word, i * most + 1, F.lit(most)))
        long = F.length(word) > most
        done = F.when(fits, s["done"]).when(long, F.concat(closed, pieces)).otherwise(closed)
        now = F.when(fits, F.concat(s["now"], F.lit(" "), word)).when(long, F.lit("")).otherwise(word)
        return F.struct(done.alias("done"), now.alias("now"))

    def one(line: Column) -> Column:
        words = F.filter(F.split(line, r"\s+", -1), lambda w: w != "")
        s = F.aggregate(words, start, put)
        out = F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        return F.when(F.size(out) == 0, F.array(F.lit(""))).otherwise(out)

    return F.flatten(F.transform(lines, one))


def measured(lines: Column, width: int | None, size: int, spacing: int = 0, line_height: int = 0) -> tuple[Column, Column]:
    """Width and height of lines; a box ``width`` is the width, and lines are at least a glyph apart."""
    side = -(-max(size, 1) // GLYPH) * GLYPH
    longest = F.array_max(F.transform(lines, F.length))
    wide = F.lit(max(width, 1)) if width is not None else F.greatest(F.lit(1), longest * side + F.greatest(longest - 1, F.lit(0)) * spacing)
    return wide.cast("int"), (F.greatest(F.size(lines), F.lit(1)) - 1).cast("int") * max(line_height, side) + side


def raster(texts: DataFrame, key: str, glyphs: DataFrame, size: int, line_height: int, spacing: int, color: tuple[int, int, int, int], align: str = "left", width: int | None = None) -> DataFrame:
    """(key, x, y, r, g, b, a): the pixels that texts (key, lines) cover in a typeface of 8 by 8 bits.

    ``glyphs`` (glyph, bits: eight rows, the lowest bit on the left) is the typeface, at most MOST_GLYPHS characters; a
    character that isn't in it looks like ``?``. ``align`` is left, center or right in the box ``width`` or in the
    longest line. Places that nothing covers have no row.
    """
    scale, side = -(-max(size, 1) // GLYPH), -(-max(size, 1) // GLYPH) * GLYPH
    table = {r["glyph"]: list(r["bits"]) for r in glyphs.limit(MOST_GLYPHS + 1).collect()}
    if len(table) > MOST_GLYPHS:
        raise ValueError(f"a typeface has at most {MOST_GLYPHS} characters")
    bits = F.create_map(*[x for g, b in sorted(table.items()) for x in (F.lit(g), F.array(*[F.lit(v) for v in b]))])
    other = F.array(*[F.lit(v) for v in table.get("?", [0] * GLYPH)])
    long = lambda n: n * side + F.greatest(n - 1, F.lit(0)) * spacing
    box = F.greatest(F.lit(1), long(F.array_max(F.transform("lines", F.length)))) if width is None else F.lit(max(1, width))
    line = texts.select(key, box.alias("_w"), F.posexplode("lines").alias("_n", "_line"))
    room = F.greatest(F.lit(0), F.col("_w") - long(F.length("_line")))
    start = {"left": F.lit(0), "center": F.floor(room / 2), "right": room}[align].cast("int")
    char = line.select(key, "_w", "_n", start.alias("_x"), F.posexplode(F.split("_line", "")).alias("_k", "_c")).where("_c <> ''")
    row = char.select(key, "_w", "_n", "_x", "_k", F.posexplode(F.coalesce(F.try_element_at(bits, F.col("_c")), other)).alias("_i", "_b"))
    spot = row.select("*", F.explode(F.sequence(F.lit(0), F.lit(GLYPH - 1))).alias("_j")).where(F.expr("shiftright(_b, _j) & 1 = 1"))
    steps = F.sequence(F.lit(0), F.lit(scale - 1))
    spot = spot.withColumn("_sx", F.explode(steps)).withColumn("_sy", F.explode(steps))
    x = F.col("_x") + F.col("_k") * (side + spacing) + F.col("_j") * scale + F.col("_sx")
    y = F.col("_n") * max(line_height, side) + F.col("_i") * scale + F.col("_sy")
    return spot.select(key, x.cast("int").alias("x"), y.cast("int").alias("y"), "_w", *[F.lit(v).alias(c) for c, v in zip("rgba", color, strict=True)]).where("x < _w").drop("_w")


def family_key(name: Column) -> Column:
    """Letters and digits of a family's name, in lower case: what names are compared by at last."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def svg_fault(markup: Column) -> Column:
    """Why an SVG isn't taken, or null: scripts, animation, images from elsewhere, no markup. By patterns, not a parser."""
    bare = F.regexp_replace(markup, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    tag = lambda names: rf"<(?:[\w.-]+:)?(?:{names})(?=[\s/>])"
    href = rf"(?s){tag('image')}[^>]*?\s(?:xlink:)?href\s*=\s*(?:\"\s*(?!data:)[^\"\s]|'\s*(?!data:)[^'\s])"
    return (
        F.when(bare.isNull() | ~bare.rlike(r"(?s)^\s*(?:<\?.*?\?>\s*)?(?:<!DOCTYPE[^>]*>\s*)?<[A-Za-z_].*>\s*$"), "not well formed")
        .when(bare.rlike(tag("script")), "holds scripts")
        .when(bare.rlike(tag(r"set|animate\w*")), "holds animations")
        .when(bare.rlike(href), "refers to images elsewhere")
    )


def font_faces(css: Column) -> Column:
    """Array of structs (family, weight, style, url) of the @font-face rules of a style sheet."""
    rules = F.regexp_extract_all(css, F.lit(r"(?s)@font-face\s*\{(.*?)\}"), F.lit(1))
    value = lambda rule, name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(rule, rf"(?s){name}\s*:\s*([^;]+)", 1), "[\"']", "")), F.lit(""))
    url = lambda rule: F.nullif(F.regexp_extract(rule, r"url\(\s*[\"']?([^\"')]+)", 1), F.lit(""))
    return F.transform(rules, lambda r: F.struct(value(r, "font-family").alias("family"), F.coalesce(value(r, "font-weight"), F.lit("400")).alias("weight"), F.coalesce(value(r, "font-style"), F.lit("normal")).alias("style"), url(r).alias("url")))
