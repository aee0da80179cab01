"""Image and layer relations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels of a vector's image: 16 pixels of four components, 4 by 4.
SIDE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, r, g, b, a): an embedding of 64 floats as a 4 by 4 image."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    part = lambda i: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((F.element_at("embedding", (F.col("p") * 4 + i).cast("int")).cast("double") + 0.15) / 0.3 * 256.0)))).cast("int")
    return v.select(F.col("vec_id").alias("image_id"), (F.col("p") % SIDE).cast("int").alias("x"), F.floor(F.col("p") / SIDE).cast("int").alias("y"), *[part(i + 1).alias(c) for i, c in enumerate("rgba")])


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, r, g, b, a): a large bag of pixels from order lines."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_orderkey") % 256).cast("int").alias("g"), (F.col("l_quantity") * 5).cast("int").alias("b"), F.least(F.lit(255), F.col("l_linenumber") * 40).cast("int").alias("a"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent, key, kind): regions, nations and suppliers as groups and layers; key orders siblings."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        r.select(text("g", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("key"), F.lit("group").alias("kind"))
        .union(n.select(text("n", "n_nationkey"), text("g", "n_regionkey"), F.col("n_nationkey").cast("long"), F.lit("group")))
        .union(s.select(text("s", "s_suppkey"), text("n", "s_nationkey"), F.col("s_suppkey").cast("long"), F.when(F.col("s_suppkey") % 5 == 0, "filter").otherwise("raster")))
    )


#: Kinds of the layers that suppliers stand for.
KINDS = ["raster", "filter", "solid", "gradient", "shape", "text", "svg", "group"]


def canvases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, width, height): regions as documents."""
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").cast("long").alias("doc_id"), (F.col("r_regionkey") * 10 + 100).cast("int").alias("width"), F.lit(80).alias("height"))


def layer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer table (operators.layers) of regions as documents: nations are groups, their suppliers layers of all kinds."""
    from pyspark.sql import Window

    from strata.operators.layers import DDL, KNOBS, TRANSFORMED

    n, s = (table(spark, sf_dir, t) for t in ("nation", "supplier"))
    place = lambda by, key: (F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1).cast("int")
    k = F.col("s_suppkey")
    groups = n.select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") + 1).alias("layer_id"), F.lit(None).alias("parent_id"), place("n_regionkey", "n_nationkey").alias("idx"), F.lit("group").alias("kind"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("name"), F.lit(None).cast("long").alias("s_suppkey"))
    below = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc_id"), (k + 100).alias("layer_id"), (F.col("n_nationkey") + 1).alias("parent_id"), place("s_nationkey", "s_suppkey").alias("idx"), F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 8 + 1).cast("int")).alias("kind"), F.concat(F.lit("layer "), k.cast("string")).alias("name"), k.cast("long").alias("s_suppkey"))
    base = groups.unionAll(below).withColumn("k", F.coalesce("s_suppkey", F.lit(5)))
    k, has = F.col("k"), F.col("kind").isin(*TRANSFORMED)
    of = lambda kind, v: F.when(F.col("kind") == kind, v)
    color = F.struct(F.lit(0.0).alias("position"), (k % 256).alias("r"), F.lit(160).alias("g"), F.lit(176).alias("b"), F.lit(255).alias("a"))
    end = F.struct(F.lit(1.0).alias("position"), F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), F.lit(128).alias("a"))
    values = {
        "visible": k % 6 != 0, "opacity": k % 10 / 10.0, "x": k * 7 % 100 - 50, "y": k * 11 % 90, "w": F.when(has, k % 24 + 3), "h": F.when(has, k % 17 + 2),
        "anchor": F.when(has & (k % 2 == 0), "center").otherwise("top-left"), "flip_x": F.lit(False), "flip_y": F.lit(False), "rotation": F.when(has, k % 4 * 90.0).otherwise(F.lit(0.0)),
        "scale_x": F.when(has, k % 3 / 2.0 + 1.0).otherwise(F.lit(1.0)), "scale_y": F.lit(1.0), "blend_mode": F.lit("normal"), "clip_to_below": F.lit(False),
        "mask": F.when(k % 5 == 0, F.unhex(F.lit("80FF00FF"))), "mask_w": F.when(k % 5 == 0, 1), "mask_h": F.when(k % 5 == 0, 1), "mask_inverted": F.lit(False), "alpha_locked": F.lit(False),
        "rgba": of("raster", F.unhex(F.repeat(F.concat(F.lpad(F.hex(k % 256), 2, "0"), F.lit("A0B0FF")), ((k % 24 + 3) * (k % 17 + 2)).cast("int")))),
        "fill": F.when(F.col("kind") == "solid", F.array(color)).when(F.col("kind") == "gradient", F.array(color, end)), "direction": of("gradient", F.lit("vertical")),
        "filter": of("filter", F.struct(*[(k % 7 / 10.0 if c == "brightness" else F.lit(0.0)).alias(c) for c in KNOBS])),
        "shape": of("shape", F.struct(F.lit("rectangle").alias("type"), F.lit(2).alias("radius"), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(255)).alias("fill"), F.lit(None).cast("array<int>").alias("stroke"), F.lit(None).cast("int").alias("stroke_width"), F.array().cast("array<struct<x:int,y:int>>").alias("points"))),
        "text": of("text", F.struct(F.concat(F.lit("text "), k.cast("string")).alias("text"), F.array(F.lit(0), F.lit(0), F.lit(0), F.lit(255)).alias("color"), F.lit("sans-serif").alias("family"), F.lit(400).alias("weight"), F.lit("normal").alias("style"), F.lit(16).alias("size"), F.lit(16).alias("line_height"), F.lit(0).alias("letter_spacing"), F.lit("left").alias("align"), F.lit(False).alias("wrap"), F.lit(None).cast("int").alias("box_width"))),
        "svg": of("svg", F.lit("<svg/>")),
    }
    schema = spark.createDataFrame([], DDL).schema
    return base.select(*[values.get(f.name, F.col(f.name) if f.name in base.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
