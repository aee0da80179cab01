"""Decoded images as layers of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.layers import _DEFAULTS

GIVEN = {"x": 0, "y": 0, "opacity": 1.0, "visible": True}


def imported(layers: DataFrame, documents: DataFrame, images: DataFrame) -> DataFrame:
    """The layers and a raster on top of its document for each image (doc_id, seq, name, width, height, data[, x, y, opacity, visible]).

    Images are stacked in the order of ``seq`` and numbered from one above the document's largest id (or from its
    ``next_id``, if that is more). Images without data (files that couldn't be decoded) are left out.
    """
    about = layers.groupBy("doc_id").agg(F.max("layer_id").alias("_last"), F.count(F.when(F.col("parent_id").isNull(), 1)).alias("_n"))
    start = F.col("next_id") if "next_id" in documents.columns else F.lit(1)
    place = documents.join(about, "doc_id", "left").select("doc_id", F.greatest(start.cast("long"), F.coalesce(F.col("_last") + 1, F.lit(1).cast("long"))).alias("_id"), F.coalesce("_n", F.lit(0)).alias("_n"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    met = images.where("data is not null").withColumn("_k", nth).join(place, "doc_id")
    value = {c: F.lit(v) for c, v in _DEFAULTS.items()} | {c: F.col(c) for c in GIVEN if c in images.columns}
    value |= {"doc_id": F.col("doc_id"), "layer_id": F.col("_id") + F.col("_k"), "idx": F.col("_n") + F.col("_k"), "kind": F.lit("raster"), "name": F.col("name"), "w": F.col("width"), "h": F.col("height"), "rgba": F.col("data")}
    return layers.unionByName(met.select(*[value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in layers.schema.fields]))


def gif_frames(frames: DataFrame) -> DataFrame:
    """Frames (image_id, frame, …) of sources.gif as images for ``imported``: frame_0 and so on, without delays."""
    return frames.select(F.col("image_id").alias("doc_id"), F.col("frame").alias("seq"), F.concat(F.lit("frame_"), F.col("frame").cast("string")).alias("name"), "width", "height", "data")


def psd_layers(rows: DataFrame) -> DataFrame:
    """Layers of sources.psd as images for ``imported``, with their places, opacity and visibility."""
    return rows.select(F.col("image_id").alias("doc_id"), F.col("layer").alias("seq"), "name", "x", "y", "width", "height", "opacity", "visible", "data")
