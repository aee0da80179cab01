"""Document files: one binary value a document, written and read by expressions, and checked before anything is used.

A file is 4 bytes big-endian of the metadata's length, the metadata (MAGIC, a version byte, JSON of the canvas and its
layers), then all pixels one after another. Layers name their pixels and masks by offset and length. A file that can't
be used has an error, the first of: too short, metadata cut off, no document, version n is not supported, metadata not
readable, pixels out of range. Tables of many documents are best kept as they are, in Parquet (``write``, ``read``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.layers import DDL

MAGIC, VERSION = b"STRATA", 1
_PLAIN = [c.strip() for c in DDL.replace("mask binary, ", "").replace("rgba binary, ", "").split(", ") if c.strip() and not c.startswith("doc_id")]
_HEAD = len(MAGIC) + 1


def _metadata() -> str:
    blobs = "rgba_at:bigint,rgba_n:bigint,mask_at:bigint,mask_n:bigint"
    fields = ",".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in _PLAIN)
    return f"struct<width:int,height:int,layers:array<struct<{fields},{blobs}>>>"


def saved(documents: DataFrame, layers: DataFrame) -> DataFrame:
    """(doc_id, content) of documents (doc_id, width, height) and their layers."""
    names = [c.split(" ", 1)[0] for c in _PLAIN]
    row = F.struct("layer_id", *[c for c in names if c != "layer_id"], "rgba", "mask")
    own = layers.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    met = documents.select("doc_id", "width", "height").join(own, "doc_id", "left")
    met = met.withColumn("rows", F.coalesce("rows", F.array().cast(own.schema["rows"].dataType)))
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    # where each layer's pixels begin: sums of what is before it
    start = F.aggregate("rows", F.array(F.lit(0).cast("long")), lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + size(r["rgba"]) + size(r["mask"]))))
    met = met.withColumn("starts", start)
    at = lambda i: F.element_at("starts", i + 1)
    blobs = lambda r, i: {"rgba_at": F.when(r["rgba"].isNotNull(), at(i)), "rgba_n": F.length(r["rgba"]).cast("long"), "mask_at": F.when(r["mask"].isNotNull(), at(i) + size(r["rgba"])), "mask_n": F.length(r["mask"]).cast("long")}
    slim = F.transform("rows", lambda r, i: F.struct(*[r[c].alias(c) for c in names], *[v.alias(k) for k, v in blobs(r, i).items()]))
    meta = F.concat(F.lit(MAGIC + bytes([VERSION])), F.encode(F.to_json(F.struct("width", "height", slim.alias("layers"))), "UTF-8"))
    pixels = F.unhex(F.array_join(F.transform("rows", lambda r: F.concat(F.coalesce(F.hex(r["rgba"]), F.lit("")), F.coalesce(F.hex(r["mask"]), F.lit("")))), ""))
    return met.select("doc_id", meta.alias("m"), pixels.alias("p")).select("doc_id", F.concat(F.unhex(F.lpad(F.hex(F.length("m")), 8, "0")), "m", "p").alias("content"))


def _head(content: Column) -> tuple[Column, Column, Column]:
    """Length of the metadata (null where there are no four bytes), the metadata, and its fault or null."""
    n = F.when(F.length(content) >= 4, F.conv(F.hex(F.substring(content, 1, 4)), 16, 10).cast("long"))
    meta = F.substr(content, F.lit(5), F.least(n, F.lit((1 << 31) - 1)).cast("int"))
    version = F.conv(F.hex(F.substring(meta, len(MAGIC) + 1, 1)), 16, 10)
    fault = (
        F.when(n.isNull(), "too short")
        .when(F.length(content) - 4 < n, "metadata cut off")
        .when((F.length(meta) < _HEAD) | (F.substring(meta, 1, len(MAGIC)) != F.lit(MAGIC)), "no document")
        .when(version != str(VERSION), F.concat(F.lit("version "), version, F.lit(" is not supported")))
    )
    return n, meta, fault


def opened(files: DataFrame) -> DataFrame:
    """(doc_id, width, height, layers, error): the canvas and its layers with pixels and masks, or an error and nulls."""
    n, meta, fault = _head(F.col("content"))
    met = files.select("doc_id", "content", n.alias("n"), fault.alias("fault"), F.when(fault.isNull(), F.from_json(F.decode(F.substr(meta, F.lit(_HEAD + 1)), "UTF-8"), _metadata())).alias("m"))
    room = F.length("content") - 4 - F.col("n")
    out = lambda at, size: at.isNotNull() & ((at < 0) | (size < 0) | (at + size > room))
    beyond = F.exists("m.layers", lambda r: F.coalesce(out(r["rgba_at"], r["rgba_n"]) | out(r["mask_at"], r["mask_n"]), F.lit(False)))
    error = F.coalesce("fault", F.when(F.col("m.layers").isNull(), "metadata not readable").when(beyond, "pixels out of range"))
    met = met.withColumn("error", error)
    cut = lambda at, size: F.when(at.isNotNull(), F.substr(F.col("content"), (at + F.col("n") + 5).cast("int"), size.cast("int")))
    names = [c.split(" ", 1)[0] for c in _PLAIN]
    whole = F.transform("m.layers", lambda r: F.struct(*[r[c].alias(c) for c in names], cut(r["rgba_at"], r["rgba_n"]).alias("rgba"), cut(r["mask_at"], r["mask_n"]).alias("mask")))
    good = F.col("error").isNull()
    return met.select("doc_id", F.when(good, F.col("m.width")).alias("width"), F.when(good, F.col("m.height")).alias("height"), F.when(good, whole).alias("layers"), "error")


def layers_of(documents: DataFrame) -> DataFrame:
    """The layer table of opened documents; those with an error have no layers."""
    rows = documents.select("doc_id", F.inline("layers"))
    return rows.select(*[c.split(" ", 1)[0] for c in DDL.split(", ")])


def has_svg(files: DataFrame) -> DataFrame:
    """(doc_id, has_svg, error): whether a layer is markup; only kinds are parsed, and no pixels are cut out."""
    _, meta, fault = _head(F.col("content"))
    kinds = F.from_json(F.decode(F.substr(meta, F.lit(_HEAD + 1)), "UTF-8"), "struct<layers:array<struct<kind:string>>>")
    met = files.select("doc_id", fault.alias("fault"), F.when(fault.isNull(), kinds).alias("m"))
    error = F.coalesce("fault", F.when(F.col("m.layers").isNull(), "metadata not readable"))
    return met.select("doc_id", F.when(error.isNull(), F.exists("m.layers", lambda r: r["kind"] == "svg")).alias("has_svg"), error.alias("error"))


def damaged(files: DataFrame) -> DataFrame:
    """Files spoilt in ways that their ids choose, to show every fault: cut to 3 bytes, cut in the metadata, other magic, other version, cut in the pixels."""
    c = F.col("content")
    bytes_ = lambda at, n: F.substr(c, F.lit(at), n)
    rest = lambda at: F.substr(c, F.lit(at))
    kind = F.pmod(F.col("doc_id"), F.lit(5))
    spoilt = (
        F.when(kind == 0, bytes_(1, F.lit(3)))
        .when(kind == 1, bytes_(1, F.lit(20)))
        .when(kind == 2, F.concat(bytes_(1, F.lit(4)), F.lit(b"X"), rest(6)))
        .when(kind == 3, F.concat(bytes_(1, F.lit(4 + len(MAGIC))), F.lit(b"\x09"), rest(6 + len(MAGIC))))
        .otherwise(bytes_(1, F.length(c) - 1))
    )
    return files.withColumn("content", spoilt)


def write(documents: DataFrame, layers: DataFrame, folder: str) -> None:
    """Documents and layers as Parquet tables."""
    documents.write.parquet(f"{folder}/documents")
    layers.write.parquet(f"{folder}/layers")


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/documents"), spark.read.schema(DDL).parquet(f"{folder}/layers")
