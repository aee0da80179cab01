"""The layer tree as an adjacency list (id, parent, idx, …): listing, removing, moving and patching layers."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.sources.shared import checkpointed


def numbered(layers: DataFrame, key: str = "key") -> DataFrame:
    """Add idx, the place among siblings."""
    return layers.withColumn("idx", (F.row_number().over(Window.partitionBy("parent").orderBy(key)) - 1).cast("int"))


def listed(layers: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every layer with its depth and pre-order path, one join a level, of levels that are written; stops when a level is empty, or at max_depth where one is given."""
    level = layers.where("parent is null").withColumn("depth", F.lit(0)).withColumn("path", F.format_string("%06d", "idx"))
    out = level = checkpointed(level)
    for d in itertools.count(1) if max_depth is None else range(1, max_depth):
        up = level.select(F.col("id").alias("_id"), F.col("path").alias("_path"))
        level = layers.join(up, F.col("parent") == F.col("_id")).withColumn("depth", F.lit(d)).withColumn("path", F.concat("_path", F.lit("/"), F.format_string("%06d", "idx"))).select(*level.columns)
        level = checkpointed(level)
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def without(layers: DataFrame, root: str, max_depth: int | None = None) -> DataFrame:
    """The tree without a layer and what is below it; idx closes up."""
    gone = listed(layers, max_depth)
    path = gone.where(F.col("id") == root).select(F.col("path").alias("_root"))
    below = F.concat("path", F.lit("/")).startswith(F.concat("_root", F.lit("/")))
    kept = gone.join(path, below, "left_anti") if not path.isEmpty() else gone
    return kept.withColumn("idx", (F.row_number().over(Window.partitionBy("parent").orderBy("idx")) - 1).cast("int")).drop("depth", "path")


def moved(layers: DataFrame, layer: str, parent: str | None, index: int | None = None) -> DataFrame:
    """The layer as a child of ``parent`` (None: on top) at ``index`` among what is there (None: at the end); siblings make room.

    Within one parent the index counts the layer itself, so places behind it close up. Nothing changes where the layer
    isn't there, or the parent isn't a group, is the layer or is below it.
    """
    own = layers.where(F.col("id") == layer).select("parent", "idx").first()
    if own is None:
        return layers
    if parent is not None:
        at, first = parent, True
        while at is not None:
            row = layers.where(F.col("id") == at).select("parent", "kind").first()
            if row is None or at == layer or (first and row["kind"] != "group"):
                return layers
            at, first = row["parent"], False
    mine = F.col("id") == layer
    to = F.when(mine, F.lit(parent).cast("string")).otherwise(F.col("parent"))
    met = layers.withColumns({"_mine": mine, "_to": to})
    met = met.withColumns({"_rest": F.row_number().over(Window.partitionBy("_to", "_mine").orderBy("idx")) - 1, "_n": F.count(F.when(~F.col("_mine"), 1)).over(Window.partitionBy("_to"))})
    if index is not None:
        index -= own["parent"] == parent and index > own["idx"]
    # where the layer goes: known from the siblings that it meets
    place = F.col("_n") if index is None else F.least(F.col("_n"), F.lit(index))
    room = F.col("_to").eqNullSafe(F.lit(parent).cast("string")) & (F.col("_rest") >= place)
    idx = F.when(F.col("_mine"), place).otherwise(F.col("_rest") + F.coalesce(room, F.lit(False)).cast("int")).cast("int")
    return met.withColumn("_idx", idx).select(*[{"parent": F.col("_to").alias("parent"), "idx": F.col("_idx").alias("idx")}.get(c, F.col(c)) for c in layers.columns])


def patched(log: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """State after a log of sparse patches: each field's last value that isn't null, by partial aggregates."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(order, c))).getField(c)
    return log.groupBy(key).agg(*[last(c).alias(c) for c in fields])


def appended(layers: DataFrame, layer: str, parent: str | None, kind: str) -> DataFrame:
    """The tree with a new last child of a group (None: on top of the document); an unknown parent or one that isn't a group is an error."""
    if parent is not None and layers.where((F.col("id") == parent) & (F.col("kind") == "group")).isEmpty():
        raise ValueError(f"no such group: {parent}")
    beside = layers.where(F.col("parent").eqNullSafe(F.lit(parent))).agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).cast("int").alias("idx"))
    values = {"id": F.lit(layer), "parent": F.lit(parent).cast("string"), "kind": F.lit(kind), "idx": F.col("idx")}
    return layers.unionByName(beside.select(*[v.alias(k) for k, v in values.items()]), allowMissingColumns=True)


def without_child(layers: DataFrame, group: str, child: str, max_depth: int | None = None) -> DataFrame:
    """As ``without``, but only where the layer is a direct child of the group; else nothing changes."""
    if layers.where((F.col("id") == child) & (F.col("parent") == group)).isEmpty():
        return layers
    return without(layers, child, max_depth)


def counts(layers: DataFrame) -> DataFrame:
    """(top, layers, filters): top-level layers, all layers, filters."""
    return layers.agg(F.count(F.when(F.col("parent").isNull(), 1)).alias("top"), F.count(F.lit(1)).alias("layers"), F.count(F.when(F.col("kind") == "filter", 1)).alias("filters"))


def _away(v: Column) -> Column:
    """Rounded, halves away from zero."""
    return (F.signum(v) * F.floor(F.abs(v) + 0.5)).cast("int")


def aligned(layers: DataFrame, mode: str, canvas: tuple[int, int] | None = None) -> DataFrame:
    """Layers (x, y, w, h, centred) lined up in their common box or in the canvas.

    ``mode`` is left, horizontal-center, right, top, vertical-center or bottom. A centred layer's position is its
    centre. The box is one global aggregate, broadcast as one row.
    """
    modes = {"left": ("x", 0), "horizontal-center": ("x", 1), "right": ("x", 2), "top": ("y", 0), "vertical-center": ("y", 1), "bottom": ("y", 2)}
    axis, to = modes[mode]
    size = F.col("w" if axis == "x" else "h")
    edge = F.when(F.col("centred"), _away(F.col(axis) - size / 2.0)).otherwise(F.col(axis))
    if canvas:
        box = layers.withColumns({"_lo": F.lit(0), "_hi": F.lit(canvas[axis == "y"])})
    else:
        box = layers.crossJoin(F.broadcast(layers.agg(F.min(edge).alias("_lo"), F.max(edge + size).alias("_hi"))))
    at = [F.col("_lo"), _away((F.col("_lo") + F.col("_hi") - size) / 2.0), F.col("_hi") - size][to]
    return box.withColumn(axis, F.when(F.col("centred"), _away(at + size / 2.0)).otherwise(at).cast("int")).select(*layers.columns)


def patched_layers(layers: DataFrame, patches: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Layers with a table of sparse patches (at most one a layer) merged in; opacity is kept in 0..1, unknown ids do nothing."""
    p = patches.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    value = lambda f: F.coalesce(F.col(f"_{f}"), F.col(f))
    new = {f: F.least(F.lit(1.0), F.greatest(F.lit(0.0), value(f))) if f == "opacity" else value(f) for f in fields}
    return layers.join(p, key, "left").withColumns(new).select(*layers.columns)
