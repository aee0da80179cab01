"""Pen strokes: pressure, smoothing and time, in order within a stroke."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dab_size(points: DataFrame, size: float, influence: float) -> DataFrame:
    """Pressure to the size of a dab: between the brush's size and its share of the pressure."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("pressure")))
    return points.withColumn("dab", F.lit(size) * (F.lit(1.0 - influence) + p * influence))


def travelled(points: DataFrame) -> DataFrame:
    """Length of the stroke up to each point, and the number of dabs that spacing leaves on the way."""
    order = Window.partitionBy("stroke_id").orderBy("seq")
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    step = points.withColumn("step", F.coalesce(F.sqrt((dx * dx + dy * dy).cast("double")), F.lit(0.0)))
    return step.withColumn("travelled", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def smoothed(points: DataFrame, smoothing: float) -> DataFrame:
    """Exponential smoothing of x, y and pressure along each stroke.

    Strokes are sorted within their partitions and smoothed side by side, one point of each at a time; of a stroke
    that goes on in the next batch only its last smoothed point is kept.
    """
    alpha, names = 1.0 - min(max(smoothing, 0.0), 0.95), ["x", "y", "pressure"]

    def run(batches):
        held = last = None
        for b in batches:
            if not b.num_rows:
                continue
            stroke = b.column(0).to_numpy()
            value = np.stack([b.column(i).to_numpy() for i in (2, 3, 4)], axis=1)
            start = np.flatnonzero(np.concatenate(([True], stroke[1:] != stroke[:-1])))
            size = np.diff(np.append(start, len(stroke)))
            if held is not None and stroke[0] == held:
                value[0] = last + (value[0] - last) * alpha
            order = np.argsort(-size, kind="stable")
            start, longest = start[order], -size[order]
            for k in range(1, -int(longest[0])):
                at = start[: int(np.searchsorted(longest, -k, "left"))] + k
                value[at] = value[at - 1] + (value[at] - value[at - 1]) * alpha
            held, last = stroke[-1], value[-1].copy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(value[:, i]) for i in range(3))], ["stroke_id", "seq", *names])

    slim = points.select(F.col("stroke_id").cast("long").alias("stroke_id"), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in names])
    return slim.repartition("stroke_id").sortWithinPartitions("stroke_id", "seq").mapInArrow(run, "stroke_id long, seq long, x double, y double, pressure double")


def smooth(stroke: pd.DataFrame, smoothing: float, last: tuple | None = None) -> pd.DataFrame:
    """Sorted points of one stroke after the smoothed point ``last``."""
    alpha, out = 1.0 - min(max(smoothing, 0.0), 0.95), []
    for v in zip(*(stroke[c].astype(float) for c in ("x", "y", "pressure")), strict=True):
        last = v if last is None else tuple(p + (q - p) * alpha for p, q in zip(last, v, strict=True))
        out.append(last)
    res = stroke[["stroke_id", "seq"]].copy()
    res[["x", "y", "pressure"]] = pd.DataFrame(out, index=res.index, columns=["x", "y", "pressure"]) if out else 0.0
    return res
