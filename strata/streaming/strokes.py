"""Strokes as a stream: smoothed points, and whole brush sessions that stamp as points come."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.brush import Brush, walk
from strata.operators.strokes import smooth

SCHEMA = "stroke_id long, seq long, x double, y double, pressure double"
STAMPS = "stroke_id long, n long, x double, y double, pressure double, tilt_x double, tilt_y double, time double, cancelled boolean"


def smoothed(points: DataFrame, smoothing: float) -> DataFrame:
    """Points of a stream (stroke_id, seq, x, y, pressure), smoothed as they come; batches must hold a stroke in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        out = smooth(rows, smoothing, tuple(state.get) if state.exists else None)
        state.update(tuple(float(v) for v in out[["x", "y", "pressure"]].iloc[-1]))
        yield out

    slim = points.selectExpr("stroke_id", "seq", "cast(x as double) x", "cast(y as double) y", "cast(pressure as double) pressure")
    return slim.groupBy("stroke_id").applyInPandasWithState(run, SCHEMA, "x double, y double, pressure double", "append", "NoTimeout")


def next_time(time: float | None, last: float | None) -> float:
    """Milliseconds that rise: a late time is one after the last, a missing one 16 after it, and the first missing one 0."""
    if time is not None and math.isfinite(time) and time > 0:
        return last + 1 if last is not None and time <= last else time
    return last + 16 if last is not None else 0.0


def sessions(events: DataFrame, brush: Brush, smoothing: float = 0.0) -> DataFrame:
    """Stamps of brush sessions, from a stream of events (stroke_id, seq, action, x, y, pressure[, tilt_x, tilt_y, time]).

    ``action`` is begin, push, end or cancel. Points pushed are smoothed, get rising times, and are walked at once: the
    state of a stroke is its last smoothed point, last time, last stamp and what is left of the spacing. A session that
    is cancelled gives one row more, cancelled, which takes its stamps back (``kept``). Events before a begin, or after
    an end or a cancel, do nothing. Batches must hold a stroke in order.
    """
    axes, alpha = ["x", "y", "pressure", "tilt_x", "tilt_y"], 1.0 - min(max(smoothing, 0.0), 0.95)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"open": False, "done": False, "n": 0, "last": None, "time": None, "walk": None}
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if row.action == "begin" and not held["done"]:
                held["open"] = True
            elif not held["open"]:
                continue
            elif row.action == "push":
                raw, last = [float(getattr(row, c)) for c in axes], held["last"]
                point = raw if last is None else [p + (q - p) * alpha for p, q in zip(last[:3], raw[:3], strict=True)] + raw[3:]
                held["last"], held["time"] = point, next_time(row.time, held["time"])
                before = held["walk"]
                made, after = walk([tuple(point)], brush, None if before is None else (tuple(before[0]), tuple(before[1]), before[2]))
                held["walk"] = [list(after[0]), list(after[1]), after[2]]
                out += [(row.stroke_id, held["n"] + i, *p, held["time"], False) for i, p in enumerate(made)]
                held["n"] += len(made)
            elif row.action in ("end", "cancel"):
                held = held | {"open": False, "done": True, "last": None, "walk": None}
                if row.action == "cancel":
                    out.append((row.stroke_id, held["n"], None, None, None, None, None, held["time"], True))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["stroke_id", "n", *axes, "time", "cancelled"])

    value = lambda c: F.col(c).cast("double") if c in events.columns else F.lit(None if c == "time" else 0.0).cast("double")
    slim = events.select("stroke_id", "seq", "action", *[value(c).alias(c) for c in (*axes, "time")])
    return slim.groupBy("stroke_id").applyInPandasWithState(run, STAMPS, "held string", "append", "NoTimeout")


def kept(stamps: DataFrame) -> DataFrame:
    """The stamps of sessions that were not cancelled, as operators.brush wants them."""
    gone = stamps.where("cancelled").select("stroke_id")
    return stamps.where("not cancelled").join(gone, "stroke_id", "left_anti").select("stroke_id", "n", "x", "y", "pressure", "tilt_x", "tilt_y")
