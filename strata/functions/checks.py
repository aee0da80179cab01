"""Checks of arguments: errors for single values, reasons for columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = ["finite", "non_negative", "positive", "positive_integer", "unit", "byte"]


def finite(value: float, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise TypeError(f"{name} has to be a finite number")
    return value


def integer(value: float, name: str) -> int:
    """The whole part."""
    return math.trunc(finite(value, name))


def _between(value, name: str, low: float | None, high: float | None = None, open_: bool = False):
    if (low is not None and (value <= low if open_ else value < low)) or (high is not None and value > high):
        raise ValueError(f"{name} is out of range: {value}")
    return value


def non_negative(value: float, name: str) -> int:
    return _between(integer(value, name), name, 0)


def positive(value: float, name: str) -> float:
    return _between(finite(value, name), name, 0, open_=True)


def positive_integer(value: float, name: str) -> int:
    return _between(integer(value, name), name, 0, open_=True)


def unit(value: float, name: str) -> float:
    return _between(finite(value, name), name, 0, 1)


def byte(value: float, name: str) -> int:
    return _between(integer(value, name), name, 0, 255)


def fault(rule: str, value: Column) -> Column:
    """Why a value of a column breaks a rule, or null."""
    v = value.cast("double")
    whole = F.signum(v) * F.floor(F.abs(v))
    broken = {
        "finite": None,
        "non_negative": (whole < 0, "below 0"),
        "positive": (v <= 0, "not above 0"),
        "positive_integer": (whole <= 0, "not above 0"),
        "unit": ((v < 0) | (v > 1), "not in 0 to 1"),
        "byte": ((whole < 0) | (whole > 255), "not a byte"),
    }[rule]
    out = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "not finite")
    return out.when(*broken) if broken else out
