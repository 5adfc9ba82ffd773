"""Unit conversion: linear and affine units of one dimension; the planner rejects what has no fixed factor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (dimension, factor to the base unit, offset).
UNITS = {
    "metre": ("length", 1.0, 0.0), "kilometre": ("length", 1000.0, 0.0), "second": ("time", 1.0, 0.0), "minute": ("time", 60.0, 0.0), "hour": ("time", 3600.0, 0.0), "day": ("time", 86400.0, 0.0),
    "pascal": ("pressure", 1.0, 0.0), "kilopascal": ("pressure", 1000.0, 0.0), "metre_per_second": ("speed", 1.0, 0.0), "kilometre_per_hour": ("speed", 1 / 3.6, 0.0),
    "celsius": ("temperature", 1.0, 273.15), "kelvin": ("temperature", 1.0, 0.0), "fahrenheit": ("temperature", 5 / 9, 459.67 * 5 / 9), "ratio": ("ratio", 1.0, 0.0), "percent": ("ratio", 0.01, 0.0),
}
CONTEXTUAL = frozenset({"decibel", "currency"})


def convert(c: Column, source: str, target: str, *, delta: bool = False) -> Column:
    """``delta``: the column holds differences, so offsets don't count."""
    if source == target:
        return c
    if source in CONTEXTUAL or target in CONTEXTUAL or source not in UNITS or target not in UNITS or UNITS[source][0] != UNITS[target][0]:
        raise ValueError(f"no fixed conversion from {source} to {target}")
    _, f, a = UNITS[source]
    _, g, b = UNITS[target]
    return c * F.lit(f / g) if delta else (c * F.lit(f) + F.lit(a) - F.lit(b)) / F.lit(g)
