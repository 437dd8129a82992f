"""Colour ramps over normalised scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: five-stop perceptual ramp (position, red, green, blue) ------------
STOPS = [
    (0.0, 0.267, 0.005, 0.329),
    (0.25, 0.229, 0.322, 0.545),
    (0.5, 0.127, 0.567, 0.551),
    (0.75, 0.369, 0.789, 0.383),
    (1.0, 0.993, 0.906, 0.144),
]
# Colour of each semantic class, in code order.
CLASS_COLOURS = [
    (0.35, 0.35, 0.35), (0.72, 0.70, 0.66), (0.55, 0.52, 0.48), (0.30, 0.38, 0.55),
    (0.45, 0.55, 0.72), (0.85, 0.80, 0.55), (0.62, 0.42, 0.30), (0.90, 0.65, 0.25),
    (0.40, 0.25, 0.45), (0.55, 0.65, 0.60), (0.70, 0.55, 0.40), (0.85, 0.25, 0.25),
]
# -------------------------------------------------------------------------------------


def ramp(t: Column, channel: int) -> Column:
    """Piecewise-linear channel value (0 red, 1 green, 2 blue) of a clamped scalar."""
    x = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    out = F.lit(STOPS[-1][channel + 1])
    for lower, upper in reversed(list(zip(STOPS, STOPS[1:]))):
        lo, hi = lower[channel + 1], upper[channel + 1]
        share = (x - lower[0]) / (upper[0] - lower[0])
        out = F.when(x <= upper[0], share * (hi - lo) + lo).otherwise(out)
    return out


def unit_interval(value: Column, low: Column, high: Column) -> Column:
    """Position of a value in [low, high]; a flat range maps to the middle."""
    return F.when(high > low, (value - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.5)


def class_colour(code: Column, channel: int) -> Column:
    table = F.array(*[F.lit(c[channel]) for c in CLASS_COLOURS])
    return F.coalesce(F.get(table, code.cast("int")), F.lit(CLASS_COLOURS[0][channel]))
