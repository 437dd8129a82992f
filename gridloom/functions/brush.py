"""Brush weights and polygon tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def falloff(d: Column, radius: Column, exponent: Column) -> Column:
    """1 at the centre, 0 from the radius on."""
    share = F.lit(1.0) - d / F.nullif(radius, F.lit(0.0))
    return F.when(d >= radius, 0.0).otherwise(F.pow(F.greatest(share, F.lit(0.0)), F.greatest(F.lit(0.01), exponent)))


def plateau(d: Column, edge: Column, band: Column, exponent: Column) -> Column:
    """1 out to the edge, then a falloff across the band."""
    return F.when(d <= edge, 1.0).otherwise(falloff(d - edge, band, exponent))


def edges(polygon: Column) -> Column:
    """Closed list of (a, b) segments of an array of ``(x, z)`` vertices."""
    before = F.transform(polygon, lambda _v, i: F.get(polygon, F.pmod(i - 1, F.size(polygon))))
    return F.arrays_zip(before.alias("a"), polygon.alias("b"))


def inside_polygon(x: Column, z: Column, segments: Column) -> Column:
    """Even-odd rule: an odd number of edges to the right of the point."""
    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (b["z"] > z) != (a["z"] > z)
        at = (a["x"] - b["x"]) * (z - b["z"]) / F.nullif(a["z"] - b["z"], F.lit(0.0)) + b["x"]
        return spans & (x < at)

    return F.size(F.filter(segments, lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 1


def boundary_distance(x: Column, z: Column, segments: Column) -> Column:
    """Distance to the nearest edge."""
    def distance(s: Column) -> Column:
        ax, az = s["a"]["x"], s["a"]["z"]
        ex, ez = s["b"]["x"] - ax, s["b"]["z"] - az
        t = ((x - ax) * ex + (z - az) * ez) / F.nullif(ex * ex + ez * ez, F.lit(0.0))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(t, F.lit(0.0))))
        dx, dz = x - (ax + t * ex), z - (az + t * ez)
        return F.sqrt(dx * dx + dz * dz)

    return F.array_min(F.transform(segments, distance))
