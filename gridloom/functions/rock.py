"""Rock abundance and shape as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def decay(k: Column) -> Column:
    """Exponential decay rate of the size-frequency curve for total coverage ``k``."""
    return F.lit(0.152) / k + 1.79


def area_fraction(k: Column, d: Column) -> Column:
    return k * F.exp(-decay(k) * d)


def number_density(k: Column, d: Column) -> Column:
    q = decay(k)
    return k * q * 4 * F.exp(-q * d) / (d * d * math.pi)


def cumulative_count(k: Column, d_min: Column, d_max: Column, bins: int = 512) -> Column:
    """Rocks per m2 between two diameters: the density summed over logarithmic bins."""
    lo, step = F.ln(d_min), (F.ln(d_max) - F.ln(d_min)) / bins

    def add(total: Column, i: Column) -> Column:
        a, b = F.exp(lo + step * i), F.exp(lo + step * (i + 1))
        return total + number_density(k, F.sqrt(a * b)) * (b - a)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0.0), add)
    return F.when(d_max <= d_min, 0.0).otherwise(total)


def draw_diameter(k: Column, lo: Column, hi: Column, u: Column) -> Column:
    """Inverse of the truncated exponential between two diameters."""
    q = decay(k)
    a, b = F.exp(-q * lo), F.exp(-q * hi)
    return -F.ln(a - u * (a - b)) / q


def quaternion(u1: Column, u2: Column, u3: Column) -> Column:
    """Uniformly distributed rotation from three uniforms."""
    s1, s2 = F.sqrt(F.lit(1.0) - u1), F.sqrt(u1)
    a, b = u2 * (2 * math.pi), u3 * (2 * math.pi)
    return F.array(s1 * F.sin(a), s1 * F.cos(a), s2 * F.sin(b), s2 * F.cos(b))
