"""Georeferencing as column expressions: polar stereographic, local tangent frames, pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.codes import BODY_RADIUS_M


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def normalize_longitude(deg: Column) -> Column:
    """(-180, 180]"""
    d = deg - F.floor(deg / 360.0) * 360.0
    return F.when(d > 180, d - 360).otherwise(d)


def norm360(deg: Column) -> Column:
    return deg - F.floor(deg / 360.0) * 360.0


def norm_two_pi(rad: Column) -> Column:
    return rad - F.floor(rad / (2 * math.pi)) * (2 * math.pi)


def polar_forward(lat: Column, lon: Column, south: Column, lon0=0.0, k0=1.0, fe=0.0, fn=0.0,
                  radius=BODY_RADIUS_M) -> tuple[Column, Column]:
    """Latitude/longitude in degrees to projected metres; ``south`` picks the hemisphere."""
    half = F.radians(F.when(south, lat).otherwise(-lat)) / 2
    rho = _c(radius) * _c(k0) * 2 * F.tan(half + math.pi / 4)
    turn = F.radians(lon - _c(lon0))
    north_south = F.when(south, F.cos(turn)).otherwise(-F.cos(turn))
    return rho * F.sin(turn) + _c(fe), rho * north_south + _c(fn)


def polar_inverse(x: Column, y: Column, south: Column, lon0=0.0, k0=1.0, fe=0.0, fn=0.0,
                  radius=BODY_RADIUS_M) -> tuple[Column, Column]:
    """Projected metres to latitude/longitude; the pole itself takes the central meridian."""
    px, py = x - _c(fe), y - _c(fn)
    rho = F.hypot(px, py)
    colat = F.atan(rho / (_c(radius) * _c(k0) * 2)) * 2
    sign = F.when(south, -1.0).otherwise(1.0)
    lat = sign * F.degrees(F.lit(math.pi / 2) - colat)
    lon = _c(lon0) + F.degrees(F.atan2(px, F.when(south, py).otherwise(-py)))
    return (F.when(rho == 0, sign * 90.0).otherwise(lat),
            F.when(rho == 0, _c(lon0)).otherwise(normalize_longitude(lon)))


def scale_factor(lat: Column, k0=1.0) -> Column:
    return _c(k0) * 2 / (F.sin(F.radians(F.abs(lat))) + 1)


def local_frame(lat: Column, lon: Column, south: Column, lon0=0.0, k0=1.0, fe=0.0, fn=0.0) -> Column:
    """Struct with the projected origin, the east and south unit vectors and the local scale."""
    x, y = polar_forward(lat, lon, south, lon0, k0, fe, fn)
    turn = F.radians(lon - _c(lon0))
    side = F.when(south, -F.sin(turn)).otherwise(F.sin(turn))
    return F.struct(
        x.alias("ox"), y.alias("oy"), F.cos(turn).alias("ex"), side.alias("ey"), side.alias("sx"),
        (-F.cos(turn)).alias("sy"), scale_factor(lat, k0).alias("scale"))


def local_to_projected(frame: Column, x: Column, z: Column) -> tuple[Column, Column]:
    g = frame.getField
    return (g("ox") + (x * g("ex") + z * g("sx")) * g("scale"),
            g("oy") + (x * g("ey") + z * g("sy")) * g("scale"))


def projected_to_local(frame: Column, px: Column, py: Column) -> tuple[Column, Column]:
    g = frame.getField
    dx, dy = (px - g("ox")) / g("scale"), (py - g("oy")) / g("scale")
    return dx * g("ex") + dy * g("ey"), dx * g("sx") + dy * g("sy")


def projected_to_pixel(px: Column, py: Column, scale, col_off, row_off, corner: Column | None = None):
    """Fractional pixel: centre-offset products, or corner-origin ones where ``corner`` holds."""
    col, row = px / _c(scale) + _c(col_off), _c(row_off) - py / _c(scale)
    if corner is None:
        return col, row
    # A corner-origin product stores the upper-left corner in the offset columns.
    ccol, crow = (px - _c(col_off)) / _c(scale) - 0.5, (_c(row_off) - py) / _c(scale) - 0.5
    return F.when(corner, ccol).otherwise(col), F.when(corner, crow).otherwise(row)


def pixel_to_projected(col: Column, row: Column, scale, col_off, row_off, corner: Column | None = None):
    x, y = (col - _c(col_off)) * _c(scale), (_c(row_off) - row) * _c(scale)
    if corner is None:
        return x, y
    cx, cy = _c(col_off) + (col + 0.5) * _c(scale), _c(row_off) - (row + 0.5) * _c(scale)
    return F.when(corner, cx).otherwise(x), F.when(corner, cy).otherwise(y)


def destination(lat: Column, lon: Column, bearing: Column, arc: Column) -> tuple[Column, Column]:
    """Great-circle destination, all in radians."""
    lat2 = F.asin(F.sin(lat) * F.cos(arc) + F.cos(lat) * F.sin(arc) * F.cos(bearing))
    lon2 = lon + F.atan2(F.sin(bearing) * F.sin(arc) * F.cos(lat), F.cos(arc) - F.sin(lat) * F.sin(lat2))
    return lat2, lon2


def curvature_drop(x: Column, z: Column, radius=BODY_RADIUS_M) -> Column:
    return (x * x + z * z) / (_c(radius) * 2)
