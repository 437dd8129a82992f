"""Time scales, sun and moon positions, body orientation and site geometry.

Positions are built up in named columns step by step, which keeps every expression small enough to be
compiled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

c = F.col

# --- fixed values: leap seconds (UTC date from which TAI-UTC holds) ------------------
LEAP_SECONDS = [
    ("1972-01-01", 10), ("1972-07-01", 11), ("1973-01-01", 12), ("1974-01-01", 13), ("1975-01-01", 14),
    ("1976-01-01", 15), ("1977-01-01", 16), ("1978-01-01", 17), ("1979-01-01", 18), ("1980-01-01", 19),
    ("1981-07-01", 20), ("1982-07-01", 21), ("1983-07-01", 22), ("1985-07-01", 23), ("1988-01-01", 24),
    ("1990-01-01", 25), ("1991-01-01", 26), ("1992-07-01", 27), ("1993-07-01", 28), ("1994-07-01", 29),
    ("1996-01-01", 30), ("1997-07-01", 31), ("1999-01-01", 32), ("2006-01-01", 33), ("2009-01-01", 34),
    ("2012-07-01", 35), ("2015-07-01", 36), ("2017-01-01", 37),
]
TT_MINUS_TAI_S = 32.184
AU_M = 149_597_870_700.0
LIGHT_M_S = 299_792_458.0
SOLAR_RADIUS_M = 6.957e8
# Periodic terms of the lunar longitude and distance: multipliers of D, M, M', F, then 1e-6 deg and 1e-3 km.
LONGITUDE_TERMS = [
    (0, 0, 1, 0, 6288774, -20905355), (2, 0, -1, 0, 1274027, -3699111), (2, 0, 0, 0, 658314, -2955968),
    (0, 0, 2, 0, 213618, -569925), (0, 1, 0, 0, -185116, 48888), (0, 0, 0, 2, -114332, -3149),
    (2, 0, -2, 0, 58793, 246158), (2, -1, -1, 0, 57066, -152138), (2, 0, 1, 0, 53322, -170733),
    (2, -1, 0, 0, 45758, -204586), (0, 1, -1, 0, -40923, -129620), (1, 0, 0, 0, -34720, 108743),
    (0, 1, 1, 0, -30383, 104755), (2, 0, 0, -2, 15327, 10321), (0, 0, 1, 2, -12528, 0), (0, 0, 1, -2, 10980, 79661),
    (4, 0, -1, 0, 10675, -34782), (0, 0, 3, 0, 10034, -23210), (4, 0, -2, 0, 8548, -21636), (2, 1, -1, 0, -7888, 24208),
    (2, 1, 0, 0, -6766, 30824), (1, 0, -1, 0, -5163, -8379), (1, 1, 0, 0, 4987, -16675), (2, -1, 1, 0, 4036, -12831),
    (2, 0, 2, 0, 3994, -10445), (4, 0, 0, 0, 3861, -11650), (2, 0, -3, 0, 3665, 14403), (0, 1, -2, 0, -2689, -7003),
    (2, 0, -1, 2, -2602, 0), (2, -1, -2, 0, 2390, 10056), (1, 0, 1, 0, -2348, 6322), (2, -2, 0, 0, 2236, -9884),
    (0, 1, 2, 0, -2120, 5751), (0, 2, 0, 0, -2069, 0), (2, -2, -1, 0, 2048, -4950), (2, 0, 1, -2, -1773, 4130),
    (2, 0, 0, 2, -1595, 0), (4, -1, -1, 0, 1215, -3958), (0, 0, 2, 2, -1110, 0), (3, 0, -1, 0, -892, 3258),
    (2, 1, 1, 0, -810, 2616), (4, -1, -2, 0, 759, -1897), (0, 2, -1, 0, -713, -2117), (2, 2, -1, 0, -700, 2354),
    (2, 1, -2, 0, 691, 0), (2, -1, 0, -2, 596, 0), (4, 0, 1, 0, 549, -1423), (0, 0, 4, 0, 537, -1117),
    (4, -1, 0, 0, 520, -1571), (1, 0, -2, 0, -487, -1739), (2, 1, 0, -2, -399, 0), (0, 0, 2, -2, -381, -4421),
    (1, 1, 1, 0, 351, 0), (3, 0, -2, 0, -340, 0), (4, 0, -3, 0, 330, 0), (2, -1, 2, 0, 327, 0), (0, 2, 1, 0, -323, 1165),
    (1, 1, -1, 0, 299, 0), (2, 0, 3, 0, 294, 0), (2, 0, -1, -2, 0, 8752),
]
# Periodic terms of the lunar latitude: multipliers of D, M, M', F, then 1e-6 deg.
LATITUDE_TERMS = [
    (0, 0, 0, 1, 5128122), (0, 0, 1, 1, 280602), (0, 0, 1, -1, 277693), (2, 0, 0, -1, 173237), (2, 0, -1, 1, 55413),
    (2, 0, -1, -1, 46271), (2, 0, 0, 1, 32573), (0, 0, 2, 1, 17198), (2, 0, 1, -1, 9266), (0, 0, 2, -1, 8822),
    (2, -1, 0, -1, 8216), (2, 0, -2, -1, 4324), (2, 0, 1, 1, 4200), (2, 1, 0, -1, -3359), (2, -1, -1, 1, 2463),
    (2, -1, 0, 1, 2211), (2, -1, -1, -1, 2065), (0, 1, -1, -1, -1870), (4, 0, -1, -1, 1828), (0, 1, 0, 1, -1794),
    (0, 0, 0, 3, -1749), (0, 1, -1, 1, -1565), (1, 0, 0, 1, -1491), (0, 1, 1, 1, -1475), (0, 1, 1, -1, -1410),
    (0, 1, 0, -1, -1344), (1, 0, 0, -1, -1335), (0, 0, 3, 1, 1107), (4, 0, 0, -1, 1021), (4, 0, -1, 1, 833),
    (0, 0, 1, -3, 777), (4, 0, -2, 1, 671), (2, 0, 0, -3, 607), (2, 0, 2, -1, 596), (2, -1, 1, -1, 491),
    (2, 0, -2, 1, -451), (0, 0, 3, -1, 439), (2, 0, 2, 1, 422), (2, 0, -3, -1, 421), (2, 1, -1, 1, -366),
    (2, 1, 0, 1, -351), (4, 0, 0, 1, 331), (2, -1, 1, 1, 315), (2, -2, 0, -1, 302), (0, 0, 1, 3, -283),
    (2, 1, 1, -1, -229), (1, 1, 0, -1, 223), (1, 1, 0, 1, 223), (0, 1, -2, -1, -220), (2, 1, -1, -1, -220),
    (1, 0, 1, 1, -185), (2, -1, -2, -1, 181), (0, 1, 2, 1, -177), (4, 0, -2, -1, 176), (4, -1, -1, -1, 166),
    (1, 0, 1, -1, -164), (4, 0, 1, -1, 132), (1, 0, -1, -1, -119), (4, -1, 0, -1, 115), (2, -2, 0, 1, 107),
]
# Libration arguments E1..E13: constant and rate in degrees per day.
LIBRATION = [
    (125.045, -0.0529921), (250.089, -0.1059842), (260.008, 13.0120009), (176.625, 13.3407154), (357.529, 0.9856003),
    (311.589, 26.4057084), (134.963, 13.064993), (276.617, 0.3287146), (34.226, 1.7484877), (15.134, -0.1589763),
    (119.743, 0.0036096), (239.961, 0.1643573), (25.053, 12.9590088),
]
POLE_RA = {1: -3.8787, 2: -0.1204, 3: 0.07, 4: -0.0172, 6: 0.0072, 10: -0.0052, 13: 0.0043}
POLE_DEC = {1: 1.5419, 2: 0.0239, 3: -0.0278, 4: 0.0068, 6: -0.0029, 7: 0.0009, 10: 0.0008, 13: -0.0009}
MERIDIAN = {1: 3.561, 2: 0.1208, 3: -0.0642, 4: 0.0158, 5: 0.0252, 6: -0.0066, 7: -0.0047, 8: -0.0046, 9: 0.0028,
            10: 0.0052, 11: 0.004, 12: 0.0019, 13: -0.0044}
# Principal axes to mean-Earth axes, arc seconds about x, y, z in the order z, y, x.
PRINCIPAL_TO_MEAN_ARCSEC = (67.8526, 78.6944, 0.2785)
# -------------------------------------------------------------------------------------


def leap_seconds(utc: Column) -> Column:
    """TAI-UTC in force; instants before the first row take the first value.  As-of over a fixed table."""
    out = F.lit(LEAP_SECONDS[0][1])
    for day, value in LEAP_SECONDS[1:]:
        out = F.when(utc >= F.lit(day).cast("timestamp_ntz"), value).otherwise(out)
    return out


def with_time(df: DataFrame, utc: str = "epoch") -> DataFrame:
    """Add ``jd_utc``, ``tai_utc``, ``days_tt`` and ``T`` (centuries) for a timestamp column."""
    seconds = F.unix_micros(c(utc).cast("timestamp")) / 1e6
    return (df.withColumn("tai_utc", leap_seconds(c(utc).cast("timestamp_ntz"))).withColumn("jd_utc", seconds / 86400.0 + 2440587.5)
            .withColumn("days_tt", c("jd_utc") + (c("tai_utc") + TT_MINUS_TAI_S) / 86400.0 - 2451545.0)
            .withColumn("T", c("days_tt") / 36525.0))


def sun_terms(t: Column) -> tuple[Column, Column]:
    """Geometric ecliptic longitude (deg) and distance (AU) of the sun."""
    mean, m = t * 36000.76983 + 280.46646 + t * t * 0.0003032, F.radians(t * 35999.05029 + 357.52911 - t * t * 0.0001537)
    e = F.lit(0.016708634) - t * 0.000042037 - t * t * 0.0000001267
    centre = ((F.lit(1.914602) - t * 0.004817 - t * t * 0.000014) * F.sin(m) + (F.lit(0.019993) - t * 0.000101) * F.sin(m * 2)
              + F.sin(m * 3) * 0.000289)
    r = (F.lit(1.0) - e * e) * 1.000001018 / (F.lit(1.0) + e * F.cos(m + F.radians(centre)))
    lon = mean + centre
    return lon - F.floor(lon / 360.0) * 360.0, r


def obliquity(t: Column) -> Column:
    return F.radians(F.lit(23 + 26 / 60) + (F.lit(21.448) - t * (t * (F.lit(0.00059) - t * 0.001813) + 46.8150)) / 3600.0)


def _precess(df: DataFrame, p: str, t: Column) -> DataFrame:
    """Rotate equatorial-of-date columns ``{p}x..z`` to J2000 (transpose of the precession matrix)."""
    sec = math.pi / 648000
    df = df.withColumn("_zt", (t * 2306.2181 + t * t * 0.30188 + t * t * t * 0.017998) * sec).withColumn(
        "_zz", (t * 2306.2181 + t * t * 1.09468 + t * t * t * 0.018203) * sec).withColumn(
        "_th", (t * 2004.3109 - t * t * 0.42665 - t * t * t * 0.041833) * sec)
    x, y, z = c(p + "x"), c(p + "y"), c(p + "z")
    # Undo the three turns one after the other.
    df = df.withColumn("_ax", F.cos("_zz") * x + F.sin("_zz") * y).withColumn("_ay", F.cos("_zz") * y - F.sin("_zz") * x)
    df = df.withColumn("_bx", F.cos("_th") * c("_ax") + F.sin("_th") * z).withColumn("_bz", F.cos("_th") * z - F.sin("_th") * c("_ax"))
    return (df.withColumn(p + "x", F.cos("_zt") * c("_bx") + F.sin("_zt") * c("_ay"))
            .withColumn(p + "y", F.cos("_zt") * c("_ay") - F.sin("_zt") * c("_bx")).withColumn(p + "z", c("_bz"))
            .drop("_zt", "_zz", "_th", "_ax", "_ay", "_bx", "_bz"))


def _equatorial(df: DataFrame, p: str, lon: Column, lat: Column, r: Column, t: Column) -> DataFrame:
    df = df.withColumn("_l", F.radians(lon)).withColumn("_b", F.radians(lat)).withColumn("_r", r).withColumn("_e", obliquity(t))
    ey, ez = c("_r") * F.cos("_b") * F.sin("_l"), c("_r") * F.sin("_b")
    df = df.withColumn(p + "x", c("_r") * F.cos("_b") * F.cos("_l")).withColumn(p + "y", ey * F.cos("_e") - ez * F.sin("_e")).withColumn(
        p + "z", ey * F.sin("_e") + ez * F.cos("_e"))
    return _precess(df.drop("_l", "_b", "_r", "_e"), p, t)


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("lon", "lat", "km")]))
def moon(t: pd.Series) -> pd.DataFrame:
    """Geocentric lunar longitude and latitude (deg) and distance (km): fundamental arguments times the term tables."""
    t = t.to_numpy(float)
    lp = 218.3164477 + 481267.88123421 * t - 0.0015786 * t**2 + t**3 / 538841 - t**4 / 65194000
    args = np.stack([
        297.8501921 + 445267.1114034 * t - 0.0018819 * t**2 + t**3 / 545868 - t**4 / 113065000,
        357.5291092 + 35999.0502909 * t - 0.0001536 * t**2 + t**3 / 24490000,
        134.9633964 + 477198.8675055 * t + 0.0087414 * t**2 + t**3 / 69699 - t**4 / 14712000,
        93.272095 + 483202.0175233 * t - 0.0036539 * t**2 - t**3 / 3526000 + t**4 / 863310000], axis=1) % 360
    ecc = (1 - 0.002516 * t - 0.0000074 * t**2)[:, None]
    sin = lambda deg: np.sin(np.radians(deg))

    def series(terms, column, wave):
        table = np.array(terms, dtype=float)
        return (table[:, column] * ecc ** np.abs(table[:, 1]) * wave(np.radians(args @ table[:, :4].T))).sum(axis=1)

    a1, a2, a3 = 119.75 + 131.849 * t, 53.09 + 479264.29 * t, 313.45 + 481266.484 * t
    mp, f = args[:, 2], args[:, 3]
    lon = series(LONGITUDE_TERMS, 4, np.sin) + 3958 * sin(a1) + 1962 * sin(lp - f) + 318 * sin(a2)
    lat = (series(LATITUDE_TERMS, 4, np.sin) - 2235 * sin(lp) + 382 * sin(a3) + 175 * sin(a1 - f) + 175 * sin(a1 + f)
           + 127 * sin(lp - mp) - 115 * sin(lp + mp))
    return pd.DataFrame({"lon": (lp + lon / 1e6) % 360, "lat": lat / 1e6, "km": 385000.56 + series(LONGITUDE_TERMS, 5, np.cos) / 1000})


def angular_radius(distance_m: Column) -> Column:
    return F.degrees(F.asin(F.lit(SOLAR_RADIUS_M) / distance_m))


def orientation(df: DataFrame, days: str = "days_tt") -> DataFrame:
    """Add pole right ascension, declination and prime meridian (radians) as ``_ra, _dec, _w``."""
    d = c(days)
    e = lambda i: F.radians(d * LIBRATION[i - 1][1] + LIBRATION[i - 1][0])
    total = lambda start, table, fn: sum((fn(e(i)) * k for i, k in table.items()), start)
    return (df.withColumn("_ra", F.radians(total(d * (0.0031 / 36525) + 269.9949, POLE_RA, F.sin)))
            .withColumn("_dec", F.radians(total(d * (0.013 / 36525) + 66.5392, POLE_DEC, F.cos)))
            .withColumn("_w", F.radians(total(d * 13.17635815 + 38.3213 - d * d * 1.4e-12, MERIDIAN, F.sin))))


def to_body(df: DataFrame, p: str, out: str) -> DataFrame:
    """Direction ``{p}x..z`` in J2000 to body axes ``{out}x..z``: along the node, its normal and the pole."""
    x, y, z = c(p + "x"), c(p + "y"), c(p + "z")
    df = df.withColumn("_n", F.cos("_ra") * y - F.sin("_ra") * x)
    df = df.withColumn("_q", F.cos("_ra") * x + F.sin("_ra") * y)
    df = df.withColumn("_m", F.cos("_dec") * z - F.sin("_dec") * c("_q"))
    return (df.withColumn(out + "x", F.cos("_w") * c("_n") + F.sin("_w") * c("_m"))
            .withColumn(out + "y", F.cos("_w") * c("_m") - F.sin("_w") * c("_n"))
            .withColumn(out + "z", F.cos("_dec") * c("_q") + F.sin("_dec") * z).drop("_n", "_q", "_m"))


def sub_solar(epochs: DataFrame, utc: str = "epoch") -> DataFrame:
    """Sub-solar point, distance and angular radius per epoch, with two light-time steps."""
    df = with_time(epochs, utc).withColumn("_moon", moon(c("T")))
    df = _equatorial(df, "m", c("_moon.lon"), c("_moon.lat"), c("_moon.km") * 1000.0, c("T")).drop("_moon").withColumn("_t", c("T"))
    for step in range(3):
        lon, r = sun_terms(c("_t"))
        df = _equatorial(df, "s", lon, F.lit(0.0), r * AU_M, c("_t"))
        for a in "xyz":
            df = df.withColumn("r" + a, c("s" + a) - c("m" + a))
        df = df.withColumn("distance_m", F.sqrt(c("rx") * c("rx") + c("ry") * c("ry") + c("rz") * c("rz")))
        df = df.withColumn("_t", c("T") - c("distance_m") / (LIGHT_M_S * 86400 * 36525))
    for a in "xyz":
        df = df.withColumn("u" + a, c("r" + a) / c("distance_m"))
    return body_direction(orientation(df))


def body_direction(df: DataFrame) -> DataFrame:
    """Sub-solar latitude, longitude and angular radius from ``u`` (J2000) and the orientation angles."""
    df = to_body(df, "u", "b")
    drop = [k for k in df.columns if k[0] == "_" or k in {a + b for a in "msru" for b in "xyz"}]
    return df.withColumn("sub_lat", F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("bz")))))).withColumn(
        "sub_lon", F.degrees(F.atan2("by", "bx"))).withColumn("sun_radius_deg", angular_radius(c("distance_m"))).drop(*drop)


def at_site(df: DataFrame, lat: Column, lon: Column) -> DataFrame:
    """Sun elevation and azimuth in the horizon frame of a site."""
    la, lo = F.radians(lat), F.radians(lon)
    df = df.withColumn("_h", F.cos(lo) * c("bx") + F.sin(lo) * c("by"))
    up = F.cos(la) * c("_h") + F.sin(la) * c("bz")
    north, east = F.cos(la) * c("bz") - F.sin(la) * c("_h"), F.cos(lo) * c("by") - F.sin(lo) * c("bx")
    az = F.degrees(F.atan2(east, north))
    return df.withColumn("elevation_deg", F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up))))).withColumn(
        "azimuth_deg", F.when(az < 0, az + 360).otherwise(az)).drop("_h")


def disc_fraction(h: Column, r: Column) -> Column:
    """Share of a disc of radius ``r`` above a straight horizon when its centre is ``h`` above it."""
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), h / F.nullif(r, F.lit(0.0))))
    part = (F.acos(-x) + x * F.sqrt(F.lit(1.0) - x * x)) / math.pi
    return F.when(r <= 0, F.when(h > 0, 1.0).otherwise(0.0)).when(h >= r, 1.0).when(h <= -r, 0.0).otherwise(part)


def shadow_length(height: Column, elevation_deg: Column) -> Column:
    return F.when(elevation_deg <= 0, float("inf")).otherwise(height / F.tan(F.radians(F.greatest(elevation_deg, F.lit(1e-12)))))


def separation_deg(a: tuple, b: tuple) -> Column:
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def chebyshev(coef: Column, x: Column) -> Column:
    """Series sum by the backward recurrence."""
    start = F.struct(F.lit(0.0).alias("b1"), F.lit(0.0).alias("b2"))
    tail = F.reverse(F.slice(coef, F.lit(2), F.size(coef) - 1))
    step = lambda a, k: F.struct((x * 2 * a["b1"] - a["b2"] + k).alias("b1"), a["b1"].alias("b2"))
    return F.aggregate(tail, start, step, lambda a: x * a["b1"] - a["b2"] + F.get(coef, F.lit(0)))


def mean_earth_from_angles(df: DataFrame, p: str, out: str, phi: Column, delta: Column, w: Column) -> DataFrame:
    """Direction to mean-Earth axes from three orientation angles and the fixed principal-axis turn."""
    df = df.withColumn("_x", c(p + "x")).withColumn("_y", c(p + "y")).withColumn("_z", c(p + "z"))

    def turn(d: DataFrame, a: Column, i: str, j: str) -> DataFrame:
        d = d.withColumn("_a", a).withColumn("_i", F.cos("_a") * c(i) - F.sin("_a") * c(j)).withColumn(
            "_j", F.sin("_a") * c(i) + F.cos("_a") * c(j))
        return d.drop(i, j).withColumnRenamed("_i", i).withColumnRenamed("_j", j).drop("_a")

    a1, a2, a3 = (F.lit(math.radians(s / 3600)) for s in PRINCIPAL_TO_MEAN_ARCSEC)
    df = turn(turn(turn(df, -phi, "_x", "_y"), -delta, "_y", "_z"), -w, "_x", "_y")
    df = turn(turn(turn(df, a1, "_x", "_y"), a2, "_z", "_x"), a3, "_y", "_z")
    return df.withColumnRenamed("_x", out + "x").withColumnRenamed("_y", out + "y").withColumnRenamed("_z", out + "z")
