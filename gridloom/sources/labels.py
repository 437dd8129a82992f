"""Keyword labels (``KEY = VALUE <unit>``) of raster products and the rules they must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.codes import BODY_RADIUS_M

c = F.col
# --- fixed values: keywords of the label format ---------------------------------------
NUMBERS = ["LINES", "LINE_SAMPLES", "SAMPLE_BITS", "MAP_SCALE", "SAMPLE_PROJECTION_OFFSET", "LINE_PROJECTION_OFFSET",
           "CENTER_LATITUDE", "CENTER_LONGITUDE", "A_AXIS_RADIUS"]
TEXTS = ["SAMPLE_TYPE", "MAP_PROJECTION_TYPE", "COORDINATE_SYSTEM_NAME"]
OPTIONAL = ["SCALING_FACTOR", "OFFSET", "MISSING_CONSTANT"]
# --------------------------------------------------------------------------------------


def value(text: Column, key: str) -> Column:
    """First value of a keyword without its unit and quotes; null when absent."""
    raw = F.regexp_extract(text, rf"(?m)^[ \t]*{key}[ \t]*=[ \t]*(.+)$", 1)
    bare = F.trim(F.regexp_replace(F.trim(raw), r"<[^>]*>\s*$", ""))
    unquoted = F.trim(F.regexp_replace(bare, "^[\"'](.*)[\"']$", "$1"))
    return F.when(raw != "", unquoted)


def parse_labels(labels: DataFrame) -> DataFrame:
    """Typed columns for ``labels(product_id, text)`` with the list of missing required keys."""
    num = lambda k: value(c("text"), k).try_cast("double").alias(k.lower())
    t = labels.select("product_id", *[num(k) for k in NUMBERS], *[value(c("text"), k).alias(k.lower()) for k in TEXTS],
                      F.coalesce(value(c("text"), "SCALING_FACTOR").try_cast("double"), F.lit(1.0)).alias("scaling_factor"),
                      F.coalesce(value(c("text"), "OFFSET").try_cast("double"), F.lit(0.0)).alias("offset"),
                      value(c("text"), "MISSING_CONSTANT").try_cast("double").alias("missing_constant"))
    missing = F.array_compact(F.array(*[F.when(c(k.lower()).isNull(), F.lit(k)) for k in NUMBERS + TEXTS]))
    return t.withColumn("missing", missing).withColumn("radius_m", c("a_axis_radius") * 1000).withColumn(
        "signed", c("sample_type").rlike("(?i)INTEGER") & ~c("sample_type").rlike("(?i)UNSIGNED")).withColumn(
        "little_endian", c("sample_type").rlike("(?i)^LSB|PC_"))


def product_problems(products: DataFrame) -> DataFrame:
    """Georeferencing rules: polar stereographic with a pole origin, the reference sphere, the body frame, 16 bits."""
    rules = [
        ("missing keywords", F.size("missing") > 0),
        ("projection", ~c("map_projection_type").rlike(r"(?i)^POLAR\s+STEREOGRAPHIC$")),
        ("pole origin", F.abs(F.abs(c("center_latitude")) - 90) > 1e-12),
        ("sphere", F.abs(c("radius_m") - BODY_RADIUS_M) > 1e-6),
        ("frame", ~c("coordinate_system_name").rlike("(?i)MEAN EARTH/POLAR AXIS")),
        ("sample bits", c("sample_bits") != 16)]
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))
    return products.select("product_id", F.explode(found).alias("problem"))
