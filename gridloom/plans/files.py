"""Rasters, digests and manifests as files: written, listed, hashed and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import fixtures as fx
from gridloom.fixtures import rnd, with_ctes
from gridloom.plans.raster import r6
from gridloom.registry import query
from gridloom.session import scratch_path
from gridloom.sources import raster_io, raw_raster

c = F.col
INT16 = {"dtype": "i2", "scale": 0.01, "missing": -32768}
WINDOW = (10, 19)


def _stored(spark, sf, **options) -> str:
    """Path of the layers with holes, written as raw files."""
    path = scratch_path(spark, "raw")
    raw_raster.write_raw(fx.with_holes(fx.raster_rows(spark, sf)), path, fx.WIDTH, **options)
    return path


def _read(spark, sf, path: str, **options) -> DataFrame:
    """All layers of a stored raster."""
    names = [r["layer_id"] for r in fx.layers(spark, sf).select("layer_id").collect()]
    return reduce(DataFrame.unionByName, [raw_raster.read_raw(spark, f"{path}/{n}", fx.WIDTH, n, **options) for n in names])


def _summary(rows: DataFrame) -> DataFrame:
    """Rows, missing samples, range and sum of each layer."""
    known = F.filter("heights", lambda h: h.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda t, h: t + h.cast("double"))
    return rows.groupBy("layer_id").agg(
        F.count("*").alias("rows"), F.sum(F.size("heights") - F.size(known)).alias("missing"),
        F.min(F.array_min("heights")).cast("double").alias("low"), F.max(F.array_max("heights")).cast("double").alias("high"), r6(F.sum(total), 3).alias("total"))


def _summary_sql(height: str, where: str = "true") -> str:
    return f"""SELECT layer_id, count(DISTINCT row) AS rows, (count(*)-count(v))::BIGINT AS missing, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high, {rnd('sum(v::DOUBLE)', 3)} AS total
       FROM (SELECT layer_id, row, {height} AS v FROM holes WHERE {where}) GROUP BY layer_id"""


@query("raster_files", with_ctes(_summary_sql("h"), "holes"))
def raster_files(spark, sf):
    """Float32 files written by row ranges and read back."""
    return _summary(_read(spark, sf, _stored(spark, sf)))


@query("raster_file_window", with_ctes(_summary_sql("h", f"row BETWEEN {WINDOW[0]} AND {WINDOW[1]}"), "holes"))
def raster_file_window(spark, sf):
    """A window of rows: the filter skips the other ranges of each file."""
    return _summary(_read(spark, sf, _stored(spark, sf), partition_rows=4).where(c("row").between(*WINDOW)))


@query("raster_int16", with_ctes(_summary_sql("(floor(h::DOUBLE/0.01e0+0.5e0)*0.01e0)::FLOAT"), "holes"))
def raster_int16(spark, sf):
    """16-bit big-endian product with scale factor and missing constant, written and read back."""
    options = {**INT16, "endian": "big"}
    return _summary(_read(spark, sf, _stored(spark, sf, **options), **options))


@query("raster_artifacts", with_ctes(
    f"SELECT layer_id, (count(DISTINCT row)*{fx.WIDTH * 4})::BIGINT AS bytes, true AS available, 0::BIGINT AS changed FROM samples GROUP BY layer_id", "samples"))
def raster_artifacts(spark, sf):
    """Listing of the written files: sizes, availability, and files whose digest in ranges changes between two readings."""
    path = _stored(spark, sf)
    layer = F.element_at(F.split("path", "/"), -2)
    first, again = (raw_raster.artifacts(spark, path, range_bytes=4096) for _ in range(2))
    both = first.join(again.select("path", c("sha256").alias("later")), "path", "left")
    return both.groupBy(layer.alias("layer_id")).agg(
        F.sum("bytes").alias("bytes"), F.bool_and("available").alias("available"), F.count_if(~c("sha256").eqNullSafe(c("later"))).alias("changed"))


@query("manifest_files", with_ctes(
    """SELECT 'layer_'||layer_id AS check_id, true AS passed, (width*height)::BIGINT AS found FROM layers
       UNION ALL SELECT 'manifest_present', false, 1::BIGINT""", "layers"))
def manifest_files(spark, sf):
    """A manifest document written and read back, and a missing one as a failed check."""
    layers = fx.layers(spark, sf)
    entry = F.struct("ordinal", "layer_id", "res", "width", "height")
    path = scratch_path(spark, "manifest")
    layers.agg(F.array_sort(F.collect_list(entry)).alias("layers")).coalesce(1).write.json(path)
    found = raster_io.read_manifest(spark, path, "layers array<struct<ordinal:int,layer_id:string,res:double,width:int,height:bigint>>")
    listed = found.select(F.explode("layers").alias("e")).join(layers.select("layer_id", c("width").alias("w"), c("height").alias("h")), c("e.layer_id") == c("layer_id"), "left")
    checks = listed.select(F.concat(F.lit("layer_"), c("e.layer_id")).alias("check_id"), ((c("e.width") == c("w")) & (c("e.height") == c("h"))).alias("passed"),
                           (c("e.width") * c("e.height")).cast("long").alias("found"))
    missing = raster_io.read_manifest(spark, path + "-absent", "layers array<string>")
    return checks.unionByName(missing.select("check_id", "passed", "found"))
