"""Raster files: raw float32 and int16 products, Parquet rows, manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from gridloom.sources.raw_raster import read_raw


def read_float32(spark: SparkSession, path: str, width: int, layer_id: str) -> DataFrame:
    """Row-major little-endian float32 raster; NaN becomes null."""
    return read_raw(spark, path, width, layer_id)


def read_int16(spark: SparkSession, path: str, width: int, layer_id: str, little_endian: bool = True, signed: bool = True,
               scale: float = 1.0, missing: int | None = None) -> DataFrame:
    """Fixed-length 16-bit product with scale factor and missing constant."""
    return read_raw(spark, path, width, layer_id, dtype="i2" if signed else "u2", endian="little" if little_endian else "big",
                    scale=scale, missing=missing)


def write_rows(rows: DataFrame, path: str) -> None:
    """Parquet rows partitioned by layer and sorted by row, so row windows prune row groups."""
    rows.repartitionByRange("layer_id", "row").sortWithinPartitions("layer_id", "row").write.mode("overwrite").partitionBy("layer_id").parquet(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Manifest records; a missing one gives a single failed check instead of an error."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)
    except AnalysisException:
        return spark.sql("SELECT 'manifest_present' AS check_id, false AS passed, 'error' AS severity, CAST(1 AS BIGINT) AS found")
