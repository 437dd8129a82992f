"""Shared pieces of the text operators: table reads, written intermediates, native word expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import scratch_path

SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def removed_chars(text: Column, chars: str) -> Column:
    """Number of code points of ``text`` that are one of ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def let(value: Column, body) -> Column:
    """Bind ``value`` once, then use it several times in ``body`` without evaluating it again."""
    return F.element_at(F.transform(F.array(value), body), 1)
