"""Order-dependent helpers that never put one key's whole history into one task.

The log of a single layer can hold a large share of all rows, so a plain window partitioned by the layer would be
one task.  A scan cuts the order into buckets of bounded span, works inside each bucket and carries one row per
bucket; the carried rows are scanned in the same way, level by level.  With three levels of 4096 a top task sees one
row in 16.7 million of its key.  A bucket is bounded by its span of order values, so few rows may share a value.

Keys may be null (a null is a key of its own); so may values: a sum, maximum, minimum or last value passes over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = 4096
LEVELS = 3
c = F.col

#: Per kind: the window function, the total of a bucket (value, order), and how a carried value meets a local one.
KINDS = {
    "last": (lambda v: F.last(v, ignorenulls=True), lambda v, at: F.max_by(v, F.when(v.isNotNull(), at)), lambda far, near: F.coalesce(near, far)),
    "sum": (F.sum, lambda v, at: F.sum(v), lambda far, near: F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))),
    "max": (F.max, lambda v, at: F.max(v), lambda far, near: F.greatest(far, near)),
    "min": (F.min, lambda v, at: F.min(v), lambda far, near: F.least(far, near)),
}


def _bucket(order_col: str, size: int) -> Column:
    return F.floor(c(order_col) / F.lit(size)).cast("long")


def _until(keys: list[str], order_col: str, end: int):
    return Window.partitionBy(*keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)


def _carried(local: DataFrame, carry: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``local`` with the ``_c`` of its bucket; null keys match."""
    names = [f"_key{i}" for i in range(len(keys))]
    there = carry.select(*[c(k).alias(n) for k, n in zip(keys, names)], c("_b").alias("_at"), "_c")
    on = c(at).eqNullSafe(c("_at"))
    for k, n in zip(keys, names):
        on = on & local[k].eqNullSafe(c(n))
    return local.join(there, on, "left").drop(*names, "_at")


def _before_buckets(heads: DataFrame, keys: list[str], kind: str, bucket: int, levels: int) -> DataFrame:
    """(keys, _b, _c): what all earlier buckets of the key hold together, from ``heads(keys, _b, _t)``."""
    over, total, both = KINDS[kind]
    if levels <= 1:
        return heads.select(*keys, "_b", over(c("_t")).over(_until(keys, "_b", -1)).alias("_c"))
    h = heads.withColumn("_up", _bucket("_b", bucket))
    local = h.select(*keys, "_b", "_up", over(c("_t")).over(_until([*keys, "_up"], "_b", -1)).alias("_l"))
    tops = h.groupBy(*keys, "_up").agg(total(c("_t"), c("_b")).alias("_t")).withColumnRenamed("_up", "_b")
    up = _before_buckets(tops, keys, kind, bucket, levels - 1)
    return _carried(local, up, keys, "_up").select(*keys, "_b", both(c("_c"), c("_l")).alias("_c"))


def scan(df: DataFrame, keys: list[str], order_col: str, value: Column, kind: str, name: str, inclusive: bool = False,
         bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """``df`` with ``name``: sum, max, min or last value of ``value`` over the rows of the key before this one (or up to it)."""
    over, total, both = KINDS[kind]
    d = df.withColumns({"_b": _bucket(order_col, bucket), "_x": value})
    local = d.withColumn("_l", over(c("_x")).over(_until([*keys, "_b"], order_col, 0 if inclusive else -1)))
    heads = d.groupBy(*keys, "_b").agg(total(c("_x"), c(order_col)).alias("_t"))
    carry = _before_buckets(heads, keys, kind, bucket, levels - 1)
    return _carried(local, carry, keys, "_b").select(*[n for n in df.columns if n != name], both(c("_c"), c("_l")).alias(name))


def lag_in_order(df: DataFrame, keys: list[str], order_col: str, cols: list[str], prefix: str = "prev_",
                 bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """Value of ``cols`` in the previous row of the same key, for integer ``order_col``."""
    d = scan(df, keys, order_col, F.struct(*cols), "last", "_v", bucket=bucket, levels=levels)
    return d.select(*df.columns, *[c(f"_v.{n}").alias(prefix + n) for n in cols])


def running_sum_in_order(df: DataFrame, keys: list[str], order_col: str, value: Column, name: str,
                         bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order_col`` order."""
    return scan(df, keys, order_col, value, "sum", name, inclusive=True, bucket=bucket, levels=levels)
