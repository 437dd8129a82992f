"""Exact percentiles by narrowing value histograms: counting scans only, no sort of the values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.session import scratch_path

c = F.col
BINS = 4096


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """``keys`` with one column per entry of ``shares``: the value at rank ceil(share * n), at least 1, of each group.

    Every pass counts each group's values in ``bins`` bins of the range that still holds the wanted rank, keeps the
    bin with that rank and takes its smallest and largest value as the next range.  Both ends of a range fall into
    different bins, so ranges shrink by about ``bins`` a pass until they hold a single value: two to five passes for
    doubles.  A pass shuffles at most ``bins`` counts per group, share and task.  Nulls do not count; NaN is the largest
    value; a group without values is absent.  Between passes only the ranges (one row per group and share) are kept.
    """
    rows = df.where(c(value).isNotNull()).select(*keys, c(value).cast("double").alias("_v"))
    number = ~F.isnan("_v")
    start = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(~number).alias("_nan"),
                                    F.min(F.when(number, c("_v"))).alias("_lo"), F.max(F.when(number, c("_v"))).alias("_hi"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in shares.items())))
    state = start.withColumn("_w", wanted).select(
        *keys, c("_w.name").alias("_name"), "_lo", "_hi",
        F.greatest(F.lit(1), F.least(c("_n"), F.ceil(c("_n") * c("_w.p")))).cast("long").alias("_rank"), (c("_n") - c("_nan")).alias("_numbers"))
    beyond = c("_rank") > c("_numbers")
    state = state.select(*keys, "_name", F.when(~beyond, c("_lo")).alias("_lo"), F.when(~beyond, c("_hi")).alias("_hi"), "_rank",
                         (beyond | (c("_lo") == c("_hi"))).alias("_done"))
    on = [c(f"_k{i}").eqNullSafe(c(k)) for i, k in enumerate(keys)]
    while True:
        state = _kept(state)
        still = state.where(~c("_done"))
        if still.isEmpty():
            break
        ask = still.select(*(c(k).alias(f"_k{i}") for i, k in enumerate(keys)), c("_name").alias("_name2"), "_lo", "_hi", "_rank")
        inside = rows.join(ask, [*on, c("_v").between(c("_lo"), c("_hi"))])
        # The width of a range of doubles may itself be too large for one; then halves are taken first.
        wide = c("_hi") - c("_lo") == float("inf")
        place = F.when(wide, (c("_v") / 2 - c("_lo") / 2) / (c("_hi") / 2 - c("_lo") / 2)).otherwise((c("_v") - c("_lo")) / (c("_hi") - c("_lo")))
        placed = inside.withColumn("_bin", F.least(F.floor(place * bins), F.lit(bins - 1)).cast("int"))
        counts = placed.groupBy(*keys, "_name2", "_rank", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        order = Window.partitionBy(*keys, "_name2").orderBy("_bin")
        counts = counts.withColumn("_upto", F.sum("_c").over(order))
        hit = counts.where((c("_upto") >= c("_rank")) & (c("_upto") - c("_c") < c("_rank")))
        narrowed = hit.select(*keys, c("_name2").alias("_name"), c("_a").alias("_lo"), c("_b").alias("_hi"),
                              (c("_rank") - (c("_upto") - c("_c"))).alias("_rank"), (c("_a") == c("_b")).alias("_done"))
        state = state.where("_done").unionByName(narrowed)
    nan = F.coalesce("_lo", F.lit(float("nan")))
    return state.groupBy(*keys).agg(*(F.max(F.when(c("_name") == name, nan)).alias(name) for name in shares))


def _kept(state: DataFrame) -> DataFrame:
    """Ranges as a written table, so that a pass is not run again by the next one."""
    path = scratch_path(state.sparkSession, "ranges")
    state.write.parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)
