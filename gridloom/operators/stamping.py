"""Crater and rock footprints on the raster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.codes import CODE
from gridloom.functions import crater
from gridloom.operators import fold, grid, sampling

c = F.col


def crater_table(seeds: DataFrame) -> DataFrame:
    """Full geometry for ``seeds(id, cx, cz, diameter, degradation, ellipticity, rotation)``."""
    geo = crater.geometry(c("diameter"), c("degradation"))
    return seeds.select("*", *[v.alias(k) for k, v in geo.items()]).withColumn(
        "reach", F.greatest(c("diameter") * 0.6, c("ejecta_extent")))


CRATER_NUMBERS = ["cx", "cz", "diameter", "depth", "rim_height", "rim_width", "floor_ratio", "ejecta_amplitude", "ellipticity",
                  "rotation", "reach"]


BOX = {"min_x": "bx0", "max_x": "bx1", "min_z": "bz0", "max_z": "bz1"}
#: Craters crowd in the middle of the fine layers, so their blocks of rows are low.
CRATER_BLOCK = 4


def _crater_boxes(craters: DataFrame) -> DataFrame:
    return craters.select("*", c("id").alias("seq"), (c("cx") - c("reach")).alias("bx0"), (c("cx") + c("reach")).alias("bx1"),
                          (c("cz") - c("reach")).alias("bz0"), (c("cz") + c("reach")).alias("bz1"))


def _crater_rows(craters: DataFrame, layers: DataFrame) -> DataFrame:
    r = fold.box_rows(_crater_boxes(craters), layers, BOX)
    return r.withColumn("cell", c("res") * c("res"))


def crater_changes(craters: DataFrame, layers: DataFrame) -> DataFrame:
    """Height change of every crater at every sample it reaches, per layer."""
    out = fold.map_boxes(_crater_rows(craters, layers), CRATER_NUMBERS, ["layer_id", "row", "seq", "cell"], crater.shape, "w double, zone int")
    return out.select("layer_id", "row", "col", "seq", F.lit(fold.ADD).alias("mode"), F.lit(0.0).alias("t"), "w",
                      F.nullif("zone", F.lit(0)).alias("zone"), "cell")


def stamped_heights(craters: DataFrame, rows: DataFrame, layers: DataFrame) -> DataFrame:
    """Last height, number of stamps and ``code`` (class of the last crater that marked it) of every sample that craters change."""
    f = _crater_boxes(craters)
    r = fold.block_records(f, layers, BOX, CRATER_BLOCK)
    return fold.block_fold(r, rows, CRATER_NUMBERS, [], crater.shape, "", steps=False, last="zone", block=CRATER_BLOCK)


def crater_volumes(craters: DataFrame, layers: DataFrame) -> DataFrame:
    """Excavated and deposited volume and touched samples per crater and layer, summed per raster row in the task."""
    part = fold.map_boxes(_crater_rows(craters, layers), CRATER_NUMBERS, ["layer_id", "seq", "cell"], crater.volume_shape,
                          "dug double, piled double", total=True)
    return part.groupBy("layer_id", "seq").agg(
        F.sum(c("dug") * c("cell")).alias("excavated"), F.sum(c("piled") * c("cell")).alias("deposited"), F.sum("n").alias("touched"))


def last_zone(changes: DataFrame) -> DataFrame:
    """Class of the last crater that marked a sample; samples only touched outside the rim keep theirs."""
    return changes.groupBy("layer_id", "row", "col").agg(
        F.max_by(c("zone"), F.when(c("zone").isNotNull(), c("seq"))).alias("code"))


def rock_cover(rocks: DataFrame, layers: DataFrame) -> DataFrame:
    """Samples under the disc of a rock (the larger horizontal semi-axis)."""
    r = F.greatest("scale_x", "scale_z")
    f = rocks.select("layer_id", "rock_id", c("x").alias("rx"), c("z").alias("rz"), r.alias("r"),
                     (c("x") - r).alias("bx0"), (c("x") + r).alias("bx1"), (c("z") - r).alias("bz0"), (c("z") + r).alias("bz1"))
    f = fold.explode_boxes(f, layers, {"min_x": "bx0", "max_x": "bx1", "min_z": "bz0", "max_z": "bz1"}, "rock_id")
    dx, dz = c("x") - c("rx"), c("z") - c("rz")
    return f.where(dx * dx + dz * dz <= c("r") * c("r")).select("layer_id", "row", "col", "rock_id")


def mark_rocks(rows: DataFrame, rocks: DataFrame, layers: DataFrame) -> DataFrame:
    marks = rock_cover(rocks, layers).select("layer_id", "row", "col").distinct().withColumn(
        "code", F.lit(CODE["rock_field"]).cast("tinyint"))
    return fold.apply_to_rows(rows, marks, "semantic", "code")


def seat_rocks(seeds: DataFrame, rows: DataFrame, layers: DataFrame) -> DataFrame:
    """Rock centres on the finest ground below them, sunk by their burial fraction."""
    placed = seeds if "layer_id" in seeds.columns else sampling.finest_layer(seeds, layers)
    g = sampling.bilinear(placed, rows, layers, "ground")
    return g.withColumn("y", c("ground") + c("scale_y") * (F.lit(1.0) - c("buried") * 2))


def reseat_rocks(rocks: DataFrame, edited_rows: DataFrame, layers: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lower rocks inside changed boxes to the new ground; never raise one.

    ``boxes`` is one row per changed layer (already grouped), so the test is a literal per box.
    """
    hit = F.lit(False)
    for b in boxes.collect():
        hit = hit | (c("x").between(b["min_x"], b["max_x"]) & c("z").between(b["min_z"], b["max_z"]))
    inside = seat_rocks(rocks.where(hit).drop("ground").withColumnRenamed("y", "old_y"), edited_rows, layers)
    moved = inside.withColumn("moved", F.coalesce(c("y") < c("old_y"), F.lit(False)))
    return moved.withColumn("y", F.when(c("moved"), c("y")).otherwise(c("old_y")))


def annulus_area(radius: Column) -> Column:
    """Area of the rim annulus between 0.9 and 1.4 radii."""
    return radius * radius * (math.pi * (1.4**2 - 0.9**2))


def ordinal_in_order(df: DataFrame, keys: list[str], order_col: str, name: str) -> DataFrame:
    """Zero-based position of each row within its key.

    Range partitioning sorts the data over all tasks; only the per-partition counts are combined, so
    a single key never has to fit into one task.
    """
    from pyspark.sql.window import Window

    spread = df.repartitionByRange(fold.task_count(df.sparkSession), *keys, order_col).withColumn("_p", F.spark_partition_id())
    spread = fold_checkpoint(spread)
    inside = Window.partitionBy("_p", *keys).orderBy(order_col)
    local = spread.withColumn("_in", F.row_number().over(inside) - 1)
    counts = spread.groupBy("_p", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("_p", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return local.join(offset, ["_p", *keys]).withColumn(name, c("_in") + c("_o")).drop("_p", "_in", "_o")


def fold_checkpoint(df: DataFrame) -> DataFrame:
    """The partition number is part of the data, so it is fixed before it is used twice."""
    from gridloom.session import cut_lineage

    return cut_lineage(df)


def budget_sample(features: DataFrame, id_col: str, first: str, budget: int) -> DataFrame:
    """At most ``budget`` features: all flagged ones if they fit, the rest evenly spaced in id order.

    Position ``i`` of a stratum of ``n`` with budget ``m`` is kept when ``floor(j*n/m) = i`` for some j.
    """
    counts = {r[first]: r["n"] for r in features.groupBy(first).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    features = features.withColumn("total", F.lit(total))
    if total <= budget:
        return features.withColumn("truncated", F.lit(False))
    flagged = min(counts.get(True, 0), budget)
    share = {True: flagged, False: budget - flagged}
    numbered = ordinal_in_order(features, [first], id_col, "_i")

    def kept(flag: bool) -> Column:
        n, m = counts.get(flag, 0), share[flag]
        if m <= 0:
            return F.lit(False)
        j = F.ceil(c("_i") * m / n)
        return (F.floor(j * n / m) == c("_i")) & (j < m)

    return numbered.where(F.when(c(first), kept(True)).otherwise(kept(False))).drop("_i").withColumn("truncated", F.lit(True))
