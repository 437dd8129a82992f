"""Slope, normal and roughness stencils over ``grid.cells``; edge rules differ and keep their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.codes import CODE
from gridloom.operators.grid import dist, row_bands
from gridloom.session import cut_lineage

c = F.col


def _slope_deg(dx: Column, dz: Column) -> Column:
    return F.degrees(F.atan(dist(dx, dz)))


def interior() -> Column:
    return (c("col") > 0) & (c("row") > 0) & (c("col") < c("width") - 1) & (c("row") < c("height") - 1)


def interior_slope() -> Column:
    """Central differences; null on the border."""
    return F.when(interior(), _slope_deg((c("e") - c("w")) / (c("res") * 2), (c("s") - c("n")) / (c("res") * 2)))


def classify_by_slope(current: Column, slope: Column) -> Column:
    """Fill class 0 inside the border from the slope; anything else keeps its class."""
    by_slope = (F.when(slope > 25, CODE["unsafe_slope"]).when(slope > 8, CODE["rough_regolith"])
                .otherwise(CODE["flat_regolith"]))
    return F.when(interior() & (current == 0), by_slope).otherwise(current)


def world_slope_on_grid() -> Column:
    """Slope of the surface normal; flat wherever a neighbour is missing."""
    nx, nz = -(c("e") - c("w")) / (c("res") * 2), -(c("s") - c("n")) / (c("res") * 2)
    return F.coalesce(F.degrees(F.acos(F.lit(1.0) / F.sqrt(nx * nx + 1 + nz * nz))), F.lit(0.0))


def clamped_slope() -> Column:
    """Neighbours clamped to the grid, divided by the real distance between them."""
    span_x = F.least(c("col") + 1, c("width") - 1) - F.greatest(c("col") - 1, F.lit(0))
    span_z = F.least(c("row") + 1, c("height") - 1) - F.greatest(c("row") - 1, F.lit(0))
    return _slope_deg((F.coalesce("e", "h") - F.coalesce("w", "h")) / (span_x * c("res")),
                      (F.coalesce("s", "h") - F.coalesce("n", "h")) / (span_z * c("res")))


def mesh_normal() -> Column:
    """Vertex normal: clamped neighbours, fixed divisor."""
    nx = -(F.coalesce("e", "h") - F.coalesce("w", "h")) / (c("res") * 2)
    nz = -(F.coalesce("s", "h") - F.coalesce("n", "h")) / (c("res") * 2)
    length = F.sqrt(nx * nx + 1 + nz * nz)
    return F.struct((nx / length).alias("x"), (F.lit(1.0) / length).alias("y"), (nz / length).alias("z"))


def roughness() -> Column:
    """Root mean square difference to the neighbours that exist."""
    sq = lambda n: F.coalesce((c(n) - c("h")) * (c(n) - c("h")), F.lit(0.0))
    count = sum((c(n).isNotNull() & c("h").isNotNull()).cast("int") for n in ("e", "w", "s", "n"))
    total = sum((sq(n) for n in ("e", "w", "s")), sq("n"))
    return F.when(count > 0, F.sqrt(total / F.nullif(count, F.lit(0)))).otherwise(0.0)


def fill_no_data(rows: DataFrame, max_passes: int | None = None) -> DataFrame:
    """Fill holes with the mean of the valid 3x3 neighbours, pass by pass until nothing changes (or a given number).

    Every pass reads the result of the pass before as a whole, so a filled value never depends on
    the order in which samples are visited.
    """
    def holes(df: DataFrame) -> int:
        n = F.size(F.filter("heights", lambda v: v.isNull() | F.isnan(v)))
        return df.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]

    left, passes = holes(rows), 0
    while left and passes != max_passes:
        passes += 1
        banded = row_bands(rows, 1, 1)

        def filled(v: Column, i: Column) -> Column:
            near = F.array_compact(F.array(*[
                F.get(F.get("band", F.lit(b)), i + d).cast("double") for b in range(3) for d in (-1, 0, 1)]))
            mean = F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(near), F.lit(0))
            return F.when(v.isNotNull(), v).otherwise(mean.cast("float"))

        rows = cut_lineage(banded.withColumn("heights", F.transform("heights", filled)).drop("band"))
        now = holes(rows)
        if now == left:
            break
        left = now
    return rows
