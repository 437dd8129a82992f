"""Point reads on nested rasters: finest covering layer, bilinear, nearest and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import half_up, row_bands

c = F.col
GRID = ("res", "width", "height", "min_x", "min_z")


def cell_level(layers: DataFrame) -> DataFrame:
    """Add ``level``: the power of two a quarter of which is at most the layer's longer side, the cell size it is spread over."""
    side = F.greatest(c("max_x") - c("min_x"), c("max_z") - c("min_z"))
    return layers.withColumn("level", F.when(side > 0, F.ceil(F.log2(side)).cast("int") - 2).otherwise(0))


def layer_cells(layers: DataFrame) -> DataFrame:
    """(level, gx, gz, found): per cell the layers a point in it may lie on, as structs that compare by fineness.

    A layer meets at most six cells each way.  The finest layer that covers a whole cell hides every coarser one
    there, so stacks of layers leave one entry a cell and only borders of finer layers stay beside it.
    """
    size = F.pow(F.lit(2.0), c("level"))
    spread = cell_level(layers).withColumn("cell", size).withColumn(
        "gx", F.explode(F.sequence(F.floor(c("min_x") / c("cell")), F.floor(c("max_x") / c("cell"))))).withColumn(
        "gz", F.explode(F.sequence(F.floor(c("min_z") / c("cell")), F.floor(c("max_z") / c("cell")))))
    whole = ((c("min_x") <= c("gx") * c("cell")) & (c("max_x") >= (c("gx") + 1) * c("cell"))
             & (c("min_z") <= c("gz") * c("cell")) & (c("max_z") >= (c("gz") + 1) * c("cell")))
    entry = F.struct("res", "ordinal", "layer_id", "min_x", "max_x", "min_z", "max_z")
    spread = spread.select("level", "gx", "gz", entry.alias("e"), whole.alias("whole"))
    hides = spread.where("whole").groupBy("level", "gx", "gz").agg(F.min("e").alias("cover"))
    shown = spread.join(hides, ["level", "gx", "gz"], "left").where(c("cover").isNull() | (c("e") <= c("cover")))
    return shown.groupBy("level", "gx", "gz").agg(F.collect_list("e").alias("found"))


def finest_layer(points: DataFrame, layers: DataFrame, name: str = "layer_id") -> DataFrame:
    """Add the finest layer that covers ``x, z``; the earlier layer wins a tie, none gives null.

    Layers lie in a hierarchy of cells by their extent.  A point looks up its cell once per level in use: equi-joins whose
    small side Spark broadcasts or sorts by its own size check, whatever the number of layers.  Levels are powers of
    two, so their number is bounded by the range of extents and not by the number of layers.
    """
    cells = layer_cells(layers)
    levels = sorted(r["level"] for r in cell_level(layers).select("level").distinct().collect())
    here = lambda e: c("x").between(e["min_x"], e["max_x"]) & c("z").between(e["min_z"], e["max_z"])
    out, best = points, []
    for i, level in enumerate(levels):
        own = cells.where(c("level") == level).select(c("gx").alias("_gx"), c("gz").alias("_gz"), c("found").alias("_found"))
        out = out.join(own, (F.floor(c("x") / 2.0**level) == c("_gx")) & (F.floor(c("z") / 2.0**level) == c("_gz")), "left")
        out = out.withColumn(f"_best{i}", F.array_min(F.filter("_found", here))).drop("_gx", "_gz", "_found")
        best.append(f"_best{i}")
    found = F.array_min(F.array_compact(F.array(*best)))["layer_id"] if best else F.lit(None).cast("string")
    return out.withColumn(name, found).drop(*best)


def read_ground(points: DataFrame, rows: DataFrame, layers: DataFrame, probes: dict[str, tuple[float, float]],
                before: int = 0, after: int = 1) -> DataFrame:
    """Bilinear heights at ``x, z`` plus offsets given in cells, for points that carry ``layer_id``.

    Each point is joined once, to the band of raster rows around it; all probes are read from that
    band.  A point off its layer gets a key that cannot match, spread over many values, so that a
    large share of outside points does not end in one task.
    """
    p = points.join(layers.select("layer_id", *GRID), "layer_id", "left")
    fr = (c("z") - c("min_z")) / c("res")
    on_grid = (fr >= 0) & (fr <= c("height") - 1)
    miss = -1 - F.pmod(F.xxhash64("x", "z"), F.lit(4096))
    p = p.withColumn("_row", F.when(on_grid, F.floor(fr)).otherwise(miss))
    band = row_bands(rows.select("layer_id", "row", "heights"), before, after).select(
        "layer_id", c("row").alias("_row"), "band")
    j = p.join(band, ["layer_id", "_row"], "left")

    def at(dx: float, dz: float) -> Column:
        fcol = (c("x") + dx * c("res") - c("min_x")) / c("res")
        frow = (c("z") + dz * c("res") - c("min_z")) / c("res")
        inside = (fcol >= 0) & (frow >= 0) & (fcol <= c("width") - 1) & (frow <= c("height") - 1)
        c0, r0 = F.floor(fcol), F.floor(frow)
        c1, r1 = F.least(c0 + 1, c("width") - 1), F.least(r0 + 1, c("height") - 1)
        tc, tr = fcol - c0, frow - r0

        def h(col: Column, row: Column) -> Column:
            line = F.get("band", (row - c("_row") + before).cast("int"))
            return F.get(line, col.cast("int")).cast("double")

        value = (h(c0, r0) * (1 - tc) * (1 - tr) + h(c1, r0) * tc * (1 - tr)
                 + h(c0, r1) * (1 - tc) * tr + h(c1, r1) * tc * tr)
        return F.when(inside, value)

    keep = list(points.columns)
    return j.select(*keep, "res", *[at(*off).alias(n) for n, off in probes.items()])


def bilinear(points: DataFrame, rows: DataFrame, layers: DataFrame, name: str = "ground") -> DataFrame:
    return read_ground(points, rows, layers, {name: (0.0, 0.0)}).drop("res")


def surface_at(points: DataFrame, rows: DataFrame, layers: DataFrame) -> DataFrame:
    """Height, normal-based slope and roughness at arbitrary points from reads one cell away."""
    read = read_ground(points, rows, layers, {
        "ground": (0, 0), "_w": (-1, 0), "_e": (1, 0), "_n": (0, -1), "_s": (0, 1)}, before=1, after=2)
    nx, nz = -(c("_e") - c("_w")) / (c("res") * 2), -(c("_s") - c("_n")) / (c("res") * 2)
    ny = F.lit(1.0) / F.sqrt(nx * nx + 1 + nz * nz)
    diffs = F.array_compact(F.array(*[(c(n) - c("ground")) * (c(n) - c("ground")) for n in ("_e", "_w", "_s", "_n")]))
    rough = F.sqrt(F.aggregate(diffs, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(diffs), F.lit(0)))
    return read.select(
        *points.columns, "res", "ground",
        F.coalesce(nx * ny, F.lit(0.0)).alias("nx"), F.coalesce(ny, F.lit(1.0)).alias("ny"),
        F.coalesce(nz * ny, F.lit(0.0)).alias("nz"),
        F.coalesce(F.when(ny.isNotNull(), F.degrees(F.acos(F.least(F.lit(1.0), ny)))), F.lit(0.0)).alias("slope_deg"),
        F.coalesce(rough, F.lit(0.0)).alias("roughness"))


def nearest_code(points: DataFrame, rows: DataFrame, layers: DataFrame, mask: str = "semantic") -> DataFrame:
    """Mask value of the nearest sample, clamped into the grid."""
    p = points.join(layers.select("layer_id", *GRID), "layer_id", "left")
    clamp = lambda v, n: F.least(F.greatest(half_up(v), F.lit(0)), n - 1)
    p = p.withColumn("_col", clamp((c("x") - c("min_x")) / c("res"), c("width"))).withColumn(
        "_row", F.coalesce(clamp((c("z") - c("min_z")) / c("res"), c("height")),
                           -1 - F.pmod(F.xxhash64("x", "z"), F.lit(4096))))
    return p.join(rows.select("layer_id", c("row").alias("_row"), mask), ["layer_id", "_row"], "left").select(
        *points.columns, F.get(mask, c("_col").cast("int")).cast("int").alias("code"))


def read_pixels(targets: DataFrame, rows: DataFrame, width: int, height: int, layer_id: str) -> DataFrame:
    """Bilinear read at fractional ``pcol, prow`` of one raster; null outside or next to no-data."""
    grid = targets.sparkSession.sql(
        f"SELECT '{layer_id}' AS layer_id, 1D AS res, {width} AS width, {height}L AS height, 0D AS min_x, 0D AS min_z")
    p = targets.withColumn("layer_id", F.lit(layer_id)).withColumn("x", c("pcol")).withColumn("z", c("prow"))
    return bilinear(p, rows.where(c("layer_id") == layer_id), grid, "h").drop("layer_id", "x", "z")
