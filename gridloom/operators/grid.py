"""Raster rows, windows, tiles, decimation and quantisation.

A raster is a table of rows ``(layer_id, row, heights array<float>, masks ...)``.  Keys are never
coarser than one raster row, so a layer that holds most of the data still spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROW_BLOCK = 256


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def dist(dx: Column, dz: Column) -> Column:
    """Plane distance; the magnitudes here need no overflow-safe (and much slower) hypot."""
    return F.sqrt(dx * dx + dz * dz)


def row_bands(rows: DataFrame, before: int, after: int, value: str = "heights", block: int = ROW_BLOCK) -> DataFrame:
    """Add ``band``: the arrays of rows ``row-before .. row+after`` (null where there is no such row).

    Rows go to blocks of a bounded number of rows, border rows also to the block next door; the
    window therefore sorts at most ``block + before + after`` rows per group and the shuffle carries
    each row once plus a small halo.
    """
    r = F.col("row")
    home = F.floor(r / block)
    blocks = F.array_distinct(F.array(F.floor((r - after) / block), home, F.floor((r + before) / block)))
    spread = rows.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy("layer_id", "_block").orderBy("row")

    def at(offset: int) -> Column:
        if offset == 0:
            return F.col(value)
        shift = F.lag if offset < 0 else F.lead
        steps = abs(offset)
        out = F.lit(None)
        # Gaps in the row numbers: look at each of the nearest rows for the wanted number.
        for k in range(1, steps + 1):
            out = F.when(shift(r, k).over(w) == r + offset, shift(F.col(value), k).over(w)).otherwise(out)
        return out

    band = F.array(*[at(o) for o in range(-before, after + 1)])
    return spread.withColumn("band", band).where(F.col("_block") == F.col("_home")).drop("_block", "_home")


def cells(rows: DataFrame, layers: DataFrame, masks: tuple[str, ...] = ()) -> DataFrame:
    """One record per sample with its four neighbours ``w e n s`` and the layer's grid columns."""
    band = row_bands(rows.select("layer_id", "row", "heights", *masks), 1, 1)
    grid = layers.select("layer_id", "res", "width", "height", "min_x", "min_z")
    flat = band.join(grid, "layer_id").select(
        "layer_id", "row", "res", "width", "height", "min_x", "min_z", *masks,
        F.get("band", F.lit(0)).alias("_up"), F.get("band", F.lit(1)).alias("_mid"),
        F.get("band", F.lit(2)).alias("_down"), F.posexplode("heights").alias("col", "_h"))
    c = F.col("col")
    pick = lambda arr, i: F.get(arr, i).cast("double")
    return flat.select(
        "layer_id", "row", "col", F.col("_h").cast("double").alias("h"),
        pick("_mid", c - 1).alias("w"), pick("_mid", c + 1).alias("e"),
        pick("_up", c).alias("n"), pick("_down", c).alias("s"),
        "res", "width", "height", "min_x", "min_z",
        *[F.get(m, c).cast("int").alias(m) for m in masks])


def samples(rows: DataFrame, layers: DataFrame) -> DataFrame:
    """One record per sample with world coordinates; no shuffle."""
    grid = layers.select("layer_id", "res", "width", "height", "min_x", "min_z")
    return rows.select("layer_id", "row", F.posexplode("heights").alias("col", "h")).join(grid, "layer_id").select(
        "layer_id", "row", "col", F.col("h").cast("double").alias("h"), "res", "width", "height",
        (F.col("min_x") + F.col("col") * F.col("res")).alias("x"),
        (F.col("min_z") + F.col("row") * F.col("res")).alias("z"))


def vertical_bounds(rows: DataFrame) -> DataFrame:
    """Minimum and maximum per layer from the row arrays, without exploding them."""
    return rows.groupBy("layer_id").agg(
        F.coalesce(F.min(F.array_min("heights")).cast("double"), F.lit(0.0)).alias("min_y"),
        F.coalesce(F.max(F.array_max("heights")).cast("double"), F.lit(0.0)).alias("max_y"))


def quality(rows: DataFrame) -> DataFrame:
    """Sample, no-data and infinity counts with the mean of the valid samples."""
    valid = F.filter("heights", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    per_row = rows.select(
        "layer_id", F.size("heights").cast("long").alias("n"), F.size(valid).cast("long").alias("ok"),
        F.size(F.filter("heights", lambda v: F.abs(v) == float("inf"))).cast("long").alias("inf"),
        F.aggregate(valid, F.lit(0.0), lambda a, v: a + v).alias("total"))
    return per_row.groupBy("layer_id").agg(
        F.sum("n").alias("samples"), F.sum("ok").alias("valid"), F.sum("inf").alias("infinite"),
        (F.sum("n") - F.sum("ok") - F.sum("inf")).alias("missing"),
        (F.sum("total") / F.nullif(F.sum("ok"), F.lit(0))).alias("mean"))


def rebase_to_mean(sample_rows: DataFrame, radius: float) -> DataFrame:
    """Subtract the layer mean and the curvature drop from every valid sample."""
    datum = sample_rows.groupBy("layer_id").agg(F.avg("h").alias("datum"))
    return sample_rows.join(datum, "layer_id").withColumn(
        "local", F.col("h") - F.col("datum") - (F.col("x") * F.col("x") + F.col("z") * F.col("z")) / (2 * radius))


def read_windows(requests: DataFrame, rows: DataFrame, layers: DataFrame) -> DataFrame:
    """Clamped window reads: one output record per request and raster row, heights cut to the window."""
    r = requests.join(layers.select("layer_id", "width", "height"), "layer_id")
    clamp = lambda v, hi: F.least(F.greatest(v, F.lit(0)), hi)
    r = r.select(
        "request_id", "layer_id",
        clamp(F.col("col0"), F.col("width") - 1).alias("c0"), clamp(F.col("row0"), F.col("height") - 1).alias("r0"),
        clamp(F.col("col0") + F.col("w"), F.col("width")).alias("c1"),
        clamp(F.col("row0") + F.col("h"), F.col("height")).alias("r1"))
    r = r.withColumn("inside", (F.col("c1") > F.col("c0")) & (F.col("r1") > F.col("r0")))
    wanted = r.withColumn("row", F.explode_outer(
        F.when(F.col("inside"), F.sequence(F.col("r0"), F.col("r1") - 1))))
    return wanted.join(rows.select("layer_id", "row", "heights"), ["layer_id", "row"], "left").select(
        "request_id", "layer_id", "row", "c0", "inside",
        F.when(F.col("inside"), F.slice("heights", (F.col("c0") + 1).cast("int"), (F.col("c1") - F.col("c0")).cast("int"))
               ).alias("heights"))


def read_tiles(requests: DataFrame, rows: DataFrame, layers: DataFrame) -> DataFrame:
    """Strict tile reads with decimation: out-of-grid requests are reported, not clamped."""
    r = requests.join(layers.select("layer_id", "width", "height", "res"), "layer_id", "left")
    bad = (F.when(F.col("width").isNull(), "no such layer")
           .when((F.col("col0") < 0) | (F.col("row0") < 0) | (F.col("w") < 1) | (F.col("h") < 1), "not a positive range")
           .when(F.col("stride") < 1, "bad stride")
           .when((F.col("col0") + F.col("w") > F.col("width")) | (F.col("row0") + F.col("h") > F.col("height")),
                 "outside the grid").otherwise("ok"))
    r = r.withColumn("status", bad)
    rows_wanted = F.when(F.col("status") == "ok",
                         F.sequence(F.col("row0"), F.col("row0") + F.col("h") - 1, F.col("stride")))
    wanted = r.withColumn("row", F.explode_outer(rows_wanted))
    cut = F.filter(F.slice("heights", (F.col("col0") + 1).cast("int"), F.col("w").cast("int")),
                   lambda _v, i: i % F.col("stride") == 0)
    return wanted.join(rows.select("layer_id", "row", "heights"), ["layer_id", "row"], "left").select(
        "request_id", "layer_id", "status", "row", (F.col("res") * F.col("stride")).alias("spacing"),
        F.when(F.col("status") == "ok", F.floor((F.col("w") - 1) / F.col("stride")) + 1).alias("out_width"),
        F.when(F.col("status") == "ok", F.floor((F.col("h") - 1) / F.col("stride")) + 1).alias("out_height"),
        F.when(F.col("status") == "ok", cut).alias("heights"))


def tiles_in_bounds(boxes: DataFrame, layers: DataFrame, tile_size: int) -> DataFrame:
    """Tiles that a world box touches, from index arithmetic instead of an overlap join."""
    step = tile_size - 1
    b = boxes.join(layers.select("layer_id", "res", "width", "height",
                                 F.col("min_x").alias("_mx"), F.col("min_z").alias("_mz")), "layer_id")

    def index_range(lo: Column, hi: Column, origin: Column, n: Column) -> Column:
        first = F.greatest(F.lit(0), F.floor((lo - origin) / F.col("res")))
        last = F.least(n - 1, F.ceil((hi - origin) / F.col("res")))
        i0 = F.greatest(F.lit(0), F.ceil(first / step) - 1)
        i1 = F.least(F.floor(last / step), F.ceil((n - 1) / step) - 1)
        # Clipped last tile: its far edge is the last sample.
        return F.filter(F.when(i1 >= i0, F.sequence(i0, i1)),
                        lambda i: F.least((i + 1) * step, n - 1) >= first)

    cols = index_range(F.col("min_x"), F.col("max_x"), F.col("_mx"), F.col("width"))
    rws = index_range(F.col("min_z"), F.col("max_z"), F.col("_mz"), F.col("height"))
    out = b.withColumn("_c", F.explode(cols)).withColumn("_r", F.explode(rws))
    return out.select(
        *boxes.columns,
        F.format_string("%s_t%06d_%06d", F.col("layer_id"), F.col("_c") * step, F.col("_r") * step).alias("tile_id"))


def quantise(rows: DataFrame) -> DataFrame:
    """16-bit codes per row with the inverse mapping of the layer."""
    b = vertical_bounds(rows)
    span = F.col("max_y") - F.col("min_y")
    b = b.withColumn("range", F.when(span == 0, 1.0).otherwise(span))
    code = lambda v: F.coalesce(
        F.least(F.greatest(half_up((v.cast("double") - F.col("min_y")) / F.col("range") * 65535.0), F.lit(0)),
                F.lit(65535)), F.lit(0)).cast("int")
    return rows.join(b, "layer_id").select(
        "layer_id", "row", "heights", "min_y", (F.col("range") / 65535.0).alias("unit"),
        F.transform("heights", code).alias("codes"))
