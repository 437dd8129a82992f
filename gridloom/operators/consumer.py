"""Jobs of a consumer of the tables: tier mosaics, blocks, decimation, buckets, import rules, refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col


def tier_mosaic(layers: DataFrame) -> DataFrame:
    """Each layer minus the footprint of the next finer one, as bands that share border samples."""
    w = Window.orderBy(F.desc("res"))  # a dimension table: one row per layer
    nxt = lambda n: F.lead(n).over(w)
    l = layers.withColumn("fx0", nxt("min_x")).withColumn("fx1", nxt("max_x")).withColumn("fz0", nxt("min_z")).withColumn("fz1", nxt("max_z"))
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0)), c(n) - 1).cast("long")
    l = (l.withColumn("c0", clamp(F.floor((c("fx0") - c("min_x")) / c("res")), "width"))
         .withColumn("c1", clamp(F.ceil((c("fx1") - c("min_x")) / c("res")), "width"))
         .withColumn("r0", clamp(F.floor((c("fz0") - c("min_z")) / c("res")), "height"))
         .withColumn("r1", clamp(F.ceil((c("fz1") - c("min_z")) / c("res")), "height")))
    wide, tall, zero = c("width").cast("long"), c("height"), F.lit(0).cast("long")

    def band(tag: str, when: Column, col0, row0, width, height) -> Column:
        return F.when(when, F.struct(F.lit(tag).alias("tag"), col0.alias("col0"), row0.alias("row0"), width.alias("w"), height.alias("h")))

    nested = c("fx0").isNotNull()
    mid = c("r1") - c("r0") + 1
    bands = F.array_compact(F.array(
        band("full", ~nested, zero, zero, wide, tall), band("north", nested & (c("r0") >= 1), zero, zero, wide, c("r0") + 1),
        band("south", nested & (c("r1") <= tall - 2), zero, c("r1"), wide, tall - c("r1")),
        band("west", nested & (c("c0") >= 1), zero, c("r0"), c("c0") + 1, mid),
        band("east", nested & (c("c1") <= wide - 2), c("c1"), c("r0"), wide - c("c1"), mid)))
    return l.select("layer_id", "res", "min_x", "min_z", "width", "height", F.explode(bands).alias("b")).select(
        "layer_id", "b.*", "res", "min_x", "min_z", "width", "height")


def split_blocks(regions: DataFrame, quads: int = 256) -> DataFrame:
    """Blocks of at most ``quads`` cells a side with shared edges; degenerate bands give none."""
    starts = lambda first, n: F.when(c(n) > 1, F.sequence(c(first), c(first) + c(n) - 2, F.lit(quads).cast("long")))
    b = regions.withColumn("bc", F.explode(starts("col0", "w"))).withColumn("br", F.explode(starts("row0", "h")))
    size = lambda at, first, n: F.least(F.lit(quads + 1).cast("long"), c(first) + c(n) - c(at))
    return b.select(*[n for n in regions.columns if n not in ("col0", "row0", "w", "h")], c("bc").alias("col0"), c("br").alias("row0"),
                    size("bc", "col0", "w").alias("w"), size("br", "row0", "h").alias("h"))


def sample_indices(start: Column, count: Column, step: Column) -> Column:
    """Every ``step``-th index from ``start``, always with the last one."""
    last = start + count - 1
    return F.filter(F.sequence(start, last), lambda i: ((i - start) % step == 0) | (i == last))


def decimation(blocks: DataFrame, focus_x: Column, focus_z: Column, radius: float, max_side: int = 512) -> DataFrame:
    """Step per block: 1 near the focus (distance from the point to the block), coarse elsewhere."""
    far = F.greatest(F.lit(1), F.ceil(F.greatest(c("width"), c("height")) / max_side))
    edge = lambda o, at, n: (c(o) + c(at) * c("res"), c(o) + (c(at) + c(n) - 1) * c("res"))
    (x0, x1), (z0, z1) = edge("min_x", "col0", "w"), edge("min_z", "row0", "h")
    dx = F.least(F.greatest(focus_x, x0), x1) - focus_x
    dz = F.least(F.greatest(focus_z, z0), z1) - focus_z
    step = F.when(dx * dx + dz * dz <= radius * radius, 1).otherwise(far).cast("long")
    b = blocks.withColumn("step", step)
    return b.withColumn("cols", sample_indices(c("col0"), c("w"), c("step"))).withColumn("rows", sample_indices(c("row0"), c("h"), c("step")))


def rock_cells(rocks: DataFrame, cell: float = 16.0, batch: int = 128) -> DataFrame:
    """Spatial cell and batch number of every rock, in id order inside the cell.

    The order inside a crowded cell comes from range partitions, not from one window over the cell.
    """
    from gridloom.operators.stamping import ordinal_in_order

    r = rocks.withColumn("cell_x", F.floor(c("x") / cell)).withColumn("cell_z", F.floor(c("z") / cell))
    return ordinal_in_order(r, ["cell_x", "cell_z"], "rock_id", "_i").withColumn("batch", F.floor(c("_i") / batch)).drop("_i")


def tile_requests(boxes: DataFrame, layers: DataFrame) -> DataFrame:
    """Smallest tile that covers a world box on its layer, or why there is none."""
    l = layers.select("layer_id", "res", "width", "height", c("min_x").alias("lx0"), c("max_x").alias("lx1"), c("min_z").alias("lz0"), c("max_z").alias("lz1"))
    j = boxes.join(l, "layer_id", "left")
    status = (F.when(c("res").isNull(), "no such layer").when((c("max_x") < c("min_x")) | (c("max_z") < c("min_z")), "unordered")
              .when((c("max_x") < c("lx0")) | (c("min_x") > c("lx1")) | (c("max_z") < c("lz0")) | (c("min_z") > c("lz1")), "disjoint").otherwise("ok"))

    def span(lo, hi, a, b, n):
        cut = lambda v: F.least(F.greatest(c(v), c(a)), c(b))
        first = F.floor((cut(lo) - c(a)) / c("res"))
        return first, F.least(F.greatest(F.ceil((cut(hi) - c(a)) / c("res")), first), c(n) - 1)

    (c0, c1), (r0, r1) = span("min_x", "max_x", "lx0", "lx1", "width"), span("min_z", "max_z", "lz0", "lz1", "height")
    ok = status == "ok"
    return j.select(*boxes.columns, status.alias("status"), F.when(ok, c0).alias("col0"), F.when(ok, r0).alias("row0"),
                    F.when(ok, c1 - c0 + 1).alias("tile_w"), F.when(ok, r1 - r0 + 1).alias("tile_h"))


def refresh_blocks(boxes: DataFrame, blocks: DataFrame, layers: DataFrame, quads: int, margin: float) -> DataFrame:
    """Blocks of a full-layer split whose world box meets a changed box, widened by a margin.

    Block numbers follow from the box by arithmetic, so there is no overlap join.
    """
    l = layers.select("layer_id", "res", "width", "height", c("min_x").alias("lx"), c("min_z").alias("lz"))
    j = boxes.join(l, "layer_id")

    def numbers(lo, hi, origin, n):
        a, b = (c(lo) - margin - c(origin)) / c("res"), (c(hi) + margin - c(origin)) / c("res")
        first, last = F.greatest(F.lit(0), F.ceil(a / quads) - 1), F.least(F.floor(b / quads), F.ceil((c(n) - 1) / quads) - 1)
        return F.filter(F.when(last >= first, F.sequence(first, last)), lambda i: F.least((i + 1) * quads, c(n) - 1) >= a)

    hit = j.withColumn("bc", F.explode(numbers("min_x", "max_x", "lx", "width"))).withColumn("br", F.explode(numbers("min_z", "max_z", "lz", "height")))
    return hit.select(*boxes.columns, (c("bc") * quads).alias("col0"), (c("br") * quads).alias("row0"))


def import_problems(artifacts: DataFrame, layers: DataFrame) -> DataFrame:
    """Duplicate and unsafe artifact paths, duplicate layers or roles, tiers that are not strictly finer or off the grid."""
    dup = artifacts.groupBy("path").agg(F.count("*").alias("n")).where(c("n") > 1).select(F.lit("duplicate path").alias("rule"), c("path").alias("subject"))
    unsafe = artifacts.where(c("path").rlike(r"(^/)|(^|/)\.\.(/|$)|\\")).select(F.lit("unsafe path").alias("rule"), c("path").alias("subject"))
    rep = lambda n, rule: layers.groupBy(n).agg(F.count("*").alias("n")).where(c("n") > 1).select(F.lit(rule).alias("rule"), c(n).alias("subject"))
    w = Window.orderBy(F.desc("res"), "ordinal")
    t = layers.withColumn("pr", F.lag("res").over(w)).withColumn("px", F.lag("min_x").over(w))
    off = F.abs((c("min_x") - c("px")) / c("pr") - F.floor((c("min_x") - c("px")) / c("pr") + 0.5)) > 1e-5
    tiers = t.where(c("res") >= c("pr")).select(F.lit("not finer").alias("rule"), c("layer_id").alias("subject"))
    grid = t.where(off).select(F.lit("off the parent grid").alias("rule"), c("layer_id").alias("subject"))
    return dup.unionByName(unsafe).unionByName(rep("layer_id", "duplicate layer")).unionByName(rep("role", "duplicate role")).unionByName(tiers).unionByName(grid)


def identity_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fields that differ between two copies, both ways and null-safe, over ``(field, value)`` rows."""
    j = a.join(b.select("field", c("value").alias("other")), "field", "full")
    status = F.when(c("other").isNull() & c("value").isNotNull(), "only left").when(c("value").isNull() & c("other").isNotNull(), "only right").otherwise("differs")
    return j.where(~c("value").eqNullSafe(c("other"))).select("field", status.alias("status"))
