"""The edit log: validity, footprints, changes per sample, mass conservation, records and replay.

Every edit becomes rows of ``(layer, row, col, seq, mode, t, w)`` that depend only on its geometry, so
a whole log is one spread, one join with the raster rows and one ordered fold.  The few edits that
read other samples (slope, ramp, smooth, and conserving edits whose net depends on the ground) get
those readings as columns beforehand.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.codes import (CODE, FEATURE_CLASS, FOOTPRINT_CLASS, OPERATION_KINDS, REPOSE_ANGLE_DEG,
                            SEMANTIC_CLASSES, SPARSE_SAMPLE_CAP)
from gridloom.functions import brush, noise
from gridloom.operators import fold, grid, sampling
from gridloom.operators.grid import half_up
from gridloom.operators.rules import violations

c = F.col
TAN_REPOSE = math.tan(math.radians(REPOSE_ANGLE_DEG))
READS_GROUND = ("slope", "ramp", "smooth")
INVERSE = {"raise": "lower", "lower": "raise", "berm": "trench", "trench": "berm"}
LONG = ("trench", "berm", "wheel_track")


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def op_rules(layer_ids: list[str]) -> list[tuple[str, Column]]:
    """Named conditions that make a record invalid."""
    k = c("kind")
    absent_or_finite = lambda n: c(n).isNull() | _finite(c(n))
    need = lambda kinds, n: k.isin(*kinds) & ~_finite(c(n))
    return [
        ("kind", ~k.isin(*OPERATION_KINDS)),
        ("layer", ~c("layer_id").isin(*layer_ids)),
        ("centre", ~(_finite(c("cx")) & _finite(c("cz")))),
        ("radius", ~_finite(c("radius")) | (c("radius") <= 0)),
        ("strength", ~_finite(c("strength"))),
        ("falloff", ~_finite(c("falloff")) | (c("falloff") <= 0)),
        ("target", ~absent_or_finite("target") | need(["flatten", "ramp", "pad", "polygonal_cut", "polygonal_fill"], "target")),
        ("heading", ~absent_or_finite("heading") | need(["slope", "ramp", "wheel_track", "trench", "berm"], "heading")),
        ("length", ~absent_or_finite("length") | (c("length") <= 0) | need(["ramp", "wheel_track", "trench", "berm"], "length")),
        ("noise_seed", (k == "noise") & (F.coalesce(F.length("noise_seed"), F.lit(0)) == 0)),
        ("semantic_class", (k == "semantic_paint") & ~F.coalesce(c("semantic_class").isin(*SEMANTIC_CLASSES), F.lit(False))),
        ("polygon", k.isin("polygonal_cut", "polygonal_fill") & (F.coalesce(F.size("polygon"), F.lit(0)) < 3)),
        ("polygon_vertex", F.coalesce(F.exists("polygon", lambda v: ~(_finite(v["x"]) & _finite(v["z"]))), F.lit(False))),
    ]


def op_violations(ops: DataFrame, layer_ids: list[str]) -> DataFrame:
    """Add ``violations``: the names of the rules a record breaks (empty when it is valid)."""
    return violations(ops, op_rules(layer_ids))


def valid_ops(ops: DataFrame, layers: DataFrame) -> DataFrame:
    """Records that break no rule: a plain conjunction, so it stays compiled and no list is built."""
    ok = F.lit(True)
    for _, bad in op_rules([r["layer_id"] for r in layers.select("layer_id").distinct().collect()]):
        ok = ok & ~F.coalesce(bad, F.lit(True))
    return ops.where(ok)


def resolve_layer(ops: DataFrame, layers: DataFrame, column: str = "requested_layer") -> DataFrame:
    """A named layer must exist; an omitted one means the finest."""
    finest = layers.agg(F.min_by("layer_id", F.struct("res", "ordinal")).alias("f")).first()["f"]
    known = layers.select(c("layer_id").alias("_known")).distinct()
    j = ops.join(known, ops[column] == c("_known"), "left")
    return j.withColumn("resolved_layer", F.when(c(column).isNull(), F.lit(finest)).otherwise(c("_known"))).withColumn(
        "status", F.when(c("resolved_layer").isNull(), "unknown layer").otherwise("ok")).drop("_known")


# ------------------------------------------------------------------ footprints
def geometry(ops: DataFrame, layers: DataFrame) -> DataFrame:
    """Per-edit constants: heading vector, edge band, influence box, ring and reported clamps."""
    o = ops.join(layers.select("layer_id", c("res").alias("_res")), "layer_id")
    k, r, length = c("kind"), c("radius"), F.coalesce(c("length"), F.lit(0.0))
    band = F.greatest(c("_res") * 2, r * 0.25)
    reach = (F.when(k.isin(*LONG), length / 2 + r).when(k == "crater_stamp", r * 1.3)
             .when(k == "ramp", length + r + band * 2).when(k == "pad", length / 2 + r + band).otherwise(r))
    poly = c("polygon").isNotNull() & k.startswith("polygonal")
    side = lambda agg, axis: agg(F.transform("polygon", lambda v: v[axis]))
    o = o.withColumn("edge", band).withColumn("reach", reach)
    box = lambda agg, axis, centre, sign: F.when(poly, side(agg, axis) + r * sign).otherwise(centre + c("reach") * sign)
    o = (o.withColumn("bx0", box(F.array_min, "x", c("cx"), -1)).withColumn("bx1", box(F.array_max, "x", c("cx"), 1))
          .withColumn("bz0", box(F.array_min, "z", c("cz"), -1)).withColumn("bz1", box(F.array_max, "z", c("cz"), 1)))
    o = o.withColumn("ring_x", F.when(poly, (c("bx0") + c("bx1")) / 2).otherwise(c("cx"))).withColumn(
        "ring_z", F.when(poly, (c("bz0") + c("bz1")) / 2).otherwise(c("cz")))
    far = F.array_max(F.transform("polygon", lambda v: grid.dist(v["x"] - c("ring_x"), v["z"] - c("ring_z"))))
    inner = (F.when(poly, far + r).when(k.isin("ramp", "pad", *LONG), c("reach")).otherwise(r))
    cap = r * TAN_REPOSE
    return (o.withColumn("ring_inner", inner)
            .withColumn("ax", F.sin(F.radians(F.coalesce("heading", F.lit(0.0)))))
            .withColumn("az", -F.cos(F.radians(F.coalesce("heading", F.lit(0.0)))))
            .withColumn("pile", F.least(F.abs(c("strength")), cap))
            .withColumn("repose_clamped", (k == "spoil_pile") & (F.abs(c("strength")) > cap))
            .withColumn("aliased", (k == "wheel_track") & (r * 0.3 < c("_res")))
            .withColumn("segments", F.when(poly, brush.edges(c("polygon")))).drop("_res"))


def changes(ops: DataFrame, layers: DataFrame) -> DataFrame:
    """Change rows of every edit at every sample of its footprint.

    ``ops`` may carry ``pivot`` (ground at a slope's centre) and ``near`` (ground at a ramp's start);
    smooth edits are produced by ``smooth_changes`` because they read their neighbours.
    """
    r = fold.box_rows(shape_inputs(ops, layers), layers, BOX)
    carry = ["seq", "kind", "layer_id", "row", "z", "res", "mass_conserving", "semantic_class"]
    return fold.map_boxes(r, SHAPE_NUMBERS, carry, _edit_shape, "mode tinyint, t double, w double, foot boolean")


BOX = {"min_x": "bx0", "max_x": "bx1", "min_z": "bz0", "max_z": "bz1"}
SHAPE_NUMBERS = ["code", "cx", "cz", "radius", "strength", "falloff", "target", "length", "ax", "az", "edge", "pile", "pivot", "near", "seed"]


def shape_inputs(ops: DataFrame, layers: DataFrame, every: bool = False) -> DataFrame:
    """Edits other than smooth ones, or ``every`` one, with what ``_edit_shape`` reads; of a smooth edit it makes the weights."""
    o = geometry(ops, layers)
    for name in ("pivot", "near"):
        if name not in o.columns:
            o = o.withColumn(name, F.lit(None).cast("double"))
    codes = F.array(*[F.lit(k) for k in OPERATION_KINDS])
    o = (o if every else o.where(c("kind") != "smooth")).withColumn("code", F.array_position(codes, c("kind"))).withColumn(
        "seed", noise.seed_of(c("noise_seed")))
    return o.withColumn("polygon", F.when(c("kind").startswith("polygonal"), F.flatten(
        F.transform("polygon", lambda v: F.array(v["x"], v["z"]))))).drop("segments")


def folded_changes(ops: DataFrame, rows: DataFrame, layers: DataFrame, steps: bool = True) -> DataFrame:
    """Changes of the edits folded on the stored rows: one row per change with ``x, z, foot, cell``, or per touched sample its last height."""
    r = fold.block_records(shape_inputs(ops, layers), layers, BOX)
    folded = fold.block_fold(r, rows, SHAPE_NUMBERS, ["res"], _edit_shape, "foot boolean", steps=steps)
    return folded.withColumn("cell", c("res") * c("res")).drop("res") if steps else folded


def _edit_shape(get, x, z):
    """Mode, target, weight and footprint flag of edits at samples; most tools are one falloff of a distance."""
    code = get("code").astype(int) - 1
    is_ = lambda *names: np.isin(np.arange(len(OPERATION_KINDS)), [OPERATION_KINDS.index(n) for n in names])[code]
    r, p, depth, length, band = get("radius"), np.maximum(0.01, get("falloff")), np.abs(get("strength")), get("length"), get("edge")
    dx, dz, ax, az = x - get("cx"), z - get("cz"), get("ax"), get("az")
    d, along, lateral = np.sqrt(dx * dx + dz * dz), dx * ax + dz * az, dz * ax - dx * az
    across, past = np.abs(lateral), np.maximum(0.0, np.abs(along) - length / 2)
    fall = lambda gap, reach, p: np.where(gap >= reach, 0.0, np.maximum(0.0, 1 - gap / reach) ** p)
    pad, ramp, poly, paint = is_("pad"), is_("ramp"), is_("polygonal_cut", "polygonal_fill"), is_("semantic_paint")
    pile, track, seg = is_("spoil_pile"), is_("wheel_track"), is_("trench", "berm")

    gap = d.copy()
    at = np.flatnonzero(seg)
    gap[at] = np.sqrt(past[at] ** 2 + lateral[at] ** 2)
    at = np.flatnonzero(pad)
    gap[at] = np.where(length[at] > 0, np.sqrt(past[at] ** 2 + np.maximum(0.0, across[at] - r[at]) ** 2), np.maximum(0.0, d[at] - r[at]))
    at = np.flatnonzero(ramp)
    gap[at] = np.maximum(0.0, across[at] - r[at])
    within = np.zeros(len(x), dtype=bool)
    if poly.any():
        within[poly], edge_gap = _polygon(*get("polygon"), poly, x[poly], z[poly])
        gap[poly] = np.where(within[poly], 0.0, edge_gap)
    reach = np.where(pad | ramp, band, r)
    # Powers only where an edit reaches; NaN stays with the plain formula.
    fw = np.zeros(len(x))
    at = np.flatnonzero(~(gap >= reach))
    fw[at] = fall(gap[at], reach[at], p[at])

    # Each of these shapes is worked out on its own samples only.
    w = fw.copy()
    # Ramp: faded in over the band at the near end and out past the far end.
    on_ramp = ramp & (along > 0) & (along < length + band)
    w[ramp & ~on_ramp] = 0.0
    at = np.flatnonzero(on_ramp)
    end_gap = np.where(along[at] < band[at], band[at] - along[at], np.maximum(0.0, along[at] - length[at]))
    w[at] = fw[at] * fall(end_gap, band[at], p[at])
    at = np.flatnonzero(is_("crater_stamp"))
    u, deep = d[at] / r[at], depth[at]
    stamp = np.where(u < 1, -deep * (1 - u * u), 0.0) + deep * 0.15 * np.exp(-(((u - 1) / 0.12) ** 2))
    w[at] = np.where(u < 1.3, stamp, 0.0)
    at = np.flatnonzero(pile)
    w[at] = np.where(d[at] < r[at], get("pile")[at] * (1 - d[at] / r[at]), 0.0)
    w = np.where(is_("raise", "berm"), depth * fw, np.where(is_("lower", "trench"), -depth * fw, np.where(paint, 0.0, w)))
    # Wheel track: two ruts with a raised berm on both sides of each.
    rutted = np.zeros(len(x), dtype=bool)
    at = np.flatnonzero(track)
    rut, deep, q = r[at] * 0.15, depth[at], p[at]
    berm_h = (deep * 2 * rut / (q + 1)) * 0.4 / (rut * 0.5)
    offs = [np.abs(lateral[at] - r[at] * 0.5 * side) for side in (-1, 1)]
    ruts = sum(np.where(o < rut, -deep * fall(o, rut, q), np.where(o < rut * 2, berm_h * (1 - np.abs((o - rut) / rut * 2 - 1)), 0.0))
               for o in offs)
    w[at] = np.where(past[at] > 0, 0.0, ruts)
    rutted[at] = (past[at] <= 0) & (np.minimum(*offs) < rut * 2)
    noisy = is_("noise")
    if noisy.any():
        w[noisy] *= noise.fbm_np(x[noisy], z[noisy], get("seed")[noisy].astype(np.int64), 2 / r[noisy], get("strength")[noisy])
    near, target = get("near"), get("target")
    t = np.where(is_("slope"), get("pivot") - along * (get("strength") / r), target)
    t = np.where(ramp, near + np.minimum(1.0, along / length) * (target - near), t)
    mode = np.where(is_("flatten", "slope", "ramp", "pad"), fold.BLEND, fold.ADD)
    mode = np.where(is_("polygonal_cut"), fold.CUT, np.where(is_("polygonal_fill"), fold.FILL, mode))
    foot = ((paint | pad) & (fw > 0)) | (on_ramp & (fw > 0) & (along <= length)) | (pile & (d < r) & (get("pile") > 0)) | rutted | within
    return {"keep": (w != 0) | foot, "mode": mode.astype(np.int8), "t": np.where(mode == fold.ADD, np.nan, t), "w": w, "foot": foot}


def _polygon(vertices, idx, chosen, x, z):
    """Even-odd test and boundary distance against flat ``x, z, x, z ...`` vertex lists, edge by edge."""
    offsets = vertices.offsets.to_numpy()
    flat = vertices.values.to_numpy(zero_copy_only=False).reshape(-1, 2)
    rec = idx[chosen]
    start, count = (offsets[rec] - offsets[0]) // 2, (offsets[rec + 1] - offsets[rec]) // 2
    inside, best = np.zeros(len(x), dtype=bool), np.full(len(x), np.inf)
    for e in range(int(count.max(initial=0))):
        on = e < count
        a, b = flat[start + np.where(on, (e - 1) % np.maximum(count, 1), 0)], flat[start + np.where(on, e, 0)]
        ex, ez = b[:, 0] - a[:, 0], b[:, 1] - a[:, 1]
        spans = (b[:, 1] > z) != (a[:, 1] > z)
        inside ^= on & spans & (x < (a[:, 0] - b[:, 0]) * (z - b[:, 1]) / (a[:, 1] - b[:, 1]) + b[:, 0])
        sq = ex * ex + ez * ez
        t = np.where(sq > 0, np.clip(((x - a[:, 0]) * ex + (z - a[:, 1]) * ez) / sq, 0.0, 1.0), 0.0)
        gap = np.sqrt((x - a[:, 0] - t * ex) ** 2 + (z - a[:, 1] - t * ez) ** 2)
        best = np.where(on, np.minimum(best, gap), best)
    return inside, best


def polygon_totals(ops: DataFrame, layers: DataFrame) -> DataFrame:
    """(seq, inside, distance_sum): samples of a polygon's box inside it, and the sum of all their distances to its edges."""
    r = fold.box_rows(shape_inputs(ops, layers).select("seq", "layer_id", "polygon", *BOX.values()), layers, BOX)
    part = fold.map_boxes(r, [], ["seq"], _polygon_totals, "inside double, d double", total=True)
    return part.groupBy("seq").agg(F.sum("inside").cast("long").alias("inside"), F.sum("d").alias("distance_sum"))


def _polygon_totals(get, x, z):
    every = np.ones(len(x), dtype=bool)
    within, gap = _polygon(*get("polygon"), every, x, z)
    return {"keep": every, "inside": within.astype(np.float64), "d": gap}


def smooth_changes(ops: DataFrame, rows: DataFrame, layers: DataFrame) -> DataFrame:
    """Smooth edits on a given surface: towards the 4-neighbour mean, borders left alone."""
    o = geometry(ops.where(c("kind") == "smooth"), layers)
    s = fold.explode_boxes(o, layers, {"min_x": "bx0", "max_x": "bx1", "min_z": "bz0", "max_z": "bz1"})
    w = brush.falloff(grid.dist(c("x") - c("cx"), c("z") - c("cz")), c("radius"), c("falloff"))
    s = s.where((c("col") > 0) & (c("row") > 0) & (c("col") < c("width") - 1) & (c("row") < c("height") - 1))
    s = s.withColumn("_w", w).where(c("_w") > 0)
    band = grid.row_bands(rows.select("layer_id", "row", "heights"), 1, 1).select("layer_id", "row", "band")
    s = s.join(band, ["layer_id", "row"])
    at = lambda b, d: F.get(F.get("band", F.lit(b)), (c("col") + d).cast("int")).cast("double")
    mean = (at(1, -1) + at(1, 1) + at(0, 0) + at(2, 0)) / 4
    dh = (mean - at(1, 0)) * c("_w") * F.least(F.lit(1.0), F.abs(c("strength")))
    return s.select("seq", "kind", "layer_id", "row", "col", "x", "z", "res", "mass_conserving", "semantic_class",
                    F.lit(fold.ADD).alias("mode"), F.lit(None).cast("double").alias("t"), dh.alias("w"),
                    F.lit(False).alias("foot")).where(c("w") != 0)


def delta_on(base: Column) -> Column:
    """Height change of a change row on a known base height."""
    gap = c("t") - base.cast("double")
    blend = gap * c("w")
    return (F.when(c("mode") == fold.ADD, c("w"))
            .when((c("mode") == fold.CUT) & ~(gap < 0), 0.0).when((c("mode") == fold.FILL) & ~(gap > 0), 0.0)
            .otherwise(blend))


def ring_changes(ops: DataFrame, net: DataFrame, layers: DataFrame) -> DataFrame:
    """Return the net volume of each conserving edit to the annulus around it.

    ``net(seq, net)`` is the signed volume.  An annulus without a single sample receives nothing.
    """
    o = geometry(ops, layers).join(net.where(c("net") != 0), "seq")
    outer = c("ring_inner") * 1.6
    o = o.select("seq", "layer_id", "net", "ring_x", "ring_z", "ring_inner", outer.alias("outer"),
                 (c("ring_x") - outer).alias("bx0"), (c("ring_x") + outer).alias("bx1"),
                 (c("ring_z") - outer).alias("bz0"), (c("ring_z") + outer).alias("bz1"))
    s = fold.explode_boxes(o, layers, {"min_x": "bx0", "max_x": "bx1", "min_z": "bz0", "max_z": "bz1"})
    d = grid.dist(c("x") - c("ring_x"), c("z") - c("ring_z"))
    s = s.withColumn("d", d).where((c("d") >= c("ring_inner")) & (c("d") <= c("outer")))
    share = F.lit(1.0) - (c("d") - c("ring_inner")) / (c("outer") - c("ring_inner"))
    s = s.withColumn("rw", share * share)
    total = s.groupBy("seq").agg(F.sum("rw").alias("total")).where(c("total") > 0)
    return s.join(total, "seq").select(
        "layer_id", "row", "col", "seq", (-c("net") * (c("rw") / c("total")) / (c("res") * c("res"))).alias("add"),
        (c("res") * c("res")).alias("cell"), "x", "z")


# ------------------------------------------------------------------ records
def op_record(folded: DataFrame, shapes: DataFrame, layers: DataFrame, tile_size: int = 64) -> DataFrame:
    """Volumes, elevation statistics, changed bounds and counts of each edit, from the folded changes.

    ``shapes`` tells which samples belong to the footprint, so that footprint figures leave the
    redistribution ring out.
    """
    return records_of(folded.join(shapes.select("layer_id", "row", "col", "seq", "x", "z", "foot", (c("res") * c("res")).alias("cell")),
                                  ["layer_id", "row", "col", "seq"]))


def records_of(j: DataFrame) -> DataFrame:
    """``op_record`` of folded changes that carry ``x, z, foot, cell`` themselves."""
    hit, foot = c("dh") != 0, c("foot")
    after = c("after").cast("double")
    fb = after - c("dh")
    agg = j.groupBy("seq", "layer_id").agg(
        F.count_if(hit).alias("changed"),
        F.coalesce(F.sum(F.when(c("dh") < 0, -c("dh") * c("cell"))), F.lit(0.0)).alias("removed"),
        F.coalesce(F.sum(F.when(c("dh") > 0, c("dh") * c("cell"))), F.lit(0.0)).alias("deposited"),
        F.min(F.when(hit, c("before"))).cast("double").alias("before_min"),
        F.max(F.when(hit, c("before"))).cast("double").alias("before_max"),
        F.avg(F.when(hit, c("before").cast("double"))).alias("before_mean"),
        F.min(F.when(hit, after)).alias("after_min"), F.max(F.when(hit, after)).alias("after_max"),
        F.avg(F.when(hit, after)).alias("after_mean"),
        F.count_if(foot).alias("foot_samples"), F.avg(F.when(foot, fb)).alias("foot_before_mean"),
        F.avg(F.when(foot, after)).alias("foot_after_mean"), F.max(F.when(foot, after)).alias("foot_after_max"),
        *[fn(F.when(hit, c(a))).alias(f"{n}_{a}") for a in ("x", "z") for n, fn in (("min", F.min), ("max", F.max))],
        *[fn(F.when(foot, c(a))).alias(f"foot_{n}_{a}") for a in ("x", "z") for n, fn in (("min", F.min), ("max", F.max))])
    return with_balance(agg)


def with_balance(agg: DataFrame) -> DataFrame:
    """Net volume, relative error of the balance and lack of effect, from the sums and counts of each edit."""
    net, scale = c("deposited") - c("removed"), F.greatest("deposited", "removed")
    return agg.withColumn("net", net).withColumn(
        "rel_err", F.when(scale > 0, F.abs(net) / F.nullif(scale, F.lit(0.0))).otherwise(0.0)).withColumn(
        "no_effect", (c("changed") == 0) & (c("foot_samples") == 0))


def paint_changes(shapes: DataFrame, rows: DataFrame) -> DataFrame:
    """Samples whose stored class is replaced: last footprint in sequence order wins."""
    table = F.create_map(*[F.lit(x) for kv in FOOTPRINT_CLASS.items() for x in kv])
    code = F.create_map(*[F.lit(x) for kv in CODE.items() for x in kv])
    name = F.coalesce(F.when(c("kind") == "semantic_paint", c("semantic_class")), F.try_element_at(table, c("kind")))
    last = shapes.where("foot").withColumn("code", F.try_element_at(code, name)).where(c("code").isNotNull()).groupBy(
        "layer_id", "row", "col").agg(F.max_by("code", "seq").alias("code"), F.count("*").alias("paints"))
    return last.join(rows.select("layer_id", "row", "semantic"), ["layer_id", "row"]).withColumn(
        "old_code", F.get("semantic", c("col").cast("int")).cast("int")).drop("semantic")


def painted(ops: DataFrame, rows: DataFrame, layers: DataFrame) -> DataFrame:
    """``paint_changes`` of the edits' footprints without a record per painted sample: folded inside blocks of rows of the class mask."""
    table = F.create_map(*[F.lit(x) for kv in FOOTPRINT_CLASS.items() for x in kv])
    code = F.create_map(*[F.lit(x) for kv in CODE.items() for x in kv])
    name = F.coalesce(F.when(c("kind") == "semantic_paint", c("semantic_class")), F.try_element_at(table, c("kind")))
    o = shape_inputs(without_readings(ops), layers).withColumn("paint", F.try_element_at(code, name)).where(c("paint").isNotNull())
    # Codes are small integers, so they pass through the block's float heights unchanged; 0 is a class, so the last one is kept plus 1.
    mask = rows.select("layer_id", "row", F.transform("semantic", lambda v: v.cast("float")).alias("heights"))
    folded = fold.block_fold(fold.block_records(o, layers, BOX), mask, [*SHAPE_NUMBERS, "paint"], [], _paint_shape, "", steps=False, last="code1")
    return folded.select("layer_id", "row", "col", (c("code") - 1).alias("code"), c("changes").alias("paints"), c("h").cast("int").alias("old_code"))


def _paint_shape(get, x, z):
    foot = _edit_shape(get, x, z)["foot"]
    return {"keep": foot, "w": np.zeros(len(x)), "code1": get("paint").astype(np.int32) + 1}


def sparse_payload(folded: DataFrame, width: Column | int) -> DataFrame:
    """Sorted changed indices with their new heights per edit, left out above the cap with a reason.

    The size is counted first, so no edit above the cap is ever collected into one record.
    """
    hit = folded.where(c("dh") != 0).withColumn("idx", c("row") * width + c("col"))
    size = hit.groupBy("seq", "layer_id").agg(F.count("*").alias("changed"))
    small = hit.join(size.where(c("changed") <= SPARSE_SAMPLE_CAP), ["seq", "layer_id"]).groupBy("seq", "layer_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", c("after").alias("h")))).alias("p"))
    return size.join(small, ["seq", "layer_id"], "left").select(
        "seq", "layer_id", "changed", F.transform("p", lambda e: e["idx"]).alias("indices"),
        F.transform("p", lambda e: e["h"]).alias("heights"),
        F.when(c("p").isNull(), F.format_string("sample count %d exceeds %d; fetch changed tiles instead", c("changed"),
                                                F.lit(SPARSE_SAMPLE_CAP))).alias("omitted"))


def undo(ops: DataFrame) -> DataFrame:
    """Inverse edits; every kind that loses information is refused."""
    table = F.create_map(*[F.lit(x) for kv in INVERSE.items() for x in kv])
    return ops.withColumn("inverse_kind", F.try_element_at(table, c("kind"))).withColumn(
        "status", F.when(c("inverse_kind").isNull(), "not invertible").otherwise("ok"))


def construction_features(ops: DataFrame, records: DataFrame, layers: DataFrame, bulk_density: float) -> DataFrame:
    """Feature record of each construction edit: footprint statistics, balance and reported clamps."""
    table = F.create_map(*[F.lit(x) for kv in FEATURE_CLASS.items() for x in kv])
    o = geometry(ops, layers).withColumn("semantic_class", F.try_element_at(table, c("kind"))).where(
        c("semantic_class").isNotNull())
    flat = F.flatten(F.transform("polygon", lambda v: F.array(v["x"], v["z"])))
    return o.join(records.drop("layer_id"), "seq").select(
        F.format_string("construction-op-%06d", c("seq")).alias("feature_id"), "seq", "kind", "layer_id", "semantic_class",
        *[F.coalesce(f"foot_{n}_{a}", f"{n}_{a}").alias(f"{n}_{a}") for a in ("x", "z") for n in ("min", "max")],
        F.coalesce("foot_before_mean", "before_mean").alias("before_mean"),
        F.coalesce("foot_after_mean", "after_mean").alias("after_mean"), "removed", "deposited", "net", "rel_err",
        (c("net") * bulk_density).alias("net_mass"), "repose_clamped", "aliased",
        F.when(c("repose_clamped"), c("pile")).alias("applied_height"), F.size("polygon").alias("vertex_count"),
        flat.alias("polygon_flat"))


# ------------------------------------------------------------------ edits that read the ground
def read_centres(ops: DataFrame, rows: DataFrame, layers: DataFrame) -> DataFrame:
    """Add ``pivot`` (bilinear ground at a slope's centre) and ``near`` (nearest sample at a ramp's start)."""
    g = layers.select("layer_id", "res", "width", "height", "min_x", "min_z")
    at = ops.withColumn("x", c("cx")).withColumn("z", c("cz"))
    read = sampling.bilinear(at, rows, layers, "pivot")
    clamp = lambda v, n: F.least(F.greatest(half_up(v), F.lit(0)), n - 1)
    near = read.join(g, "layer_id").withColumn("row", clamp((c("cz") - c("min_z")) / c("res"), c("height"))).withColumn(
        "_col", clamp((c("cx") - c("min_x")) / c("res"), c("width")))
    near = near.join(rows.select("layer_id", "row", "heights"), ["layer_id", "row"], "left")
    return near.select(*ops.columns, F.when(c("kind") == "slope", c("pivot")).alias("pivot"),
                       F.when(c("kind") == "ramp", F.get("heights", c("_col").cast("int")).cast("double")).alias("near"))


# ------------------------------------------------------------------ replay of a whole log
def without_readings(ops: DataFrame) -> DataFrame:
    """Edits with zero for what slopes and ramps read: enough for footprints, not for heights."""
    return ops.withColumn("pivot", F.lit(0.0)).withColumn("near", F.lit(0.0))
