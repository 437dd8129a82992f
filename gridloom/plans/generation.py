"""Generated tables and the full log replay."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom import fixtures as fx
from gridloom.codes import BULK_DENSITY_KG_M3
from gridloom.fixtures import rnd, with_ctes
from gridloom.functions import noise
from gridloom.operators import edits, fold, grid, population, replay, sampling, stamping, stencil
from gridloom.plans.edits import lattice_sql
from gridloom.plans.raster import r6
from gridloom.registry import query

c = F.col


def add_relief(rows, layers, channel: str, frequency: float, amplitude: float, slope_deg: float = 0.0, azimuth_deg: float = 0.0):
    """Regional plane plus seeded noise added to the raster rows, in Arrow batches and without a shuffle."""
    tan = math.tan(math.radians(slope_deg))
    sx, sz = math.sin(math.radians(azimuth_deg)) * tan, -math.cos(math.radians(azimuth_deg)) * tan
    g = layers.select("layer_id", "res", "min_x", "min_z")
    r = rows.select("layer_id", "row", "heights").join(g, "layer_id").withColumn(
        "seed", noise.seed_of(F.concat(F.lit(channel + ":"), c("layer_id"))))

    def run(batches):
        for b in batches:
            lists = b.column("heights")
            offs = lists.offsets.to_numpy()
            size = np.diff(offs)
            idx = np.repeat(np.arange(b.num_rows), size)
            col = np.arange(len(idx)) - np.repeat(offs[:-1] - offs[0], size)
            get = lambda n: b.column(n).to_numpy(zero_copy_only=False)[idx]
            x, z = get("min_x") + col * get("res"), get("min_z") + get("row") * get("res")
            h = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)[offs[0]:offs[-1]]
            add = noise.fbm_np(x, z, get("seed"), frequency, amplitude) - (x * sx + z * sz)
            out = pa.ListArray.from_arrays(pa.array(offs - offs[0]), pa.array((h + add).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column("layer_id"), b.column("row"), out], names=["layer_id", "row", "heights"])

    return r.mapInArrow(run, "layer_id string, row long, heights array<float>")


_N = "(" + "+".join(f"{0.5**i}e0*nz{i}" for i in range(4)) + ")/1.875e0"


@query("relief_noise", with_ctes(
    f"""SELECT layer_id, row, {rnd('sum(hh)', 3)} AS total, {rnd('max(hh)', 4)} AS top FROM (SELECT layer_id, row, (h+0.2e0*{_N}-(x*0e0-z*tan(radians(2e0))))::FLOAT::DOUBLE AS hh FROM (SELECT *, {', '.join(f"{lattice_sql(f'(x*{0.8*2**i}e0)', f'(z*{0.8*2**i}e0)', 'sd')} AS nz{i}" for i in range(4))}
        FROM (SELECT s.*, min_x+col*res AS x, min_z+row*res AS z, ('0x'||substr(md5('relief:'||layer_id),1,8))::BIGINT%2147483647 AS sd FROM samples s JOIN layers USING (layer_id)))) GROUP BY ALL""", "samples", "layers"))
def relief_noise(spark, sf):
    rows = add_relief(fx.raster_rows(spark, sf), fx.layers(spark, sf), "relief", 0.8, 0.2, 2.0)
    s = rows.select("layer_id", "row", F.explode("heights").alias("h")).withColumn("h", c("h").cast("double"))
    return s.groupBy("layer_id", "row").agg(r6(F.sum("h"), 3).alias("total"), r6(F.max("h"), 4).alias("top"))


def _box(spark, sf):
    l = fx.layers(spark, sf).where(c("ordinal") == 0).first()
    return (l["min_x"], l["max_x"], l["min_z"], l["max_z"]), (l["max_x"] - l["min_x"]) * (l["max_z"] - l["min_z"])


def _craters(spark, sf):
    box, area = _box(spark, sf)
    ends = fx.crater_seeds(spark, sf).agg(F.greatest(F.min("diameter"), F.lit(0.6)).alias("mn"), F.max("diameter").alias("mx"))
    d = population.craters(population.crater_bins(ends, F.lit(3.5), F.lit(area)), box, "site:crater:context-0", clustering=0.3)
    return d.withColumn("id", c("b") * 1_000_000 + c("i"))


@query("crater_population")
def crater_population(spark, sf):
    t = stamping.crater_table(_craters(spark, sf))
    return t.select("id", *[r6(n).alias(n) for n in ("cx", "cz", "diameter", "depth", "rim_height", "degradation", "ellipticity", "reach")])


@query("rock_population")
def rock_population(spark, sf):
    """Background rocks plus the excess on the rims of the part-table craters; steep ground rejects."""
    layers, rows = fx.layers(spark, sf), fx.raster_rows(spark, sf)
    box, area = _box(spark, sf)
    ends = fx.crater_seeds(spark, sf).agg((F.min("diameter") * 1.5).alias("mn"), (F.max("diameter") / 5).alias("mx"))
    bins = population.rock_bins(ends, F.lit(0.06), F.lit(area))
    rims = fx.crater_seeds(spark, sf).select("id", c("cx").alias("rim_x"), c("cz").alias("rim_z"), (c("diameter") / 2).alias("radius"))
    both = population.rocks(bins, box, "site:rock", 0.06, 0.3).unionByName(population.rim_rocks(bins, rims, box, "site:rock", 0.06, 0.3))
    s = sampling.surface_at(both.withColumn("layer_id", F.lit("context-0")), rows, layers)
    return s.where(c("slope_deg") <= 25).select("b", "i", *[r6(n).alias(n) for n in ("x", "z", "diameter", "buried", "scale_y")], "physical")


@query("exclusion_thinning")
def exclusion_thinning(spark, sf):
    seeds = fx.crater_seeds(spark, sf).select(c("id").alias("ord"), c("cx").alias("x"), c("cz").alias("z"), "diameter")
    return population.thin_by_exclusion(seeds, 1.0, 2.5)


@query("annulus_pick", with_ctes(
    """SELECT event_id, id AS rim_id FROM (SELECT event_id, (event_id*7919%1000003)/1000003e0 AS pick FROM events) e JOIN (SELECT id, (run-w)/tot AS lo, run/tot AS hi FROM (SELECT id, w, sum(w) OVER (ORDER BY id) AS run, sum(w) OVER () AS tot FROM
       (SELECT id, (diameter/2)*(diameter/2) AS w FROM crater_seeds))) r ON pick>=lo AND pick<hi""", "crater_seeds"))
def annulus_pick(spark, sf):
    e = c("event_id")
    draws = fx.table(spark, sf, "events").select("event_id", ((e * 7919 % 1000003) / 1000003.0).alias("pick"))
    rims = fx.crater_seeds(spark, sf).select("id", c("cx").alias("rim_x"), c("cz").alias("rim_z"), (c("diameter") / 2).alias("radius"))
    return population.pick_annulus(draws, rims).select("event_id", "rim_id")


@query("site_build")
def site_build(spark, sf):
    """Relief, craters, micro-relief and classes in order: one chained job over the raster rows."""
    layers = fx.layers(spark, sf)
    rows = add_relief(fx.raster_rows(spark, sf), layers, "procedural", 0.2, 0.3, 1.0, 135.0)
    ids = F.array(*[F.lit(r["layer_id"]) for r in layers.collect()])
    seeds = stamping.crater_table(_craters(spark, sf)).withColumn("layer_id", F.explode(ids))
    stamped = stamping.stamped_heights(seeds, rows, layers)
    rows = fold.apply_to_rows(rows, stamped)
    fine = layers.where(c("res") <= 0.125)
    rows = add_relief(rows.join(fine.select("layer_id"), "layer_id"), fine, "regolith", 2.0, 0.02).unionByName(
        rows.join(fine.select("layer_id"), "layer_id", "left_anti").select("layer_id", "row", "heights"))
    cells = grid.cells(rows, layers).withColumn("slope", stencil.interior_slope())
    zones = stamped.select("layer_id", "row", "col", "code")
    j = cells.join(zones, ["layer_id", "row", "col"], "left")
    code = stencil.classify_by_slope(F.coalesce("code", F.lit(0)), c("slope"))
    return j.groupBy("layer_id", code.alias("code")).agg(F.count("*").alias("samples"), r6(F.avg("h"), 4).alias("mean_h"))


@query("replay_log")
def replay_log(spark, sf):
    """The whole valid log in sequence order, with the edits that read the ground and what conserving edits give back."""
    layers, rows = fx.layers(spark, sf), fx.raster_rows(spark, sf)
    ops = edits.valid_ops(fx.operations(spark, sf), layers)
    return replay.touched_rows(replay.replay(ops, rows, layers)).withColumn("height_sum", r6("height_sum", 4))


@query("replay_records")
def replay_records(spark, sf):
    """Record of every edit of the replayed log: readers of the ground and rings included."""
    layers, rows = fx.layers(spark, sf), fx.raster_rows(spark, sf)
    ops = edits.valid_ops(fx.operations(spark, sf), layers)
    rec, _, _ = replay.replay_records(ops, rows, layers)
    return rec.select("seq", "layer_id", "changed", *[r6(n, 5).alias(n) for n in (
        "removed", "deposited", "net", "before_mean", "after_mean", "foot_before_mean", "foot_after_mean")],
        r6(c("net") * BULK_DENSITY_KG_M3, 2).alias("net_mass"), r6("rel_err", 4).alias("rel_err"), "foot_samples", "no_effect")
