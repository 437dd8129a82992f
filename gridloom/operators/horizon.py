"""Skylines by ray marching over blocks of raster rows, their merge, and illumination statistics."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.codes import BODY_RADIUS_M
from gridloom.functions import geo, solar
from gridloom.operators import sampling
from gridloom.operators.fold import task_count
from gridloom.operators.ordered import running_sum_in_order
from gridloom.operators.rays import march
from gridloom.session import cut_lineage, stored

c = F.col


def ladder(start: float, first_step: float, max_range: float, growth: float = 8.0) -> list[float]:
    """Sample distances of a ray: the step grows with distance.  The same for every ray."""
    out, d = [], start
    while d <= max_range:
        out.append(d)
        d += first_step * (1 + d / max_range * growth)
    return out


def _every_ray(observers: DataFrame, bins: int, seen: DataFrame) -> DataFrame:
    """``seen`` with an empty row for every observer and bin."""
    every = observers.select("observer_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return seen.unionByName(every, allowMissingColumns=True)


def _once(observers: DataFrame, *place: str) -> tuple[DataFrame, DataFrame]:
    """One observer for each place, and the numbers of all with that of the one who stands for them."""
    spots = observers.groupBy(*place).agg(F.min("observer_id").alias("_spot"))
    who = observers.join(spots.hint("merge"), list(place)).select("observer_id", "_spot")
    return spots.withColumnRenamed("_spot", "observer_id"), who


def _for_all(skyline: DataFrame, who: DataFrame) -> DataFrame:
    names = skyline.columns
    return skyline.withColumnRenamed("observer_id", "_spot").join(who.hint("merge"), "_spot").select(*names)


#: Steps of the first leg of near rays; every further leg ends at four times as many.
LEG = 64


def near_skyline(observers: DataFrame, rows: DataFrame, layers: DataFrame, bins: int, cell: float, max_range: float) -> DataFrame:
    """Highest angle per azimuth bin for ``observers(observer_id, layer_id, x, z)``.

    A ray ends at its first sample without a height.  The box of the layer is convex, so a ray that has left it does not
    come back; holes inside it end the ray in whichever block of rows has the first of them.  Rays are followed in legs, and
    only those that no hole has ended go on to the next one, so their geometry is not worked out far beyond their end.
    Observers at one place share their rays.
    """
    observers, who = _once(observers, "layer_id", "x", "z")
    eye = sampling.bilinear(observers, rows, layers, "eye").where(c("eye").isNotNull())
    box = eye.join(layers.select("layer_id", "res", "width", "height", "min_x", "max_x", "min_z", "max_z"), "layer_id")
    box = cut_lineage(box.withColumn("_home", F.floor((c("z") - c("min_z")) / c("res"))))

    def place(get, dist):
        az = np.radians(get("bin") * (360.0 / bins))
        x, z = get("x") + np.sin(az) * dist, get("z") - np.cos(az) * dist
        inside = (x >= get("min_x")) & (x <= get("max_x")) & (z >= get("min_z")) & (z <= get("max_z"))
        return (x - get("min_x")) / get("res"), (z - get("min_z")) / get("res"), inside

    steps, legs, live, done = ladder(cell, cell, max_range), [], box, 0
    while True:
        end = min(len(steps), max(LEG, 4 * done))
        reach = F.lit(steps[end - 1] if steps else 0.0) / c("res") + 1
        leg = march(live, rows, bins, steps[done:end], place, lambda get, h, dist: np.arctan2(h - get("eye"), dist),
                    ["x", "z", "eye", "res", "min_x", "max_x", "min_z", "max_z"], "_home", reach, stops=True)
        legs.append(leg.withColumns({"first": c("first") + done, "stop": c("stop") + done}))
        if end == len(steps):
            break
        legs[-1] = stored(legs[-1], "skyline-leg")
        # A ray with a hole in another block may still be among these; what it sees behind that does not count below.
        on = legs[-1].where(c("stop").isNull() & (c("first") + c("evaluated") == end)).groupBy("observer_id").agg(F.collect_set("bin").alias("_bins"))
        live, done = cut_lineage(box.join(on.hint("merge"), "observer_id")), end
        if live.isEmpty():
            break
    seen = functools.reduce(DataFrame.unionByName, legs)
    # A ray has one stretch per block; those after its first hole do not count.
    parts = _every_ray(box, bins, seen).groupBy("observer_id", "bin").agg(
        F.collect_list(F.when(c("first").isNotNull(), F.struct("first", "a"))).alias("parts"), F.min("stop").alias("stop"))
    best = F.array_max(F.transform(F.filter("parts", lambda p: c("stop").isNull() | (p["first"] <= c("stop"))), lambda p: p["a"]))
    return _for_all(parts.select("observer_id", "bin", F.coalesce(F.degrees(best), F.lit(-90.0)).alias("angle_deg")), who)


def far_skyline(observers: DataFrame, rows: DataFrame, height: int, width: int, layer_id: str, bins: int, map_scale: float,
                max_range: float) -> DataFrame:
    """Great-circle march over a projected product for ``observers(observer_id, lat, lon, radial)``.

    Leaving the product truncates the ray; no-data inside it is skipped.  Observers at one place share their rays.
    """
    steps = ladder(2 * map_scale, map_scale, max_range)
    observers, who = _once(observers, "lat", "lon", "radial")
    _, py = geo.polar_forward(c("lat"), c("lon"), F.lit(True))
    o = observers.select("observer_id", F.lit(layer_id).alias("layer_id"), "radial", F.radians("lat").alias("la"), F.radians("lon").alias("lo"),
                         F.lit(width).alias("width"), F.lit(height).cast("long").alias("height"),
                         F.floor(F.lit((height - 1) / 2) - py / map_scale).alias("_home"))
    o = cut_lineage(o)

    def place(get, dist):
        az, arc = np.radians(get("bin") * (360.0 / bins)), dist / BODY_RADIUS_M
        la, lo = get("la"), get("lo")
        lat = np.arcsin(np.sin(la) * np.cos(arc) + np.cos(la) * np.sin(arc) * np.cos(az))
        lon = lo + np.arctan2(np.sin(az) * np.sin(arc) * np.cos(la), np.cos(arc) - np.sin(la) * np.sin(lat))
        rho = 2 * BODY_RADIUS_M * np.tan(lat / 2 + math.pi / 4)
        col, row = rho * np.sin(lon) / map_scale + (width - 1) / 2, (height - 1) / 2 - rho * np.cos(lon) / map_scale
        return col, row, ~((col < 0) | (row < 0) | (col > width - 1) | (row > height - 1))

    def angle(get, h, dist):
        away, arc = h + BODY_RADIUS_M, dist / BODY_RADIUS_M
        return np.degrees(np.arctan2(away * np.cos(arc) - (get("radial") + BODY_RADIUS_M), away * np.sin(arc)))

    seen = march(o, rows.where(c("layer_id") == layer_id), bins, steps, place, angle, ["la", "lo", "radial"], "_home", F.lit(max_range / map_scale * 2), stops=False)
    total = _every_ray(o, bins, seen).groupBy("observer_id", "bin").agg(
        F.max("a").alias("a"), F.coalesce(F.sum("evaluated"), F.lit(0)).alias("evaluated"), F.coalesce(F.sum("no_data"), F.lit(0)).alias("no_data"))
    # All steps before the first one outside are read, so their number names it.
    return _for_all(total.select("observer_id", "bin", F.coalesce("a", F.lit(-90.0)).alias("angle_deg"),
                                 F.get(F.array(*[F.lit(v) for v in steps]), c("evaluated").cast("int")).alias("truncated_at"), "evaluated", "no_data"), who)


def merge(near: DataFrame, far: DataFrame) -> DataFrame:
    f = far.select("observer_id", "bin", c("angle_deg").alias("far_deg"))
    return near.join(f, ["observer_id", "bin"], "full").select("observer_id", "bin", F.greatest("angle_deg", "far_deg").alias("angle_deg"))


def profiles(skyline: DataFrame) -> DataFrame:
    """One array per observer in bin order (a group holds one value per bin)."""
    return skyline.groupBy("observer_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("bin", "angle_deg"))), lambda s: s["angle_deg"]).alias("profile"))


def at_azimuth(profile: Column, azimuth: Column) -> Column:
    """Linear between bins, wrapping around."""
    n = F.size(profile)
    x = geo.norm360(azimuth) * n / 360.0
    i, f = F.floor(x), x - F.floor(x)
    return F.get(profile, (i % n).cast("int")) * (F.lit(1.0) - f) + F.get(profile, ((i + 1) % n).cast("int")) * f


def sunlit_fraction(profile: Column, azimuth: Column, elevation: Column, radius: Column) -> Column:
    return solar.disc_fraction(elevation - at_azimuth(profile, azimuth), radius)


#: Epochs of an observer that are summed up in one go.
EPOCHS = 4096


def _stretches(batches):
    """Per observer and run of rows that follow each other in a task: number, lit ones, sum, and unlit runs at the start, the end and at most."""
    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        who, bucket = b.column("observer_id").to_numpy(), b.column("_b").to_numpy()
        light = b.column("fraction").to_numpy(zero_copy_only=False)
        new = np.ones(n, dtype=bool)
        new[1:] = (who[1:] != who[:-1]) | (bucket[1:] != bucket[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        lit, dark = light > 0, light <= 0
        # Unlit epochs up to here since the last lit one of the stretch.
        count, at = np.cumsum(dark), np.arange(n)
        last = np.maximum.accumulate(np.where(lit | new, at, 0))
        run = count - count[last] + dark[last]
        lits = np.add.reduceat(lit, start)
        first = np.minimum.reduceat(np.where(lit, at, n), start)
        stop = np.where(lits > 0, first, start + size) - 1
        head = np.where(stop >= start, count[stop] - count[start] + dark[start], 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(who[start]), b.column("_at").take(pa.array(start)), pa.array(size), pa.array(lits), pa.array(np.add.reduceat(np.nan_to_num(light), start)), pa.array(head),
             pa.array(run[start + size - 1]), pa.array(np.maximum.reduceat(run, start))],
            names=["observer_id", "at", "n", "lit", "s", "head", "tail", "longest"])


def illumination(lit: DataFrame, order: str = "ord") -> DataFrame:
    """Statistics per observer over ``lit(observer_id, ord, fraction)``, with the longest unlit run.

    Epochs are dealt out by observer and bucket of the order and cross one exchange; a task sums stretches of them up, so one
    observer's epochs need not share a task and no row per unlit run is held.  Runs that go on from one stretch to the next
    are put together from the stretches' ends.
    """
    at = c(order).cast("long")
    cut = lit.select(c("observer_id").cast("long").alias("observer_id"), at.alias("_at"), F.floor(at / EPOCHS).alias("_b"), c("fraction").cast("double").alias("fraction"))
    dealt = cut.repartition(task_count(lit.sparkSession), "observer_id", "_b").sortWithinPartitions("observer_id", "_b", "_at")
    return from_stretches(dealt)


def illumination_of_all(observers: DataFrame, epochs: DataFrame, order: str, fraction: Column) -> DataFrame:
    """``illumination`` of every observer at every epoch: epochs are put in order once, in buckets, and observers meet whole buckets.

    ``observers`` is a small table with ``observer_id``; ``fraction`` reads its columns and those of ``epochs``.
    """
    met = every_epoch(observers, epochs, order)
    return from_stretches(met.select("observer_id", "_at", "_b", fraction.cast("double").alias("fraction")))


def every_epoch(observers: DataFrame, epochs: DataFrame, order: str) -> DataFrame:
    """Observers with the columns of every epoch, ``_at`` for its order and ``_b`` for its bucket; the rows of a bucket stay in order and share a task."""
    at = c(order).cast("long")
    names = [n for n in epochs.columns if n != order]
    held = epochs.withColumn("_at", at).groupBy(F.floor(at / EPOCHS).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_at", *names))).alias("_all"))
    # Epochs of a bucket leave the list in its order, so nothing is sorted or exchanged per observer.
    return held.crossJoin(observers).select("*", F.explode("_all").alias("_e")).select(*observers.columns, "_b", "_e.*")


def from_stretches(dealt: DataFrame) -> DataFrame:
    """Statistics from ``observer_id, _at, _b, fraction`` in order inside every observer's bucket."""
    part = dealt.mapInArrow(_stretches, "observer_id long, at long, n long, lit long, s double, head long, tail long, longest long")
    # Stretches without light join the run before them, so a run ends where a stretch has light: its island is the number of those before.
    part = running_sum_in_order(part, ["observer_id"], "at", (c("lit") > 0).cast("int"), "island")
    over = part.select("observer_id", F.explode(F.when(c("lit") > 0, F.array(
        F.struct((c("island") - 1).alias("island"), c("head").alias("run")), F.struct(c("island").alias("island"), c("tail").alias("run")))).otherwise(
        F.array(F.struct(c("island").alias("island"), c("head").alias("run"))))).alias("e")).groupBy("observer_id", "e.island").agg(F.sum("e.run").alias("run"))
    longest = over.groupBy("observer_id").agg(F.max("run").alias("across"))
    total = part.groupBy("observer_id").agg(
        (F.sum("s") / F.sum("n")).alias("mean_fraction"), (F.sum("lit") / F.sum("n")).alias("lit_share"),
        (F.sum("lit") == 0).alias("always_dark"), F.max("longest").alias("longest_dark"), F.sum("n").alias("epochs"))
    return total.join(longest, "observer_id").withColumn("longest_dark", F.greatest("longest_dark", "across")).drop("across")
