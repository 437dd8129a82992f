"""Synthetic populations: expectation bins, seeded counts and draws, thinning and annulus picks.

Every draw is a hash of the seed channel, the bin and the ordinal, so any task can make any record
and a lost executor makes the same ones again.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import crater, rock
from gridloom.functions.noise import uniform
from gridloom.session import cut_lineage

c = F.col


def log_bins(ends: DataFrame, bins: int) -> DataFrame:
    """Logarithmic bins ``b, lo, hi`` between ``mn`` and ``mx`` of every row of ``ends``."""
    at = lambda i: F.exp(F.ln("mn") + (F.ln("mx") - F.ln("mn")) * i / bins)
    return ends.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("lo", at(c("b"))).withColumn(
        "hi", at(c("b") + 1))


def crater_bins(ends: DataFrame, age_ga: Column, area_m2: Column, bins: int = 48) -> DataFrame:
    """Expected craters per bin: differences of the capped cumulative density times the area."""
    t = log_bins(ends, bins)
    step = crater.capped_density(c("lo"), age_ga) - crater.capped_density(c("hi"), age_ga)
    return t.withColumn("expected", F.greatest(F.lit(0.0), step) * area_m2)


def rock_bins(ends: DataFrame, coverage: Column, area_m2: Column, bins: int = 40) -> DataFrame:
    t = log_bins(ends, bins)
    return t.withColumn("per_m2", rock.cumulative_count(coverage, c("lo"), c("hi"))).withColumn(
        "expected", c("per_m2") * area_m2)


def normal(*parts: Column) -> Column:
    """Standard normal from two hashed uniforms."""
    u = F.greatest(uniform(*parts, F.lit("a")), F.lit(1e-15))
    return F.sqrt(F.ln(u) * -2) * F.cos(uniform(*parts, F.lit("b")) * (2 * math.pi))


def poisson(mean: Column, *parts: Column) -> Column:
    """Seeded Poisson count: inverse of the distribution function below 30, normal above."""
    u = uniform(*parts, F.lit("p"))
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("term"), F.exp(-mean).alias("cdf"))

    def step(a: Column, i: Column) -> Column:
        go = a["cdf"] < u
        term = a["term"] * mean / i
        return F.struct(F.when(go, i).otherwise(a["k"]).alias("k"), F.when(go, term).otherwise(a["term"]).alias("term"),
                        F.when(go, a["cdf"] + term).otherwise(a["cdf"]).alias("cdf"))

    small = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step, lambda a: a["k"])
    large = F.floor(mean + F.sqrt(mean) * normal(*parts, F.lit("n")) + 0.5)
    return F.when(mean <= 0, 0).when(mean < 30, small).otherwise(F.greatest(F.lit(0), large)).cast("long")


def power_law(lo: Column, hi: Column, exponent: float, u: Column) -> Column:
    """Inverse transform of a truncated power law with differential slope ``-exponent``."""
    g = 1.0 - exponent
    a, b = F.pow(lo, F.lit(g)), F.pow(hi, F.lit(g))
    return F.pow(a + u * (b - a), F.lit(1.0 / g))


def place(bins: DataFrame, channel: Column, chunk: int = 4096) -> DataFrame:
    """One record ``b, i`` per drawn feature.  Counts are spread in chunks, so one big bin is many tasks' work."""
    counted = bins.withColumn("count", poisson(c("expected"), channel, c("b")))
    chunks = counted.where(c("count") > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.floor((c("count") - 1) / chunk))))
    from gridloom.operators.fold import task_count

    chunks = chunks.repartition(task_count(bins.sparkSession), "b", "_chunk")
    first = c("_chunk") * chunk
    last = F.least(first + chunk, c("count")) - 1
    return chunks.withColumn("i", F.explode(F.sequence(first, last))).drop("_chunk")


def craters(bins: DataFrame, box: tuple[float, float, float, float], seed: str, exponent: float = 3.0,
            mean_degradation: float = 0.45, spread: float = 0.3, elliptical: float = 0.15, clustering: float = 0.0) -> DataFrame:
    """Crater population with uniform or clustered centres and full geometry."""
    min_x, max_x, min_z, max_z = box
    ch = F.lit(seed)
    d = place(bins, ch)
    u = lambda name: uniform(ch, c("b"), c("i"), F.lit(name))
    x, z = u("x") * (max_x - min_x) + min_x, u("z") * (max_z - min_z) + min_z
    if clustering > 0:
        groups = max(1, math.floor(4 + 12 * clustering + 0.5))
        reach = max(max_x - min_x, max_z - min_z) * (0.05 + 0.15 * (1 - clustering))
        g = F.floor(u("cluster") * groups)
        gx = uniform(ch, F.lit("cx"), g) * (max_x - min_x) + min_x
        gz = uniform(ch, F.lit("cz"), g) * (max_z - min_z) + min_z
        near = u("pick") < clustering
        x = F.when(near, gx + normal(ch, c("b"), c("i"), F.lit("nx")) * reach).otherwise(x)
        z = F.when(near, gz + normal(ch, c("b"), c("i"), F.lit("nz")) * reach).otherwise(z)
    deg = F.greatest(F.lit(0.0), F.least(F.lit(0.98), normal(ch, c("b"), c("i"), F.lit("d")) * spread + mean_degradation))
    d = d.select("b", "i", "expected", x.alias("cx"), z.alias("cz"), power_law(c("lo"), c("hi"), exponent, u("size")).alias("diameter"),
                 deg.alias("degradation"),
                 F.when(u("ell") < elliptical, u("ellv") * 0.32 + 0.6).otherwise(1.0).alias("ellipticity"),
                 (u("rot") * math.pi).alias("rotation"))
    return d.where(c("cx").between(min_x, max_x) & c("cz").between(min_z, max_z))


def rocks(bins: DataFrame, box: tuple[float, float, float, float], seed: str, coverage: float, physical_min: float,
          mean_buried: float = 0.3, angularity: float = 0.5) -> DataFrame:
    """Background rocks: diameter from the truncated exponential, burial, semi-axes and rotation."""
    min_x, max_x, min_z, max_z = box
    ch = F.lit(seed)
    u = lambda name: uniform(ch, c("b"), c("i"), F.lit(name))
    return _rock_shape(place(bins, ch).withColumn("x", u("x") * (max_x - min_x) + min_x).withColumn(
        "z", u("z") * (max_z - min_z) + min_z), ch, coverage, physical_min, mean_buried, angularity)


def _rock_shape(d: DataFrame, ch: Column, coverage: float, physical_min: float, mean_buried: float, angularity: float) -> DataFrame:
    u = lambda name: uniform(ch, c("b"), c("i"), F.lit(name))
    n = lambda name: normal(ch, c("b"), c("i"), F.lit(name))
    d = d.withColumn("diameter", rock.draw_diameter(F.lit(coverage), c("lo"), c("hi"), u("size")))
    a, wide = c("diameter") / 2, 0.15 + 0.35 * angularity
    return d.select(
        "b", "i", "x", "z", "diameter", (c("diameter") >= physical_min).alias("physical"),
        F.greatest(F.lit(0.0), F.least(F.lit(0.95), n("bury") * 0.15 + mean_buried)).alias("buried"),
        (a * (n("sx") * (wide * 0.5) + 1)).alias("scale_x"),
        (a * F.greatest(F.lit(0.35), F.lit(1.0) - F.abs(n("sy")) * wide)).alias("scale_y"),
        (a * (n("sz") * (wide * 0.5) + 1)).alias("scale_z"),
        rock.quaternion(u("q1"), u("q2"), u("q3")).alias("rotation"))


def rim_rocks(bins: DataFrame, rims: DataFrame, box: tuple[float, float, float, float], seed: str, coverage: float,
              physical_min: float, enhancement: float = 4.0, mean_buried: float = 0.3, angularity: float = 0.5) -> DataFrame:
    """Excess rocks on crater rims: area-weighted choice of a rim annulus, uniform point inside it."""
    total = rims.agg(F.sum(c("radius") * c("radius") * (math.pi * (1.4**2 - 0.9**2))).alias("a")).first()["a"] or 0.0
    ch = F.lit(seed + ":rim")
    d = place(bins.withColumn("expected", c("per_m2") * total * (enhancement - 1)), ch)
    u = lambda name: uniform(ch, c("b"), c("i"), F.lit(name))
    d = pick_annulus(d.withColumn("pick", u("rim")), rims)
    ri, ro = c("radius") * 0.9, c("radius") * 1.4
    r, theta = F.sqrt(u("r") * (ro * ro - ri * ri) + ri * ri), u("t") * (2 * math.pi)
    d = d.withColumn("x", c("rim_x") + r * F.cos(theta)).withColumn("z", c("rim_z") + r * F.sin(theta))
    min_x, max_x, min_z, max_z = box
    d = d.where(c("x").between(min_x, max_x) & c("z").between(min_z, max_z))
    return _rock_shape(d, ch, coverage, physical_min, mean_buried, angularity)


def weight_intervals(rims: DataFrame, chunk: int = 4096) -> DataFrame:
    """Cumulative share interval ``[lo, hi)`` of every rim in id order, by two-level running sums."""
    from gridloom.operators.ordered import running_sum_in_order

    w = rims.withColumn("_w", c("radius") * c("radius")).withColumn("_k", F.lit(0))
    run = running_sum_in_order(w, ["_k"], "id", c("_w"), "_run", chunk)
    total = w.agg(F.sum("_w").alias("t")).first()["t"]
    return run.select("id", "rim_x", "rim_z", "radius", ((c("_run") - c("_w")) / total).alias("lo_share"),
                      (c("_run") / total).alias("hi_share"))


def pick_annulus(draws: DataFrame, rims: DataFrame, cells: int | None = None) -> DataFrame:
    """Interval join of ``pick`` in [0, 1) with the cumulative shares, as an equi-join on share cells.

    An interval is listed in every cell it overlaps and a draw looks only at its own cell, so a rim
    that holds a third of the area is spread over a third of the cells.  There are as many cells as rims, so
    both sides stay linear: a draw meets two intervals on average.  Drawn features are many more than Spark takes
    from the few bins they come from, so neither side may be sent whole to all tasks.
    """
    iv = weight_intervals(rims)
    cells = cells or max(1024, rims.count())
    iv = iv.withColumn("_cell", F.explode(F.sequence(
        F.floor(c("lo_share") * cells), F.least(F.floor(c("hi_share") * cells), F.lit(cells - 1)))))
    d = draws.withColumn("_cell", F.floor(c("pick") * cells))
    return d.join(iv.withColumnRenamed("id", "rim_id").hint("merge"), "_cell").where(
        (c("pick") >= c("lo_share")) & (c("pick") < c("hi_share"))).drop("_cell", "lo_share", "hi_share")


#: Earliest undecided features that a list of ``thin_by_exclusion`` shows in a round; sets the rounds, never the result.
HEADS = 128


def thin_by_exclusion(features: DataFrame, factor: float, cell: float) -> DataFrame:
    """Greedy thinning in placement order: keep a feature when no kept earlier one is too close.

    ``features(ord, x, z, diameter)`` with unique ``ord``; features with a null among them meet nothing and are kept.
    Cells form levels of doubling size from ``cell``; a feature's own level is the first whose cells are as wide as its reach,
    and it also lies in the cells of all wider levels in use.  Two features that conflict lie in the same or adjoining cells
    of the wider one's level.  No list of conflicting pairs is made: in every round a cell shows its first undecided
    features only.  A feature that comes no later than the last one shown anywhere around it, and conflicts with none
    shown before it, is kept; then all that conflict with it leave at once.  The first undecided feature always
    qualifies, so the rounds end with exactly the greedy result.
    """
    from gridloom.operators.fold import task_count

    near_to = lambda a, b: (
        (c(f"{a}.x") - c(f"{b}.x")) * (c(f"{a}.x") - c(f"{b}.x")) + (c(f"{a}.z") - c(f"{b}.z")) * (c(f"{a}.z") - c(f"{b}.z"))
        < F.greatest(f"{a}.diameter", f"{b}.diameter") * (factor * 0.5) * (F.greatest(f"{a}.diameter", f"{b}.diameter") * (factor * 0.5)))
    placed = features.select("ord", "x", "z", "diameter").dropna()
    reach = F.greatest(c("diameter") * (factor * 0.5 / cell), F.lit(1e-300))
    placed = placed.withColumn("own", F.ceil(F.log2(reach) + 1e-9).cast("int"))
    top = placed.agg(F.max("own").alias("m")).first()["m"]
    if top is None:
        return features
    # Wider cells than needed are right as well, so very small features share the lowest of 24 levels.
    placed = placed.withColumn("own", F.greatest("own", F.lit(top - 23)))
    levels = sorted(r["own"] for r in placed.select("own").distinct().collect())
    at = ("level", "gx", "gz")

    def entries(some: DataFrame) -> DataFrame:
        e = some.withColumn("level", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= c("own"))))
        size = F.pow(F.lit(2.0), c("level")) * cell
        return e.select("*", F.floor(c("x") / size).alias("gx"), F.floor(c("z") / size).alias("gz"), (c("own") == c("level")).alias("wide"))

    def around(e: DataFrame) -> DataFrame:
        side = F.sequence(F.lit(-1), F.lit(1))
        return e.withColumn("_i", F.explode(side)).withColumn("_j", F.explode(side)).withColumn("gx", c("gx") + c("_i")).withColumn(
            "gz", c("gz") + c("_j")).drop("_i", "_j")

    # Spark takes the copies around cells for as small as the features' file; hints keep them out of the driver.
    same = c("a.level").eqNullSafe(c("b.level")) & (c("a.gx") == c("b.gx")) & (c("a.gz") == c("b.gz"))
    # What a feature meets at a level: the level's own features, and the narrower ones only at its own level.
    met = c("a.wide") | c("b.wide")
    rest, kept = cut_lineage(placed.repartition(task_count(placed.sparkSession), "ord")), []
    while not rest.isEmpty():
        e = entries(rest)
        order = Window.partitionBy(*at, "wide").orderBy("ord")
        shown = cut_lineage(e.withColumn("rank", F.row_number().over(order)).where(c("rank") <= HEADS))
        last = around(shown.where(c("rank") == HEADS).select(*at, "wide", "ord"))
        late = e.alias("a").join(last.alias("b").hint("merge"), same & met & (c("a.ord") > c("b.ord")), "left_semi").select("ord").distinct()
        sure = e.join(late.hint("merge"), "ord", "left_anti")
        heads = around(shown.select(*at, "wide", "ord", "x", "z", "diameter"))
        behind = sure.alias("a").join(heads.alias("b").hint("merge"), same & met & (c("b.ord") < c("a.ord")) & near_to("a", "b"), "left_semi")
        won = sure.where("wide").join(behind.select("ord").distinct().hint("merge"), "ord", "left_anti")
        won = cut_lineage(won.select("ord", "x", "z", "diameter", "own"))
        kept.append(won.select("ord"))
        gone = e.alias("a").join(around(entries(won)).alias("b").hint("merge"), same & met & near_to("a", "b"), "left_semi").select("ord")
        rest = cut_lineage(rest.join(gone.union(won.select("ord")).distinct().hint("merge"), "ord", "left_anti"))
    free = features.where(c("x").isNull() | c("z").isNull() | c("diameter").isNull())
    return features.join(functools.reduce(DataFrame.union, kept).hint("merge"), "ord").unionByName(free)
