"""Crater and rock queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom import fixtures as fx
from gridloom.fixtures import rnd, with_ctes
from gridloom.functions import crater, rock
from gridloom.operators import fold, rules, sampling, stamping
from gridloom.plans.raster import _FINEST, bilinear_sql, placed_points, r6
from gridloom.registry import query

c = F.col

# ------------------------------------------------------------------ SQL building blocks
_COEF = crater.PRODUCTION_COEFFICIENTS


def _poly_sql(x: str) -> str:
    return "(" + "+".join(f"({a!r})::DOUBLE*power({x},{i})" for i, a in enumerate(_COEF)) + ")"


_CHRON = "(5.44e-14*(exp(6.93e0*{t})-1)+8.38e-4*{t})"
_PROD = f"power(10e0,{_poly_sql('log10({d})')})"
_P0 = _PROD.format(d="0.01e0")
_SLOPE = f"(ln({_PROD.format(d='0.0101e0')}/{_P0})/ln(1.01e0))"
_DENS = (f"(CASE WHEN {{d}}>=0.01e0 THEN {_PROD} ELSE {_P0}*power({{d}}/0.01e0,{_SLOPE}) END*" + _CHRON + "/" + _CHRON.format(t="1e0") + ")")
_RATIO = "(CASE WHEN diameter>=400 THEN 0.2e0 WHEN diameter<=1 THEN 0.11e0 ELSE 0.11e0+ln(diameter)/ln(400e0)*0.09e0 END)"
CRATERS = f"""SELECT *, greatest(diameter*0.6e0, ejecta_extent) AS reach FROM (SELECT *, diameter*{_RATIO}*power(1-degradation,1.2e0) AS depth,
    36e0*power(diameter/1e3,1.014e0)*power(1-degradation,2.2e0) AS rim_height, diameter*0.1e0*(1+degradation) AS rim_width,
    least(0.75e0,0.08e0+0.55e0*degradation) AS floor_ratio,
    least(CASE WHEN 0.14e0*power(diameter/2,0.74e0)<=1e-3 THEN diameter/2 ELSE diameter/2*cbrt(0.14e0*power(diameter/2,0.74e0)/1e-3) END, diameter*3)*(1-degradation*0.8e0) AS ejecta_extent,
    0.14e0*power(diameter/2,0.74e0)*power(1-degradation,1.5e0) AS ejecta_amplitude FROM crater_seeds)"""
STAMPS = """SELECT id AS seq, layer_id, row, col, res, u, floor_ratio, CASE WHEN u<1 THEN CASE WHEN u<=floor_ratio THEN -depth ELSE -depth*(1-power((u-floor_ratio)/(1-floor_ratio),2)) END ELSE 0e0 END
    + CASE WHEN rim_height>0 THEN rim_height*exp(-power((u-1)/greatest(1e-6,rim_width/(diameter/2)),2)) ELSE 0e0 END
    + CASE WHEN u>1 AND ejecta_amplitude>0 THEN 0.14e0*power(diameter/2,0.74e0)*power(u,-3)*ejecta_amplitude/greatest(1e-12,0.14e0*power(diameter/2,0.74e0)) ELSE 0e0 END AS w
    FROM (SELECT *, sqrt(power(dx*cos(-rotation)-dz*sin(-rotation),2)+power((dx*sin(-rotation)+dz*cos(-rotation))/greatest(1e-6,ellipticity),2))/(diameter/2) AS u
      FROM (SELECT *, min_x+col*res-cx AS dx, min_z+row*res-cz AS dz FROM (SELECT * FROM craters, layers,
        LATERAL (SELECT unnest(range(greatest(0,floor((cz-reach-min_z)/res))::BIGINT, least(height-1,ceil((cz+reach-min_z)/res))::BIGINT+1)) AS row),
        LATERAL (SELECT unnest(range(greatest(0,floor((cx-reach-min_x)/res))::BIGINT, least(width-1,ceil((cx+reach-min_x)/res))::BIGINT+1)) AS col)))) WHERE u<=reach/(diameter/2)"""
_C = ("crater_seeds", "layers", "samples")
SEATED = f"""SELECT r.*, g.h AS ground, g.h+scale_y*(1-2*buried) AS y FROM placed_rocks r JOIN ground g ON g.pid=r.k"""
ROCKS = dict(placed_rocks=f"SELECT p.*, {_FINEST} AS layer_id FROM rock_seeds p",
             src="SELECT k AS pid, layer_id, x, z FROM placed_rocks", ground=bilinear_sql("src"), seated=SEATED)
FAULTY = "SELECT * REPLACE (CASE WHEN k%41=0 THEN y+1 ELSE y END AS y) FROM seated"
_R = ("rock_seeds", "layers", "samples")


def craters(spark, sf):
    return stamping.crater_table(fx.crater_seeds(spark, sf))


def craters_on_all_layers(spark, sf):
    layers = fx.layers(spark, sf)
    ids = F.array(*[F.lit(r["layer_id"]) for r in layers.collect()])
    return craters(spark, sf).withColumn("layer_id", F.explode(ids)), layers


def seated_rocks(spark, sf):
    return stamping.seat_rocks(fx.rock_seeds(spark, sf), fx.raster_rows(spark, sf), fx.layers(spark, sf))


def faulty_rocks(spark, sf):
    return seated_rocks(spark, sf).withColumn("y", F.when(c("k") % 41 == 0, c("y") + 1).otherwise(c("y")))


# ------------------------------------------------------------------ craters
@query("crater_models", with_ctes(
    f"""SELECT id, {rnd(f'log10({_DENS.format(d="(diameter/1e3)", t="3.5e0")})', 8)} AS log_density, {rnd('0.084e0/(diameter*diameter)', 7)} AS equilibrium,
        {rnd(f'least({_DENS.format(d="(diameter/1e3)", t="3.5e0")}/1e6,0.084e0/(diameter*diameter))', 9)} AS capped, {rnd('depth',8)} AS depth, {rnd('rim_height',8)} AS rim_height,
        {rnd('rim_width',8)} AS rim_width, {rnd('floor_ratio',8)} AS floor_ratio, {rnd('ejecta_extent',7)} AS ejecta_extent, {rnd('ejecta_amplitude',8)} AS ejecta_amplitude,
        diameter*1000>=15000 AS central_peak, {rnd("CASE WHEN diameter*3<diameter*250/500 THEN 0 ELSE 0.14e0*power(diameter*250/1e0,0.74e0)*power((diameter*375)/(diameter*250),-3) END",8)} AS blanket FROM craters""",
    "crater_seeds", craters=CRATERS))
def crater_models(spark, sf):
    d = c("diameter")
    age = F.lit(3.5)
    big = d * 1000
    return craters(spark, sf).select(
        "id", r6(F.log10(crater.production_density_extended(d / 1000.0, age)), 8).alias("log_density"),
        r6(crater.equilibrium_density(d), 7).alias("equilibrium"), r6(crater.capped_density(d, age), 9).alias("capped"),
        *[r6(n, 7 if n == "ejecta_extent" else 8).alias(n) for n in (
            "depth", "rim_height", "rim_width", "floor_ratio", "ejecta_extent", "ejecta_amplitude")],
        crater.geometry(big, c("degradation"))["central_peak"].alias("central_peak"),
        r6(crater.ejecta_thickness(d * 250, d * 375), 8).alias("blanket"))


@query("crater_csfd_bins", with_ctes(
    f"""SELECT b, {rnd('lo',7)} AS lo, {rnd('hi',7)} AS hi, {rnd('greatest(0,cl-ch)*area',5)} AS expected, (SELECT count(*) FROM crater_seeds WHERE diameter>=lo AND diameter<hi) AS observed FROM (
        SELECT *, least({_DENS.format(d='(lo/1e3)', t='3.5e0')}/1e6,0.084e0/(lo*lo)) AS cl, least({_DENS.format(d='(hi/1e3)', t='3.5e0')}/1e6,0.084e0/(hi*hi)) AS ch FROM (
        SELECT b, exp(ln(mn)+(ln(mx)-ln(mn))*b/48) AS lo, exp(ln(mn)+(ln(mx)-ln(mn))*(b+1)/48) AS hi, (SELECT max((max_x-min_x)*(max_z-min_z)) FROM layers) AS area
        FROM range(0,48) t(b), (SELECT min(diameter) AS mn, max(diameter)*1.001e0 AS mx FROM crater_seeds)))""", "crater_seeds", "layers"))
def crater_csfd_bins(spark, sf):
    seeds = fx.crater_seeds(spark, sf)
    area = fx.layers(spark, sf).agg(F.max((c("max_x") - c("min_x")) * (c("max_z") - c("min_z"))).alias("a")).first()["a"]
    ends = seeds.agg(F.min("diameter").alias("mn"), (F.max("diameter") * 1.001).alias("mx"))
    from gridloom.operators import population

    bins = population.crater_bins(ends, F.lit(3.5), F.lit(area))
    lims = ends.first()
    step = (math.log(lims["mx"]) - math.log(lims["mn"])) / 48
    # Arithmetic bin guess, then corrected against the exact bin edges.
    guess = F.floor((F.ln(c("diameter")) - math.log(lims["mn"])) / step)
    near = seeds.withColumn("b", F.explode(F.array(guess - 1, guess, guess + 1)))
    seen = near.join(bins.select("b", "lo", "hi"), "b").where((c("diameter") >= c("lo")) & (c("diameter") < c("hi"))).groupBy("b").agg(
        F.count("*").alias("observed"))
    return bins.join(seen, "b", "left").select(
        "b", r6("lo", 7).alias("lo"), r6("hi", 7).alias("hi"), r6("expected", 5).alias("expected"),
        F.coalesce("observed", F.lit(0)).alias("observed"))


@query("crater_volumes", with_ctes(
    f"""SELECT layer_id, seq, count(*) AS touched, {rnd('sum(CASE WHEN w<0 THEN -w*res*res ELSE 0 END)')} AS excavated, {rnd('sum(CASE WHEN w>=0 THEN w*res*res ELSE 0 END)')} AS deposited
        FROM stamps WHERE w<>0 GROUP BY ALL""", *_C, craters=CRATERS, stamps=STAMPS))
def crater_volumes(spark, sf):
    return stamping.crater_volumes(*craters_on_all_layers(spark, sf)).select("layer_id", "seq", "touched", r6("excavated").alias("excavated"), r6("deposited").alias("deposited"))


@query("crater_stamp_grid", with_ctes(
    f"""SELECT layer_id, row, count(*) AS touched, sum(n)::BIGINT AS stamps, {rnd('sum(h)', 3)} AS height_sum, sum(coalesce(zone,-1))::BIGINT AS zone_sum,
        count_if(source=1) AS promoted FROM (SELECT s.layer_id, s.row, s.col, any_value(b.source) AS source, count(*) AS n,
        list_reduce(list_prepend(any_value(b.h), list(w ORDER BY seq)), lambda a, w: (a+w)::FLOAT::DOUBLE) AS h,
        arg_max(CASE WHEN u<=floor_ratio THEN 3 WHEN u<0.92e0 THEN 4 WHEN u<=1.15e0 THEN 5 END, CASE WHEN u<=1.15e0 OR u<=floor_ratio THEN seq END) AS zone
        FROM stamps s JOIN samples b USING (layer_id,row,col) WHERE w<>0 GROUP BY s.layer_id, s.row, s.col) GROUP BY layer_id, row""", *_C, craters=CRATERS, stamps=STAMPS))
def crater_stamp_grid(spark, sf):
    rows = fx.raster_rows(spark, sf)
    seeds, layers = craters_on_all_layers(spark, sf)
    final = stamping.stamped_heights(seeds, rows, layers)
    j = final.join(rows.select("layer_id", "row", "source"), ["layer_id", "row"])
    # A measured sample that a synthetic crater changed becomes "measured plus synthetic".
    promoted = F.get("source", c("col")) == 1
    return j.groupBy("layer_id", "row").agg(
        F.count("*").alias("touched"), F.sum("changes").alias("stamps"), r6(F.sum(c("h").cast("double")), 3).alias("height_sum"),
        F.sum(F.coalesce(c("code"), F.lit(-1)).cast("long")).alias("zone_sum"), F.count_if(promoted).alias("promoted"))


# ------------------------------------------------------------------ rocks
_COUNT = """list_sum(list_transform(range(0,512), lambda i: (4*k*q*exp(-q*sqrt(exp(ln(lo)+(ln(hi)-ln(lo))*i/512)*exp(ln(lo)+(ln(hi)-ln(lo))*(i+1)/512)))
    /(pi()*exp(ln(lo)+(ln(hi)-ln(lo))*i/512)*exp(ln(lo)+(ln(hi)-ln(lo))*(i+1)/512)))*(exp(ln(lo)+(ln(hi)-ln(lo))*(i+1)/512)-exp(ln(lo)+(ln(hi)-ln(lo))*i/512))))"""


@query("rock_sfd", with_ctes(
    f"""SELECT id, {rnd('q',8)} AS q, {rnd('k*exp(-q*lo)',9)} AS area_fraction, {rnd('4*k*q*exp(-q*lo)/(pi()*lo*lo)',6)} AS density, {rnd(_COUNT,5)} AS per_m2,
        {rnd('-ln(exp(-q*lo)-0.3e0*(exp(-q*lo)-exp(-q*hi)))/q',8)} AS drawn FROM (SELECT s_suppkey AS id, 0.01e0+(s_suppkey%20)/1e2 AS k, 1.79e0+0.152e0/(0.01e0+(s_suppkey%20)/1e2) AS q,
        0.05e0+(s_suppkey%7)/1e2 AS lo, 0.5e0+(s_suppkey%11)/1e1 AS hi FROM supplier)"""))
def rock_sfd(spark, sf):
    s = c("s_suppkey")
    # 512 bins a row from a file that one task reads: dealt out first.
    dealt = fx.table(spark, sf, "supplier").select("s_suppkey").repartition(fold.task_count(spark), "s_suppkey")
    t = dealt.select(s.alias("id"), (0.01 + (s % 20) / 100.0).alias("k"),
                                               (0.05 + (s % 7) / 100.0).alias("lo"), (0.5 + (s % 11) / 10.0).alias("hi"))
    k, lo, hi = c("k"), c("lo"), c("hi")
    return t.select("id", r6(rock.decay(k), 8).alias("q"), r6(rock.area_fraction(k, lo), 9).alias("area_fraction"),
                    r6(rock.number_density(k, lo)).alias("density"), r6(rock.cumulative_count(k, lo, hi), 5).alias("per_m2"),
                    r6(rock.draw_diameter(k, lo, hi, F.lit(0.3)), 8).alias("drawn"))


@query("rock_ground", with_ctes(f"SELECT rock_id, layer_id, {rnd('ground')} AS ground, {rnd('y')} AS y FROM seated", *_R, **ROCKS))
def rock_ground(spark, sf):
    return seated_rocks(spark, sf).select("rock_id", "layer_id", r6("ground").alias("ground"), r6("y").alias("y"))


@query("rock_semantics", with_ctes(
    """SELECT layer_id, row, count_if(code=6) AS rock_samples, sum(code)::BIGINT AS code_sum FROM (SELECT s.layer_id, s.row, CASE WHEN m.col IS NOT NULL THEN 6 ELSE s.semantic END AS code FROM samples s LEFT JOIN
       (SELECT DISTINCT layer_id, row, col FROM (SELECT *, min_x+col*res-x AS dx, min_z+row*res-z AS dz FROM (SELECT r.*, greatest(scale_x,scale_z) AS rr, res, width, height, min_x, min_z FROM placed_rocks r JOIN layers USING (layer_id)),
        LATERAL (SELECT unnest(range(greatest(0,floor((z-rr-min_z)/res))::BIGINT, least(height-1,ceil((z+rr-min_z)/res))::BIGINT+1)) AS row),
        LATERAL (SELECT unnest(range(greatest(0,floor((x-rr-min_x)/res))::BIGINT, least(width-1,ceil((x+rr-min_x)/res))::BIGINT+1)) AS col)) WHERE dx*dx+dz*dz<=rr*rr) m
       USING (layer_id,row,col)) GROUP BY ALL""", *_R, placed_rocks=ROCKS["placed_rocks"]))
def rock_semantics(spark, sf):
    layers = fx.layers(spark, sf)
    rocks = sampling.finest_layer(fx.rock_seeds(spark, sf), layers)
    rows = stamping.mark_rocks(fx.raster_rows(spark, sf), rocks, layers)
    total = F.aggregate("semantic", F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.groupBy("layer_id", "row").agg(
        F.sum(F.size(F.filter("semantic", lambda v: v == 6)).cast("long")).alias("rock_samples"), F.sum(total).alias("code_sum"))


@query("rock_reseat", with_ctes(
    f"""SELECT rock_id, y2<y AS moved, {rnd('least(y2,y)')} AS y FROM (SELECT s.*, g2.h+scale_y*(1-2*buried) AS y2 FROM seated s JOIN ground2 g2 ON g2.pid=s.k
        WHERE s.x BETWEEN -4e0 AND 4e0 AND s.z BETWEEN -40e0 AND 40e0) WHERE ground IS NOT NULL""", *_R, **ROCKS,
    edited="SELECT layer_id, row, col, (h-CASE WHEN row%2=0 THEN 0.25e0 ELSE -0.25e0 END)::FLOAT::DOUBLE AS h FROM samples", ground2=bilinear_sql("src", "edited")))
def rock_reseat(spark, sf):
    layers, rows = fx.layers(spark, sf), fx.raster_rows(spark, sf)
    step = F.when(c("row") % 2 == 0, 0.25).otherwise(-0.25)
    edited = rows.withColumn("heights", F.transform("heights", lambda v: (v.cast("double") - step).cast("float")))
    box = spark.sql("SELECT -4D AS min_x, 4D AS max_x, -40D AS min_z, 40D AS max_z")
    out = stamping.reseat_rocks(seated_rocks(spark, sf).where(c("ground").isNotNull()), edited, layers, box)
    return out.select("rock_id", "moved", r6("y").alias("y"))


@query("rock_checks", with_ctes(
    """SELECT layer_id, count(*) AS rocks, count_if(y-scale_y>ground+1e-3) AS floating, count_if(y-(ground+scale_y*(1-2*buried))>greatest(0.05e0,scale_y*0.5e0)) AS burial_wrong,
       count_if(abs(sqrt(list_sum(list_transform(quaternion, lambda v: v*v)))-1)>1e-6) AS bad_rotation FROM faulty WHERE ground IS NOT NULL GROUP BY layer_id""", *_R, **ROCKS, faulty=FAULTY))
def rock_checks(spark, sf):
    r = faulty_rocks(spark, sf).where(c("ground").isNotNull())
    return r.groupBy("layer_id").agg(
        F.count("*").alias("rocks"), F.count_if(rules.floating()).alias("floating"), F.count_if(rules.burial_wrong()).alias("burial_wrong"),
        F.count_if(rules.bad_rotation()).alias("bad_rotation"))


@query("rock_budget_sample", with_ctes(
    """SELECT rock_id, physical, total, kept<total AS truncated FROM (SELECT *, count(*) FILTER (WHERE keep) OVER () AS kept FROM (SELECT *, CASE WHEN total<=budget THEN true WHEN bud<=0 THEN false ELSE
         (rn*bud)//n <> (rn*bud-1+n)//n OR rn=0 END AS k0, CASE WHEN total<=budget THEN true WHEN bud<=0 THEN false ELSE floor(ceil(rn*bud/n::DOUBLE)*n/bud)=rn AND ceil(rn*bud/n::DOUBLE)<bud END AS keep FROM (
       SELECT rock_id, physical, row_number() OVER (PARTITION BY physical ORDER BY rock_id)-1 AS rn, count(*) OVER (PARTITION BY physical) AS n, count(*) OVER () AS total, total*3//5 AS budget,
         CASE WHEN physical THEN least(n, budget) ELSE budget-least(count_if(physical) OVER (), budget) END AS bud FROM rock_seeds))) WHERE keep""", "rock_seeds"))
def rock_budget_sample(spark, sf):
    rocks = fx.rock_seeds(spark, sf)
    total = rocks.count()
    return stamping.budget_sample(rocks, "rock_id", "physical", total * 3 // 5).select("rock_id", "physical", "total", "truncated")


@query("feature_counts", with_ctes(
    """SELECT kind, physical, count(*) AS features FROM (SELECT 'crater' AS kind, NULL::BOOLEAN AS physical FROM crater_seeds UNION ALL SELECT 'rock', physical FROM rock_seeds
       UNION ALL SELECT kind, NULL FROM operations WHERE kind IN ('trench','berm','ramp','pad','spoil_pile','wheel_track','polygonal_cut','polygonal_fill')) GROUP BY ALL""",
    "crater_seeds", "rock_seeds", "operations"))
def feature_counts(spark, sf):
    from gridloom.codes import FEATURE_CLASS

    manifest = (fx.crater_seeds(spark, sf).select(F.lit("crater").alias("kind"))
                .unionByName(fx.rock_seeds(spark, sf).select(F.lit("rock").alias("kind"), "physical"), allowMissingColumns=True)
                .unionByName(fx.operations(spark, sf).where(c("kind").isin(*FEATURE_CLASS)).select("kind"), allowMissingColumns=True))
    return manifest.groupBy("kind", "physical").agg(F.count("*").alias("features"))
