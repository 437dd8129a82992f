"""Raster, georeferencing, stencil and point queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom import fixtures as fx
from gridloom.codes import BODY_RADIUS_M, ELEVATION_SOURCES, SEMANTIC_CLASSES
from gridloom.fixtures import rnd, with_ctes
from gridloom.functions import geo, mobility, overlay
from gridloom.operators import grid, sampling, stencil
from gridloom.registry import query

c = F.col


def r6(col, digits: int = 6):
    return F.round(col, digits)


# ------------------------------------------------------------------ stencils
_CLASS_SQL = "CASE WHEN slope>25 THEN 'unsafe_slope' WHEN slope>8 THEN 'rough_regolith' ELSE 'flat_regolith' END"
_SLOPE = "degrees(atan(sqrt(power((e-w)/(res*2),2)+power((s-n)/(res*2),2))))"
_IN = "col>0 AND row>0 AND col<width-1 AND row<height-1"


@query("slope_class_summary", with_ctes(
    f"""SELECT layer_id, cls AS class_name, count(*) AS samples, {rnd('coalesce(avg(slope),0)')} AS mean_slope_deg,
        {rnd('coalesce(max(slope),0)')} AS max_slope_deg
        FROM (SELECT layer_id, slope, CASE WHEN slope IS NULL THEN 'unknown' ELSE {_CLASS_SQL} END AS cls
              FROM (SELECT layer_id, CASE WHEN {_IN} THEN {_SLOPE} END AS slope FROM stencil)) GROUP BY ALL""", "stencil"))
def slope_class_summary(spark, sf):
    cells = grid.cells(fx.raster_rows(spark, sf), fx.layers(spark, sf))
    names = fx.lit_array(SEMANTIC_CLASSES)
    slope = stencil.interior_slope()
    code = stencil.classify_by_slope(F.lit(0), c("slope"))
    return (cells.withColumn("slope", slope).withColumn("class_name", F.get(names, code))
            .groupBy("layer_id", "class_name")
            .agg(F.count("*").alias("samples"), r6(F.coalesce(F.avg("slope"), F.lit(0.0))).alias("mean_slope_deg"),
                 r6(F.coalesce(F.max("slope"), F.lit(0.0))).alias("max_slope_deg")))


@query("slope_fill_classes", with_ctes(
    f"""SELECT layer_id, cls AS code, count(*) AS samples FROM (
        SELECT layer_id, CASE WHEN {_IN} AND semantic=0 THEN CASE WHEN {_SLOPE}>25 THEN 11 WHEN {_SLOPE}>8 THEN 2 ELSE 1 END
        ELSE semantic END AS cls FROM stencil) GROUP BY ALL""", "stencil"))
def slope_fill_classes(spark, sf):
    cells = grid.cells(fx.raster_rows(spark, sf), fx.layers(spark, sf), ("semantic",))
    code = stencil.classify_by_slope(c("semantic"), stencil.interior_slope())
    return cells.select("layer_id", code.alias("code")).groupBy("layer_id", "code").agg(F.count("*").alias("samples"))


@query("slope_clamped_stats", with_ctes(
    f"""SELECT layer_id, row, {rnd('avg(sl)')} AS mean_slope_deg, {rnd('max(sl)')} AS max_slope_deg FROM (
        SELECT layer_id, row, degrees(atan(sqrt(
          power((coalesce(e,h)-coalesce(w,h))/((least(col+1,width-1)-greatest(col-1,0))*res),2)+
          power((coalesce(s,h)-coalesce(n,h))/((least(row+1,height-1)-greatest(row-1,0))*res),2)))) AS sl FROM stencil)
        GROUP BY ALL""", "stencil"))
def slope_clamped_stats(spark, sf):
    cells = grid.cells(fx.raster_rows(spark, sf), fx.layers(spark, sf)).withColumn("sl", stencil.clamped_slope())
    return cells.groupBy("layer_id", "row").agg(
        r6(F.avg("sl")).alias("mean_slope_deg"), r6(F.max("sl")).alias("max_slope_deg"))


@query("mesh_normals", with_ctes(
    f"""SELECT layer_id, row, {rnd('sum(nx/len)')} AS sum_nx, {rnd('sum(1/len)')} AS sum_ny, {rnd('sum(nz/len)')} AS sum_nz
        FROM (SELECT *, sqrt(nx*nx+1+nz*nz) AS len FROM (SELECT layer_id, row,
          -(coalesce(e,h)-coalesce(w,h))/(2*res) AS nx, -(coalesce(s,h)-coalesce(n,h))/(2*res) AS nz FROM stencil)) GROUP BY ALL""",
    "stencil"))
def mesh_normals(spark, sf):
    cells = grid.cells(fx.raster_rows(spark, sf), fx.layers(spark, sf)).withColumn("v", stencil.mesh_normal())
    return cells.groupBy("layer_id", "row").agg(
        *[r6(F.sum(f"v.{a}")).alias(f"sum_n{a}") for a in "xyz"])


_FINEST = """(SELECT layer_id FROM layers l WHERE p.x BETWEEN l.min_x AND l.max_x AND p.z BETWEEN l.min_z AND l.max_z
    ORDER BY res, ordinal LIMIT 1)"""
_AT = """(SELECT id, layer_id, res, width, height, (x-min_x)/res AS fc, (z-min_z)/res AS fr FROM probes JOIN layers USING (layer_id))"""


def bilinear_sql(src: str, samples: str = "samples") -> str:
    """SQL for a bilinear read of ``src(pid, layer_id, x, z)`` giving ``pid, h``."""
    return f"""SELECT pid, CASE WHEN inside THEN a.h*(1-tc)*(1-tr)+b.h*tc*(1-tr)+g.h*(1-tc)*tr+d.h*tc*tr END AS h
      FROM (SELECT *, fc>=0 AND fr>=0 AND fc<=width-1 AND fr<=height-1 AS inside, floor(fc)::BIGINT AS c0, floor(fr)::BIGINT AS r0,
              least(floor(fc)::BIGINT+1,width-1) AS c1, least(floor(fr)::BIGINT+1,height-1) AS r1, fc-floor(fc) AS tc, fr-floor(fr) AS tr
            FROM (SELECT pid, p.layer_id, width, height, (p.x-min_x)/res AS fc, (p.z-min_z)/res AS fr
                  FROM {src} p LEFT JOIN layers l USING (layer_id))) q
      LEFT JOIN {samples} a ON a.layer_id=q.layer_id AND a.row=r0 AND a.col=c0 LEFT JOIN {samples} b ON b.layer_id=q.layer_id AND b.row=r0 AND b.col=c1
      LEFT JOIN {samples} g ON g.layer_id=q.layer_id AND g.row=r1 AND g.col=c0 LEFT JOIN {samples} d ON d.layer_id=q.layer_id AND d.row=r1 AND d.col=c1"""


PLACED = f"SELECT p.*, {_FINEST} AS layer_id FROM points p"
PROBED = """SELECT id*5+j AS pid, id, j, layer_id, x+dx*coalesce(res,0) AS x, z+dz*coalesce(res,0) AS z FROM placed LEFT JOIN
    (SELECT layer_id, res FROM layers) USING (layer_id), (VALUES (0,0,0),(1,-1,0),(2,1,0),(3,0,-1),(4,0,1)) o(j,dx,dz)"""
SURFACE = f"""SELECT id, max(layer_id) AS layer_id, max(CASE WHEN j=0 THEN h END) AS h0, max(CASE WHEN j=1 THEN h END) AS hw,
    max(CASE WHEN j=2 THEN h END) AS he, max(CASE WHEN j=3 THEN h END) AS hn, max(CASE WHEN j=4 THEN h END) AS hs
    FROM probes JOIN reads USING (pid) GROUP BY id"""
SHAPED = f"""SELECT s.*, res, coalesce(degrees(acos(1/sqrt(power((he-hw)/(2*res),2)+1+power((hs-hn)/(2*res),2)))),0) AS slope,
    coalesce(sqrt((coalesce(power(he-h0,2),0)+coalesce(power(hw-h0,2),0)+coalesce(power(hs-h0,2),0)+coalesce(power(hn-h0,2),0))/
      nullif((he-h0 IS NOT NULL)::INT+(hw-h0 IS NOT NULL)::INT+(hs-h0 IS NOT NULL)::INT+(hn-h0 IS NOT NULL)::INT,0)),0) AS rough
    FROM surface s LEFT JOIN layers USING (layer_id)"""
_SURFACE_CTES = dict(placed=PLACED, probes=PROBED, reads=bilinear_sql("probes"), surface=SURFACE, shaped=SHAPED)


def placed_points(spark, sf):
    return sampling.finest_layer(fx.points(spark, sf), fx.layers(spark, sf))


@query("world_slope", with_ctes(
    f"""SELECT id, layer_id, {rnd('h0')} AS ground, {rnd('slope',5)} AS slope_deg,
        {rnd('coalesce(-(he-hw)/(2*res)/sqrt(power((he-hw)/(2*res),2)+1+power((hs-hn)/(2*res),2)),0)')} AS nx,
        {rnd('coalesce(1/sqrt(power((he-hw)/(2*res),2)+1+power((hs-hn)/(2*res),2)),1)')} AS ny FROM shaped""",
    "points", "layers", "samples", **_SURFACE_CTES))
def world_slope(spark, sf):
    s = sampling.surface_at(placed_points(spark, sf), fx.raster_rows(spark, sf), fx.layers(spark, sf))
    return s.select("id", "layer_id", r6("ground").alias("ground"), r6("slope_deg", 5).alias("slope_deg"),
                    r6("nx").alias("nx"), r6("ny").alias("ny"))


@query("roughness_heuristic", with_ctes(
    f"""SELECT id, layer_id, {rnd('rough')} AS roughness_m, {rnd('score')} AS score,
        CASE WHEN slope>25 THEN 'unsafe_slope' WHEN score<0.4e0 THEN 'difficult' WHEN score<0.7e0 THEN 'moderate' ELSE 'traversable' END AS class
        FROM (SELECT *, 0.65e0*greatest(0,1-slope/25)+0.35e0*greatest(0,1-rough/(res*2)) AS score FROM shaped WHERE layer_id IS NOT NULL)""",
    "points", "layers", "samples", **_SURFACE_CTES))
def roughness_heuristic(spark, sf):
    p = placed_points(spark, sf).where(c("layer_id").isNotNull())
    s = sampling.surface_at(p, fx.raster_rows(spark, sf), fx.layers(spark, sf))
    s = s.withColumn("sc", mobility.heuristic_score(c("slope_deg"), c("roughness"), c("res")))
    return s.select("id", "layer_id", r6("roughness").alias("roughness_m"), r6("sc").alias("score"),
                    mobility.heuristic_class(c("slope_deg"), c("sc")).alias("class"))


def ramp_sql(t: str, ch: int) -> str:
    x = f"least(greatest({t},0e0),1e0)"
    out = "CASE "
    for a, b in zip(overlay.STOPS, overlay.STOPS[1:]):
        out += f"WHEN {x}<={b[0]}e0 THEN {a[ch+1]}e0+({x}-{a[0]}e0)/{b[0]-a[0]}e0*({b[ch+1]}e0-{a[ch+1]}e0) "
    return out + f"ELSE {overlay.STOPS[-1][ch+1]}e0 END"


@query("overlay_colours", with_ctes(
    f"""SELECT layer_id, row, {', '.join(f"{rnd(f'sum({ramp_sql('t', i)})')} AS elev_{n}" for i, n in enumerate('rgb'))},
        {', '.join(f"{rnd(f'sum({ramp_sql('sl/25', i)})')} AS slope_{n}" for i, n in enumerate('rgb'))},
        {rnd(f"sum({ramp_sql('rg/res', 1)})")} AS rough_g, {rnd(f"sum({ramp_sql('0.65e0*greatest(0,1-sl/25)+0.35e0*greatest(0,1-rg/(res*2))', 0)})")} AS trav_r,
        {rnd("sum((" + "[" + ",".join(f"{x[0]}e0" for x in overlay.CLASS_COLOURS) + "])[semantic+1])")} AS class_r
        FROM (SELECT layer_id, row, res, semantic, CASE WHEN hi>lo THEN (h-lo)/(hi-lo) ELSE 0.5e0 END AS t,
          degrees(atan(sqrt(power((coalesce(e,h)-coalesce(w,h))/((least(col+1,width-1)-greatest(col-1,0))*res),2)+
          power((coalesce(s,h)-coalesce(n,h))/((least(row+1,height-1)-greatest(row-1,0))*res),2)))) AS sl,
          sqrt((coalesce(power(e-h,2),0)+coalesce(power(w-h,2),0)+coalesce(power(n-h,2),0)+coalesce(power(s-h,2),0))/
            ((e IS NOT NULL)::INT+(w IS NOT NULL)::INT+(n IS NOT NULL)::INT+(s IS NOT NULL)::INT)) AS rg
          FROM stencil JOIN (SELECT layer_id, min(h) AS lo, max(h) AS hi FROM samples GROUP BY 1) USING (layer_id)) GROUP BY ALL""", "stencil"))
def overlay_colours(spark, sf):
    rows, layers = fx.raster_rows(spark, sf), fx.layers(spark, sf)
    cells = grid.cells(rows, layers, ("semantic",)).join(grid.vertical_bounds(rows), "layer_id")
    cells = cells.withColumn("t", overlay.unit_interval(c("h"), c("min_y"), c("max_y"))).withColumn(
        "sl", stencil.clamped_slope()).withColumn("rg", stencil.roughness())
    score = mobility.heuristic_score(c("sl"), c("rg"), c("res"))
    return cells.groupBy("layer_id", "row").agg(
        *[r6(F.sum(overlay.ramp(c("t"), i))).alias(f"elev_{n}") for i, n in enumerate("rgb")],
        *[r6(F.sum(overlay.ramp(c("sl") / 25.0, i))).alias(f"slope_{n}") for i, n in enumerate("rgb")],
        r6(F.sum(overlay.ramp(c("rg") / c("res"), 1))).alias("rough_g"),
        r6(F.sum(overlay.ramp(score, 0))).alias("trav_r"),
        r6(F.sum(overlay.class_colour(c("semantic"), 0))).alias("class_r"))


# ------------------------------------------------------------------ mobility
def drawbar_sql(deg: str, m="450e0", wh="4e0", b="0.2e0", r="0.25e0", g="1.62e0") -> dict[str, str]:
    load = f"({m}*{g}/{wh}*cos(radians({deg})))"
    k = f"(1400e0/{b}+820000e0)"
    z = f"(CASE WHEN {load}<=0 THEN 0e0 ELSE power({load}/({k}*{b}*sqrt({r}*2)), 2e0/3e0) END)"
    thrust = f"({wh}*({b}*sqrt({r}*2*{z})*170e0+{load}*tan(radians(35e0))))"
    comp = f"({wh}*CASE WHEN {z}<=0 THEN 0e0 ELSE {b}*{k}*power({z},2e0)/2e0 END)"
    return {"z": z, "thrust": thrust, "pull": f"({thrust}-{comp}-{m}*{g}*sin(radians({deg})))"}


_D = drawbar_sql("slope")


@query("mobility_by_class", with_ctes(
    f"""SELECT layer_id, class, count(*) AS samples, {rnd('avg(slope)')} AS mean_slope_deg, {rnd('avg(pull)', 4)} AS mean_pull_n,
        {rnd('avg(z)', 8)} AS mean_sinkage_m FROM (SELECT *, CASE WHEN pull<=0 OR z>0.125e0 THEN 'no-go' WHEN pull>0.2e0*thrust THEN 'go' ELSE 'marginal' END AS class
        FROM (SELECT layer_id, slope, {_D['z']} AS z, {_D['thrust']} AS thrust, {_D['pull']} AS pull FROM
          (SELECT layer_id, coalesce(degrees(acos(1/sqrt(power((e-w)/(2*res),2)+1+power((s-n)/(2*res),2)))),0) AS slope FROM stencil))) GROUP BY ALL""",
    "stencil"))
def mobility_by_class(spark, sf):
    cells = grid.cells(fx.raster_rows(spark, sf), fx.layers(spark, sf)).withColumn("sl", stencil.world_slope_on_grid())
    v = {k: F.lit(x) for k, x in mobility.VEHICLE.items()}
    d = mobility.drawbar(c("sl"), v)
    cells = cells.select("layer_id", "sl", d["pull"].alias("pull"), d["thrust"].alias("thrust"), d["sinkage"].alias("z"))
    cells = cells.withColumn("class", mobility.mobility_class(c("pull"), c("thrust"), c("z"), v["radius"]))
    return cells.groupBy("layer_id", "class").agg(
        F.count("*").alias("samples"), r6(F.avg("sl")).alias("mean_slope_deg"),
        r6(F.avg("pull"), 4).alias("mean_pull_n"), r6(F.avg("z"), 8).alias("mean_sinkage_m"))


_DV = drawbar_sql("(a.lo+a.hi)/2", "mass", "wheels", "width", "radius", "gravity")
_D0 = drawbar_sql("10e0", "mass", "wheels", "width", "radius", "gravity")


@query("slope_margin", with_ctes(
    f"""SELECT vehicle_id, {rnd('(res.lo+res.hi)/2')} AS margin_deg, {rnd(_D0['pull'], 4)} AS pull_10deg_n, {rnd(_D0['z'], 8)} AS sinkage_10deg_m,
        {rnd("2e4/(1400e0/width+820000e0)", 9)} AS plate_sinkage_m FROM (SELECT *,
        list_reduce(list_transform(range(61), lambda i: {{'lo':0e0,'hi':90e0}}), lambda a, b:
          CASE WHEN {_DV['pull']}>0 THEN {{'lo':(a.lo+a.hi)/2,'hi':a.hi}} ELSE {{'lo':a.lo,'hi':(a.lo+a.hi)/2}} END) AS res FROM vehicles)""", "vehicles"))
def slope_margin(spark, sf):
    v = {k: c(k) for k in ("mass", "wheels", "width", "radius", "gravity")}
    d = mobility.drawbar(F.lit(10.0), v)
    return fx.vehicles(spark, sf).select(
        "vehicle_id", r6(mobility.slope_margin(v)).alias("margin_deg"), r6(d["pull"], 4).alias("pull_10deg_n"),
        r6(d["sinkage"], 8).alias("sinkage_10deg_m"),
        r6(mobility.pressure_sinkage(F.lit(2e4), c("width")), 9).alias("plate_sinkage_m"))


# ------------------------------------------------------------------ grid facts
@query("raster_bounds", with_ctes(
    """SELECT layer_id, min(h) AS min_y, max(h) AS max_y, min(min_x) AS min_x, max(max_x) AS max_x, min(min(min_z)) OVER () AS union_min_z,
       max(max(max_z)) OVER () AS union_max_z FROM holes JOIN layers USING (layer_id) GROUP BY layer_id""", "holes", "layers"))
def raster_bounds(spark, sf):
    b = grid.vertical_bounds(fx.with_holes(fx.raster_rows(spark, sf)))
    layers = fx.layers(spark, sf)
    union = layers.agg(F.min("min_z").alias("union_min_z"), F.max("max_z").alias("union_max_z")).first()
    return b.join(layers, "layer_id").select(
        "layer_id", "min_y", "max_y", "min_x", "max_x", F.lit(union["union_min_z"]).alias("union_min_z"),
        F.lit(union["union_max_z"]).alias("union_max_z"))


@query("raster_quality", with_ctes(
    f"""SELECT layer_id, count(*) AS samples, count(h) AS valid, count(*)-count(h) AS missing, 0::BIGINT AS infinite,
        {rnd('avg(h)', 9)} AS mean, {rnd('(count(*)-count(h))/count(*)::DOUBLE', 9)} AS missing_share,
        count(*) = max(width*height) AS complete FROM holes JOIN layers USING (layer_id) GROUP BY layer_id""", "holes", "layers"))
def raster_quality(spark, sf):
    q = grid.quality(fx.with_holes(fx.raster_rows(spark, sf)))
    return q.join(fx.layers(spark, sf), "layer_id").select(
        "layer_id", "samples", "valid", "missing", "infinite", r6("mean", 9).alias("mean"),
        r6(c("missing") / c("samples"), 9).alias("missing_share"),
        (c("samples") == c("width") * c("height")).alias("complete"))


@query("datum_rebase", with_ctes(
    f"""SELECT layer_id, {rnd('max(d)', 9)} AS datum, {rnd('sum(h-d-(x*x+z*z)/(2*1737400e0))')} AS total,
        {rnd('max(h-d-(x*x+z*z)/(2*1737400e0))')} AS top, count(h) AS valid
        FROM (SELECT h.*, min_x+col*res AS x, min_z+row*res AS z, avg(h) OVER (PARTITION BY layer_id) AS d FROM holes h JOIN layers USING (layer_id)) GROUP BY layer_id""",
    "holes", "layers"))
def datum_rebase(spark, sf):
    s = grid.samples(fx.with_holes(fx.raster_rows(spark, sf)), fx.layers(spark, sf))
    return grid.rebase_to_mean(s, BODY_RADIUS_M).groupBy("layer_id").agg(
        r6(F.max("datum"), 9).alias("datum"), r6(F.sum("local")).alias("total"), r6(F.max("local")).alias("top"),
        F.count("h").alias("valid"))


_REQ = """SELECT c_custkey AS request_id, (['context-0','mission-1','operational-2'])[c_custkey%3+1] AS layer_id,
    c_custkey%75-4 AS col0, (c_custkey*13)%(n+8)-4 AS row0, 1+c_custkey%8 AS w, 1+c_custkey%5 AS h, c_custkey%4 AS stride FROM customer, n"""


def _requests(spark, sf):
    n = fx.raster_height(spark, sf)
    k = c("c_custkey")
    return fx.table(spark, sf, "customer").select(
        k.alias("request_id"),
        F.element_at(fx.lit_array(["context-0", "mission-1", "operational-2"]), (k % 3 + 1).cast("int")).alias("layer_id"),
        (k % 75 - 4).alias("col0"), ((k * 13) % (n + 8) - 4).alias("row0"), (1 + k % 8).alias("w"),
        (1 + k % 5).alias("h"), (k % 4).alias("stride"))


@query("window_read", with_ctes(
    f"""SELECT request_id, layer_id, bool_and(inside) AS inside, count(h) AS samples, {rnd('coalesce(sum(h),0)')} AS total FROM (
        SELECT q.*, s.h FROM (SELECT *, c1>c0 AND r1>r0 AS inside FROM (SELECT request_id, r.layer_id, least(greatest(col0,0),l.width-1) AS c0,
          least(greatest(row0,0),l.height-1) AS r0, least(greatest(col0+w,0),l.width) AS c1, least(greatest(row0+h,0),l.height) AS r1
          FROM req r JOIN layers l USING (layer_id))) q
        LEFT JOIN samples s ON s.layer_id=q.layer_id AND s.row>=r0 AND s.row<r1 AND s.col>=c0 AND s.col<c1) GROUP BY request_id, layer_id""",
    "layers", "samples", req=_REQ))
def window_read(spark, sf):
    w = grid.read_windows(_requests(spark, sf), fx.raster_rows(spark, sf), fx.layers(spark, sf))
    total = F.aggregate(F.coalesce("heights", F.array().cast("array<float>")), F.lit(0.0), lambda a, v: a + v)
    return w.groupBy("request_id", "layer_id").agg(
        F.bool_and("inside").alias("inside"),
        F.coalesce(F.sum(F.size("heights").cast("long")), F.lit(0)).alias("samples"), r6(F.sum(total)).alias("total"))


@query("tile_stride", with_ctes(
    f"""SELECT request_id, layer_id, status, CASE WHEN status='ok' THEN (w-1)//stride+1 END AS out_width, CASE WHEN status='ok' THEN (h-1)//stride+1 END AS out_height,
        res*stride AS spacing, {rnd('coalesce((SELECT sum(s.h) FROM samples s WHERE status=\'ok\' AND s.layer_id=q.layer_id AND s.row BETWEEN row0 AND row0+q.h-1 AND s.col BETWEEN col0 AND col0+w-1 AND (s.row-row0)%q.stride=0 AND (s.col-col0)%q.stride=0),0)')} AS total
        FROM (SELECT r.*, res, CASE WHEN col0<0 OR row0<0 OR w<1 OR h<1 THEN 'not a positive range' WHEN stride<1 THEN 'bad stride'
          WHEN col0+w>width OR row0+h>height THEN 'outside the grid' ELSE 'ok' END AS status FROM req r JOIN layers USING (layer_id)) q""",
    "layers", "samples", req=_REQ))
def tile_stride(spark, sf):
    t = grid.read_tiles(_requests(spark, sf), fx.raster_rows(spark, sf), fx.layers(spark, sf))
    total = F.aggregate(F.coalesce("heights", F.array().cast("array<float>")), F.lit(0.0), lambda a, v: a + v)
    return t.groupBy("request_id", "layer_id", "status", "out_width", "out_height", "spacing").agg(r6(F.sum(total)).alias("total"))


_BOX = "SELECT seq, layer_id, cx-radius AS min_x, cx+radius AS max_x, cz-radius AS min_z, cz+radius AS max_z FROM operations"


@query("tiles_in_bounds", with_ctes(
    """SELECT tile_id, count(*) AS edits, min(seq) AS first_seq, max(seq) AS last_seq FROM (
       SELECT seq, format('{}_t{:06d}_{:06d}', t.layer_id, tc, tr) AS tile_id FROM
        (SELECT b.*, greatest(0,floor((b.min_x-l.min_x)/res)) AS c0, least(width-1,ceil((b.max_x-l.min_x)/res)) AS c1,
           greatest(0,floor((b.min_z-l.min_z)/res)) AS r0, least(height-1,ceil((b.max_z-l.min_z)/res)) AS r1 FROM box b JOIN layers l USING (layer_id)) b
        JOIN (SELECT layer_id, i*31 AS tc, j*31 AS tr, least(i*31+31,width-1) AS tc1, least(j*31+31,height-1) AS tr1 FROM layers,
           range(0,3) a(i), range(0,1000) d(j) WHERE i*31<width-1 AND j*31<height-1) t
        ON t.layer_id=b.layer_id AND NOT (tc1<c0 OR tc>c1 OR tr1<r0 OR tr>r1)) GROUP BY tile_id""", "operations", "layers", box=_BOX))
def tiles_in_bounds(spark, sf):
    box = fx.operations(spark, sf).select(
        "seq", "layer_id", (c("cx") - c("radius")).alias("min_x"), (c("cx") + c("radius")).alias("max_x"),
        (c("cz") - c("radius")).alias("min_z"), (c("cz") + c("radius")).alias("max_z"))
    return grid.tiles_in_bounds(box, fx.layers(spark, sf), 32).groupBy("tile_id").agg(
        F.count("*").alias("edits"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("quantise_u16", with_ctes(
    f"""SELECT layer_id, row, sum(q)::BIGINT AS code_sum, {rnd('max(abs(lo+q*rg/65535e0-h))', 9)} AS max_error FROM (
        SELECT *, coalesce(least(greatest(floor((h-lo)/rg*65535e0+0.5e0),0),65535),0)::BIGINT AS q FROM holes JOIN
        (SELECT layer_id, min(h) AS lo, CASE WHEN max(h)=min(h) THEN 1 ELSE max(h)-min(h) END AS rg FROM holes GROUP BY 1) USING (layer_id)) GROUP BY ALL""", "holes"))
def quantise_u16(spark, sf):
    q = grid.quantise(fx.with_holes(fx.raster_rows(spark, sf)))
    pairs = q.select("layer_id", "row", "min_y", "unit", F.explode(F.arrays_zip("heights", "codes")).alias("p"))
    err = F.abs(c("min_y") + c("p.codes") * c("unit") - c("p.heights"))
    return pairs.groupBy("layer_id", "row").agg(
        F.sum(c("p.codes").cast("long")).alias("code_sum"), r6(F.max(err), 9).alias("max_error"))


# ------------------------------------------------------------------ points
@query("finest_layer_points", with_ctes(f"SELECT p.id, {_FINEST} AS layer_id FROM points p", "points", "layers"))
def finest_layer_points(spark, sf):
    return placed_points(spark, sf).select("id", "layer_id")


@query("bilinear_points", with_ctes(
    f"""SELECT p.id, p.layer_id, {rnd('a.h')} AS on_full, {rnd('b.h')} AS on_holes FROM placed p JOIN reads a ON a.pid=p.id JOIN reads_holes b ON b.pid=p.id""",
    "points", "layers", "samples", "holes", placed=PLACED, src="SELECT id AS pid, * FROM placed", reads=bilinear_sql("src"),
    reads_holes=bilinear_sql("src", "holes")))
def bilinear_points(spark, sf):
    rows, layers = fx.raster_rows(spark, sf), fx.layers(spark, sf)
    full = sampling.bilinear(placed_points(spark, sf), rows, layers, "a")
    both = sampling.bilinear(full, fx.with_holes(rows), layers, "b")
    return both.select("id", "layer_id", r6("a").alias("on_full"), r6("b").alias("on_holes"))


@query("nearest_class", with_ctes(
    f"""SELECT p.id, p.layer_id, ({fx._CLASSES_SQL})[semantic+1] AS class_name FROM placed p LEFT JOIN layers l USING (layer_id)
        LEFT JOIN samples s ON s.layer_id=p.layer_id AND s.col=least(greatest(floor((p.x-min_x)/res+0.5e0),0),width-1)
          AND s.row=least(greatest(floor((p.z-min_z)/res+0.5e0),0),height-1)""", "points", "layers", "samples", placed=PLACED))
def nearest_class(spark, sf):
    n = sampling.nearest_code(placed_points(spark, sf), fx.raster_rows(spark, sf), fx.layers(spark, sf))
    return n.select("id", "layer_id", F.get(fx.lit_array(SEMANTIC_CLASSES), c("code")).alias("class_name"))


# ------------------------------------------------------------------ georeferencing
_GEO = """SELECT c_custkey AS id, CASE WHEN c_custkey%2=0 THEN -1e0 ELSE 1e0 END AS hemi,
    CASE WHEN c_custkey%100=0 THEN 90e0 ELSE 60e0+(c_custkey*31%3000)/1e2 END*CASE WHEN c_custkey%2=0 THEN -1e0 ELSE 1e0 END AS lat,
    (c_custkey*37%720)-360+0.25e0 AS lon, (c_custkey%3)*10e0 AS lon0, (c_custkey%2)*1000e0 AS fe, 0e0 AS fn, 1e0-(c_custkey%2)*0.006e0 AS k0 FROM customer"""
_NL = "({d}-floor({d}/360)*360 - CASE WHEN {d}-floor({d}/360)*360>180 THEN 360 ELSE 0 END)"


def _geo_points(spark, sf):
    k = c("c_custkey")
    hemi = F.when(k % 2 == 0, -1.0).otherwise(1.0)
    return fx.table(spark, sf, "customer").select(
        k.alias("id"), (hemi < 0).alias("south"),
        (F.when(k % 100 == 0, 90.0).otherwise(60.0 + (k * 31 % 3000) / 100.0) * hemi).alias("lat"),
        ((k * 37 % 720) - 360 + 0.25).alias("lon"), ((k % 3) * 10.0).alias("lon0"), ((k % 2) * 1000.0).alias("fe"),
        F.lit(0.0).alias("fn"), (1.0 - (k % 2) * 0.006).alias("k0"))


@query("polar_roundtrip", with_ctes(
    f"""SELECT id, {rnd('x',3)} AS x, {rnd('y',3)} AS y, {rnd('lat2',7)} AS lat, {rnd('lon2',7)} AS lon, {rnd('2*k0/(1+sin(radians(abs(lat))))',9)} AS scale,
        {rnd('lon-floor(lon/360)*360')} AS lon360 FROM (SELECT *,
        CASE WHEN rho=0 THEN hemi*90e0 ELSE hemi*degrees(pi()/2-2*atan(rho/(2*1737400e0*k0))) END AS lat2,
        CASE WHEN rho=0 THEN lon0 ELSE {_NL.format(d='(lon0+degrees(atan2(px,-hemi*py)))')} END AS lon2
        FROM (SELECT *, sqrt(px*px+py*py) AS rho FROM (SELECT *, x-fe AS px, y-fn AS py FROM (SELECT *,
          2*1737400e0*k0*tan(pi()/4-hemi*radians(lat)/2)*sin(radians(lon-lon0))+fe AS x,
          -hemi*2*1737400e0*k0*tan(pi()/4-hemi*radians(lat)/2)*cos(radians(lon-lon0))+fn AS y FROM g))))""", g=_GEO))
def polar_roundtrip(spark, sf):
    g = _geo_points(spark, sf)
    args = (c("south"), c("lon0"), c("k0"), c("fe"), c("fn"))
    x, y = geo.polar_forward(c("lat"), c("lon"), *args)
    g = g.withColumn("x", x).withColumn("y", y)
    lat2, lon2 = geo.polar_inverse(c("x"), c("y"), *args)
    return g.select("id", r6("x", 3).alias("x"), r6("y", 3).alias("y"), r6(lat2, 7).alias("lat"), r6(lon2, 7).alias("lon"),
                    r6(geo.scale_factor(c("lat"), c("k0")), 9).alias("scale"), r6(geo.norm360(c("lon"))).alias("lon360"))


@query("local_frame", with_ctes(
    f"""SELECT id, {rnd('px',3)} AS px, {rnd('py',3)} AS py, {rnd('dx*ex+dy*ey',5)} AS back_x, {rnd('dx*sx+dy*sy',5)} AS back_z,
        {rnd('hemi*degrees(pi()/2-2*atan(sqrt((px-fe)*(px-fe)+(py-fn)*(py-fn))/(2*1737400e0*k0)))',7)} AS point_lat FROM (
        SELECT *, (px-ox)/sc AS dx, (py-oy)/sc AS dy FROM (SELECT *, ox+(lx*ex+lz*sx)*sc AS px, oy+(lx*ey+lz*sy)*sc AS py FROM (
        SELECT *, cos(t) AS ex, hemi*sin(t) AS ey, hemi*sin(t) AS sx, -cos(t) AS sy, 2*k0/(1+sin(radians(abs(lat)))) AS sc,
          2*1737400e0*k0*tan(pi()/4-hemi*radians(lat)/2)*sin(t)+fe AS ox, -hemi*2*1737400e0*k0*tan(pi()/4-hemi*radians(lat)/2)*cos(t)+fn AS oy,
          (id%200-100)*5e0 AS lx, (id%77-38)*7e0 AS lz FROM (SELECT *, radians(lon-lon0) AS t FROM g))))""", g=_GEO))
def local_frame(spark, sf):
    g = _geo_points(spark, sf).withColumn(
        "f", geo.local_frame(c("lat"), c("lon"), c("south"), c("lon0"), c("k0"), c("fe"), c("fn")))
    px, py = geo.local_to_projected(c("f"), (c("id") % 200 - 100) * 5.0, (c("id") % 77 - 38) * 7.0)
    g = g.withColumn("px", px).withColumn("py", py)
    bx, bz = geo.projected_to_local(c("f"), c("px"), c("py"))
    lat, _ = geo.polar_inverse(c("px"), c("py"), c("south"), c("lon0"), c("k0"), c("fe"), c("fn"))
    return g.select("id", r6("px", 3).alias("px"), r6("py", 3).alias("py"), r6(bx, 5).alias("back_x"),
                    r6(bz, 5).alias("back_z"), r6(lat, 7).alias("point_lat"))


@query("pixel_georef", with_ctes(
    f"""SELECT id, corner, {rnd('col',6)} AS col, {rnd('row',6)} AS row, {rnd('CASE WHEN corner THEN off+(col+0.5e0)*20 ELSE (col-off)*20 END',3)} AS back_x,
        {rnd('CASE WHEN corner THEN off-(row+0.5e0)*20 ELSE (off-row)*20 END',3)} AS back_y FROM (SELECT *,
        CASE WHEN corner THEN (x-off)/20-0.5e0 ELSE x/20+off END AS col, CASE WHEN corner THEN (off-y)/20-0.5e0 ELSE off-y/20 END AS row FROM (
        SELECT id, id%3=0 AS corner, CASE WHEN id%3=0 THEN 500e0 ELSE 31.5e0 END AS off, 2*1737400e0*tan(pi()/4-radians(abs(lat))/2)*sin(radians(lon)) AS x,
        2*1737400e0*tan(pi()/4-radians(abs(lat))/2)*cos(radians(lon)) AS y FROM g))""", g=_GEO))
def pixel_georef(spark, sf):
    g = _geo_points(spark, sf)
    x, y = geo.polar_forward(-F.abs(c("lat")), c("lon"), F.lit(True))
    corner = c("id") % 3 == 0
    g = g.select("id", corner.alias("corner"), x.alias("x"), y.alias("y"), F.when(corner, 500.0).otherwise(31.5).alias("off"))
    col, row = geo.projected_to_pixel(c("x"), c("y"), 20.0, c("off"), c("off"), c("corner"))
    g = g.withColumn("col", col).withColumn("row", row)
    bx, by = geo.pixel_to_projected(c("col"), c("row"), 20.0, c("off"), c("off"), c("corner"))
    return g.select("id", "corner", r6("col").alias("col"), r6("row").alias("row"), r6(bx, 3).alias("back_x"), r6(by, 3).alias("back_y"))


# ------------------------------------------------------------------ resampling and holes
_SITES = "SELECT s_suppkey AS site, (s_suppkey%40-20)*30e0+7 AS ox, ((s_suppkey*7)%100-50)*40e0+3 AS oy FROM supplier"


@query("resample_grid", with_ctes(
    f"""SELECT site, count(*) AS samples, {rnd('(count(*)-count(h))/count(*)::DOUBLE')} AS missing_share, {rnd('avg(h)')} AS datum,
        {rnd('sum(h-d-(lx*lx+lz*lz)/(2*1737400e0))')} AS total, {rnd('max(15e0/(20e0/sc))')} AS pixels_per_sample FROM (SELECT *, avg(h) OVER (PARTITION BY site) AS d FROM
        (SELECT t.*, r.h FROM target t JOIN reads r USING (pid))) GROUP BY site HAVING count(h)>0""",
    "n", "holes", sites=_SITES, frames=f"""SELECT site, ox, oy, t, sc, cos(t) AS ex, -sin(t) AS ey, -sin(t) AS sx, -cos(t) AS sy FROM (
      SELECT *, radians({_NL.format(d='degrees(atan2(ox,oy))')}) AS t, 2/(1+sin(radians(abs(degrees(2*atan(sqrt(ox*ox+oy*oy)/(2*1737400e0))-pi()/2))))) AS sc FROM sites)""",
    target="""SELECT (site*9+i)*9+j AS pid, 'context-0' AS layer_id, site, lx, lz, sc, (fx+(lx*ex+lz*sx)*sc)/20+31.5e0 AS x, (n-1)/2e0-(fy+(lx*ey+lz*sy)*sc)/20 AS z
      FROM (SELECT *, ox AS fx, oy AS fy FROM frames), (SELECT i, j, -60+i*15e0 AS lx, -60+j*15e0 AS lz FROM range(0,9) a(i), range(0,9) b(j)), n""",
    layers="SELECT 'context-0' AS layer_id, 1e0 AS res, 64 AS width, n AS height, 0e0 AS min_x, 0e0 AS min_z FROM n",
    reads=bilinear_sql("target", "holes")))
def resample_grid(spark, sf):
    n = fx.raster_height(spark, sf)
    k = c("s_suppkey")
    sites = fx.table(spark, sf, "supplier").select(
        k.alias("site"), ((k % 40 - 20) * 30.0 + 7).alias("ox"), (((k * 7) % 100 - 50) * 40.0 + 3).alias("oy"))
    return sampling_resample(sites, fx.with_holes(fx.raster_rows(spark, sf)), n)


def sampling_resample(sites, rows, height: int):
    """Tangent-plane grids around sites from a projected raster: frame, pixels, bilinear, datum."""
    south = F.lit(True)
    lat, lon = geo.polar_inverse(c("ox"), c("oy"), south)
    sites = sites.withColumn("f", geo.local_frame(lat, lon, south))
    axis = F.sequence(F.lit(0), F.lit(8))
    t = sites.withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis))
    t = t.withColumn("lx", c("i") * 15.0 - 60).withColumn("lz", c("j") * 15.0 - 60)
    px, py = geo.local_to_projected(c("f"), c("lx"), c("lz"))
    pc, pr = geo.projected_to_pixel(px, py, 20.0, 31.5, (height - 1) / 2)
    t = t.withColumn("pcol", pc).withColumn("prow", pr)
    h = sampling.read_pixels(t.select("site", "lx", "lz", c("f.scale").alias("sc"), "pcol", "prow"),
                             rows, fx.WIDTH, height, "context-0")
    datum = h.groupBy("site").agg(F.avg("h").alias("d")).where(c("d").isNotNull())
    h = h.join(datum, "site")
    return h.groupBy("site").agg(
        F.count("*").alias("samples"), r6((F.count("*") - F.count("h")) / F.count("*")).alias("missing_share"),
        r6(F.avg("h")).alias("datum"),
        r6(F.sum(c("h") - c("d") - geo.curvature_drop(c("lx"), c("lz")))).alias("total"),
        r6(F.max(F.lit(15.0) / (F.lit(20.0) / c("sc")))).alias("pixels_per_sample"))


_FILL = """SELECT layer_id, row, col, CASE WHEN h IS NOT NULL THEN h ELSE (SELECT avg(b.h)::FLOAT::DOUBLE FROM {src} b WHERE b.layer_id=a.layer_id
    AND b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1) END AS h FROM {src} a"""


@query("nodata_fill", with_ctes(
    f"""SELECT layer_id, row, count(*) AS samples, count(h) AS valid, {rnd('sum(h)')} AS total FROM p3 GROUP BY ALL""",
    "samples", p0="SELECT layer_id, row, col, CASE WHEN NOT (row%9<3 AND col%13<3) THEN h END AS h FROM samples",
    p1=_FILL.format(src="p0"), p2=_FILL.format(src="p1"), p3=_FILL.format(src="p2")))
def nodata_fill(spark, sf):
    rows = fx.raster_rows(spark, sf).select("layer_id", "row", F.transform(
        "heights", lambda v, i: F.when(~((c("row") % 9 < 3) & (i % 13 < 3)), v)).alias("heights"))
    f = stencil.fill_no_data(rows).select("layer_id", "row", F.explode("heights").alias("h"))
    return f.groupBy("layer_id", "row").agg(
        F.count("*").alias("samples"), F.count("h").alias("valid"), r6(F.sum(c("h").cast("double"))).alias("total"))


@query("code_names", with_ctes(
    f"""SELECT layer_id, ({fx._CLASSES_SQL})[semantic+1] AS class_name, ([{",".join(f"'{s}'" for s in ELEVATION_SOURCES)}])[source+1] AS source_name,
        count(*) AS samples FROM samples GROUP BY ALL""", "samples"))
def code_names(spark, sf):
    rows = fx.raster_rows(spark, sf).select("layer_id", F.explode(F.arrays_zip("semantic", "source")).alias("m"))
    name = lambda table, code: F.get(fx.lit_array(table), code.cast("int"))
    return rows.groupBy("layer_id", name(SEMANTIC_CLASSES, c("m.semantic")).alias("class_name"),
                        name(ELEVATION_SOURCES, c("m.source")).alias("source_name")).agg(F.count("*").alias("samples"))
