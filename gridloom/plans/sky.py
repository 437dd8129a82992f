"""Time, sun, ephemeris, skyline and illumination queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom import fixtures as fx
from gridloom.codes import BODY_RADIUS_M
from gridloom.fixtures import rnd, with_ctes
from gridloom.functions import geo, solar
from gridloom.operators import ephemeris, horizon, sampling
from gridloom.plans.raster import bilinear_sql, r6
from gridloom.registry import query
from gridloom.session import cut_lineage

c = F.col

_LEAP = "CASE " + " ".join(f"WHEN epoch>=TIMESTAMP '{d}' THEN {v}" for d, v in reversed(solar.LEAP_SECONDS)) + " ELSE 10 END"
_TIME = f"""SELECT *, days/36525e0 AS t FROM (SELECT *, jd+(tai+32.184e0)/86400e0-2451545e0 AS days FROM (SELECT epoch, {_LEAP} AS tai, epoch_us(epoch)/1e6/86400e0+2440587.5e0 AS jd FROM epochs))"""


@query("leap_asof", with_ctes(f"SELECT epoch, tai AS tai_utc, {rnd('days', 6)} AS days_tt, {rnd('t', 9)} AS centuries FROM tm", "epochs", tm=_TIME))
def leap_asof(spark, sf):
    return solar.with_time(fx.epochs(spark, sf)).select("epoch", "tai_utc", r6("days_tt").alias("days_tt"), r6("T", 9).alias("centuries"))


@query("sun_position", with_ctes(
    f"""SELECT epoch, {rnd('lon-floor(lon/360)*360', 6)} AS longitude_deg, {rnd('1.000001018e0*(1-e*e)/(1+e*cos(radians(m+cc)))', 8)} AS distance_au, {rnd('23+26/60e0+(21.448e0-t*(46.815e0+t*(0.00059e0-t*0.001813e0)))/3600', 8)} AS obliquity_deg
        FROM (SELECT *, l0+cc AS lon FROM (SELECT *, (1.914602e0-0.004817e0*t-0.000014e0*t*t)*sin(radians(m))+(0.019993e0-0.000101e0*t)*sin(radians(2*m))+0.000289e0*sin(radians(3*m)) AS cc FROM
        (SELECT *, 280.46646e0+36000.76983e0*t+0.0003032e0*t*t AS l0, 357.52911e0+35999.05029e0*t-0.0001537e0*t*t AS m, 0.016708634e0-0.000042037e0*t-0.0000001267e0*t*t AS e FROM tm)))""", "epochs", tm=_TIME))
def sun_position(spark, sf):
    t = solar.with_time(fx.epochs(spark, sf))
    lon, r = solar.sun_terms(c("T"))
    return t.select("epoch", r6(lon).alias("longitude_deg"), r6(r, 8).alias("distance_au"), r6(F.degrees(solar.obliquity(c("T"))), 8).alias("obliquity_deg"))


def site_table(spark, sf):
    k = c("n_nationkey")
    return fx.table(spark, sf, "nation").select(k.alias("site"), (-90.0 + k * 2.5).alias("lat"), (k * 17.0 - 180).alias("lon"))


@query("solar_track")
def solar_track(spark, sf):
    """Sun over every site of the nation table at every order date; sites are a fixed small table."""
    ep = solar.sub_solar(fx.epochs(spark, sf))
    sites = F.array(*[F.struct(F.lit(r["site"]).alias("site"), F.lit(r["lat"]).alias("lat"), F.lit(r["lon"]).alias("lon"))
                      for r in site_table(spark, sf).collect()])
    t = ep.withColumn("s", F.explode(sites))
    t = solar.at_site(t, c("s.lat"), c("s.lon"))
    return t.select(c("s.site").alias("site"), "epoch", r6("sub_lat").alias("sub_lat"), r6("sub_lon").alias("sub_lon"),
                    r6("elevation_deg").alias("elevation_deg"), r6("azimuth_deg").alias("azimuth_deg"),
                    r6(solar.disc_fraction(c("elevation_deg"), c("sun_radius_deg"))).alias("disc_fraction"),
                    r6(F.least(solar.shadow_length(F.lit(1.0), c("elevation_deg")), F.lit(1e6)), 3).alias("shadow_m"))


# ------------------------------------------------------------------ coefficient tables
_CHEB = """list_reduce(list_prepend({{'b1':0e0,'b2':0e0,'k':0e0}}, list_transform(list_reverse({v}[2:]), lambda k: {{'b1':0e0,'b2':0e0,'k':k}})), lambda a, b: {{'b1':2*tau*a.b1-a.b2+b.k,'b2':a.b1,'k':0e0}})"""
_EVAL = f"""SELECT id, covered, {", ".join(f"tau*{_CHEB.format(v='coef_'+a)}.b1-{_CHEB.format(v='coef_'+a)}.b2+coef_{a}[1] AS p{a}" for a in "xyz")} FROM (SELECT q.id, covered, (et-mid)/radius AS tau, r.* FROM q LEFT JOIN coef_records r ON covered AND r.rec=idx)"""
_Q = """SELECT id, et, et BETWEEN 0 AND n*10 AS covered, least(greatest(floor(et/10),0),n-1)::BIGINT AS idx FROM (SELECT event_id AS id, CASE WHEN event_id%97=0 THEN -5e0 ELSE (event_id*7919%(n*1000+1))/1e2 END AS et, n FROM events, n)"""


def _requests(spark, sf):
    n = fx.raster_height(spark, sf)
    e = c("event_id")
    return fx.table(spark, sf, "events").select(e.alias("id"), F.when(e % 97 == 0, -5.0).otherwise((e * 7919 % (n * 1000 + 1)) / 100.0).alias("et")), n


@query("chebyshev_eval", with_ctes(f"SELECT id, covered, {', '.join(f'{rnd('p'+a, 5)} AS p{a}' for a in 'xyz')} FROM ev", "n", "coef_records", q=_Q, ev=_EVAL))
def chebyshev_eval(spark, sf):
    req, n = _requests(spark, sf)
    p = ephemeris.evaluate(req, fx.coef_records(spark, sf), 0.0, 10.0, n)
    return p.select("id", "covered", *[r6("p" + a, 5).alias("p" + a) for a in "xyz"])


_SEGMENTS = "VALUES (301, 3, 1.0D), (3, 0, 2.0D), (10, 0, -0.5D), (77, 78, 1.0D), (78, 77, 1.0D) AS t(target, center, k)"


def _segments(spark, sf):
    """Segments, and the coefficient records of each: the common ones times a factor per segment."""
    seg = spark.sql(f"SELECT * FROM {_SEGMENTS}")
    records = fx.coef_records(spark, sf).crossJoin(F.broadcast(seg.select("target", "k")))
    scaled = {f"coef_{a}": F.transform(f"coef_{a}", lambda v: v * c("k")) for a in "xyz"}
    return seg.select("target", "center"), records.withColumns(scaled).drop("k")


@query("body_chain", with_ctes(
    f"""SELECT body, count(*) AS requests, count_if(status='ok') AS resolved, {', '.join(f"{rnd(f'sum(CASE WHEN status=\'ok\' THEN k*p{a} END)', 3)} AS {a}_sum" for a in "xyz")}, min(status) AS first_status FROM (SELECT ([301,3,10,399,77])[id%5+1] AS body, CASE WHEN NOT covered THEN 'out of coverage' WHEN id%5=3 THEN 'missing 399' WHEN id%5=4 THEN 'loop at 77' ELSE 'ok' END AS status,
        CASE WHEN id%5=0 THEN 3e0 WHEN id%5=1 THEN 2e0 ELSE -0.5e0 END AS k, px, py, pz FROM ev) GROUP BY body""", "n", "coef_records", q=_Q, ev=_EVAL))
def body_chain(spark, sf):
    """Positions of bodies relative to the root, summed over the segments of their chains."""
    req, n = _requests(spark, sf)
    body = F.element_at(F.array(*[F.lit(b) for b in (301, 3, 10, 399, 77)]), (c("id") % 5 + 1).cast("int"))
    p = ephemeris.chain_positions(req.withColumn("body", body), *_segments(spark, sf), 0.0, 10.0, n)
    p = p.withColumn("status", F.when(~c("covered"), "out of coverage").otherwise(c("chain_status")))
    return p.groupBy("body").agg(
        F.count("*").alias("requests"), F.count_if(c("status") == "ok").alias("resolved"),
        *[r6(F.sum(F.when(c("status") == "ok", c("p" + a))), 3).alias(f"{a}_sum") for a in "xyz"], F.min("status").alias("first_status"))


def _turned_sql(src, turns):
    """Nested rotations of x, y, z in ``src``: pairs of axes turn by an angle one after the other."""
    for angle, i, j in turns:
        rest = ({"x", "y", "z"} - {i, j}).pop()
        src = f"(SELECT id, phi, delta, w, {rest}, cos({angle})*{i}-sin({angle})*{j} AS {i}, sin({angle})*{i}+cos({angle})*{j} AS {j} FROM {src})"
    return src


_A1, _A2, _A3 = (f"radians({v!r}e0/3600)" for v in solar.PRINCIPAL_TO_MEAN_ARCSEC)


@query("kernel_sun_direction", with_ctes(
    f"""SELECT id, {', '.join(f"{rnd(f'{a}/sqrt(x*x+y*y+z*z)')} AS {a}" for a in "xyz")} FROM {_turned_sql(
        "(SELECT id, px/1e1 AS phi, py/1e1 AS delta, pz/1e1 AS w, -3.5e0*px AS x, -3.5e0*py AS y, -3.5e0*pz AS z FROM ev WHERE covered)",
        [("-phi", "x", "y"), ("-delta", "y", "z"), ("-w", "x", "y"), (_A1, "x", "y"), (_A2, "z", "x"), (_A3, "y", "z")])}""", "n", "coef_records", q=_Q, ev=_EVAL))
def kernel_sun_direction(spark, sf):
    """Direction of the sun from the moon in mean-Earth axes: chained positions, turned by the orientation angles of the time."""
    req, n = _requests(spark, sf)
    segments, records = _segments(spark, sf)
    both = req.withColumn("body", F.explode(F.array(F.lit(10), F.lit(301)))).withColumn("id", c("id") * 2 + (c("body") == 301).cast("long"))
    p = ephemeris.chain_positions(both, segments, records, 0.0, 10.0, n).where("covered")
    sign = F.when(c("body") == 301, -1.0).otherwise(1.0)
    v = p.groupBy(F.floor(c("id") / 2).alias("id")).agg(*[F.sum(sign * c("p" + a)).alias("v" + a) for a in "xyz"])
    turns = ephemeris.evaluate(req, fx.coef_records(spark, sf), 0.0, 10.0, n).select("id", *[(c("p" + a) / 10.0).alias(t) for a, t in zip("xyz", ("phi", "delta", "w"))])
    d = solar.mean_earth_from_angles(v.join(turns, "id"), "v", "d", c("phi"), c("delta"), c("w"))
    x, y, z = ephemeris.unit(c("dx"), c("dy"), c("dz"))
    return d.select("id", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


@query("ephemeris_compare", with_ctes(
    f"""SELECT count(*) AS n, {rnd('avg(sep)', 5)} AS mean_sep, {rnd('max(sep)', 5)} AS max_sep, arg_max(id, sep) AS worst_id FROM (SELECT id, degrees(acos(greatest(-1e0,least(1e0,(px*px2+py*py2+pz*pz2)/
        (sqrt(px*px+py*py+pz*pz)*sqrt(px2*px2+py2*py2+pz2*pz2)))))) AS sep FROM (SELECT id, px, py, pz, px+0.01e0 AS px2, py-0.02e0 AS py2, pz+0.005e0 AS pz2 FROM ev WHERE covered))""", "n", "coef_records", q=_Q, ev=_EVAL))
def ephemeris_compare(spark, sf):
    req, n = _requests(spark, sf)
    p = ephemeris.evaluate(req, fx.coef_records(spark, sf), 0.0, 10.0, n).where("covered")
    a = ephemeris.unit(c("px"), c("py"), c("pz"))
    b = ephemeris.unit(c("px") + 0.01, c("py") - 0.02, c("pz") + 0.005)
    p = p.select("id", solar.separation_deg(a, b).alias("sep"))
    return p.agg(F.count("*").alias("n"), r6(F.avg("sep"), 5).alias("mean_sep"), r6(F.max("sep"), 5).alias("max_sep"), F.max_by("id", "sep").alias("worst_id"))


# ------------------------------------------------------------------ skylines
#: The SQL texts of horizon_near and horizon_far cover this much; queries without SQL take the operator's whole range.
NEAR_RANGE, NEAR_BINS = 12.0, 8
FAR_RANGE, FAR_BINS = 1500.0, 8
WHOLE_BINS, WHOLE_FAR = 360, 100_000.0
_LADDER = lambda steps: "(VALUES " + ",".join(f"({i},{s!r}::DOUBLE)" for i, s in enumerate(steps)) + ") l(step,dist)"
_OBS = "SELECT id, 'context-0' AS layer_id, x, z FROM points"
_NEAR = dict(
    obs=_OBS, eyes_src="SELECT id AS pid, * FROM obs", eyes=bilinear_sql("eyes_src", "holes"),
    ray=f"""SELECT (id*{NEAR_BINS}+bin)*1000+step AS pid, id, bin, step, dist, layer_id, x+sin(radians(bin*360e0/{NEAR_BINS}))*dist AS x, z-cos(radians(bin*360e0/{NEAR_BINS}))*dist AS z
      FROM obs, range(0,{NEAR_BINS}) b(bin), {_LADDER(horizon.ladder(0.25, 0.25, NEAR_RANGE))}""",
    rh=bilinear_sql("ray", "holes"),
    near=f"""SELECT id, bin, coalesce(max(CASE WHEN stop IS NULL OR step<stop THEN degrees(atan2(h-eye,dist)) END),-90) AS angle FROM (SELECT ray.*, rh.h, eyes.h AS eye, min(CASE WHEN rh.h IS NULL THEN step END) OVER (PARTITION BY ray.id, bin) AS stop
      FROM ray JOIN rh USING (pid) JOIN eyes ON eyes.pid=ray.id WHERE eyes.h IS NOT NULL) GROUP BY id, bin""")
_SITE = """SELECT s_suppkey AS id, degrees(2*atan(sqrt(ox*ox+oy*oy)/(2*1737400e0))-pi()/2) AS lat, degrees(atan2(ox,oy)) AS lon, (s_suppkey%5)/1e1 AS radial FROM (SELECT s_suppkey, (s_suppkey%40-20)*30e0+7 AS ox, ((s_suppkey*7)%100-50)*40e0+3 AS oy FROM supplier)"""
_FAR = dict(
    site=_SITE, fray=f"""SELECT *, (id*{FAR_BINS}+bin)*1000+step AS pid, 'context-0' AS layer_id, 2*1737400e0*tan(pi()/4+la2/2)*sin(lo2)/20+31.5e0 AS x, (n-1)/2e0-2*1737400e0*tan(pi()/4+la2/2)*cos(lo2)/20 AS z FROM (SELECT *, lo+atan2(sin(az)*sin(g)*cos(la), cos(g)-sin(la)*sin(la2)) AS lo2 FROM
      (SELECT *, asin(sin(la)*cos(g)+cos(la)*sin(g)*cos(az)) AS la2 FROM (SELECT id, radial, bin, step, dist, radians(lat) AS la, radians(lon) AS lo, radians(bin*360e0/{FAR_BINS}) AS az, dist/1737400e0 AS g FROM site, range(0,{FAR_BINS}) b(bin), {_LADDER(horizon.ladder(40.0, 20.0, FAR_RANGE))}))), n""",
    layers="SELECT 'context-0' AS layer_id, 1e0 AS res, 64 AS width, n AS height, 0e0 AS min_x, 0e0 AS min_z FROM n", fh=bilinear_sql("fray", "holes"),
    far="""SELECT id, bin, coalesce(max(CASE WHEN cut IS NULL OR step<cut THEN degrees(atan2((1737400e0+h)*cos(g)-(1737400e0+radial),(1737400e0+h)*sin(g))) END),-90) AS angle, min(CASE WHEN outside THEN dist END) AS truncated_at,
      count_if((cut IS NULL OR step<cut) AND h IS NULL) AS no_data FROM (SELECT *, min(CASE WHEN outside THEN step END) OVER (PARTITION BY id, bin) AS cut FROM (SELECT fray.*, fh.h, x<0 OR z<0 OR x>63 OR z>n-1 AS outside FROM fray JOIN fh USING (pid))) GROUP BY id, bin""")


def near_skyline(spark, sf, bins=NEAR_BINS, reach=NEAR_RANGE):
    obs = fx.points(spark, sf).select(c("id").alias("observer_id"), F.lit("context-0").alias("layer_id"), "x", "z")
    return horizon.near_skyline(obs, fx.with_holes(fx.raster_rows(spark, sf)), fx.layers(spark, sf), bins, 0.25, reach)


def whole_near(spark, sf):
    """Diagonal of the near layer."""
    return math.hypot(fx.WIDTH, fx.raster_height(spark, sf)) * 0.25


def far_skyline(spark, sf, bins=FAR_BINS, reach=FAR_RANGE):
    k = c("s_suppkey")
    o = fx.table(spark, sf, "supplier").select(k.alias("observer_id"), ((k % 40 - 20) * 30.0 + 7).alias("ox"),
                                               (((k * 7) % 100 - 50) * 40.0 + 3).alias("oy"), ((k % 5) / 10.0).alias("radial"))
    lat, lon = geo.polar_inverse(c("ox"), c("oy"), F.lit(True))
    o = o.select("observer_id", lat.alias("lat"), lon.alias("lon"), "radial")
    return horizon.far_skyline(o, fx.with_holes(fx.raster_rows(spark, sf)), fx.raster_height(spark, sf), fx.WIDTH, "context-0", bins, 20.0, reach)


@query("horizon_near", with_ctes(f"SELECT id AS observer_id, bin, {rnd('angle', 5)} AS angle_deg FROM near", "points", "layers", "holes", **_NEAR))
def horizon_near(spark, sf):
    return near_skyline(spark, sf).select("observer_id", c("bin").cast("long").alias("bin"), r6("angle_deg", 5).alias("angle_deg"))


@query("horizon_far", with_ctes(f"SELECT id AS observer_id, bin, {rnd('angle', 5)} AS angle_deg, {rnd('truncated_at', 4)} AS truncated_at, no_data FROM far", "n", "holes", **_FAR))
def horizon_far(spark, sf):
    return far_skyline(spark, sf).select("observer_id", c("bin").cast("long").alias("bin"), r6("angle_deg", 5).alias("angle_deg"),
                                         r6("truncated_at", 4).alias("truncated_at"), "no_data")


@query("horizon_merge")
def horizon_merge(spark, sf):
    """Both skylines over the whole range: 360 bins, near to the layer's diagonal, far to 100 km."""
    near = near_skyline(spark, sf, WHOLE_BINS, whole_near(spark, sf))
    return horizon.merge(near, far_skyline(spark, sf, WHOLE_BINS, WHOLE_FAR)).withColumn("angle_deg", r6("angle_deg", 5))


_SUN = "SELECT event_id AS ord, (event_id*13%3600)/1e1 AS az, value/1e1-4 AS el FROM events"


@query("sunlit_stats", with_ctes(
    f"""SELECT site, {rnd('sum(f)/count(*)', 6)} AS mean_fraction, {rnd('count_if(f>0)/count(*)::DOUBLE', 6)} AS lit_share, count_if(f>0)=0 AS always_dark, max(run) AS longest_dark, count(*) AS epochs FROM (
        SELECT *, count_if(f<=0) OVER (PARTITION BY site, island) AS run FROM (SELECT *, count_if(f>0) OVER (PARTITION BY site ORDER BY ord) AS island FROM (SELECT site, ord, CASE WHEN d>=0.27e0 THEN 1e0 WHEN d<=-0.27e0 THEN 0e0 ELSE (acos(-d/0.27e0)+d/0.27e0*sqrt(1-d/0.27e0*(d/0.27e0)))/pi() END AS f FROM (
        SELECT site, ord, el-(p[(i%10)::BIGINT+1]*(1-(x-i))+p[((i+1)%10)::BIGINT+1]*(x-i)) AS d FROM (SELECT *, floor(x) AS i FROM (SELECT n_nationkey AS site, ord, el, az/36e0 AS x, list_transform(range(0,10), lambda b: ((n_nationkey*7+b*3)%11)/1e0-4) AS p FROM nation, sun)))))) GROUP BY site""", sun=_SUN))
def sunlit_stats(spark, sf):
    e = c("event_id")
    sun = fx.table(spark, sf, "events").select(e.alias("ord"), ((e * 13 % 3600) / 10.0).alias("az"), (c("value") / 10.0 - 4).alias("el"))
    k = c("observer_id")
    prof = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda b: ((k * 7 + b * 3) % 11) / 1.0 - 4)
    sites = spark.range(fx.table(spark, sf, "nation").count()).select(c("id").alias("observer_id")).withColumn("profile", prof)
    s = horizon.illumination_of_all(sites, sun, "ord", horizon.sunlit_fraction(c("profile"), c("az"), c("el"), F.lit(0.27)))
    return s.select(c("observer_id").alias("site"), r6("mean_fraction").alias("mean_fraction"), r6("lit_share").alias("lit_share"), "always_dark", "longest_dark", "epochs")


@query("site_illumination")
def site_illumination(spark, sf):
    """Skyline of the supplier sites joined to the sun at every order date: sunlit statistics per site."""
    sky = horizon.profiles(far_skyline(spark, sf, WHOLE_BINS, WHOLE_FAR))
    k = c("s_suppkey")
    sites = fx.table(spark, sf, "supplier").select(k.alias("observer_id"), ((k % 40 - 20) * 30.0 + 7).alias("ox"), (((k * 7) % 100 - 50) * 40.0 + 3).alias("oy"))
    lat, lon = geo.polar_inverse(c("ox"), c("oy"), F.lit(True))
    sky = sky.join(sites.select("observer_id", lat.alias("lat"), lon.alias("lon")), "observer_id")
    track = solar.sub_solar(fx.epochs(spark, sf)).select(F.datediff("epoch", F.lit("1995-01-01")).alias("ord"), "bx", "by", "bz", "sun_radius_deg")
    # Every site needs every epoch; whole buckets of epochs meet the sites, so no pair of the two is exchanged.
    t = horizon.every_epoch(cut_lineage(sky), cut_lineage(track), "ord")
    t = solar.at_site(t, c("lat"), c("lon"))
    fraction = horizon.sunlit_fraction(c("profile"), c("azimuth_deg"), c("elevation_deg"), c("sun_radius_deg"))
    return horizon.from_stretches(t.select("observer_id", "_at", "_b", fraction.cast("double").alias("fraction"))).withColumn("mean_fraction", r6("mean_fraction"))
