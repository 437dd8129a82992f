"""Input tables derived from the given parquet files, once as DataFrames and once as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.codes import OPERATION_KINDS, SEMANTIC_CLASSES
from gridloom.operators.fold import task_count
from gridloom.operators.ordered import lag_in_order

WIDTH = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_COUNTS: dict = {}


def raster_height(spark: SparkSession, sf: str) -> int:
    """Row count of the raster table; read once per session, the inputs never change."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _COUNTS:
        _COUNTS[key] = table(spark, sf, "embeddings").count()
    return _COUNTS[key]


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ------------------------------------------------------------------ rasters and layers
def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Three nested layers centred on the origin; their height is the row count of the raster."""
    n = raster_height(spark, sf)
    specs = [(0, "context-0", "context", 0.25, "1D"), (1, "mission-1", "mission", 0.125, "0.5D"),
             (2, "operational-2", "operational", 0.03125, "CAST(NULL AS DOUBLE)")]
    rows = ", ".join(
        f"({o}, '{i}', '{r}', {res}D, {WIDTH}, {n}L, {-31.5 * res}D, {-((n - 1) * res) / 2}D, {31.5 * res}D, "
        f"{((n - 1) * res) / 2}D, {eff})" for o, i, r, res, eff in specs)
    # A values list is a local relation: its size is known, so joins with it broadcast by themselves.
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ordinal, layer_id, role, res, width, height, min_x, min_z, "
                     "max_x, max_z, source_eff_res)")


def raster_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One record per raster row: heights as float32, with class and source masks."""
    emb = table(spark, sf, "embeddings")
    n = raster_height(spark, sf)
    e = F.col("embedding")
    variants = F.array(
        F.struct(F.lit("context-0").alias("layer_id"), F.col("vec_id").alias("row"), e.alias("heights")),
        F.struct(F.lit("mission-1").alias("layer_id"), (F.lit(n - 1) - F.col("vec_id")).alias("row"),
                 F.transform(e, lambda v: (v * F.lit(0.5)).cast("float")).alias("heights")),
        F.struct(F.lit("operational-2").alias("layer_id"), F.col("vec_id").alias("row"),
                 F.transform(F.reverse(e), lambda v: (v * F.lit(0.125)).cast("float")).alias("heights")),
    )
    index = F.sequence(F.lit(0), F.lit(WIDTH - 1))
    return emb.select("label", F.explode(variants).alias("v")).select(
        "v.layer_id", "v.row", "v.heights",
        F.transform(index, lambda c: ((F.col("label") + c) % 12).cast("tinyint")).alias("semantic"),
        F.transform(index, lambda c: (F.col("label") % 3).cast("tinyint")).alias("source"),
    )


def with_holes(rows: DataFrame) -> DataFrame:
    """No-data variant: every 97th sample of the row-major order is null."""
    return rows.withColumn(
        "heights",
        F.transform("heights", lambda h, c: F.when((F.col("row") * WIDTH + c) % 97 != 0, h)),
    )


# ------------------------------------------------------------------ points and features
def _placed(key: str, df: DataFrame, n: int, *also: str) -> DataFrame:
    k = F.col(key)
    zmin = -((n - 1) * 0.125)
    span = (n - 1) * 250 + 1
    m = k % 3
    x = (F.when(m == 0, -7.875 + (k * 7919 % 15751) / 1000.0)
         .when(m == 1, -3.9 + (k * 7919 % 7801) / 1000.0)
         .otherwise(-0.98 + (k * 7919 % 1961) / 1000.0))
    z = (F.when(m == 0, zmin + (k * 104729 % span) / 1000.0)
         .when(m == 1, -3.9 + (k * 104729 % 7801) / 1000.0)
         .otherwise(-0.98 + (k * 104729 % 1961) / 1000.0))
    return df.select(k.alias("id"), (x + F.when(k % 50 == 0, 100.0).otherwise(0.0)).alias("x"), z.alias("z"), *also)


def points(spark: SparkSession, sf: str) -> DataFrame:
    n = raster_height(spark, sf)
    return _placed("c_custkey", table(spark, sf, "customer"), n)


def crater_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Crater centres and sizes; the geometry is derived by ``functions.crater``."""
    n = raster_height(spark, sf)
    k = F.col("id")
    return _placed("p_partkey", table(spark, sf, "part"), n, "p_size").where(k.isNotNull()).select(
        k, F.col("x").alias("cx"), F.col("z").alias("cz"), (F.col("p_size") / 10.0).alias("diameter"),
        ((k % 98) / 100.0).alias("degradation"), (0.6 + (k % 5) / 10.0).alias("ellipticity"),
        ((k % 314) / 100.0).alias("rotation"),
    )


def rock_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Rocks without elevation; ``operators.rocks`` seats them on the ground."""
    k = F.col("k")
    return points(spark, sf).select(
        F.col("id").alias("k"), F.format_string("rock-%06d", F.col("id")).alias("rock_id"), "x", "z"
    ).select(
        "k", "rock_id", "x", "z",
        (0.04 + (k % 7) / 100.0).alias("scale_x"), (0.05 + (k % 20) / 100.0).alias("scale_y"),
        (0.04 + (k % 11) / 100.0).alias("scale_z"),
        ((k % 19) / 20.0).alias("buried"), (k % 3 == 0).alias("physical"),
        # Turned rocks are valid; every 37th rotation is too short.
        F.transform(F.when(k % 3 == 0, F.array(F.lit(0.0), F.lit(0.6), F.lit(0.0), F.lit(0.8)))
                    .when(k % 3 == 1, F.array(*[F.lit(v) for v in (0.5, -0.5, 0.5, 0.5)]))
                    .otherwise(F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])),
                    lambda v: v * F.when(k % 37 == 0, 0.9).otherwise(1.0)).alias("quaternion"),
    )


# ------------------------------------------------------------------ edit log
def operations(spark: SparkSession, sf: str) -> DataFrame:
    n = raster_height(spark, sf)
    ev = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), "user_id", "value", "ts",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    s, k = F.col("seq"), F.col("k")
    kind = F.element_at(lit_array(OPERATION_KINDS), ((F.floor(s / 4) % 16) + 1).cast("int"))
    base = ev.select(
        "seq", kind.alias("kind"), F.lit("context-0").alias("layer_id"), "user_id", "k", "ts",
        (-7.5 + (F.col("user_id") * 37 % 60) / 4.0).alias("cx"),
        (-((n - 1) * 0.125) + (s * 53 % (n - 1)) * 0.25 + (k % 10) / 50.0).alias("cz"),
        F.when(s % 101 == 0, -1.0).otherwise(0.3 + k / 100.0).alias("radius"),
        (F.col("value") / 1000.0).alias("strength"), F.lit(2.0).alias("falloff"),
        F.when(s % 103 == 0, float("nan")).otherwise(F.col("value") / 1000.0 - 0.1).alias("target"),
        (k * 37 % 360).cast("double").alias("heading"), (0.5 + k / 50.0).alias("length"),
        (s % 4 == 0).alias("mass_conserving"),
    )
    r, cx, cz = F.col("radius"), F.col("cx"), F.col("cz")
    corner = lambda sx, sz: F.struct((cx + sx * r).alias("x"), (cz + sz * r).alias("z"))
    return base.select(
        "*",
        F.when(F.col("kind").startswith("polygonal"),
               F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))).alias("polygon"),
        F.when(F.col("kind") == "noise", F.concat(F.lit("n"), F.col("user_id").cast("string"))).alias("noise_seed"),
        F.when(F.col("kind") == "semantic_paint",
               F.element_at(lit_array(SEMANTIC_CLASSES), (F.col("user_id") % 12 + 1).cast("int"))
               ).alias("semantic_class"),
    )


_THREE = ["context-0", "mission-1", "operational-2"]


def delta_log(spark: SparkSession, sf: str, faults: bool = True) -> DataFrame:
    """Stored log with a terrain chain per layer and a rock chain over all layers; with seeded faults or without."""
    s = F.col("seq")
    d = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.element_at(lit_array(_THREE), (F.col("user_id") % 3 + 1).cast("int")).alias("layer_id"),
        F.get_json_object("props", "$.k").cast("long").alias("k"))
    # A checksum follows from the number, so numbers are looked up instead of checksums.
    d = lag_in_order(d, ["layer_id"], "seq", ["seq"])
    checksum = lambda n: F.sha2(F.concat("layer_id", F.lit(":"), F.col(n).cast("string")), 256)
    d = d.select("*", checksum("seq").alias("resulting"), F.coalesce(checksum("prev_seq"), F.sha2(F.concat(F.lit("base:"), F.col("layer_id")), 256)).alias("previous"),
                 F.when(s > 0, F.md5((s - 1).cast("string"))).otherwise("none").alias("rocks_before"), F.md5(s.cast("string")).alias("rocks_after"),
                 F.lit(1).cast("long").alias("revision"), F.md5(F.concat(F.lit("op:"), s.cast("string"))).alias("op"))
    if faults:
        d = d.where(s % 1009 != 5).withColumns({
            "previous": F.when(s % 997 == 0, "wrong").otherwise(F.col("previous")), "rocks_before": F.when(s % 613 == 2, "wrong").otherwise(F.col("rocks_before")),
            "op": F.when(s % 401 == 7, "other").otherwise(F.col("op")), "revision": F.when(s % 1511 == 3, 2).otherwise(F.col("revision"))})
    return d.select("seq", "revision", "layer_id", "k", "previous", "resulting", "rocks_before", "rocks_after", "op")


def deliveries(spark: SparkSession, sf: str, *also: Column) -> DataFrame:
    """A first pass over each 64 numbers with losses, copies, damage and a wrong revision, then a second, intact pass; ``also`` comes from the events."""
    s = F.col("seq")
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("long").alias("k"), *also)
    # A few rows of a small file become many, so they are dealt out first.
    log = log.repartition(task_count(spark), "seq")
    at = (s - s % 64) * 16
    sent = F.array(
        F.when(s % 97 != 11, F.struct((at + s % 64 * 2).alias("arrival"), F.when(s % 53 == 8, 2).otherwise(1).cast("long").alias("revision"),
                                      (s % 41 == 9).alias("damaged"))),
        F.when(s % 23 == 6, F.struct((at + s % 64 * 2 + 1).alias("arrival"), F.lit(1).cast("long").alias("revision"), F.lit(False).alias("damaged"))),
        F.struct((at + 512 + s % 64).alias("arrival"), F.lit(1).cast("long").alias("revision"), F.lit(False).alias("damaged")))
    return log.select("seq", (F.col("k") % 4 + 1).alias("n_parts"), *log.columns[2:], F.inline(F.array_compact(sent)))


def delivered_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the deliveries: of a damaged one the first part is lost (even numbers) or altered (odd ones)."""
    s, t = F.col("seq"), F.col("part")
    # A delivery comes from the event that names its layer, so nothing has to be joined.
    d = deliveries(spark, sf, F.element_at(lit_array(_THREE), (F.col("user_id") % 3 + 1).cast("int")).alias("layer_id"))
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1))).where(~(F.col("damaged") & (t == 0) & (s % 2 == 0)))
    want = F.md5(F.concat_ws(":", s.cast("string"), t.cast("string")))
    return d.select("arrival", "part", "layer_id", ((s * 31 + t * 7) % 4096).alias("idx"), (s * 10 + t).alias("value"), want.alias("want"),
                    F.when(F.col("damaged") & (t == 0), "altered").otherwise(want).alias("got"))


def deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Checksummed delta log with seeded faults: wrong links, dropped records, bad balances."""
    ev = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), "user_id", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    s = F.col("seq")
    layer = F.element_at(lit_array(["context-0", "mission-1", "operational-2"]), (F.col("user_id") % 3 + 1).cast("int"))
    base = ev.select(
        "seq", layer.alias("layer_id"), "k", "value",
        F.sha2(F.concat(layer, F.lit(":"), s.cast("string")), 256).alias("resulting"),
        F.lit(1).cast("long").alias("revision"),
    )
    base = lag_in_order(base, ["layer_id"], "seq", ["resulting"], prefix="prev_")
    removed, deposited = F.col("value") / 100.0, F.col("k") / 10.0
    scale = F.greatest(removed, deposited)
    return base.where(s % 1009 != 5).select(
        "revision", "seq", "layer_id",
        F.when(s % 997 == 0, F.sha2(F.lit("wrong"), 256))
        .otherwise(F.coalesce("prev_resulting", F.sha2(F.concat(F.lit("base:"), F.col("layer_id")), 256)))
        .alias("previous"),
        "resulting",
        F.transform(F.sequence(F.lit(0), (F.col("k") % 4).cast("int")),
                    lambda t: F.format_string("%s_t%06d_%06d", F.col("layer_id"),
                                              ((s + t) % 16).cast("long"), (F.col("k") % 3))).alias("changed_tiles"),
        (F.col("k") * 3).alias("changed_count"),
        F.when(s % 211 == 3, -removed).otherwise(removed).alias("removed"), deposited.alias("deposited"),
        F.when(s % 307 == 1, deposited - removed + 1.0).otherwise(deposited - removed).alias("net"),
        F.when(scale > 0, F.abs(deposited - removed) / scale).otherwise(0.0).alias("rel_err"),
        (F.col("k") % 5).alias("rocks_reseated"),
    )


# ------------------------------------------------------------------ manifests, epochs, configs
def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat(F.lit("layers/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("source").alias("kind"), F.octet_length("text").cast("long").alias("bytes"),
        F.sha2("text", 256).alias("sha256"),
    )


def prior_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.when(d % 89 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").where(d % 97 != 0).select(
        F.concat(F.lit("layers/"), d.cast("string"), F.lit(".txt")).alias("path"),
        F.col("source").alias("kind"), F.octet_length(text).cast("long").alias("bytes"),
        F.sha2(text, 256).alias("sha256"),
    )


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderdate").alias("epoch")).distinct()


def configs(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON configuration per supplier, with seeded faults on ``s_suppkey % 7``."""
    k = F.col("s_suppkey")
    f = k % 7
    layer = lambda role, w, res, cx: F.struct(
        F.lit(role).alias("role"), w.alias("width"), w.alias("length"), res.alias("resolution"), cx.alias("center_x"),
        F.lit(0.0).alias("center_z"))
    coarse = layer("context", (100 + k * 10).cast("double"), F.lit(1.0), F.lit(0.0))
    fine_res = F.when(f == 2, 500.0).otherwise(0.1)
    fine = layer("mission", (20 + k % 30).cast("double"), fine_res,
                 F.when(f == 1, (k * 10).cast("double") + 100.0).otherwise(0.0))
    doc = F.struct(
        F.array(coarse, fine).alias("layers"),
        F.when(f != 5, F.lit(64)).alias("tile_size"),
        F.struct(F.when(f == 4, 50_000.0).otherwise(8e9).alias("max_bytes"),
                 F.when(f == 6, 10_000.0).otherwise(25e6).alias("max_samples"),
                 F.lit(100_000.0).alias("max_tiles")).alias("limits"),
        F.struct(F.when(k % 2 == 0, "manual").otherwise("ephemeris").alias("mode"),
                 F.when(f != 3, "2026-01-01T00:00:00Z").alias("epoch")).alias("sun"),
    )
    return table(spark, sf, "supplier").select(k.alias("config_id"), F.to_json(doc).alias("json"))


def vehicles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("vehicle_id"), (200.0 + 10.0 * k).alias("mass"),
        F.when(k % 2 == 0, 4.0).otherwise(6.0).alias("wheels"), F.lit(0.2).alias("width"),
        F.lit(0.25).alias("radius"), F.lit(1.62).alias("gravity"))


def coef_records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("rec"), (F.col("vec_id") * 10.0 + 5.0).alias("mid"), F.lit(5.0).alias("radius"),
        *[F.transform(F.slice("embedding", 1 + 21 * i, 21), lambda v: v.cast("double")).alias(f"coef_{a}")
          for i, a in enumerate("xyz")])


def label_texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    ks = k.cast("string")
    line = lambda key, value: F.concat(F.lit(f"{key} = "), value, F.lit("\n"))
    return table(spark, sf, "part").select(
        k.alias("product_id"),
        F.concat(
            F.when(k % 13 == 0, F.lit("")).otherwise(line("LINES", (k * 4 + 8).cast("string"))),
            line("  LINE_SAMPLES", (k * 4 + 8).cast("string")),
            line("SAMPLE_BITS", F.lit("16")),
            line("SAMPLE_TYPE", F.when(k % 2 == 0, F.lit("LSB_INTEGER")).otherwise(F.lit("MSB_INTEGER"))),
            line("MAP_SCALE", F.concat((F.col("p_size") * 5).cast("string"), F.lit(" <m/pix>"))),
            line("MAP_PROJECTION_TYPE", F.when(k % 17 == 0, F.lit('"EQUIRECTANGULAR"'))
                 .otherwise(F.lit('"POLAR STEREOGRAPHIC"'))),
            line("SAMPLE_PROJECTION_OFFSET", F.concat((k * 2 + 3).cast("string"), F.lit(".5 <pix>"))),
            line("LINE_PROJECTION_OFFSET", F.concat((k * 2 + 3).cast("string"), F.lit(".5 <pix>"))),
            line("CENTER_LATITUDE", F.when(k % 19 == 0, F.lit("-80 <deg>")).otherwise(F.lit("-90 <deg>"))),
            line("CENTER_LONGITUDE", F.lit("0 <deg>")),
            line("A_AXIS_RADIUS", F.when(k % 23 == 0, F.lit("6371.0 <km>")).otherwise(F.lit("1737.4 <km>"))),
            line("COORDINATE_SYSTEM_NAME", F.lit('"MEAN EARTH/POLAR AXIS OF DE421"')),
            F.when(k % 5 == 0, line("MISSING_CONSTANT", F.lit("-32768"))).otherwise(F.lit("")),
        ).alias("text"))


# ------------------------------------------------------------------ the same tables as SQL
_KINDS_SQL = "[" + ",".join(f"'{k}'" for k in OPERATION_KINDS) + "]"
_CLASSES_SQL = "[" + ",".join(f"'{k}'" for k in SEMANTIC_CLASSES) + "]"


def _placed_sql(key: str, src: str) -> str:
    return f"""SELECT {key} AS id,
      CASE WHEN {key}%3=0 THEN -7.875e0 + ({key}*7919%15751)/1e3 WHEN {key}%3=1 THEN -3.9e0+({key}*7919%7801)/1e3
           ELSE -0.98e0+({key}*7919%1961)/1e3 END + CASE WHEN {key}%50=0 THEN 100e0 ELSE 0e0 END AS x,
      CASE WHEN {key}%3=0 THEN -((n-1)*0.125e0) + ({key}*104729%((n-1)*250+1))/1e3 WHEN {key}%3=1 THEN -3.9e0+({key}*104729%7801)/1e3
           ELSE -0.98e0+({key}*104729%1961)/1e3 END AS z
      FROM {src}, n"""


CTES: dict[str, tuple[list[str], str]] = {
    "n": ([], "SELECT count(*) AS n FROM embeddings"),
    "layers": (["n"], """SELECT ordinal, layer_id, role, res, 64 AS width, n AS height, -31.5e0*res AS min_x,
        -((n-1)*res)/2 AS min_z, 31.5e0*res AS max_x, ((n-1)*res)/2 AS max_z, source_eff_res
        FROM (VALUES (0,'context-0','context',0.25e0,1e0),(1,'mission-1','mission',0.125e0,0.5e0),
                     (2,'operational-2','operational',0.03125e0,NULL)) v(ordinal,layer_id,role,res,source_eff_res), n"""),
    "raster_rows": (["n"], """SELECT 'context-0' AS layer_id, vec_id AS row, embedding AS heights, label FROM embeddings
        UNION ALL SELECT 'mission-1', n-1-vec_id, list_transform(embedding, lambda v: (v*0.5e0)::FLOAT), label FROM embeddings, n
        UNION ALL SELECT 'operational-2', vec_id, list_transform(list_reverse(embedding), lambda v: (v*0.125e0)::FLOAT), label FROM embeddings"""),
    "samples": (["raster_rows"], """SELECT layer_id, row, i-1 AS col, heights[i]::DOUBLE AS h, (label+i-1)%12 AS semantic, label%3 AS source
        FROM raster_rows, range(1,65) t(i)"""),
    "holes": (["samples"], "SELECT layer_id, row, col, CASE WHEN (row*64+col)%97 <> 0 THEN h END AS h FROM samples"),
    "stencil": (["samples", "layers"], """SELECT s.*, l.res, l.width, l.height,
        lag(h) OVER r AS w, lead(h) OVER r AS e, lag(h) OVER c AS n, lead(h) OVER c AS s
        FROM samples s JOIN layers l USING (layer_id)
        WINDOW r AS (PARTITION BY layer_id, row ORDER BY col), c AS (PARTITION BY layer_id, col ORDER BY row)"""),
    "points": (["n"], _placed_sql("c_custkey", "customer")),
    "crater_points": (["n"], _placed_sql("p_partkey", "part")),
    "crater_seeds": (["crater_points"], """SELECT id, x AS cx, z AS cz, p_size/1e1 AS diameter, (id%98)/1e2 AS degradation,
        0.6e0+(id%5)/1e1 AS ellipticity, (id%314)/1e2 AS rotation FROM crater_points JOIN part ON p_partkey=id"""),
    "rock_seeds": (["points"], """SELECT id AS k, format('rock-{:06d}', id) AS rock_id, x, z, 0.04e0+(id%7)/1e2 AS scale_x,
        0.05e0+(id%20)/1e2 AS scale_y, 0.04e0+(id%11)/1e2 AS scale_z, (id%19)/2e1 AS buried, id%3=0 AS physical,
        list_transform(CASE id%3 WHEN 0 THEN [0e0,0.6e0,0e0,0.8e0] WHEN 1 THEN [0.5e0,-0.5e0,0.5e0,0.5e0] ELSE [0e0,0e0,0e0,1e0] END,
            lambda v: v*CASE WHEN id%37=0 THEN 0.9e0 ELSE 1e0 END) AS quaternion FROM points"""),
    "operations": (["n"], f"""SELECT *,
        CASE WHEN kind IN ('polygonal_cut','polygonal_fill') THEN [{{'x':cx-radius,'z':cz-radius}},{{'x':cx+radius,'z':cz-radius}},
             {{'x':cx+radius,'z':cz+radius}},{{'x':cx-radius,'z':cz+radius}}] END AS polygon,
        CASE WHEN kind='noise' THEN 'n'||user_id END AS noise_seed,
        CASE WHEN kind='semantic_paint' THEN ({_CLASSES_SQL})[user_id%12+1] END AS semantic_class
        FROM (SELECT seq, ({_KINDS_SQL})[(seq//4)%16+1] AS kind, 'context-0' AS layer_id, user_id, k, ts,
          -7.5e0+(user_id*37%60)/4e0 AS cx, -((n-1)*0.125e0)+(seq*53%(n-1))*0.25e0+(k%10)/5e1 AS cz,
          CASE WHEN seq%101=0 THEN -1e0 ELSE 0.3e0+k/1e2 END AS radius, value/1e3 AS strength, 2e0 AS falloff,
          CASE WHEN seq%103=0 THEN 'NaN'::DOUBLE ELSE value/1e3-0.1e0 END AS target, (k*37%360)::DOUBLE AS heading,
          0.5e0+k/5e1 AS length, seq%4=0 AS mass_conserving
          FROM (SELECT event_id AS seq, user_id, value, ts, json_extract_string(props,'$.k')::BIGINT AS k FROM events), n)"""),
    "deltas": ([], """SELECT 1::BIGINT AS revision, seq, layer_id,
        CASE WHEN seq%997=0 THEN sha256('wrong') ELSE coalesce(prev, sha256('base:'||layer_id)) END AS previous, resulting,
        list_transform(range(0, k%4+1), lambda t: format('{}_t{:06d}_{:06d}', layer_id, (seq+t)%16, k%3)) AS changed_tiles,
        k*3 AS changed_count, CASE WHEN seq%211=3 THEN -(value/1e2) ELSE value/1e2 END AS removed, k/1e1 AS deposited,
        CASE WHEN seq%307=1 THEN k/1e1-value/1e2+1e0 ELSE k/1e1-value/1e2 END AS net,
        CASE WHEN greatest(value/1e2,k/1e1)>0 THEN abs(k/1e1-value/1e2)/greatest(value/1e2,k/1e1) ELSE 0e0 END AS rel_err,
        k%5 AS rocks_reseated
        FROM (SELECT *, lag(resulting) OVER (PARTITION BY layer_id ORDER BY seq) AS prev FROM
          (SELECT *, sha256(layer_id||':'||seq) AS resulting FROM
            (SELECT event_id AS seq, (['context-0','mission-1','operational-2'])[user_id%3+1] AS layer_id, value,
              json_extract_string(props,'$.k')::BIGINT AS k FROM events)))
        WHERE seq%1009<>5"""),
    "sound_log": ([], """SELECT seq, 1::BIGINT AS revision, layer_id, coalesce(lag(resulting) OVER (PARTITION BY layer_id ORDER BY seq), sha256('base:'||layer_id)) AS previous, resulting,
        CASE WHEN seq>0 THEN md5((seq-1)::VARCHAR) ELSE 'none' END AS rocks_before, md5(seq::VARCHAR) AS rocks_after, md5('op:'||seq) AS op
        FROM (SELECT *, sha256(layer_id||':'||seq) AS resulting FROM (SELECT event_id AS seq, (['context-0','mission-1','operational-2'])[user_id%3+1] AS layer_id FROM events))"""),
    "delta_log": (["sound_log"], """SELECT * REPLACE (CASE WHEN seq%997=0 THEN 'wrong' ELSE previous END AS previous, CASE WHEN seq%613=2 THEN 'wrong' ELSE rocks_before END AS rocks_before,
        CASE WHEN seq%401=7 THEN 'other' ELSE op END AS op, CASE WHEN seq%1511=3 THEN 2 ELSE revision END AS revision) FROM sound_log WHERE seq%1009<>5"""),
    "deliveries": ([], """SELECT seq, k%4+1 AS n_parts, arrival, revision, damaged FROM (SELECT event_id AS seq, json_extract_string(props,'$.k')::BIGINT AS k, (event_id-event_id%64)*16 AS b FROM events), LATERAL
        (SELECT b+seq%64*2 AS arrival, CASE WHEN seq%53=8 THEN 2 ELSE 1 END AS revision, seq%41=9 AS damaged WHERE seq%97<>11 UNION ALL SELECT b+seq%64*2+1, 1, false WHERE seq%23=6 UNION ALL SELECT b+512+seq%64, 1, false)"""),
    "delivered_parts": (["deliveries"], """SELECT arrival, seq, part, layer_id, (seq*31+part*7)%4096 AS idx, seq*10+part AS value, NOT (damaged AND part=0) AS ok
        FROM (SELECT *, unnest(range(0, n_parts)) AS part FROM deliveries) JOIN (SELECT event_id AS seq, (['context-0','mission-1','operational-2'])[user_id%3+1] AS layer_id FROM events) USING (seq)
        WHERE NOT (damaged AND part=0 AND seq%2=0)"""),
    "artifacts": ([], "SELECT 'layers/'||doc_id||'.txt' AS path, source AS kind, strlen(text) AS bytes, sha256(text) AS sha256 FROM documents"),
    "prior_artifacts": ([], """SELECT 'layers/'||doc_id||'.txt' AS path, source AS kind, strlen(t) AS bytes, sha256(t) AS sha256
        FROM (SELECT *, CASE WHEN doc_id%89=0 THEN text||'x' ELSE text END AS t FROM documents WHERE doc_id%97<>0)"""),
    "epochs": ([], "SELECT DISTINCT o_orderdate AS epoch FROM orders"),
    "vehicles": ([], """SELECT s_suppkey AS vehicle_id, 2e2+1e1*s_suppkey AS mass, CASE WHEN s_suppkey%2=0 THEN 4e0 ELSE 6e0 END AS wheels,
        0.2e0 AS width, 0.25e0 AS radius, 1.62e0 AS gravity FROM supplier"""),
    "coef_records": ([], """SELECT vec_id AS rec, vec_id*1e1+5e0 AS mid, 5e0 AS radius,
        embedding[1:21]::DOUBLE[] AS coef_x, embedding[22:42]::DOUBLE[] AS coef_y, embedding[43:63]::DOUBLE[] AS coef_z FROM embeddings"""),
    "config_layers": ([], """SELECT s_suppkey AS config_id, ord, role, w AS width, w AS length, res AS resolution, cx AS center_x, 0e0 AS center_z FROM (
        SELECT s_suppkey, 0 AS ord, 'context' AS role, (100+s_suppkey*10)::DOUBLE AS w, 1e0 AS res, 0e0 AS cx FROM supplier
        UNION ALL SELECT s_suppkey, 1, 'mission', (20+s_suppkey%30)::DOUBLE, CASE WHEN s_suppkey%7=2 THEN 500e0 ELSE 0.1e0 END,
          CASE WHEN s_suppkey%7=1 THEN (s_suppkey*10)::DOUBLE+100e0 ELSE 0e0 END FROM supplier)"""),
    "config_heads": ([], """SELECT s_suppkey AS config_id, CASE WHEN s_suppkey%7<>5 THEN 64 END AS tile_size,
        CASE WHEN s_suppkey%7=4 THEN 5e4 ELSE 8e9 END AS max_bytes, CASE WHEN s_suppkey%7=6 THEN 1e4 ELSE 25e6 END AS max_samples,
        1e5 AS max_tiles, CASE WHEN s_suppkey%2=0 THEN 'manual' ELSE 'ephemeris' END AS mode,
        CASE WHEN s_suppkey%7<>3 THEN '2026-01-01T00:00:00Z' END AS epoch FROM supplier"""),
}


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """Prefix ``body`` with the named common table expressions and their dependencies."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS ({CTES[name][1]})" for name in order]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def rnd(expr: str, digits: int = 6) -> str:
    """SQL rounding that never yields a negative zero."""
    return f"(round({expr}, {digits}) + 0e0)"
