"""Configurations: parsing with defaults, issues, cost estimates, feasibility and grid allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col
SCHEMA = ("layers array<struct<role:string,width:double,length:double,resolution:double,center_x:double,center_z:double>>, "
          "tile_size int, limits struct<max_bytes:double,max_samples:double,max_tiles:double>, sun struct<mode:string,epoch:string>")
DEFAULT_TILE = 64


def read_configs(raw: DataFrame) -> DataFrame:
    """Typed configurations with defaults filled in; unreadable ones have no layers."""
    p = raw.withColumn("cfg", F.from_json("json", SCHEMA))
    return p.select("config_id", "cfg.layers", F.coalesce("cfg.tile_size", F.lit(DEFAULT_TILE)).alias("tile_size"), "cfg.limits", "cfg.sun")


def config_issues(raw: DataFrame) -> DataFrame:
    """All issues of every configuration, one row per issue with its path."""
    p = read_configs(raw)
    per_layer = p.select("config_id", F.posexplode("layers").alias("i", "l")).where(
        c("l.resolution") > F.least(c("l.width"), c("l.length"))).select(
        "config_id", F.format_string("layers[%d].resolution", c("i")).alias("path"))
    epoch = p.where((c("sun.mode") == "ephemeris") & c("sun.epoch").isNull()).select("config_id", F.lit("sun.epoch").alias("path"))
    torn = p.where(c("layers").isNull()).select("config_id", F.lit("json").alias("path"))
    return per_layer.unionByName(epoch).unionByName(torn)


def config_hashes(cfg: DataFrame) -> DataFrame:
    """Hash of the canonical text of a configuration after defaults: every field, alphabetical, numbers with 12 places."""
    def shown(v):
        return F.coalesce(v.cast("string"), F.lit("null"))

    number = lambda v: shown(v.cast("decimal(38,12)"))
    layer = lambda v: F.concat_ws(":", *[number(v[k]) for k in ("center_x", "center_z", "length", "resolution")],
                                  shown(v["role"]), number(v["width"]))
    text = F.concat_ws("|", F.array_join(F.transform("layers", layer), ","),
                       *[number(c(f"limits.{k}")) for k in ("max_bytes", "max_samples", "max_tiles")],
                       shown(c("sun.epoch")), shown(c("sun.mode")), shown(c("tile_size")))
    return cfg.select("config_id", F.sha2(text, 256).alias("hash"))


def layer_estimates(cfg: DataFrame) -> DataFrame:
    e = cfg.select("config_id", "tile_size", "limits", F.posexplode("layers").alias("ord", "l")).select(
        "config_id", "tile_size", "limits", "ord", "l.*")
    n = lambda extent: (F.floor(c(extent) / c("resolution")) + 1).cast("long")
    e = e.withColumn("w", n("width")).withColumn("h", n("length"))
    tiles = lambda v: F.greatest(F.lit(1), F.ceil((c(v) - 1) / (c("tile_size") - 1)))
    return e.withColumn("samples", c("w") * c("h")).withColumn("tiles", tiles("w") * tiles("h")).withColumn(
        "field_bytes", c("samples") * 10).withColumn("mesh_bytes", c("samples") * 32 + (c("w") - 1) * (c("h") - 1) * 24)


def totals(e: DataFrame, large: int = 25_000_000, crater_min: float = 1.0, crater_max: float = 50.0) -> DataFrame:
    """Totals per configuration with the expected craters at equilibrium and the large-layer count."""
    lo = F.greatest(F.lit(crater_min), c("resolution") * 4)
    count = F.floor(F.greatest(F.lit(0.0), (F.lit(1.0) / (lo * lo) - 1 / crater_max**2) * 0.084 * c("width") * c("length")) + 0.5)
    return e.groupBy("config_id").agg(
        F.sum("samples").alias("samples"), F.sum("tiles").alias("tiles"), F.sum("field_bytes").alias("field_bytes"),
        F.sum("mesh_bytes").alias("mesh_bytes"), (F.sum("samples") * 5 + F.floor(F.sum("mesh_bytes") * 0.5 + 0.5)).alias("export_bytes"),
        F.min_by("role", "resolution").alias("finest"), F.sum(F.when(lo < crater_max, count).otherwise(0)).alias("craters"),
        F.count_if(c("samples") > large).alias("large_layers"))


def feasibility(cfg: DataFrame) -> DataFrame:
    """First failing rule per configuration: memory, samples per layer, tiles, nesting."""
    e = layer_estimates(cfg)
    w = Window.partitionBy("config_id").orderBy(F.desc("resolution"), "ord")
    prev = lambda n: F.lag(n).over(w)
    low = lambda centre, size: c(centre) - c(size) / 2
    bad = F.lit(False)
    for centre, size in (("center_x", "width"), ("center_z", "length")):
        plow, phigh = prev(centre) - prev(size) / 2, prev(centre) + prev(size) / 2
        bad = bad | (low(centre, size) < plow - 1e-9) | (c(centre) + c(size) / 2 > phigh + 1e-9)
    e = e.withColumn("bad", F.coalesce(bad, F.lit(False)))
    t = e.groupBy("config_id").agg(F.first("limits").alias("lim"), F.sum("field_bytes").alias("fb"), F.max("samples").alias("ms"),
                                   F.sum("tiles").alias("tl"), F.bool_or("bad").alias("bad"))
    return t.select("config_id", F.when(c("fb") > c("lim.max_bytes"), "memory_limit").when(c("ms") > c("lim.max_samples"), "sample_limit")
                    .when(c("tl") > c("lim.max_tiles"), "tile_limit").when(c("bad"), "layer_bounds").otherwise("ok").alias("outcome"))


def allocate(cfg: DataFrame, source_pixel: float = 5.0, scale: float = 1.01) -> DataFrame:
    """Layers snapped to their sample grid, with the note when the request did not fit."""
    e = layer_estimates(cfg)
    span = lambda n: (c(n) - 1) * c("resolution")
    return e.select("config_id", F.format_string("%s-%d", c("role"), c("ord")).alias("layer_id"), c("w").alias("width_samples"),
                    F.round(c("center_x") - span("w") / 2, 6).alias("min_x"), F.round(c("center_x") + span("w") / 2, 6).alias("max_x"),
                    ((F.abs(span("w") - c("width")) > 1e-9) | (F.abs(span("h") - c("length")) > 1e-9)).alias("snapped"),
                    F.round(c("resolution") / (source_pixel / scale), 6).alias("pixels_per_sample"))


def nesting(layers: DataFrame) -> DataFrame:
    """Each layer against the next coarser one (a dimension table, so one small window)."""
    w = Window.orderBy(F.desc("res"))
    p = lambda n: F.lag(n).over(w)
    inside = ((c("min_x") >= p("min_x") - 1e-6) & (c("max_x") <= p("max_x") + 1e-6)
              & (c("min_z") >= p("min_z") - 1e-6) & (c("max_z") <= p("max_z") + 1e-6))
    finest = c("res") == F.min("res").over(Window.partitionBy())
    return layers.select("layer_id", "role", p("layer_id").alias("parent"), F.coalesce(inside, F.lit(True)).alias("inside"), finest.alias("finest"))


def relief_gate(layers: DataFrame, spectrum: DataFrame) -> DataFrame:
    """Wavelengths a layer may still add (shorter than what its source resolves) and those it may not."""
    rows = layers.select("layer_id", "source_eff_res").collect()
    flags = F.array(*[F.struct(F.lit(r["layer_id"]).alias("layer_id"), F.lit(r["source_eff_res"]).cast("double").alias("eff")) for r in rows])
    s = spectrum.withColumn("g", F.explode(flags)).withColumn("active", c("g.eff").isNull() | (c("wavelength") < c("g.eff")))
    return s.groupBy("g.layer_id").agg(F.coalesce(F.sum(F.when(c("active"), c("n"))), F.lit(0)).alias("active"),
                                       F.coalesce(F.sum(F.when(~c("active"), c("n"))), F.lit(0)).alias("suppressed"))
