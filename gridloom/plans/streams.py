"""Streaming queries: each drives a table through a stream to completion and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import fixtures as fx
from gridloom.fixtures import rnd, with_ctes
from gridloom.plans.edits import BASE, FOLD
from gridloom.plans.raster import r6
from gridloom.registry import ORACLES, query
from gridloom.session import scratch_path
from gridloom.streaming import log_stream

c = F.col


@query("stream_deltas", with_ctes(
    f"SELECT s.layer_id, s.row, {rnd('sum(coalesce(d.f.h, s.h))', 4)} AS height_sum FROM samples s LEFT JOIN folded d USING (layer_id,row,col) GROUP BY s.layer_id, s.row", *BASE, **FOLD))
def stream_deltas(spark, sf):
    layers, rows = fx.layers(spark, sf), fx.raster_rows(spark, sf).select("layer_id", "row", "heights")
    out = log_stream.stream_table(spark, fx.operations(spark, sf), "seq", 2,
                                  lambda s, o, ck: log_stream.apply_edits(s, rows, layers, o, ck), "stream-deltas")
    total = F.aggregate("heights", F.lit(0.0), lambda a, v: a + v)
    return log_stream.latest_rows(spark, out).select("layer_id", "row", r6(total, 4).alias("height_sum"))


@query("stream_chain", with_ctes(
    """SELECT layer_id, seq, coalesce(p IS NOT NULL AND previous<>p, false) AS broken FROM (SELECT *, lag(resulting) OVER (PARTITION BY layer_id ORDER BY seq) AS p FROM deltas)""", "deltas"))
def stream_chain(spark, sf):
    out = log_stream.stream_table(spark, fx.deltas(spark, sf), "seq", 3, log_stream.verify_chain, "stream-chain")
    return spark.read.parquet(f"{out}/checks").select("layer_id", "seq", "broken")


@query("stream_retained", ORACLES.get("retained_window"))
def stream_retained(spark, sf):
    out = log_stream.stream_table(spark, fx.deltas(spark, sf), "seq", 3, log_stream.retain, "stream-kept")
    kept = spark.read.parquet(f"{out}/kept")
    last = kept.agg(F.max("batch").alias("b")).first()["b"]
    return kept.where(c("batch") == last).select("revision", "seq", "layer_id")


@query("stream_progress", ORACLES.get("job_progress"))
def stream_progress(spark, sf):
    out = log_stream.stream_table(spark, fx.table(spark, sf, "conversations"), "conv_id", 2, log_stream.progress, "stream-progress")
    return spark.read.parquet(out).groupBy("job_id").agg(F.max("seq").alias("seq"), F.max_by("stage", "seq").alias("stage"), F.max("progress").alias("progress"))


@query("snapshot_restore", with_ctes(f"SELECT layer_id, row, {rnd('sum(h)', 5)} AS height_sum FROM samples GROUP BY ALL", "samples"))
def snapshot_restore(spark, sf):
    path = scratch_path(spark, "snapshot")
    log_stream.snapshot(fx.raster_rows(spark, sf), path)
    total = F.aggregate("heights", F.lit(0.0), lambda a, v: a + v)
    return log_stream.restore(spark, path).select("layer_id", "row", r6(total, 5).alias("height_sum"))
