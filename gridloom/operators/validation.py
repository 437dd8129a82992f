"""Dataset validation: one row ``check_id, passed, severity, found`` per check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import estimate, grid, rules

c = F.col


def _check(df: DataFrame, check_id, passed, found=None, severity: str = "error") -> DataFrame:
    return df.select(check_id.alias("check_id"), F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(severity).alias("severity"),
                     (F.lit(None) if found is None else found).cast("long").alias("found"))


def layer_checks(rows: DataFrame, finite_rows: DataFrame, layers: DataFrame) -> DataFrame:
    """Sample counts, finiteness, spacing, mask alignment and nesting per layer."""
    name = lambda suffix: F.concat(F.lit("layer_"), c("layer_id"), F.lit(suffix))
    sizes = rows.groupBy("layer_id").agg(F.sum(F.size("heights").cast("long")).alias("n"), F.sum(F.size("semantic").cast("long")).alias("m"))
    j = layers.join(sizes, "layer_id", "left")
    want = c("width") * c("height")
    q = grid.quality(finite_rows)
    res = (c("max_x") - c("min_x")) / (c("width") - 1)
    return (_check(j, name("_sample_count"), c("n") == want).unionByName(_check(j, name("_semantic_aligned"), c("m") == want))
            .unionByName(_check(layers, name("_spacing"), F.abs(res - c("res")) < c("res") * 1e-6))
            .unionByName(_check(q, name("_finite"), c("missing") + c("infinite") == 0, c("missing") + c("infinite")))
            .unionByName(_check(estimate.nesting(layers).where(c("parent").isNotNull()), F.concat(F.lit("nesting_"), c("layer_id")), c("inside"))))


def vertical_bounds_check(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """``declared(layer_id, min_y, max_y)`` against the data, within a millimetre."""
    b = grid.vertical_bounds(rows).select("layer_id", c("min_y").alias("lo"), c("max_y").alias("hi"))
    j = declared.join(b, "layer_id", "left")
    ok = (F.abs(c("lo") - c("min_y")) < 1e-3) & (F.abs(c("hi") - c("max_y")) < 1e-3)
    return _check(j, F.concat(F.lit("layer_"), c("layer_id"), F.lit("_vertical_bounds")), ok)


def metadata_checks(manifest: DataFrame) -> DataFrame:
    """Axis declaration, provenance and synthetic labels of a manifest record."""
    axes = (c("handedness") == "right") & (c("up_axis") == "+Y") & (c("east_axis") == "+X") & (c("north_axis") == "-Z")
    return (_check(manifest, F.lit("coordinate_system_declared"), axes)
            .unionByName(_check(manifest, F.lit("provenance_complete"), c("master_seed").isNotNull() & c("configuration_hash").isNotNull()))
            .unionByName(_check(manifest, F.lit("synthetic_labelled"), F.size("synthetic_heuristics") > 0)))


def rock_checks(rocks: DataFrame) -> DataFrame:
    t = rocks.agg(F.count_if(rules.floating()).alias("a"), F.count_if(rules.burial_wrong()).alias("b"))
    return _check(t, F.lit("rocks_not_floating"), c("a") == 0, c("a")).unionByName(
        _check(t, F.lit("rocks_burial_consistent"), c("b") == 0, c("b")))


def crater_check(craters: DataFrame) -> DataFrame:
    bad = F.count_if(~((c("diameter") > 0) & (c("depth") >= 0))) + F.count_if(c("depth") > c("diameter") * 0.25)
    return _check(craters.agg(bad.alias("n")), F.lit("crater_geometry_plausible"), c("n") == 0, c("n"))


def artifact_checks(declared: DataFrame, found: DataFrame) -> DataFrame:
    j = declared.join(found.select("path", c("sha256").alias("got"), c("bytes").alias("got_bytes")), "path", "left")
    t = j.agg(F.count_if(c("got").isNull()).alias("a"), F.count_if((c("got") != c("sha256")) | (c("got_bytes") != c("bytes"))).alias("b"))
    return _check(t, F.lit("artifact_files_present"), c("a") == 0, c("a")).unionByName(_check(t, F.lit("checksums_match"), c("b") == 0, c("b")))


def report(checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One line per check, and the totals with the overall verdict."""
    mark = F.when(c("passed"), "PASS").when(c("severity") == "error", "FAIL").otherwise("WARN")
    lines = checks.select("check_id", F.format_string("[%s] %s", mark, c("check_id")).alias("line"))
    errors = F.count_if(~c("passed") & (c("severity") == "error"))
    return lines, checks.agg(F.count("*").alias("checks"), errors.alias("errors"),
                             F.count_if(~c("passed") & (c("severity") == "warning")).alias("warnings"), (errors == 0).alias("passed"))
