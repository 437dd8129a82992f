"""Operator 3, mixing sources to target weights by entropy balancing.

Each source gets a token target: its weight's share of all tokens, at most ``limit`` times its own size, the
excess going to the others by weight.  Inside a source the documents' rates minimise the relative entropy
sum(r log r - r + 1) under the constraint sum(size * r) = target and 0 <= r <= limit.  The dual has one unknown per
source and its solution tilts rates exponentially, r = min(limit, exp(lambda * size)); Newton steps on it, kept
inside a bracket, converge in a few rounds.  Rates become whole copies by rounding running totals over sizes, which
leaves a source within one long document of its target, and a few single changes then close most of that gap.

Rates depend on a document's source and size only, so everything after the first aggregation works on counts
per (source, size): the Newton sums, the running totals of the rounding, and how many documents of a cell take one
copy more.  Those are spread over hash buckets of the cell, and only inside a bucket documents are ranked.  Hot
sources and large groups of equal size are therefore pre-aggregated or split everywhere.  Sums run in a fixed
order, so reruns agree.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own, sorted last;
rows of one doc_id are separate documents; an empty table gives an empty table; weights repeat along the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import SPACE_CLASS, written

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3
BUCKETS = 256
STEPS = 8
TOLERANCE = 1e-9
c = F.col


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS[1:-1]}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from ``sizes`` (source key, source_size): one row per source, water-filled.

    Sorted by the ratio of cap to weight, capped sources come first; the level of the others is what the caps leave,
    divided by the weights left.
    """
    by_name = Window.orderBy("source")  # one row per source
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", (limit * c("source_size")).cast("double"))
    s = s.withColumn("ratio", c("cap") / c("w"))
    order = Window.orderBy("ratio", "source")
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    free = c("level") <= c("ratio")
    s = s.withColumn("_level", F.first(F.when(free, c("level")), ignorenulls=True).over(every))
    return s.select("source", "source_size", F.when(c("_level").isNull(), c("cap")).otherwise(
        F.least(c("cap"), c("w") * c("_level"))).alias("target"))


def _balanced(cells: DataFrame, limit: int) -> DataFrame:
    """Cells (source, size, n, source_size, target) with the rate of their documents."""
    whole = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = c("size") / c("scale")
    tilt = lambda lam: F.least(F.lit(float(limit)), F.exp(F.least(lam * x, F.lit(50.0))))
    log_ratio = F.log(c("target") / c("source_size"))
    start = cells.where("size > 0").withColumn("scale", c("source_size") / F.sum("n").over(whole))
    # All rates are at most target / size at the lower end and at the limit at the upper one: size / scale >= 1 / scale.
    start = start.withColumn("lo", F.least(F.lit(0.0), log_ratio * c("scale"))).withColumn(
        "hi", F.when(log_ratio > 0, F.log(F.lit(float(limit))) * c("scale") * 1.000001).otherwise(0.0)).withColumn(
        "lam", F.greatest(c("lo"), F.least(c("hi"), log_ratio)))
    full = c("target") >= limit * c("source_size") * (1 - 1e-12)

    def step(df: DataFrame) -> DataFrame:
        r = tilt(c("lam"))
        df = df.withColumn("_r", c("n") * c("size") * r)
        df = df.withColumn("f", F.sum("_r").over(whole)).withColumn(
            "g", F.sum(F.when(r < limit, c("_r") * x).otherwise(0.0)).over(whole))
        df = df.withColumn("lo", F.when(c("f") < c("target"), F.greatest("lo", "lam")).otherwise(c("lo"))).withColumn(
            "hi", F.when(c("f") >= c("target"), F.least("hi", "lam")).otherwise(c("hi")))
        # No slope is left where every rate is at the limit; a null step falls back to the middle of the bracket.
        newton = c("lam") - (F.log("f") - F.log("target")) * F.try_divide(c("f"), c("g"))
        inside = (c("g") > 0) & (newton > c("lo")) & (newton < c("hi"))
        return df.withColumn("lam", F.when(inside, newton).otherwise((c("lo") + c("hi")) / 2)).drop("_r", "f", "g")

    now = start.repartition("source").sortWithinPartitions("source", "size")
    while True:
        for _ in range(STEPS):
            now = step(now)
        now = written(now.withColumn("_r", c("n") * c("size") * tilt(c("lam"))).withColumn(
            "off", F.abs(F.sum("_r").over(whole) - c("target")) / c("target")).drop("_r"), "dual")
        # The bracket halves at least, so a source that is off ends when its bracket has no number left inside.
        open_ = (c("off") > TOLERANCE) & ~full & ((c("hi") - c("lo")) > 1e-13 * F.greatest(F.abs("lo"), F.abs("hi")))
        if now.where(open_).isEmpty():
            break
    return now.select("source", "size", "n", "target", F.when(full, F.lit(float(limit))).otherwise(tilt(c("lam"))).alias("rate"))


def _settled(r: DataFrame, limit: int = LIMIT, passes: int = 4) -> DataFrame:
    """Cells whose ``more`` is changed by one where that brings the source closest to its target, a few times."""
    whole = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for _ in range(passes):
        off = c("target") - F.sum((c("size") * (c("copies") * c("n") + c("more"))).cast("double")).over(whole)
        r = r.withColumn("_off", off)
        able = F.when(c("_off") > 0, (c("more") < c("n")) & (c("copies") < limit)).otherwise(c("more") > 0)
        gain = able & (c("size") < 2 * F.abs("_off"))
        best = F.min(F.when(gain, F.struct(F.abs(c("size") - F.abs("_off")).alias("d"), c("size").alias("z")))).over(whole)
        change = F.when(c("_best.z") == c("size"), F.signum("_off").cast("long")).otherwise(0)
        r = r.withColumn("_best", best).withColumn("more", c("more") + change).drop("_best", "_off")
    return r


def _copies(cells: DataFrame, rated: DataFrame) -> DataFrame:
    """(source, size, bucket, copies, extra): copies of every document, and how many of the bucket take one more."""
    floor = F.floor("rate").cast("long")
    in_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    r = rated.withColumn("copies", floor).withColumn("_x", F.floor(F.sum((c("rate") - c("copies")) * c("n")).over(in_source) + 0.5))
    before = F.coalesce(F.lag("_x").over(Window.partitionBy("source").orderBy("size")), F.lit(0))
    # Between equal sums of fractions the difference cannot exceed the cell.
    r = r.withColumn("more", F.least(c("n"), F.greatest(F.lit(0), c("_x") - before)))
    r = _settled(r)
    r = r.select(c("source").alias("_s"), c("size").alias("_z"), c("n").alias("_n"), "copies", "more")
    j = cells.join(r, (cells["source"] == c("_s")) & (cells["size"] == c("_z")))
    in_cell = Window.partitionBy("_s", "_z").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("n").over(in_cell)
    share = lambda k: F.floor(c("more") * k / c("_n"))
    j = j.withColumn("_upto", upto).withColumn("extra", (share(c("_upto")) - share(c("_upto") - c("n"))).cast("long"))
    return j.select("source", "size", "bucket", "copies", "extra")


def source_key(source: Column) -> Column:
    """Never-null key that sorts like the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT, keep: list[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, and columns in ``keep``."""
    u = F.xxhash64(F.lit("mix"), "doc_id")
    rows = docs.select("doc_id", c("source").alias("_source"), word_count(c("text")).alias("size"), source_key(c("source")).alias("source"),
                       *[k for k in keep if k not in ("doc_id", "source")])
    rows = rows.withColumn("_u", u).withColumn("bucket", F.pmod("_u", F.lit(BUCKETS)).cast("int"))
    cells = written(rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "cells")
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    per_source = by_size.groupBy("source").agg(F.sum(c("size") * c("n")).cast("long").alias("source_size"))
    aims = written(targets(per_source, weights, limit), "targets")
    rated = _balanced(by_size.join(aims, "source").where("source_size > 0"), limit)
    # Ranking and joining use the same key, and no key is larger than a hash bucket of documents of one size.
    key = ["source", "size", "bucket"]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy("_u", "doc_id")))
    got = ranked.join(cells.join(aims, "source").join(_copies(cells, rated), key, "left").drop("n"), key)
    times = F.coalesce(c("copies") + F.when(c("_rank") <= c("extra"), 1).otherwise(0), F.lit(0)).cast("long")
    return got.withColumn("copies", times).select(
        "doc_id", c("_source").alias("source"), "size", "source_size", "target", "copies", (c("copies") * c("size")).alias("taken"),
        *[k for k in keep if k not in ("doc_id", "source")])


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Documents the mix takes, with their columns and size, source_size, target, copies and taken.

    A document column of one of these five names wins.
    """
    names = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*[c(f"`{n}`") for n in names]).alias("_doc"))
    got = mix(packed, weights, limit, keep=["_doc"]).where("copies > 0")
    return got.select(*[c("_doc")[n].alias(n) for n in names],
                      *[k for k in ("size", "source_size", "target", "copies", "taken") if k not in names])
