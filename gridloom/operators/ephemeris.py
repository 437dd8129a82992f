"""Coefficient tables: record lookup by arithmetic, series evaluation and chains of bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.solar import chebyshev
from gridloom.session import cut_lineage

c = F.col


def evaluate(requests: DataFrame, records: DataFrame, start: float, interval: float, count: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Position at ``et``: the record number is arithmetic, so the interval join is an equi-join.

    ``keys`` name further columns that requests and records share, such as a segment's target.  The last interval is
    closed.  Requests outside the coverage keep a row with ``covered`` false.
    """
    inside = c("et").between(start, start + interval * count)
    idx = F.least(F.greatest(F.floor((c("et") - start) / interval), F.lit(0)), F.lit(count - 1))
    # Uncovered requests get keys that match nothing and differ, so they do not pile up in one task.
    q = requests.withColumn("covered", inside).withColumn("rec", F.when(inside, idx).otherwise(-1 - F.pmod(F.xxhash64("id"), F.lit(4096))))
    j = q.join(records, ["rec", *keys], "left").withColumn("tau", (c("et") - c("mid")) / c("radius"))
    return j.select(*[c(n) for n in requests.columns], "covered", *[chebyshev(c("coef_" + a), c("tau")).alias("p" + a) for a in "xyz"])


def _doubled(step: DataFrame, nodes: DataFrame, limit: int, also=None) -> DataFrame:
    """Follow ``step(node, to, hops)`` to its end by pointer doubling: every round takes twice as many hops as the last.

    Rows whose ``to`` is no node are finished and join no more.  ``also(step)`` sees every round's table first.  A loop
    never finishes; ``limit`` rounds cover every chain that does.
    """
    known = nodes.select(c("node").alias("to")).distinct()
    done = None
    for _ in range(limit):
        step = cut_lineage(step)
        if also:
            also(step)
        over = step.join(known, "to", "left_anti").select("node", "to", "hops")
        done = over if done is None else done.unionByName(over)
        step = step.join(known, "to", "left_semi").select("node", "to", "hops")
        if step.isEmpty():
            return cut_lineage(done)
        # What a pointer lands on may itself be finished: both kinds are looked up.
        whole = step.unionByName(done).select(c("node").alias("to"), c("to").alias("_to"), c("hops").alias("_hops"))
        step = step.join(whole, "to").select("node", c("_to").alias("to"), (c("hops") + c("_hops")).alias("hops"))
    return cut_lineage(done.unionByName(step))


def resolve_chains(segments: DataFrame, root: int = 0) -> tuple[DataFrame, DataFrame]:
    """Where the chain of every body with a segment ends, and the segments on the way of those that reach the root.

    Returns (body, hops, chain_status) and (body, target), one row per segment of the chain.  ``segments(target, center)``
    with several centres for a target counts the smallest.  Rounds grow with the logarithm of the longest chain.
    """
    step = cut_lineage(segments.where(c("target") != root).groupBy(c("target").alias("node")).agg(F.min("center").alias("to")).withColumn("hops", F.lit(1)))
    limit = step.count().bit_length() + 1
    first = _doubled(step, step, limit)
    # After more hops than there are nodes, pointers of looping bodies stand on exactly the nodes of loops.
    loops = cut_lineage(first.join(step.select(c("node").alias("to")), "to", "left_semi").select("to").distinct())
    open_step = step.join(loops.select(c("to").alias("node")), "node", "left_anti")
    ends = _doubled(open_step, open_step, limit).join(loops.withColumn("_loop", F.lit(True)), "to", "left")
    text = c("to").cast("string")
    status = F.when(c("to") == root, F.lit("ok")).when(c("_loop"), F.concat(F.lit("loop at "), text)).otherwise(F.concat(F.lit("missing "), text))
    ends = ends.select(c("node").alias("body"), "hops", status.alias("chain_status")).unionByName(
        loops.select(c("to").alias("body"), F.lit(0).alias("hops"), F.concat(F.lit("loop at "), text).alias("chain_status")))
    ends = cut_lineage(ends)

    whole = open_step.join(ends.where("chain_status = 'ok'").select(c("body").alias("node")), "node", "left_semi")
    way = [whole.select(c("node").alias("body"), c("node").alias("target"))]

    def longer(now: DataFrame) -> None:
        ahead = now.select(c("node").alias("_node"), "to").join(way[0].withColumnRenamed("body", "to"), "to").select(c("_node").alias("body"), "target")
        way[0] = cut_lineage(way[0].unionByName(ahead))

    _doubled(whole, whole, limit, longer)
    return ends, way[0].distinct()


def walk_chain(requests: DataFrame, segments: DataFrame, root: int = 0) -> DataFrame:
    """Requests with the number of segments from their body to the root, or why there is no way."""
    ends, _ = resolve_chains(segments, root)
    return _with_ends(requests, ends, root)


def _with_ends(requests: DataFrame, ends: DataFrame, root: int) -> DataFrame:
    j = requests.join(ends, "body", "left")
    status = F.when(c("body") == root, F.lit("ok")).otherwise(F.coalesce("chain_status", F.concat(F.lit("missing "), c("body").cast("string"))))
    return j.withColumns({"hops": F.when(c("body") == root, 0).otherwise(F.coalesce("hops", F.lit(0))), "chain_status": status})


def chain_positions(requests: DataFrame, segments: DataFrame, records: DataFrame, start: float, interval: float, count: int, root: int = 0) -> DataFrame:
    """Requests (id, et, body) with hops, chain_status, covered and px, py, pz relative to the root.

    A position is the sum of the chain's segments at the request's time, each from its own ``records(target, rec, ...)``.
    The root itself is at the origin; a body without a way, or a time outside the records, has no position.
    """
    ends, way = resolve_chains(segments, root)
    walked = _with_ends(requests, ends, root)
    inside = c("et").between(start, start + interval * count)
    parts = walked.where("chain_status = 'ok'").select("id", "et", "body").join(way, "body")
    at = evaluate(parts, records, start, interval, count, ("target",)).groupBy("id").agg(*[F.sum("p" + a).alias("p" + a) for a in "xyz"])
    origin = (c("body") == root) & inside
    return walked.withColumn("covered", inside).join(at, "id", "left").withColumns(
        {"p" + a: F.when(origin, 0.0).otherwise(c("p" + a)) for a in "xyz"})


def unit(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    n = F.sqrt(x * x + y * y + z * z)
    return x / n, y / n, z / n
