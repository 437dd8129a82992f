"""A consumer of the edit log: which deliveries it applies, which it undoes, and the copy that it ends with.

Deliveries of a log arrive in any order, more than once, damaged or in part.  A consumer applies sequence number after
sequence number, each as a whole: parts that do not match their digests, or are missing, roll the delivery back to the
state before it, and a later delivery of the same number can still be applied.

Which delivery of a number is applied depends on when its predecessor was, so the applied ones are a path: every intact
delivery points to the first intact delivery of the next number after it (sorted by number; a scan in pieces where numbers
come very often), and the path from the first number is found inside ranges of arrivals and by pointer doubling over ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.log import chain_breaks
from gridloom.operators.ordered import lag_in_order, scan
from gridloom.session import cut_lineage

c = F.col
#: Consecutive numbers that are counted together, and the deliveries of so many numbers that are sorted without being cut into pieces.
SPAN, CROWD = 256, 1 << 17


def intact(deliveries: DataFrame, parts: DataFrame) -> DataFrame:
    """Deliveries with ``whole``: all of their ``n_parts`` came and every part matches its digest.

    The parts that came are marked in words of 64 bits, so that a delivery's parts meet as one row for 64 of them.  As in the
    other joins here, both sides grow with the log, whatever their size is guessed at, so neither is sent through the driver.
    """
    mark = F.expr("shiftleft(1L, CAST(part & 63 AS INT))")
    words = parts.groupBy("arrival", F.expr("shiftright(part, 6)").alias("_word")).agg(
        F.bool_and(c("got").eqNullSafe(c("want"))).alias("_ok"), F.bit_or(mark).alias("_came"))
    # Parts without a number are one part.
    came = F.when(c("_word").isNull(), 1).otherwise(F.bit_count("_came"))
    per = words.groupBy("arrival").agg(F.bool_and("_ok").alias("_ok"), F.sum(came).alias("_n")).hint("merge")
    return deliveries.join(per, "arrival", "left").withColumn(
        "whole", F.coalesce(F.coalesce("_n", F.lit(0)) == c("n_parts"), F.lit(False)) & F.coalesce("_ok", F.lit(True))).drop("_ok", "_n")


def next_delivery(good: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(node, to): the first delivery of the next sequence number that arrives later; ``good(arrival, seq)``.

    The few deliveries of a number are sorted in one task; spans of numbers with more than ``crowd`` of them are scanned in pieces.
    """
    asks = good.select((c("seq") + 1).alias("seq"), "arrival", F.lit(False).alias("offer"))
    both = asks.unionByName(good.select("seq", "arrival", F.lit(True).alias("offer")))
    span, offered = F.floor(c("seq") / SPAN), F.when(c("offer"), c("arrival"))
    crowded = cut_lineage(both.groupBy(span.alias("_span")).agg(F.count("*").alias("_n")).where(c("_n") > crowd).select("_span"))
    many = None
    if not crowded.isEmpty():
        both = both.withColumn("_span", span)
        many = both.join(F.broadcast(crowded), "_span", "left_semi").drop("_span").withColumn("_back", -c("arrival"))
        both = both.join(F.broadcast(crowded), "_span", "left_anti").drop("_span")
    later = Window.partitionBy("seq").orderBy(F.desc("arrival")).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("to", F.last(offered, ignorenulls=True).over(later))
    if many is not None:
        seen = seen.unionByName(scan(many, ["seq"], "_back", offered, "last", "to").drop("_back"))
    return seen.where(~c("offer") & c("to").isNotNull()).select(c("arrival").alias("node"), "to")


def _walk(batches, from_entry: bool):
    """Inside one range of nodes: where every node leaves the range, or the nodes that are passed from the range's entry."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    get = lambda n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in batches])
    node, to = get("node"), get("to")
    order = np.argsort(node)
    node, to = node[order], to[order]
    at = np.minimum(np.searchsorted(node, to), len(node) - 1)
    ahead = np.where(node[at] == to, at, np.arange(len(node)))
    if from_entry:
        here = int(np.searchsorted(node, get("entry")[0]))
        passed = [here]
        while ahead[here] != here:
            here = int(ahead[here])
            passed.append(here)
        yield pa.RecordBatch.from_arrays([pa.array(node[passed])], names=["node"])
        return
    while True:
        further = ahead[ahead]
        if (further == ahead).all():
            break
        ahead = further
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(to[ahead])], names=["node", "to"])


def on_path(step: DataFrame, root: DataFrame, parts: int | None = None) -> DataFrame:
    """(node): everything that is reached from the one row of ``root(node)`` over ``step(node, to)`` with ``to`` > ``node``, one step a node.

    Nodes are cut into ranges of their order.  A path only rises, so it passes through a range once: steps inside a range are
    skipped first, and the rounds follow the logarithm of the number of ranges instead of the path's length.
    """
    cut = step.repartitionByRange(parts, "node") if parts else step.repartitionByRange("node")
    cut = cut_lineage(cut.withColumn("_range", F.spark_partition_id()))
    exits = cut.select("node", "to").mapInArrow(lambda b: _walk(b, False), "node long, to long")
    exits = cut_lineage(exits)
    entered = exits.select(c("to").alias("node")).unionByName(root.select("node")).distinct()
    jump, reached = cut_lineage(exits.join(entered, "node", "left_semi")), cut_lineage(root.select("node"))
    while True:
        # What is reached holds all entries nearer than the length of a jump, so what a jump adds is new.
        ahead = cut_lineage(reached.join(jump, "node").select(c("to").alias("node")))
        if ahead.isEmpty():
            break
        reached = reached.unionByName(ahead)
        far = jump.select(c("node").alias("to"), c("to").alias("_far"))
        jump = cut_lineage(jump.join(far, "to").select("node", c("_far").alias("to")))
    # At most one entry a range, so there are no more rows than partitions.
    entry = cut.join(reached, "node", "left_semi").groupBy("_range").agg(F.min("node").alias("entry"))
    passed = cut.join(F.broadcast(entry), "_range").select("node", "to", "entry").mapInArrow(lambda b: _walk(b, True), "node long")
    return passed.unionByName(reached).distinct()


def admit(deliveries: DataFrame, parts: DataFrame, log: DataFrame, start: int, revision: int) -> DataFrame:
    """Deliveries with ``expected`` (the number the consumer waits for) and ``status``.

    ``deliveries(arrival, revision, seq, n_parts)`` with unique arrivals, ``parts(arrival, part, want, got)``,
    ``log(seq, layer_id, previous, resulting)``.  Another revision, or a number whose checksum does not follow the one before
    it on its layer, asks for a new baseline (``resync``) and is never applied; so nothing after a broken number is.
    Smaller numbers are ignored (null numbers too), larger ones make the consumer fetch what is missing; a number whose parts do not hold is
    undone (``roll back``).
    """
    linked = chain_breaks(log).select("seq", (~c("broken")).alias("linked")).hint("merge")
    d = intact(deliveries, parts).join(linked, "seq", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    d = cut_lineage(d.withColumn("current", F.coalesce(c("revision") == revision, F.lit(False))))
    good = d.where("current and linked and whole").select("arrival", "seq")
    d = d.join(_path(good, start).withColumn("applied", F.lit(True)).hint("merge"), "arrival", "left")
    d = scan(d, [], "arrival", F.when(c("applied"), c("seq")), "max", "_head").withColumn("expected", F.coalesce(c("_head") + 1, F.lit(start)))
    status = (F.when(~c("current"), "resync").when(c("seq").isNull() | (c("seq") < c("expected")), "ignore")
              .when(c("seq") > c("expected"), "fetch").when(c("applied"), "apply").when(~c("linked"), "resync").otherwise("roll back"))
    return d.withColumn("status", status).drop("applied", "_head", "current", "linked")


def _path(good: DataFrame, start: int) -> DataFrame:
    """(arrival): the applied ones among the deliveries that can be applied, ``good(arrival, seq)``."""
    first = good.where(c("seq") == start).agg(F.min("arrival").alias("node")).where("node is not null")
    return on_path(next_delivery(good), first).select(c("node").alias("arrival")).hint("merge")


def applied(deliveries: DataFrame, parts: DataFrame, log: DataFrame, start: int, revision: int) -> DataFrame:
    """(arrival, seq, status): the deliveries with status ``apply`` of ``admit`` alone.

    Numbers rise by one along the path of the applied ones, so each of them is what the consumer waits for, and nothing has
    to be known about the others.
    """
    linked = chain_breaks(log).where(~c("broken")).select("seq").hint("merge")
    good = intact(deliveries.where(c("revision") == revision), parts).where("whole").select("arrival", "seq")
    good = cut_lineage(good.join(linked, "seq", "left_semi").select("arrival", "seq"))
    return good.join(_path(good, start), "arrival", "left_semi").withColumn("status", F.lit("apply"))


def copy_after(base: DataFrame, changes: DataFrame, admitted: DataFrame) -> DataFrame:
    """The consumer's copy ``(layer_id, idx, value, seq)``: the base with the last applied change of every sample.

    ``changes(arrival, part, layer_id, idx, value)`` are the contents of the parts; of one delivery the last part counts.
    """
    done = admitted.where("status = 'apply'").select("arrival", "seq").hint("merge")
    last = changes.join(done, "arrival").groupBy("layer_id", "idx").agg(
        F.max_by(F.struct("value", "seq"), F.struct("seq", "part")).alias("_n"))
    return base.join(last, ["layer_id", "idx"], "full").select(
        "layer_id", "idx", F.when(c("_n").isNotNull(), c("_n.value")).otherwise(c("value")).alias("value"), c("_n.seq").alias("seq"))


def snapshot_problems(deltas: DataFrame, operations: DataFrame, revision: int, next_sequence: Column | int, window: int | None = None) -> DataFrame:
    """(seq, problem) where a stored log does not hold together; a null seq is a problem of the whole log.

    ``deltas(seq, revision, layer_id, previous, resulting, rocks_before, rocks_after, op)``, ``operations(seq, op)``.  The
    terrain's checksums follow each other per layer, the rocks' over all layers; numbers are contiguous and end before
    ``next_sequence``; every delta names the operation of its number exactly.
    """
    want = F.lit(next_sequence).cast("long") if isinstance(next_sequence, int) else next_sequence
    chain = chain_breaks(deltas.select("layer_id", "seq", "previous", "resulting")).where("broken").select(
        "seq", F.lit("terrain chain").alias("problem"))
    whole = lag_in_order(deltas.select("seq", "revision", "rocks_before", "rocks_after").withColumn("_one", F.lit(0)), ["_one"], "seq", ["seq", "rocks_after"])
    row = F.array_compact(F.array(
        F.when(c("prev_rocks_after").isNotNull() & ~c("rocks_before").eqNullSafe(c("prev_rocks_after")), "rock chain"),
        F.when(c("seq") != c("prev_seq") + 1, "sequence"), F.when(c("revision") > revision, "newer revision")))
    rows = whole.select("seq", F.explode(row).alias("problem"))
    named = deltas.select("seq", "op").join(operations.select("seq", c("op").alias("_op")), "seq", "left").where(
        ~c("op").eqNullSafe(c("_op"))).select("seq", F.lit("operation differs").alias("problem"))
    rows_of = lambda d, stored: d.select(F.lit(stored).alias("_d"), "seq")
    counts = rows_of(deltas, True).unionByName(rows_of(operations, False)).agg(
        F.count_if("_d").alias("n"), F.max(F.when(c("_d"), c("seq"))).alias("last"), F.count_if(~c("_d")).alias("ops"))
    size = F.array_compact(F.array(
        F.when(c("ops") != want, "operation count"), F.when(c("n") > F.least(want, F.lit(window)) if window else c("n") > want, "delta count"),
        F.when((c("n") > 0) & (c("last") != want - 1), "last sequence")))
    return chain.unionByName(rows).unionByName(named).unionByName(counts.select(
        F.lit(None).cast("long").alias("seq"), F.explode(size).alias("problem")))
