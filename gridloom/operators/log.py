"""Delta log integrity: chains, gaps, retention, change polling, digests and audits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.codes import DELTA_WINDOW, FEATURE_CLASS
from gridloom.operators.ordered import lag_in_order, scan

c = F.col


def chain_breaks(deltas: DataFrame) -> DataFrame:
    """Compare ``previous`` with the resulting checksum of the delta before it on the same layer."""
    d = lag_in_order(deltas.select("layer_id", "seq", "previous", "resulting"), ["layer_id"], "seq", ["resulting", "seq"])
    return d.withColumn("broken", c("prev_resulting").isNotNull() & (c("previous") != c("prev_resulting")))


def sequence_gaps(deltas: DataFrame) -> DataFrame:
    """Ranges of missing sequence numbers."""
    d = lag_in_order(deltas.select("revision", "seq"), ["revision"], "seq", ["seq"])
    return d.where(c("seq") > c("prev_seq") + 1).select(
        "revision", (c("prev_seq") + 1).alias("first_missing"), (c("seq") - 1).alias("last_missing"))


def retained(deltas: DataFrame, window: int = DELTA_WINDOW) -> DataFrame:
    """The newest ``window`` deltas of each revision; a revision keeps a bounded number, so a top-k is enough."""
    head = deltas.groupBy("revision").agg(F.max("seq").alias("head"))
    # The sequence threshold prunes the log before the bounded ranking.
    from pyspark.sql.window import Window

    near = deltas.join(head, "revision").where(c("seq") > c("head") - window * 4)
    counts = near.groupBy("revision").agg(F.count("*").alias("n"))
    enough = near.join(counts, "revision").where(c("n") >= window).drop("n")
    short = deltas.join(head, "revision").join(
        counts.where(c("n") < window).select("revision"), "revision", "left_semi")
    rn = F.row_number().over(Window.partitionBy("revision").orderBy(F.desc("seq")))
    return enough.unionByName(short.select(*enough.columns)).withColumn("_rn", rn).where(c("_rn") <= window).drop("_rn")


def fetch_status(requests: DataFrame, deltas: DataFrame) -> DataFrame:
    """Outcome of asking for one delta: found, pruned, unknown or stale revision."""
    kept = retained(deltas)
    ends = kept.groupBy("revision").agg(F.min("seq").alias("oldest"), F.max("head").alias("head"))
    hit = kept.select(c("revision").alias("_r"), c("seq").alias("_s"))
    j = requests.join(ends, "revision", "left").join(
        hit, (requests["revision"] == c("_r")) & (requests["seq"] == c("_s")), "left")
    status = (F.when(c("head").isNull(), "stale_revision").when(c("_s").isNotNull(), "found")
              .when(c("seq") < c("oldest"), "pruned").otherwise("unknown"))
    return j.withColumn("status", status).drop("_r", "_s", "oldest", "head")


def changed_since(deltas: DataFrame, seq: Column) -> tuple[DataFrame, DataFrame]:
    """Distinct changed tiles, and per-layer sums, of all deltas from a sequence number on."""
    d = deltas.where(c("seq") >= seq)
    tiles = d.select("layer_id", F.explode("changed_tiles").alias("tile_id")).distinct()
    sums = d.groupBy("layer_id").agg(F.count("*").alias("deltas"), F.sum("changed_count").alias("changed"),
                                     F.sum("rocks_reseated").alias("reseated"))
    return tiles, sums


def terminal(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("layer_id").agg(F.max_by(F.struct("seq", "resulting"), "seq").alias("t")).select(
        "layer_id", "t.seq", "t.resulting")


# ------------------------------------------------------------------ digests
def _row_digests(batches):
    import hashlib

    for b in batches:
        lists = b.column("heights")
        offs = lists.offsets.to_numpy()
        raw = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<f4"))
        out = [hashlib.sha256(raw[i:j].tobytes()).hexdigest() for i, j in zip(offs[:-1], offs[1:])]
        yield pa.RecordBatch.from_arrays([b.column("layer_id"), b.column("row"), pa.array(out)], names=["layer_id", "row", "digest"])


def layer_digests(rows: DataFrame, block: int = 256) -> DataFrame:
    """Tree digest of a layer: rows, then blocks of rows, then blocks of blocks, up to one hash.

    Each level combines a bounded number of hashes, so a layer of any height never becomes one list.
    """
    d = rows.select("layer_id", "row", "heights").mapInArrow(_row_digests, "layer_id string, row long, digest string")
    top = d.agg(F.max("row").alias("m")).first()["m"]
    while True:
        d = d.groupBy("layer_id", F.floor(c("row") / block).alias("row")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "digest"))), lambda s: s["digest"]), ""), 256)
            .alias("digest"))
        top = (top or 0) // block
        if top == 0:
            return d.select("layer_id", "digest")


def audit_features(ops: DataFrame, features: DataFrame, deltas: DataFrame) -> DataFrame:
    """Problems between construction edits, their features and their deltas, in both directions."""
    table = F.create_map(*[F.lit(x) for kv in FEATURE_CLASS.items() for x in kv])
    o = ops.withColumn("want", F.try_element_at(table, c("kind"))).where(c("want").isNotNull())
    f = features.select(c("op_seq").alias("seq"), c("kind").alias("f_kind"), c("layer_id").alias("f_layer"),
                        c("semantic_class").alias("f_class"), c("cx").alias("f_cx"), c("radius").alias("f_radius"), c("net").alias("f_net"))
    d = deltas.select("seq", c("net").alias("d_net"))
    j = o.join(f, "seq", "left").join(d, "seq", "left")
    identity = (c("f_kind") == c("kind")) & (c("f_layer") == c("layer_id")) & (c("f_class") == c("want"))
    same = c("f_cx").eqNullSafe(c("cx")) & c("f_radius").eqNullSafe(c("radius"))
    problem = F.array_compact(F.array(
        F.when(c("f_kind").isNull(), "edit without feature"),
        F.when(c("f_kind").isNotNull() & ~identity, "identity differs"),
        F.when(c("f_kind").isNotNull() & identity & ~same, "parameters diverge"),
        F.when(c("f_kind").isNotNull() & identity & c("d_net").isNotNull() & (c("d_net") != c("f_net")), "balance diverges")))
    forward = j.select("seq", F.explode(problem).alias("problem"))
    orphans = features.join(o.select(c("seq").alias("op_seq")), "op_seq", "left_anti").select(
        c("op_seq").alias("seq"), F.lit("feature without edit").alias("problem"))
    return forward.unionByName(orphans)


def latest_values(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Sparse apply: last value per index by sequence over a base copy."""
    last = changes.groupBy("layer_id", "idx").agg(F.max_by("value", "seq").alias("new"))
    return base.join(last, ["layer_id", "idx"], "left").select("layer_id", "idx", F.coalesce("new", "value").alias("value"))


def admission(arrivals: DataFrame, revision: int) -> DataFrame:
    """What a consumer does with each delta in arrival order: apply, ignore, fetch the gap or resync."""
    seen = scan(arrivals, [], "arrival", F.when(c("revision") == revision, c("seq")), "max", "_head")
    expected = F.coalesce(c("_head"), F.lit(-1)) + 1
    action = (F.when(c("revision") != revision, "resync").when(c("seq") < expected, "ignore")
              .when(c("seq") > expected, "fetch").otherwise("apply"))
    return seen.withColumn("expected", expected).withColumn("action", action).drop("_head")
