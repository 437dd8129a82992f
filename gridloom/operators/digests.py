"""Digest trees of layers: which tiles two copies of a layer differ in, without comparing their samples.

A leaf is the part of a raster row inside one tile and holds two digests, of the packed heights (little-endian float32, missing
ones as NaN) and of the packed class mask (an absent mask is the empty string).  A node hashes its children's numbers and
digests, ``tile`` at a time, so the first level are tiles and the last is one root per layer.  Every aggregation has at most
``tile`` rows a group.  Edits rehash the leaves of changed rows and the nodes above them; other rows are not read again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut_lineage

c = F.col
TILE = 64
LEAF = "layer_id string, node long, heights string, mask string"


def leaves(rows: DataFrame, tile: int = TILE, mask: str | None = "semantic") -> DataFrame:
    """(layer_id, node, heights, mask): digests of row parts; a node is its tile's number times ``tile`` plus the row in it."""
    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            packed = [_packed(b.column("heights"), np.nan, "<f4"), _packed(b.column("mask"), 255, "u1")]
            size = packed[0][1]
            for i, (layer, row) in enumerate(zip(b.column("layer_id").to_pylist(), b.column("row").to_pylist())):
                across = -(-int(size[i + 1] - size[i]) // tile)
                for k in range(across):
                    out[0].append(layer)
                    out[1].append((row // tile * across + k) * tile + row % tile)
                    for o, (data, at) in zip(out[2:], packed):
                        part = data[min(at[i] + k * tile, at[i + 1]):min(at[i] + (k + 1) * tile, at[i + 1])]
                        o.append(hashlib.sha256(part.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.string()))],
                                             names=["layer_id", "node", "heights", "mask"])

    kept = c(mask).cast("array<int>") if mask else F.lit(None).cast("array<int>")
    return rows.select("layer_id", "row", "heights", kept.alias("mask")).mapInArrow(run, LEAF)


def _packed(lists, missing, kind: str):
    """Values of a list column as one array of ``kind``, and the offsets of its rows."""
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return np.where(np.isnan(values), missing, values).astype(kind), lists.offsets.to_numpy()


def _parents(children: DataFrame, up: Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("node", "heights", "mask")))
    text = lambda of: F.sha2(F.array_join(F.transform(c("_all"), lambda x: F.concat_ws(":", x["node"], x[of])), ","), 256)
    return children.groupBy("layer_id", up.alias("_up")).agg(ordered.alias("_all")).select(
        "layer_id", c("_up").alias("node"), text("heights").alias("heights"), text("mask").alias("mask"))


def _up(tile: int, node: str = "node") -> Column:
    return F.floor(c(node) / tile).cast("long")


def tree(rows: DataFrame, tile: int = TILE, mask: str | None = "semantic") -> list[DataFrame]:
    """Levels of (layer_id, node, heights, mask), leaves first, tiles second and one root per layer last."""
    levels = [cut_lineage(leaves(rows, tile, mask))]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top > 0 or len(levels) < 2:
        levels.append(cut_lineage(_parents(levels[-1], _up(tile))))
        top //= tile
    return levels


def updated(levels: list[DataFrame], changed: DataFrame, tile: int = TILE, mask: str | None = "semantic") -> list[DataFrame]:
    """The tree after rows of the layers were replaced by ``changed``; their number and width stay."""
    new, out = cut_lineage(leaves(changed, tile, mask)), []
    for i, level in enumerate(levels):
        now = level.join(new, ["layer_id", "node"], "left_anti").unionByName(new)
        out.append(now)
        if i + 1 < len(levels):
            above = new.select("layer_id", _up(tile).alias("_p")).distinct()
            touched = now.withColumn("_p", _up(tile)).join(above, ["layer_id", "_p"], "left_semi").drop("_p")
            new = cut_lineage(_parents(touched, _up(tile)))
    return out


def differing(one: list[DataFrame], two: list[DataFrame], tile: int = TILE) -> DataFrame:
    """(layer_id, node, status, heights_differ, masks_differ) of the leaves in which two trees differ, found from the roots down.

    Only children of differing nodes are compared.  status: changed, missing (not in the second) or surplus.  Trees of
    unlike height are of layers of unlike extent, all of whose leaves are compared.
    """
    found = None
    for a, b in list(zip(one, two))[::-1] if len(one) == len(two) else [(one[0], two[0])]:
        if found is not None:
            under = found.select("layer_id", c("node").alias("_p"))
            a, b = (x.withColumn("_p", _up(tile)).join(under, ["layer_id", "_p"], "left_semi").drop("_p") for x in (a, b))
        other = b.select("layer_id", "node", c("heights").alias("_h"), c("mask").alias("_m"))
        both = a.join(other, ["layer_id", "node"], "full")
        status = F.when(c("_h").isNull(), "missing").when(c("heights").isNull(), "surplus").otherwise("changed")
        found = cut_lineage(both.where(~c("heights").eqNullSafe(c("_h")) | ~c("mask").eqNullSafe(c("_m"))).select(
            "layer_id", "node", status.alias("status"), (~c("heights").eqNullSafe(c("_h"))).alias("heights_differ"),
            (~c("mask").eqNullSafe(c("_m"))).alias("masks_differ")))
    return found


def differing_tiles(leaf_report: DataFrame, tile: int = TILE) -> DataFrame:
    """Per tile: rows that are changed, missing and surplus, and whether its heights or its mask differ."""
    return leaf_report.groupBy("layer_id", _up(tile).alias("tile")).agg(
        *[F.count_if(c("status") == s).alias(s) for s in ("changed", "missing", "surplus")],
        F.bool_or("heights_differ").alias("heights_differ"), F.bool_or("masks_differ").alias("masks_differ"))
