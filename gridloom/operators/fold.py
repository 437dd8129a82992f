"""Ordered float32 fold per raster sample.

Heights are float32 and every change rounds, so changes to one sample must be applied one after the
other in sequence order; a sum gives other bits.  The changes are spread by sample, the finest key
there is, sorted by sequence inside each partition, and streamed through once.  The running height is
the only state, so a sample that takes a large share of all changes costs time but no memory.

Where a whole log follows from the geometry of its edits, ``block_fold`` moves the edits instead of their samples: one
record per edit and block of raster rows meets the stored rows of that block, and samples exist only inside the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("layer_id", "row", "col")

#: Samples are worked on in pieces of about 2 ** PIECE_BITS, so that the arrays of a piece stay in a core's cache.
PIECE_BITS = 15
#: Raster rows of a feature that ``box_rows`` deals out together.
DEALT_ROWS = 64
#: Raster rows of a block of ``block_fold``.
BLOCK_ROWS = 16

# How a change acts on the height h: add w; blend h towards t by w; the same, only when it lowers or
# only when it raises.
ADD, BLEND, CUT, FILL = 0, 1, 2, 3


def _fold_batches(batches: Iterator[pa.RecordBatch], carry: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    last_key, last_h = None, np.float32(0)
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        layer = batch.column("layer_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        row, col, mode, base, t, w, extra = (
            batch.column(name).to_numpy(zero_copy_only=False)
            for name in ("row", "col", "mode", "base", "t", "w", "extra"))
        first_name = batch.column("layer_id")[0].as_py()
        change = np.ones(n, dtype=bool)
        change[1:] = (layer[1:] != layer[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])
        starts = np.flatnonzero(change)
        run = np.cumsum(change) - 1
        rank = np.arange(n) - starts[run]
        h = base[starts].astype(np.float32)
        if last_key == (first_name, int(row[0]), int(col[0])):
            h[0] = last_h
        before, delta, after = np.empty(n, np.float32), np.zeros(n, np.float64), np.empty(n, np.float32)
        # All samples advance together, one change each per round.
        order = np.argsort(rank, kind="stable")
        bounds = np.searchsorted(rank[order], np.arange(rank.max() + 2))
        with np.errstate(over="ignore", invalid="ignore"):
            for k in range(len(bounds) - 1):
                at = order[bounds[k]:bounds[k + 1]]
                now = h[run[at]].astype(np.float64)
                gap = t[at] - now
                m = mode[at]
                blend = np.where(((m == CUT) & ~(gap < 0)) | ((m == FILL) & ~(gap > 0)), 0.0, gap * w[at])
                dh = np.where(m == ADD, w[at], blend) + extra[at]
                new = (now + dh).astype(np.float32)
                before[at], delta[at], after[at] = now, dh, new
                h[run[at]] = new
        last_key = (batch.column("layer_id")[n - 1].as_py(), int(row[-1]), int(col[-1]))
        last_h = h[-1]
        keep = [batch.column(name) for name in ("layer_id", "row", "col", "seq", "turn", *carry)]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(before), pa.array(delta), pa.array(after)],
            names=["layer_id", "row", "col", "seq", "turn", *carry, "before", "dh", "after"])


def ordered_fold(changes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``layer_id, row, col, seq, before, dh, after`` for ``changes(layer_id, row, col, seq, mode, t, w, base)``.

    ``base`` is the stored height of the sample and must be the same in all its changes.  Optional
    columns: ``extra`` is added to the change of the same edit before rounding; ``turn`` orders rows
    of one edit on one sample, so a reading (turn 0) comes before the change (turn 1).  Columns named
    in ``carry`` (doubles) are copied to the result.
    """
    for name in ("extra", "turn"):
        if name not in changes.columns:
            changes = changes.withColumn(name, F.lit(0.0 if name == "extra" else 1))
    cols = changes.select(
        "layer_id", F.col("row").cast("long"), F.col("col").cast("int"), F.col("seq").cast("long"),
        F.col("mode").cast("tinyint"), F.coalesce(F.col("t").cast("double"), F.lit(0.0)).alias("t"),
        F.col("w").cast("double"), F.col("base").cast("float"), F.col("extra").cast("double"),
        F.col("turn").cast("tinyint"), *[F.col(n).cast("double") for n in carry if n not in ("t", "w", "extra")])
    # The explicit repartition keeps all changes of a sample in one task whatever the optimiser does
    # to the join below it.
    return cols.repartition(*KEYS).sortWithinPartitions(*KEYS, "seq", "turn").mapInArrow(
        lambda batches: _fold_batches(batches, carry), ", ".join([
            "layer_id string, row long, col int, seq long, turn tinyint", *[f"{n} double" for n in carry],
            "before float, dh double, after float"]))


def with_base(changes: DataFrame, rows: DataFrame) -> DataFrame:
    """Attach the stored height of each touched sample; samples without a value are left out."""
    r = rows.select("layer_id", "row", "heights")
    return changes.join(r, ["layer_id", "row"]).withColumn(
        "base", F.get("heights", F.col("col").cast("int"))).drop("heights").where(F.col("base").isNotNull())


def final_heights(folded: DataFrame) -> DataFrame:
    """Last height of every touched sample."""
    return folded.groupBy(*KEYS).agg(F.max_by("after", "seq").alias("h"), F.count("*").alias("changes"))


def apply_to_rows(rows: DataFrame, changed: DataFrame, column: str = "heights", value: str = "h") -> DataFrame:
    """Write sparse ``(layer_id, row, col, value)`` back into the row arrays.

    The map of one raster row is at most one row wide, so the group is bounded by the row width.
    """
    per_row = changed.groupBy("layer_id", "row").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), F.col(value)))).alias("_m"))
    patched = F.transform(F.col(column), lambda v, i: F.coalesce(F.try_element_at("_m", i), v))
    return rows.join(per_row, ["layer_id", "row"], "left").withColumn(
        column, F.when(F.col("_m").isNull(), F.col(column)).otherwise(patched)).drop("_m")


def task_count(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def box_rows(features: DataFrame, layers: DataFrame, box: dict[str, str], key: str = "seq") -> DataFrame:
    """Spread features over the raster rows of their layer inside a world box, clipped to the grid.

    ``box`` names the columns ``min_x max_x min_z max_z``.  The compact (feature, row) records carry
    the column range ``_c0.._c1`` and are dealt out to all tasks in groups of ``DEALT_ROWS`` rows: one very large feature, or a
    small input file, is split before the per-sample work starts, and what is exchanged does not follow the rows.
    """
    g = layers.select("layer_id", "res", "width", "height", F.col("min_x").alias("_lx"), F.col("min_z").alias("_lz"))
    f = features.join(g, "layer_id")
    lo = lambda v, o: F.greatest(F.lit(0), F.floor((F.col(v) - F.col(o)) / F.col("res")))
    hi = lambda v, o, n: F.least(F.col(n) - 1, F.ceil((F.col(v) - F.col(o)) / F.col("res")))
    f = f.withColumn("_r0", lo(box["min_z"], "_lz")).withColumn("_r1", hi(box["max_z"], "_lz", "height"))
    f = f.withColumn("_c0", lo(box["min_x"], "_lx")).withColumn("_c1", hi(box["max_x"], "_lx", "width"))
    f = f.where((F.col("_r1") >= F.col("_r0")) & (F.col("_c1") >= F.col("_c0")))
    part = F.sequence(F.floor(F.col("_r0") / DEALT_ROWS), F.floor(F.col("_r1") / DEALT_ROWS))
    f = f.withColumn("_part", F.explode(part)).repartition(task_count(features.sparkSession), "layer_id", key, "_part")
    inside = F.sequence(F.greatest("_r0", F.col("_part") * DEALT_ROWS), F.least("_r1", (F.col("_part") + 1) * DEALT_ROWS - 1))
    f = f.withColumn("row", F.explode(inside))
    return f.withColumn("z", F.col("_lz") + F.col("row") * F.col("res")).drop("_r0", "_r1", "_lz", "_part")


def explode_boxes(features: DataFrame, layers: DataFrame, box: dict[str, str], key: str = "seq") -> DataFrame:
    """One record per feature and sample of its box, with world coordinates ``x, z``."""
    f = box_rows(features, layers, box, key).withColumn("col", F.explode(F.sequence("_c0", "_c1")))
    return f.withColumn("x", F.col("_lx") + F.col("col") * F.col("res")).drop("_c0", "_c1", "_lx")


class _Inputs:
    """What a shape reads of its records: ``get(name)`` per sample; ``each`` works a record's figure out once before it is spread."""

    def __init__(self, arrays: dict, lists: dict, idx):
        self.arrays, self.lists, self.idx = arrays, lists, idx

    def __call__(self, name: str):
        return self.arrays[name][self.idx] if name in self.arrays else (self.lists[name], self.idx)

    def each(self, figure, *names: str):
        return figure(*(self.arrays[n] for n in names))[self.idx]

    def at(self, samples) -> _Inputs:
        return _Inputs(self.arrays, self.lists, self.idx[samples])


def map_boxes(records: DataFrame, numbers: list[str], carry: list[str], shape, out: str, total: bool = False) -> DataFrame:
    """Evaluate ``shape`` at every sample of the column range of (feature, row) records, in Arrow batches.

    ``shape(get, x, z)`` receives sample arrays and returns a dict of arrays plus the mask ``keep``.
    ``numbers`` are read as float arrays; ``carry`` columns are copied to the samples that are kept.
    ``out`` declares the columns made by ``shape``.  Work is cut into pieces that fit a core's cache.
    With ``total`` the arrays are summed over each record inside the batch, so one row per record
    leaves the task, with the number ``n`` of its samples.
    """
    spark_types = dict(records.dtypes)
    carry = [n for n in carry if n != "col"]
    made = [part.strip().split(" ")[0] for part in out.split(",")]
    per_sample = ["n long"] if total else ["col int", "x double"]
    schema = ", ".join([f"{n} {spark_types[n]}" for n in carry] + [*per_sample, out])
    numbers = list(dict.fromkeys(numbers))

    def run(batches):
        for batch in batches:
            arrays = {n: batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in numbers}
            lists = {n: batch.column(n) for n in batch.schema.names if pa.types.is_list(batch.schema.field(n).type)}
            c0 = batch.column("_c0").to_numpy(zero_copy_only=False).astype(np.int64)
            size = batch.column("_c1").to_numpy(zero_copy_only=False).astype(np.int64) - c0 + 1
            lx, res, z = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_lx", "res", "z"))
            piece = np.cumsum(size) >> PIECE_BITS
            for p in np.unique(piece):
                rec = np.flatnonzero(piece == p)
                idx = np.repeat(rec, size[rec])
                first = np.repeat(np.cumsum(size[rec]) - size[rec], size[rec])
                col = np.arange(len(idx)) - first + c0[idx]
                x = lx[idx] + col * res[idx]
                with np.errstate(all="ignore"):
                    made_arrays = shape(_Inputs(arrays, lists, idx), x, z[idx])
                keep = np.flatnonzero(made_arrays["keep"])
                if len(keep) == 0:
                    continue
                if total:
                    at = np.searchsorted(rec, idx[keep])
                    count = np.bincount(at, minlength=len(rec))
                    has = np.flatnonzero(count)
                    cols = [batch.column(n).take(pa.array(rec[has])) for n in carry] + [pa.array(count[has])]
                    cols += [pa.array(np.bincount(at, weights=made_arrays[n][keep], minlength=len(rec))[has]) for n in made]
                    yield pa.RecordBatch.from_arrays(cols, names=[*carry, "n", *made])
                    continue
                take = pa.array(idx[keep])
                cols = [batch.column(n).take(take) for n in carry]
                cols += [pa.array(col[keep].astype(np.int32)), pa.array(x[keep])]
                cols += [made_arrays[n] if isinstance(made_arrays[n], pa.Array) else pa.array(made_arrays[n][keep]) for n in made]
                yield pa.RecordBatch.from_arrays(cols, names=[*carry, "col", "x", *made])

    wanted = list(dict.fromkeys([*carry, *numbers, "_c0", "_c1", "_lx", "res", "z",
                                 *[n for n, t in spark_types.items() if t.startswith("array")]]))
    return records.select(*wanted).mapInArrow(run, schema)


# ------------------------------------------------------------------ folding inside blocks of rows
def block_records(features: DataFrame, layers: DataFrame, box: dict[str, str], block: int = BLOCK_ROWS) -> DataFrame:
    """One record per feature and block of raster rows inside its box: ``_block``, ``_r0.._r1`` within it, ``_c0.._c1``."""
    g = layers.select("layer_id", "res", "width", "height", F.col("min_x").alias("_lx"), F.col("min_z").alias("_lz"))
    f = features.join(g, "layer_id")
    lo = lambda v, o: F.greatest(F.lit(0), F.floor((F.col(v) - F.col(o)) / F.col("res")))
    hi = lambda v, o, n: F.least(F.col(n) - 1, F.ceil((F.col(v) - F.col(o)) / F.col("res")))
    f = f.withColumn("_r0", lo(box["min_z"], "_lz")).withColumn("_r1", hi(box["max_z"], "_lz", "height"))
    f = f.withColumn("_c0", lo(box["min_x"], "_lx")).withColumn("_c1", hi(box["max_x"], "_lx", "width"))
    f = f.where((F.col("_r1") >= F.col("_r0")) & (F.col("_c1") >= F.col("_c0")))
    f = f.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_r0") / block), F.floor(F.col("_r1") / block))))
    return f.withColumn("_r0", F.greatest("_r0", F.col("_block") * block)).withColumn("_r1", F.least("_r1", (F.col("_block") + 1) * block - 1))


def block_fold(records: DataFrame, rows: DataFrame, numbers: list[str], carry: list[str], shape, out: str, steps: bool = True,
               last: str | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """Evaluate ``shape`` over ``block_records`` and fold the changes of each sample in ``seq`` order.

    Stored rows and records of a block meet in one task, rows first, records in order; the state is the block's heights, so a
    block with many edits costs time but no memory.  ``shape`` is as in ``map_boxes`` and makes ``w`` and, unless every change
    adds, ``mode`` and ``t``.  Samples without a stored height are left out.

    With ``steps``: one row per change, ``layer_id, row, col, seq, x, z``, ``carry``, ``out`` and ``before, dh, after``.  Without:
    one row per touched sample, ``layer_id, row, col, h, changes`` and, for an integer output named by ``last``, ``code``: its last
    value that is not 0.
    """
    spark_types = dict(records.dtypes)
    numbers, carry = list(dict.fromkeys(numbers)), [n for n in carry if n not in ("layer_id", "row", "col", "seq", "x", "z")]
    kept = [part.strip().split(" ")[0] for part in out.split(",")] if out else []
    lists = [n for n, t in spark_types.items() if t.startswith("array")]
    wanted = list(dict.fromkeys(["layer_id", "_block", "seq", *numbers, *carry, *lists, "_r0", "_r1", "_c0", "_c1", "_lx", "_lz", "res", "width"]))
    base = rows.select("layer_id", F.floor(F.col("row") / block).alias("_block"), F.lit(0).cast("tinyint").alias("_tag"),
                       F.col("row").cast("long").alias("_row"), F.col("heights").alias("_stored"))
    both = base.unionByName(records.select(*wanted).withColumn("_tag", F.lit(1).cast("tinyint")), allowMissingColumns=True)
    dealt = both.repartition(task_count(records.sparkSession), "layer_id", "_block").sortWithinPartitions("layer_id", "_block", "_tag", "seq")

    if steps:
        schema = ", ".join(["layer_id string, row long, col int, seq long, x double, z double", *[f"{n} {spark_types[n]}" for n in carry],
                            *([out] if out else []), "before float, dh double, after float"])
    else:
        schema = "layer_id string, row long, col int, h float, changes long" + (", code int" if last else "")

    def run(batches):
        held = None  # key, width and arrays of the block that may go on in the next batch
        for batch in batches:
            if batch.num_rows == 0:
                continue
            name, number = batch.column("layer_id"), batch.column("_block").to_numpy()
            code = name.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = (code[1:] != code[:-1]) | (number[1:] != number[:-1])
            at_run, first = np.cumsum(new) - 1, np.flatnonzero(new)
            keys = [(name[int(i)].as_py(), int(number[i])) for i in first]
            tag = batch.column("_tag").to_numpy()
            stored, edit = np.flatnonzero(tag == 0), np.flatnonzero(tag == 1)
            cells = batch.column("_stored").take(pa.array(stored))
            size = np.diff(cells.offsets.to_numpy()) if len(stored) else np.zeros(0, dtype=np.int64)
            wide = max(int(size.max(initial=0)), held[1] if held else 0, 1)
            area = block * wide
            state = _Block(len(keys) * area)
            if len(stored):
                rec = np.repeat(stored, size)
                col = np.arange(len(rec)) - np.repeat(np.cumsum(size) - size, size)
                row = batch.column("_row").take(pa.array(stored)).to_numpy().astype(np.int64) - number[stored] * block
                spot = at_run[rec] * area + np.repeat(row, size) * wide + col
                flat = cells.flatten()
                there = flat.is_valid().to_numpy(zero_copy_only=False)
                state.there[spot] = there
                state.h[spot[there]] = flat.drop_null().to_numpy(zero_copy_only=False)
            if held and held[0] == keys[0]:
                state.take(held[2], block, held[1], wide, keep=~state.there[:area])
            elif held and not steps:
                yield from _final(held[0], held[2], held[1], block, last)
            if len(edit):
                yield from changes(batch, edit, at_run, number, state, wide, area)
            if not steps:
                for k in range(len(keys) - 1):
                    yield from _final(keys[k], state.cut(k * area, (k + 1) * area), wide, block, last)
            held = (keys[-1], wide, state.cut((len(keys) - 1) * area, len(keys) * area))
        if held and not steps:
            yield from _final(held[0], held[2], held[1], block, last)

    def changes(batch, edit, at_run, number, state, wide, area):
        """Fold the edits of one batch, in pieces that fit a core's cache."""
        get_column = lambda n: batch.column(n)
        columns = {n: get_column(n) for n in lists}
        arrays = {n: get_column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in numbers}
        long = lambda n: get_column(n).take(pa.array(edit)).to_numpy(zero_copy_only=False).astype(np.int64)
        double = lambda n: get_column(n).cast(pa.float64()).to_numpy(zero_copy_only=False)
        r0, r1, c0, c1 = (long(n) for n in ("_r0", "_r1", "_c0", "_c1"))
        lx, lz, res = double("_lx"), double("_lz"), double("res")
        across = c1 - c0 + 1
        size = across * (r1 - r0 + 1)
        piece = np.cumsum(size) >> PIECE_BITS
        for p in np.unique(piece):
            e = np.flatnonzero(piece == p)
            which = np.repeat(e, size[e])
            place = np.arange(len(which)) - np.repeat(np.cumsum(size[e]) - size[e], size[e])
            row, col = r0[which] + place // across[which], c0[which] + place % across[which]
            idx = edit[which]
            x, z = lx[idx] + col * res[idx], lz[idx] + row * res[idx]
            with np.errstate(all="ignore"):
                made = shape(_Inputs(arrays, columns, idx), x, z)
            spot = at_run[idx] * area + (row - number[idx] * block) * wide + col
            inside = col < wide
            use = np.flatnonzero(made["keep"] & inside & state.there[np.where(inside, spot, 0)])
            if len(use) == 0:
                continue
            # Stable by sample: records come in seq order, so changes of a sample stay in it.
            use = use[np.argsort(spot[use], kind="stable")]
            spot, w = spot[use], made["w"][use]
            mode = made["mode"][use] if "mode" in made else np.full(len(use), ADD, dtype=np.int8)
            t = np.nan_to_num(made["t"][use]) if "t" in made else np.zeros(len(use))
            before, delta, after = _fold_sorted(spot, state.h, mode, t, w)
            if not steps:
                state.count(spot)
                if last:
                    v = made[last][use]
                    state.mark(spot[v != 0], v[v != 0])
                continue
            idx = idx[use]
            take = pa.array(idx)
            cols = [batch.column("layer_id").take(take), pa.array(row[use]), pa.array(col[use].astype(np.int32)), batch.column("seq").take(take),
                    pa.array(x[use]), pa.array(z[use]), *[batch.column(n).take(take) for n in carry], *[pa.array(made[n][use]) for n in kept],
                    pa.array(before), pa.array(delta), pa.array(after)]
            yield pa.RecordBatch.from_arrays(cols, names=["layer_id", "row", "col", "seq", "x", "z", *carry, *kept, "before", "dh", "after"])

    return dealt.mapInArrow(run, schema)


class _Block:
    """Heights of blocks of rows with what is known of each sample: stored at all, number of changes, last class."""

    def __init__(self, n: int):
        self.h, self.there = np.zeros(n, np.float32), np.zeros(n, dtype=bool)
        self.n, self.code = np.zeros(n, np.int64), np.zeros(n, np.int32)

    def parts(self):
        return self.h, self.there, self.n, self.code

    def cut(self, a: int, b: int) -> _Block:
        out = _Block(0)
        out.h, out.there, out.n, out.code = (v[a:b].copy() for v in self.parts())
        return out

    def take(self, old: _Block, block: int, old_wide: int, wide: int, keep) -> None:
        """What an earlier batch left of the first block, for the samples whose row did not come just now."""
        grid = keep.reshape(block, wide)[:, :old_wide]
        for mine, theirs in zip(self.parts(), old.parts()):
            part = mine[:block * wide].reshape(block, wide)[:, :old_wide]
            part[grid] = theirs.reshape(block, old_wide)[grid]

    def count(self, spot) -> None:
        at, n = np.unique(spot, return_counts=True)
        self.n[at] += n

    def mark(self, spot, value) -> None:
        end = np.ones(len(spot), dtype=bool)
        end[:-1] = spot[1:] != spot[:-1]
        self.code[spot[end]] = value[end]


def _final(key, state: _Block, wide: int, block: int, last: str | None):
    at = np.flatnonzero(state.n)
    if len(at) == 0:
        return
    cols = [pa.array([key[0]] * len(at), pa.string()), pa.array(key[1] * block + at // wide), pa.array((at % wide).astype(np.int32)),
            pa.array(state.h[at]), pa.array(state.n[at])]
    names = ["layer_id", "row", "col", "h", "changes"]
    if last:
        cols, names = [*cols, pa.array(state.code[at], mask=state.code[at] == 0)], [*names, "code"]
    yield pa.RecordBatch.from_arrays(cols, names=names)


def _fold_sorted(spot, heights, mode, t, w):
    """Apply changes that are sorted by sample and, within it, in order; ``heights`` is brought up to date."""
    n = len(spot)
    first = np.ones(n, dtype=bool)
    first[1:] = spot[1:] != spot[:-1]
    starts = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    rank = np.arange(n) - starts[run]
    h = heights[spot[starts]]
    before, delta, after = np.empty(n, np.float32), np.empty(n, np.float64), np.empty(n, np.float32)
    order = np.argsort(rank, kind="stable")
    bounds = np.searchsorted(rank[order], np.arange(rank.max() + 2))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(len(bounds) - 1):
            at = order[bounds[k]:bounds[k + 1]]
            now = h[run[at]].astype(np.float64)
            gap, m = t[at] - now, mode[at]
            blend = np.where(((m == CUT) & ~(gap < 0)) | ((m == FILL) & ~(gap > 0)), 0.0, gap * w[at])
            dh = np.where(m == ADD, w[at], blend)
            new = (now + dh).astype(np.float32)
            before[at], delta[at], after[at] = now, dh, new
            h[run[at]] = new
    heights[spot[starts]] = h
    return before, delta, after
