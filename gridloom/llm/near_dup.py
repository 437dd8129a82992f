"""Operator 5, MinHash near-dedup with b-bit signatures, exact links and exact components.

1. Every text becomes a set of word-shingle hashes, 192 minima of it and one hash of the whole set.  Only the
   low 16 bits of each minimum are kept and packed, four minima to a long: 48 longs that are both the packed
   signature and the band keys.
2. Equal sets form a class; one document stands for each, so exact copies never meet each other again.
3. Documents that share a band key are candidates.  First each is compared with the smallest document of its
   bucket only: bit counts estimate the similarity, corrected for chance collisions, pairs clearly below the
   limit go, and the rest is decided on full sets.  These links already give nearly all components.
4. What remains are pairs inside a bucket that the components of these links do not connect.  A bucket's largest
   component are its hosts, everyone else is a guest; guests meet guests and hosts chunk by chunk (``block_rows``),
   signatures drop clear misses, and the others are decided on full sets.  Pairs already connected need no look, so a
   large group of near copies costs little more than its size, and no link that could join two groups is lost.

A pair at exactly the limit shares no band with probability (1 - 0.75^4)^48 = 1e-8; the estimate drops it with
3e-7 (five standard deviations).

Defined cases: texts without words have an empty set and stay alone; a null doc_id is never linked, has a null
component and is kept; every row is returned with the component of its own text, also where rows share a doc_id;
only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens
from gridloom.llm.common import written
from gridloom.llm.graph import components

BANDS, ROWS = 48, 4
HASHES = BANDS * ROWS
LANES = 2**-16  # chance that two different minima agree in their kept bits
BLOCK = 512
BROADCAST_IDS = 500_000
_RNG = np.random.default_rng(75)
_MUL = _RNG.integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)

c = F.col


def estimate_floor(percent: int) -> float:
    """Estimated similarity below which a pair at the limit falls by a five-sigma accident only."""
    p = percent / 100
    return p - 5 * (p * (1 - p) / HASHES) ** 0.5


def _minima(hashes: np.ndarray) -> np.ndarray:
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 256):
        part = low[a:a + 256, None] * _MUL
        part += _ADD
        np.minimum(out, part.min(axis=0), out=out)
    return out


def _shingle_sets(words: tokens.Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a shorter text is one shingle."""
    at, h = words.windows(size)
    bounds = np.searchsorted(words.row[at], np.arange(len(words.first)))
    for r in range(len(words.first) - 1):
        if bounds[r + 1] > bounds[r]:
            yield np.unique(h[bounds[r]:bounds[r + 1]])
        elif words.first[r + 1] > words.first[r]:
            a, b = words.first[r], words.first[r + 1]
            yield tokens.spans(words.hash[a:b], "word", np.array([0]), np.array([b - a])) * tokens.U(2 * (b - a) + 1)
        else:
            yield np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and the packed signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in tokens.pieces(batch.column("text"), "spaces"):
                n, key, sig = np.zeros(b - a, np.int64), np.zeros((2, b - a), np.uint64), np.zeros((b - a, HASHES), np.uint16)
                for r, s in enumerate(_shingle_sets(words, size)):
                    if len(s):
                        n[r], sig[r] = len(s), _minima(s).astype(np.uint16)
                        key[0, r] = np.sum(tokens.mix(s), dtype=np.uint64)
                        key[1, r] = np.sum(tokens.mix(s ^ tokens.U(0x5851F42D4C957F2D)), dtype=np.uint64)
                packed = _signed(sig).ravel() if b > a else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(packed))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(_signed(key[0])), pa.array(_signed(key[1])), lists],
                    names=["doc_id", "n_shingles", "k1", "k2", "sig"])

    return docs.select(c("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, k1 long, k2 long, sig array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc, n, shingles) of the documents in ``ids``; ids are broadcast only while their count is under the bound."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = docs.select(c("doc_id").cast("long").alias("doc"), "text").join(F.broadcast(ids) if few else ids, "doc", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in tokens.pieces(batch.column("text"), "spaces"):
                sets = list(_shingle_sets(words, size))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(sets))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(a, b - a), pa.array(np.diff(ends).astype(np.int64)), lists], names=["doc", "n", "shingles"])

    return chosen.mapInArrow(run, "doc long, n long, shingles array<long>")


def bit_estimate(a: Column, b: Column) -> Column:
    """Similarity from the packed signatures: 16-bit lanes that differ are counted by folding each onto one bit."""
    def differing(x, y):
        m = x.bitwiseXOR(y)
        for k in (8, 4, 2, 1):
            m = m.bitwiseOR(F.shiftrightunsigned(m, k))
        return F.bit_count(m.bitwiseAND(F.lit(0x0001000100010001)))

    equal = 1 - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda t, x: t + x) / F.lit(float(HASHES))
    return (equal - LANES) / (1 - LANES)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal ``keys`` from batches sorted by them; one group is held at a time."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not len(t):
            continue
        cols = [t[k].to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols], axis=0)) + 1
        edges = [0, *cut.tolist()]
        for a, b in zip(edges, edges[1:]):
            yield t.slice(a, b - a)
        rest = t.slice(edges[-1])
    if rest is not None and len(rest):
        yield rest


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column."""
    arr = column.combine_chunks()
    arr = arr.chunk(0) if isinstance(arr, pa.ChunkedArray) else arr
    off = arr.offsets.to_numpy()
    return arr.values.to_numpy(), off


def _open_pairs(floor: float, percent: int):
    """Candidate pairs of one pair of blocks: different components, sizes and estimates that allow the limit."""
    def run(batches):
        for g in runs_of(batches, ["key", "band", "i", "j"]):
            if len(g) < 2:
                continue
            label, doc, n, chunk = (g[k].to_numpy() for k in ("label", "doc", "n", "chunk"))
            if (label == label[0]).all():
                continue
            values, off = _lists(g["sig"])
            sig = values[off[0]:off[-1]].reshape(-1, BANDS)
            lanes, band = sig.view(np.uint16), g["band"][0].as_py()
            i, j = g["i"][0].as_py(), g["j"][0].as_py()
            left = np.flatnonzero(chunk == i)
            found: dict[int, list[int]] = {}
            for q in left:
                other = np.flatnonzero((chunk == j) & (label != label[q]) & (100 * np.minimum(n, n[q]) >= percent * np.maximum(n, n[q]))
                                       & ((np.arange(len(doc)) > q) | (i != j)) & (doc != doc[q]))
                if not len(other):
                    continue
                equal = (lanes[other] == lanes[q]).mean(axis=1)
                other = other[(equal - LANES) / (1 - LANES) >= floor]
                if len(other):
                    # A pair that meets in several bands is looked at in the first of them.
                    other = other[(sig[other] == sig[q]).argmax(axis=1) == band]
                if len(other):
                    found.setdefault(int(q), []).extend(doc[other].tolist())
                    for o in other.tolist():
                        found.setdefault(o, [])
            if found:
                m = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[k][0].as_py()] * m, t) for k, t in (("key", pa.int64()), ("band", pa.int32()), ("i", pa.int32()), ("j", pa.int32()))]
                    + [pa.array([int(doc[q]) for q in found], pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))],
                    names=["key", "band", "i", "j", "doc", "partners"])

    return run


def _decided(percent: int):
    """Links among the candidates of one pair of blocks, from full sets."""
    def run(batches):
        for g in runs_of(batches, ["key", "band", "i", "j"]):
            doc = g["doc"].to_numpy()
            values, off = _lists(g["shingles"])
            sets: dict[int, list[np.ndarray]] = {}
            for r, d in enumerate(doc.tolist()):
                sets.setdefault(d, []).append(values[off[r]:off[r + 1]].view(np.uint64))
            links = set()
            for d, partners in zip(doc.tolist(), g["partners"].to_pylist()):
                for p in partners:
                    for x in sets[d]:
                        for y in sets.get(p, ()):
                            both = len(np.intersect1d(x, y, assume_unique=True))
                            if 100 * both >= percent * (len(x) + len(y) - both):
                                links.add((d, p))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def block_rows(labelled: DataFrame) -> DataFrame:
    """Rows (key, band, i, j, chunk, ...) that bring members of a bucket with different labels together.

    ``labelled`` has band, key, doc, label and what a comparison needs.  The members with a bucket's most common label
    are its hosts and never meet each other; the others are guests.  Both are cut into chunks of about ``BLOCK``, and a
    chunk of guests meets every chunk, so a bucket sends hosts x guest chunks + guests x chunks rows: its own size
    while the guests fit one chunk.
    """
    labelled = labelled.repartition("band", "key")
    labels = labelled.groupBy("band", "key", "label").agg(F.count("*").alias("_n"))
    # Larger labels first, then smaller ones: the choice only decides who is a host.
    mixed = labels.groupBy("band", "key").agg(
        F.max(F.struct("_n", (-c("label")).alias("_less"))).alias("_top"), F.sum("_n").alias("_all"), F.count("*").alias("_labels")).where("_labels > 1")
    mixed = mixed.select("band", "key", (-c("_top._less")).alias("_host"), F.ceil(c("_top._n") / BLOCK).cast("int").alias("_h"),
                         F.ceil((c("_all") - c("_top._n")) / BLOCK).cast("int").alias("_g"))
    host = c("label") == c("_host")
    place = F.when(host, c("_g") + F.pmod(F.hash("doc"), c("_h"))).otherwise(F.pmod(F.hash("doc"), c("_g")))
    meets = F.when(host, c("_g")).otherwise(c("_g") + c("_h"))
    spread = labelled.join(mixed, ["band", "key"]).withColumn("chunk", place).withColumn("_o", F.explode(F.sequence(F.lit(0), meets - 1)))
    return spread.withColumns({"i": F.least("chunk", "_o"), "j": F.greatest("chunk", "_o")}).drop("_host", "_h", "_g", "_o")


def links(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the class representatives ``nodes`` (doc, n, sig) that have a link."""
    floor = estimate_floor(percent)
    sig = nodes.select("doc", "n", "sig")
    # One exchange serves the counting and the join; a bucket's rows only stream through both.
    bands = nodes.select("doc", F.posexplode("sig").alias("band", "key")).repartition("band", "key")
    buckets = bands.groupBy("band", "key").agg(F.min("doc").alias("first"), F.count("*").alias("size")).where("size > 1")
    members = written(bands.join(buckets, ["band", "key"]), "members")

    stars = members.where("doc <> first").select(c("doc").alias("u"), c("first").alias("v")).distinct()
    near = stars.join(sig.select(c("doc").alias("u"), c("n").alias("nu"), c("sig").alias("su")), "u").join(
        sig.select(c("doc").alias("v"), c("n").alias("nv"), c("sig").alias("sv")), "v").where(
        (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")) & (bit_estimate(c("su"), c("sv")) >= floor))
    near = written(near.select("u", "v"), "stars")
    ids = near.select(F.explode(F.array("u", "v")).alias("doc")).distinct()
    sets = written(full_sets(docs, ids, size), "sets")
    both = F.size(F.array_intersect("su", "sv"))
    first = near.join(sets.select(c("doc").alias("u"), c("n").alias("nu"), c("shingles").alias("su")), "u").join(
        sets.select(c("doc").alias("v"), c("n").alias("nv"), c("shingles").alias("sv")), "v").where(
        100 * both >= percent * (c("nu") + c("nv") - both)).select("u", "v")
    first = written(first, "first")

    # Exact components of the star links: only documents that they leave apart still have to meet.
    joined = written(components(first), "joined")
    labelled = members.select("band", "key", "doc").join(joined.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
        "label", F.coalesce("component", "doc")).drop("component")
    labelled = written(labelled, "labelled")
    block = ["key", "band", "i", "j"]
    # A signature is looked up once per member of a mixed bucket, before its rows are dealt to chunks.
    open_buckets = labelled.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band", "key")
    opened = labelled.join(open_buckets, ["band", "key"], "left_semi").join(sig, "doc")
    asked = block_rows(opened).select(*block, "chunk", "doc", "label", "n", "sig").repartition(*block).sortWithinPartitions(*block).mapInArrow(
        _open_pairs(floor, percent), "key long, band int, i int, j int, doc long, partners array<long>")
    asked = written(asked, "asked")
    more = full_sets(docs, asked.select("doc").distinct(), size)
    second = asked.join(more, "doc").repartition(*block).sortWithinPartitions(*block).mapInArrow(_decided(percent), "u long, v long")
    return components(joined.where("node <> component").select(c("node").alias("u"), c("component").alias("v")).union(second))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    sketch = written(sketches(docs, size), "sketch")
    known = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets have equal signatures; copies meet in the map-side step first.
    nodes = written(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "nodes")
    linked = links(docs, nodes, size, percent)
    named = nodes.select("k1", "k2", "doc").join(linked, c("doc") == c("node"), "left").select(
        "k1", "k2", F.coalesce("component", "doc").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(c("n_shingles") > 0, c("component_id")).otherwise(c("doc_id"))
    component = F.when(c("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(c("doc_id") == c("component_id"), F.lit(True)))
