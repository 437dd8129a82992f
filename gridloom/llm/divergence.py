"""Operator 11, audit of how far the sources of a language differ in their words.

1. Terms are cut by a translate table: one ``bytes.translate`` lowers letters and blanks separators, ``bytes.split``
   cuts, and a Counter per document gives a term's occurrences there and that the document holds it.  A task adds
   Counters up per (lang, source) until they reach ``ENTRIES``, so few rows leave it even for a hot source.
2. Cells (lang, source, term) meet by (lang, term); a term with too few documents in its lang goes there.
3. Shares are whole numbers, exact in decimals.  A source's share of a term it lacks is the same for all such terms, so
   the distance of two sources is that of two sources without terms, corrected by the terms that either has (from a
   histogram of each source's shares) and by those that both have (added up inside tasks, term by term).

Defined cases: null text, lang or source count as ''; doc_id is not read, so each repeated row is a document of its
own; a lang without kept terms gives pairs with value 0 and no term rows; a lang with one source has no pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import written

SCALE = 1_000_000_000
PRIOR = 5
ENTRIES = 1 << 18
SOURCES = 2048  # sources whose pair sums a task holds at once before it sends them on
CELLS = 1 << 20

#: Lowers A-Z, keeps a-z and every byte of a character beyond ASCII, blanks the rest.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

c = F.col


def _terms(text: str | None) -> Counter:
    return Counter((text or "").encode().translate(TABLE).split())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, docs) in cells.items():
            if uses:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(uses)), pa.array([source] * len(uses)), pa.array(list(uses), pa.binary()).cast(pa.string()),
                     pa.array(list(uses.values()), pa.int64()), pa.array([docs[t] for t in uses], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
        cells.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(x).to_pylist() for x in ("lang", "source", "text"))):
            found = _terms(text)
            uses, docs = cells.setdefault((lang, source), (Counter(), Counter()))
            before = len(uses)
            uses.update(found)
            docs.update(found.keys())
            held += len(uses) - before
            if held > ENTRIES:
                yield from flush()
                held = 0
    yield from flush()


def term_cells(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, lang_n, first): occurrences of every kept term in each source and in its lang; first marks one row a term."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text").mapInArrow(
        _counted, "lang string, source string, term string, n long, docs long")
    # One exchange by term serves the sums per source and the window over sources.
    cells = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return cells.withColumns({
        "lang_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "first": (c("source") == F.min("source").over(term)).cast("int"),
    }).where(c("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n", "first")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)); the product may pass 64 bits."""
    wide = "decimal(20,0)"
    below = total.cast(wide) + terms.cast(wide) * PRIOR
    return F.when(terms > 0, 1 + F.call_function("div", F.lit(SCALE).cast(wide) * (count.cast(wide) + PRIOR).cast(wide), below))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of sources: what the terms that both have change against counting each source's terms alone."""
    place: dict[str, int] = {}
    base = np.zeros(0, np.int64)
    sums = np.zeros((0, 0), np.int64)
    now: str | None = None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal base, sums
        names = list(place)
        i, j = np.nonzero(sums)
        if len(i):
            yield pa.RecordBatch.from_arrays(
                [pa.array([now] * len(i), pa.string()), pa.array([names[x] for x in i]), pa.array([names[x] for x in j]), pa.array(sums[i, j])],
                names=["lang", "source", "item", "value"])
        place.clear()
        base, sums = np.zeros(0, np.int64), np.zeros((0, 0), np.int64)

    def add(lang: str, sources: list[str], p0: np.ndarray, p: np.ndarray, term: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal base, sums, now
        if lang != now or len(place) > SOURCES:
            yield from flush()
            now = lang
        for s, x in zip(sources, p0.tolist()):
            if s not in place:
                place[s] = len(place)
                base = np.append(base, x)
        size = len(place)
        if len(sums) < size:
            sums = np.pad(sums, (0, size - len(sums)))
        at = np.array([place[s] for s in sources])
        # A term that a source lacks stands at the source's base, where its correction is 0.
        grid = np.tile(base, (int(term[-1]) + 1, 1))
        grid[term, at] = p
        alone = np.abs(grid[:, :, None] - base).sum(axis=0) if grid.size * size <= CELLS else np.stack([np.abs(grid - x).sum(axis=0) for x in base], axis=1)
        for i in range(size):
            both = np.abs(grid - grid[:, i:i + 1]).sum(axis=0)
            sums[i] += both - alone[i] - alone[:, i] + len(grid) * np.abs(base[i] - base)

    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not len(t):
            continue
        lang, term = t["lang"].to_pylist(), t["term"].to_pylist()
        new = np.array([True] + [lang[i] != lang[i - 1] or term[i] != term[i - 1] for i in range(1, len(lang))])
        last = int(np.flatnonzero(new)[-1])
        yield from _pieces(t, lang, new, last, add)
        rest = t.slice(last)
    if rest is not None and len(rest):
        lang = rest["lang"].to_pylist()
        yield from _pieces(rest, lang, np.array([True] + [False] * (len(lang) - 1)), len(lang), add)
    yield from flush()


def _pieces(t: pa.Table, lang: list[str], new: np.ndarray, end: int, add) -> Iterator[pa.RecordBatch]:
    """Hand whole terms of one lang to ``add``, few enough that a grid of terms by sources stays small."""
    source, p0, p = t["source"].to_pylist(), t["p0"].to_numpy(), t["p"].to_numpy()
    starts = np.flatnonzero(new[:end]).tolist() + [end]
    a = 0
    while a < len(starts) - 1:
        b, seen = a, set()
        while b < len(starts) - 1 and lang[starts[b]] == lang[starts[a]]:
            more = seen | set(source[starts[b]:starts[b + 1]])
            if b > a and (b + 1 - a) * len(more) > CELLS:
                break
            seen, b = more, b + 1
        lo, hi = starts[a], starts[b]
        yield from add(lang[lo], source[lo:hi], p0[lo:hi], p[lo:hi], np.cumsum(new[lo:hi]) - 1)
        a = b


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: distances of the sources of a lang, and each source's ``top`` terms above its lang."""
    cells = written(term_cells(docs, least), "cells")
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    langs = cells.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    zero = F.lit(0).cast("long")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *(F.coalesce(x, zero).alias(x) for x in ("total", "own", "terms", "lang_total")))
    groups = written(groups.withColumn("p0", F.coalesce(share(zero, c("total"), c("terms")), zero)), "groups")

    shares = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", share(c("n"), c("total"), c("terms")).alias("p"), share(c("lang_n"), c("lang_total"), c("terms")).alias("q"))
    shares = written(shares, "shares")

    ranked = Window.partitionBy("lang", "source").orderBy(c("value").desc(), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), c("term").alias("item"), (c("p") - c("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(c("rank") <= top)

    # What a source's own terms add against each other source; terms with one share are counted together.
    other = groups.select("lang", c("source").alias("item"), c("p0").alias("q0"), c("own").alias("item_own"))
    marks = shares.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("k"))
    alone = marks.join(other.select("lang", "item", "q0"), "lang").where("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(c("k") * (F.abs(c("p") - c("q0")) - F.abs(c("p0") - c("q0")))).alias("value"))
    common = shares.select("lang", "term", "source", "p0", "p").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(
        _common, "lang string, source string, item string, value long")
    bare = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", (c("terms") * F.abs(c("p0") - c("q0"))).alias("value"))
    pairs = bare.unionByName(alone).unionByName(alone.select("lang", c("item").alias("source"), c("source").alias("item"), "value")).unionByName(
        common.where("source <> item")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)
