"""Operator 13, phrase collocations from count streams kept in prefix and in suffix order.

1. Texts are cut into blocks of bounded size.  Each block sorts its word windows (up to four words from every
   position within a piece), sums equal ones and sends them, packed by range of the window order, to one task per
   range.  One window per position is all that travels: in prefix order the counts of its first one, two, three
   and four words are sums over neighbours.
2. A range merges the sorted blocks, sums the runs and keeps what reaches ``least``.  Phrases cut by a range border
   are sent as parts and added up.  The borders come from a small sample and only balance the work.
3. The count stream is sorted by reversed words (suffix order) and walked once: the counts of a phrase's last words
   stand just before it, and its left extensions just behind it.  Then the same rows are sorted by words (prefix order)
   and walked once for first words and right extensions.  A walk holds a stack of at most four phrases; what a
   partition border cuts off is at most three phrases a partition, so these travel as a small table.

A longer candidate that contains a phrase is nowhere more frequent than the one-word extension between them, which
then is a candidate too; so one-word extensions decide what is dropped.

Defined cases: a null text has no words; a null lang counts as ``und``; doc_id is not read, so repeated rows count as
often as they occur; a text of any length is one block; without candidates the result is empty.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import written

ORDER = 4
BLOCK_BYTES = 4 << 20
RANGE_WINDOWS = 2_000_000
SAMPLE_DOCS, SAMPLE_STEP = 4_000, 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2

c = F.col


def _ranks(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in byte order, and the place of each word among them, from 1."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.zeros(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


class _Windows:
    """Distinct windows in order with their counts: columns lang, w1 to w4 are places in ``langs`` and ``words``, 0 past the end."""

    def __init__(self, langs: pa.Array, words: pa.Array, columns: list[np.ndarray], counts: np.ndarray | None = None):
        self.langs, self.words = langs, words
        size = np.int64(len(words) + 1)
        heads, head = np.unique((columns[0] * size + columns[1]) * size + columns[2], return_inverse=True)
        tails, tail = columns[3] * size + columns[4], None
        wide = size * size
        if len(heads) * int(wide) >= 2**63:
            tail, tails = np.unique(tails, return_inverse=True)
            wide = np.int64(len(tail) + 1)
        keys = head * wide + tails
        if counts is None:
            keys, self.counts = np.unique(keys, return_counts=True)
        else:
            order = np.argsort(keys)
            keys = keys[order]
            cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            keys, self.counts = keys[cut], np.add.reduceat(counts[order], cut) if len(cut) else counts
        head, tails = heads[keys // wide], keys % wide
        tails = tails if tail is None else tail[tails]
        self.columns = [head // (size * size), head // size % size, head % size, tails // size, tails % size]

    def __len__(self) -> int:
        return len(self.counts)

    def key(self, i: int, n: int = ORDER) -> tuple[bytes, ...]:
        """Lang and words of window i; past the end of its piece the words are empty."""
        places = [int(x[i]) for x in self.columns[1:n + 1]]
        return (self.langs[int(self.columns[0][i]) - 1].as_py(), *(self.words[p - 1].as_py() if p else b"" for p in places))

    def packed(self, a: int, b: int) -> tuple[bytes, bytes, bytes]:
        """Windows a to b with only the words they use."""
        used = np.zeros(len(self.words) + 1, bool)
        for x in self.columns[1:]:
            used[x[a:b]] = True
        used[0] = False
        places = np.flatnonzero(used)
        code = np.zeros(len(used), np.uint32)
        code[places] = np.arange(1, len(places) + 1)
        table = np.stack([self.columns[0][a:b].astype(np.uint32), *(code[x[a:b]] for x in self.columns[1:]), self.counts[a:b].astype(np.uint32)])
        table = table.astype(np.uint16) if table.max() < 2**16 else table
        pack = zstandard.ZstdCompressor(level=1).compress
        words = b"\n".join(self.words.take(pa.array(places - 1)).to_pylist())
        return b"\n".join(self.langs.to_pylist()), pack(words), bytes([table.itemsize]) + pack(table.tobytes())


def _escaped(lang: str | None) -> bytes:
    return ("und" if lang is None else lang).replace("\\", "\\b").replace("\n", "\\n").encode()


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a batch: langs, distinct words, lang of every word, word places, piece of every word."""
    texts = batch.column("text").cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1 + texts.offset)[texts.offset:]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    langs, lang = _ranks(pa.array([_escaped(x) for x in batch.column("lang").to_pylist()], pa.binary()))
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + BLOCK_BYTES, "right")) - 1)
        body, bounds = _LOWER[data[off[a]:off[b]]], off[a:b + 1] - off[a]
        kind = _KIND[body]
        inside = kind == 0
        first = np.zeros(len(body) + 1, bool)
        first[bounds] = True
        start = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]]))) if len(body) else np.zeros(0, np.int64)
        end = np.flatnonzero(inside & (first[1:] | ~np.concatenate([inside[1:], [False]]))) + 1 if len(body) else start
        row = np.searchsorted(bounds, start, "right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int32)[start] + row
        ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        words, places = _ranks(pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(body[inside])]))
        yield langs, words, lang[a + row], places, piece
        a = b


def _columns(lang: np.ndarray, places: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
    out = [lang, places]
    for k in range(1, ORDER):
        ahead = np.zeros(len(places), np.int64)
        if len(places) > k:
            ahead[:-k] = np.where(piece[k:] == piece[:-k], places[k:], 0)
        out.append(ahead)
    return out


def _borders(docs: DataFrame, least_ranges: int) -> list[tuple[bytes, ...]]:
    """Window keys that cut the window order into ranges of about equal work, from a bounded sample of documents."""
    def pick(batches):
        for batch in batches:
            for langs, words, lang, places, piece in _parts(batch):
                at = slice(0, None, SAMPLE_STEP)
                columns = [x[at] for x in _columns(lang, places, piece)]
                keys = [b"\n".join([langs[int(x[0]) - 1].as_py(), *(words[int(p) - 1].as_py() if p else b"" for p in x[1:])]) for x in zip(*columns)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    rows = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    sample = docs if share == 1 else docs.sample(fraction=share, seed=13)
    keys = sorted(tuple(bytes(r[0]).split(b"\n")) for r in sample.mapInArrow(pick, "key binary").collect())
    windows = len(keys) * SAMPLE_STEP / share
    ranges = max(least_ranges, int(windows / RANGE_WINDOWS) + 1)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _blocks(borders: list[tuple[bytes, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, words, lang, places, piece in _parts(batch):
                w = _Windows(langs, words, _columns(lang, places, piece))
                cuts = [0]
                for border in borders:
                    cuts.append(bisect.bisect_left(range(len(w)), border, lo=cuts[-1], key=w.key))
                cuts.append(len(w))
                for r, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *(pa.array([x], pa.binary()) for x in w.packed(a, b))],
                                                         names=["range", "langs", "words", "codes"])

    return run


def _merged(least: int):
    """Counts of all orders in one range; those at its two ends may continue in other ranges and always go on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, words, tables = [], [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                kind = np.uint16 if row["codes"][0] == 2 else np.uint32
                tables.append(np.frombuffer(unpack(row["codes"][1:]), kind).reshape(ORDER + 2, -1))
                langs.append(row["langs"].split(b"\n"))
                words.append(unpack(row["words"]).split(b"\n"))
        if not tables:
            return
        lang_names, lang_place = _ranks(pa.array([x for part in langs for x in part], pa.binary()))
        names, place = _ranks(pa.array([x for part in words for x in part], pa.large_binary()))
        columns: list[list[np.ndarray]] = [[] for _ in range(ORDER + 2)]
        at_lang = at_word = 0
        for part_langs, part_words, table in zip(langs, words, tables):
            own = np.concatenate([[0], place[at_word:at_word + len(part_words)]])
            columns[0].append(lang_place[at_lang:at_lang + len(part_langs)][table[0].astype(np.int64) - 1])
            for k in range(1, ORDER + 1):
                columns[k].append(own[table[k]])
            columns[ORDER + 1].append(table[ORDER + 1].astype(np.int64))
            at_lang, at_word = at_lang + len(part_langs), at_word + len(part_words)
        *keys, counts = [np.concatenate(x) for x in columns]
        del tables, words, columns
        w = _Windows(lang_names, names, keys, counts)
        new = np.zeros(len(w), bool)
        new[0] = True
        for k in range(ORDER + 1):
            new[1:] |= w.columns[k][1:] != w.columns[k][:-1]
            start = np.flatnonzero(new)
            f = np.add.reduceat(w.counts, start)
            keep = f >= (least if k else 0)
            keep[[0, -1]] = True
            if k:
                keep &= w.columns[k][start] > 0
            chosen = np.flatnonzero(keep)
            texts = [b"\n".join(w.key(int(i), k)) + b"\n" for i in start[chosen]]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(f[chosen], pa.int64())], names=["key", "f"])

    return run


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """(key, f): lang and one to four words, each closed by a line feed, with their count from ``least`` on; a lang alone has all its words."""
    spark = docs.sparkSession
    texts = docs.select("lang", "text")
    borders = _borders(texts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = texts.mapInArrow(_blocks(borders), "range int, langs binary, words binary, codes binary")
    parts = blocks.repartitionById(len(borders) + 1, c("range")).mapInArrow(_merged(least), "key string, f long")
    # Only phrases cut by a range border have more than one part.
    return parts.groupBy("key").agg(F.sum("f").alias("f")).where((c("f") >= least) | (_words("key") == 0))


def _words(key: str) -> Column:
    return F.size(F.split(key, "\n")) - 2


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: the counts of a row's own beginnings, and the largest count one word further on."""
    open_rows: list[list] = []  # at, f, more, counts of the beginnings, largest extension
    out: list[tuple] = []
    late: dict[str, int] = {}

    def close():
        at, f, more, counts, longer = open_rows.pop()
        out.append((0, at, f, more, *(counts + [None] * 3)[:3], longer))

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ("kind", "at", "f", "more", "c1", "c2", "c3", "longer")
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=list(names))

    for batch in batches:
        for at, f, more in zip(*(batch.column(x).to_pylist() for x in ("at", "f", "more"))):
            while open_rows and not at.startswith(open_rows[-1][0]):
                close()
            words = at.count("\n") - 1
            counts = [None] * (words - 1)
            for row in open_rows:
                counts[row[0].count("\n") - 2] = row[1]
            if words > 1:
                parent = at[:at.rindex("\n", 0, -1) + 1]
                if open_rows and open_rows[-1][0] == parent:
                    open_rows[-1][4] = max(open_rows[-1][4], f)
                else:
                    late[parent] = max(late.get(parent, 0), f)
            open_rows.append([at, f, more, counts, 0])
        if out:
            yield batch_of()
            out.clear()
    out.extend((1, row[0], row[1], None, None, None, None, None) for row in open_rows)
    out.extend((2, parent, f, None, None, None, None, None) for parent, f in late.items())
    while open_rows:
        close()
    if out:
        yield batch_of()


def lockstep(stream: DataFrame) -> DataFrame:
    """(at, f, more) with c1 to c3, the counts of its first one to three words, and longer, the largest count with one word behind it.

    A partition sends the rows still open at its end, and extensions whose phrase stands in an earlier partition: at
    most ``ORDER`` of each, so both tables are bounded by the number of partitions and are broadcast.
    """
    walked = written(stream.repartitionByRange("at").sortWithinPartitions("at").mapInArrow(
        _walk, "kind int, at string, f long, more array<long>, c1 long, c2 long, c3 long, longer long"), "walked")
    rows = walked.where("kind = 0").drop("kind")
    ends = walked.where("kind = 1")
    for k in (1, 2, 3):
        end = ends.select(c("at").alias("_at"), c("f").alias("_f"))
        begin = F.when(c(f"c{k}").isNull() & (_words("at") > k), F.concat(F.substring_index("at", "\n", k + 1), F.lit("\n")))
        rows = rows.join(F.broadcast(end), begin == c("_at"), "left").withColumn(f"c{k}", F.coalesce(f"c{k}", "_f")).drop("_at", "_f")
    late = walked.where("kind = 2").groupBy(c("at").alias("_at")).agg(F.max("f").alias("_f"))
    return rows.join(F.broadcast(late), c("at") == c("_at"), "left").withColumn(
        "longer", F.greatest("longer", F.coalesce("_f", F.lit(0)))).drop("_at", "_f")


def _turned(key: str) -> Column:
    """The key with its words in reverse."""
    parts = F.split(key, "\n")
    return F.concat(parts[0], F.lit("\n"), F.array_join(F.reverse(F.slice(parts, 2, F.size(parts) - 2)), "\n"), F.lit("\n"))


def phrases(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, and the cut k, of each lang's first ``top`` collocations of 2 to 4 words."""
    counts = written(phrase_counts(docs, least), "counts")
    totals = counts.where(_words("key") == 0).select(F.substring_index("key", "\n", 1).alias("_lang"), c("f").alias("n"))
    stream = counts.where(_words("key") > 0)
    suffix = lockstep(stream.select(_turned("key").alias("at"), "f", F.array().cast("array<long>").alias("more")))
    prefix = lockstep(suffix.select(_turned("at").alias("at"), "f", F.array("c1", "c2", "c3", "longer").alias("more")))
    m = _words("at")

    def cut(k):
        l, r = c(f"c{k}"), F.element_at("more", F.when(m > k, m - k).otherwise(1))
        # Integer division of decimals: the product may pass 64 bits.
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(20,0)") * c("f").cast("decimal(20,0)"), (l + r).cast("decimal(20,0)"))
        return F.when(m > k, F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))

    best = prefix.where(m > 1).select(
        F.substring_index("at", "\n", 1).alias("_lang"),
        F.array_join(F.slice(F.split("at", "\n"), 2, m), " ").alias("phrase"), c("f").alias("a"),
        F.greatest("longer", F.element_at("more", 4)).alias("longer"),
        F.array_min(F.array_compact(F.array(*(cut(k) for k in (1, 2, 3))))).alias("cut"))
    kept = best.where(c("longer").cast("decimal(20,0)") * 100 < c("a").cast("decimal(20,0)") * percent)
    order = Window.partitionBy("_lang").orderBy(c("score").desc(), c("a").desc(), "phrase")
    ranked = kept.select("_lang", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(order)).where(c("rank") <= top)
    lang = F.replace(F.replace(c("_lang"), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))
    return ranked.join(totals, "_lang").select(lang.alias("lang"), c("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "k")

