"""Operator 2, line dedup by winnowing.

Lines (split at ``\\n``) are compared by their words, lower-cased in A-Z; lines without words do not count.  A
run of consecutive lines with ``min_words`` words or more that also occurs earlier, in document order
(doc_id, then line), is deleted from the later place.

1. Winnowing: every shortest run of lines that reaches ``min_words`` is a window; the line with the smallest
   hash in it is selected.  Equal windows select the same line, so any repeated run of ``min_words`` words leaves
   at least one equal fingerprint at the same offset in both places.
2. Fingerprints that occur once are dropped.  Only their counts are shuffled.
3. The positions left are joined with their documents' line hashes and every match is extended both ways to
   the runs around it that just reach ``min_words`` when grown to the right or to the left.  Each line of a longer
   repeated run lies in one of these, so whole runs are found from pieces of bounded length, and pieces of
   equal content are compared through their hash instead of pair by pair.
4. The first place of each piece stays, all later ones are deleted.  A passage shared by a third of all
   documents costs one row per occurrence.

Defined cases: null and empty texts stay; a document without a word left becomes '' (``dedup_documents``
drops it); rows of one doc_id with different texts are ordered by text hash; exact repeats of a row count
as one document; a null doc_id sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens
from gridloom.llm.common import written

MIN_WORDS = 30
_WORD = re.compile(r"[^\x20\x09-\x0D]")
c = F.col


def _lines(words: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, line number, number of words and hash of every line with a word."""
    breaks = np.flatnonzero(words.data == 10)
    in_piece = np.searchsorted(breaks, words.start)
    before_row = np.searchsorted(breaks, words.row_bytes[:-1])
    number = in_piece - before_row[words.row]
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (words.row[1:] != words.row[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(number))
    h = tokens.spans(words.hash, "word", first, end) * tokens.U(2) + (end - first).astype(np.uint64)
    return words.row[first], number[first], end - first, tokens.mix(h)


def runs_right(n_words: np.ndarray, min_words: int) -> np.ndarray:
    """End of the shortest run from each line on that reaches ``min_words``; 0 where there is none."""
    total = np.concatenate([[0], np.cumsum(n_words)])
    end = np.searchsorted(total, total[:-1] + min_words, "left")
    return np.where(end <= len(n_words), end, 0)


def runs_left(n_words: np.ndarray, min_words: int) -> np.ndarray:
    """Start of the shortest run up to each line that reaches ``min_words``; -1 where there is none."""
    total = np.concatenate([[0], np.cumsum(n_words)])
    return np.searchsorted(total, total[1:] - min_words, "right") - 1


def winnow(hashes: np.ndarray, n_words: np.ndarray, min_words: int) -> np.ndarray:
    """Positions of the window minima; the rightmost of equal minima is selected."""
    end = runs_right(n_words, min_words)
    picked, queue, upto = set(), [], 0
    for a in range(len(hashes)):
        if not end[a]:
            break
        while upto < end[a]:
            while queue and hashes[queue[-1]] >= hashes[upto]:
                queue.pop()
            queue.append(upto)
            upto += 1
        while queue[0] < a:
            queue.pop(0)
        picked.add(queue[0])
    return np.array(sorted(picked), np.int64)


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """Per distinct document: key, line numbers, word counts and hashes of its lines, and selected positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in tokens.pieces(batch.column("text"), "spaces"):
                row, number, count, h = _lines(words)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                keep = np.flatnonzero(np.bincount(row, weights=count, minlength=b - a) >= min_words)
                picked = [winnow(h[bounds[r]:bounds[r + 1]], count[bounds[r]:bounds[r + 1]], min_words) for r in keep]
                lists = lambda parts, t: pa.array([p.tolist() for p in parts], pa.list_(t))
                cut = lambda x: [x[bounds[r]:bounds[r + 1]] for r in keep]
                rows = pa.array(keep + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("th").take(rows), lists(cut(number), pa.int32()),
                     lists(cut(count), pa.int32()), lists(cut(h.view(np.int64)), pa.int64()), lists(picked, pa.int32()),
                     lists([x[p] for x, p in zip(cut(h.view(np.int64)), picked)], pa.int64())],
                    names=["doc_id", "th", "number", "n_words", "hash", "picked", "prints"])

    return docs.mapInArrow(run, "doc_id long, th long, number array<int>, n_words array<int>, hash array<long>, "
                                "picked array<int>, prints array<long>")


def _extend(min_words: int):
    """Pieces around repeated fingerprints: the shortest runs to the right and to the left that contain one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], [], []]
            for r in range(batch.num_rows):
                count, h = (np.asarray(batch.column(k)[r].values) for k in ("n_words", "hash"))
                number = np.asarray(batch.column("number")[r].values)
                at = np.sort(np.asarray(batch.column("repeated")[r].values))
                right, left = runs_right(count, min_words), runs_left(count, min_words)
                index = np.arange(len(count))
                s = np.concatenate([index[right > 0], left[left >= 0]])
                e = np.concatenate([right[right > 0], index[left >= 0] + 1])
                has = np.searchsorted(at, e) > np.searchsorted(at, s)
                pairs = np.unique(np.stack([s[has], e[has]], 1), axis=0)
                s, e = pairs[:, 0], pairs[:, 1]
                key = tokens.spans(h.view(np.uint64), "word", s, e) * tokens.U(2) + (e - s).astype(np.uint64)
                out[0] += [batch.column("doc_id")[r].as_py()] * len(s)
                out[1] += [batch.column("th")[r].as_py()] * len(s)
                out[2] += number[s].tolist()
                out[3] += number[e - 1].tolist()
                out[4] += tokens.mix(key).view(np.int64).tolist()
                out[5] += [int(x) for x in np.diff(np.concatenate([[0], np.cumsum(count)])[np.stack([s, e])], axis=0)[0]] if len(s) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))],
                names=["doc_id", "th", "a", "b", "piece", "words"])

    return run


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, removed): line numbers to delete per document key; only documents that lose a line."""
    keyed = docs.select(c("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    lines = written(line_table(keyed, min_words).dropDuplicates(["doc_id", "th"]), "lines")
    prints = lines.select("doc_id", "th", F.explode(F.arrays_zip("picked", "prints")).alias("p")).select(
        "doc_id", "th", c("p.picked").alias("at"), c("p.prints").alias("print"))
    twice = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    spots = prints.join(twice, "print", "left_semi").groupBy("doc_id", "th").agg(F.collect_list("at").alias("repeated"))
    on = [c("l.doc_id").eqNullSafe(c("s.doc_id")), c("l.th") == c("s.th")]
    pieces = lines.alias("l").join(spots.alias("s"), on).select("l.doc_id", "l.th", "number", "n_words", "hash", "repeated").mapInArrow(
        _extend(min_words), "doc_id long, th long, a int, b int, piece long, words int")
    pieces = written(pieces, "pieces")
    place = F.struct("doc_id", "th", "a", "b")
    first = pieces.groupBy("piece", "words").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = pieces.join(first, ["piece", "words"]).where(place > c("first"))
    return later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("runs"))


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines of their runs; blank lines stay."""
    for batch in batches:
        n_lines, n_cut, ranges, texts = [], [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            lines = text.split("\n") if text is not None else []
            cut = np.zeros(len(lines) + 1, np.int8)
            for run in runs or ():
                cut[run["a"]:run["b"] + 1] = 1
            if runs:
                cut[:-1] &= np.array([bool(_WORD.search(x)) for x in lines], np.int8)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], cut])))
            n_lines.append(len(lines))
            n_cut.append(int(cut.sum()))
            ranges.append(",".join(f"{x}-{y - 1}" for x, y in zip(edge[::2], edge[1::2])))
            texts.append(text if not runs else "\n".join(x for x, gone in zip(lines, cut) if not gone))
        out = {k: batch.column(k) for k in batch.schema.names if k != "runs"} | {
            "n_lines": pa.array(n_lines, pa.int64()), "n_removed_lines": pa.array(n_cut, pa.int64()),
            "removed": pa.array(ranges, pa.string()), "deduped_text": pa.array(texts, pa.string())}
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, keep: list[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_lines, n_removed_lines, removed (``first-last`` runs), deduped_text.

    ``keep`` names further columns to carry along.
    """
    cuts = repeated_lines(docs, min_words).select(c("doc_id").alias("_id"), c("th").alias("_h"), "runs")
    d = docs.select("doc_id", "text", *[k for k in keep if k not in ("doc_id", "text")])
    on = c("doc_id").cast("long").eqNullSafe(c("_id")) & (F.xxhash64("text") == c("_h"))
    j = d.join(cuts, on, "left").drop("_id", "_h")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema]
    return j.mapInArrow(_cut_lines, ", ".join([*fields, "n_lines long, n_removed_lines long, removed string, deduped_text string"]))


def dedup_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without their repeated runs; one that loses its last word goes.  All columns of ``docs``."""
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[c(f"`{n}`") for n in names]).alias("_doc"))
    out = line_dedup(packed, min_words, keep=["_doc"])
    cut = c("n_removed_lines") > 0
    fresh = {"text": c("deduped_text"), "n_chars": F.length("deduped_text").cast("long")}
    return out.where(~cut | c("deduped_text").rlike(r"[^\x20\x09-\x0D]")).select(*[
        F.when(cut, fresh[n]).otherwise(c("_doc")[n]).alias(n) if n in fresh else c("_doc")[n].alias(n) for n in names])
