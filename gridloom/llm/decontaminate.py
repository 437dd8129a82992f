"""Operator 4, benchmark decontamination.

Benchmark items become hashed windows of ten normalised words (shorter items are one window).  While they are
fewer than a checked bound, they are broadcast as a hash set: training documents are scanned once, every window
that is in the set is verified word by word, and the words inside any hit are marked.  Beyond the bound the
same windows meet by a shuffled join, in which each distinct window is one row on the benchmark's side.

Results name hit words, items and the verdict; ``decontaminated`` removes whole documents or only the hit words.

Defined cases: null and empty texts have no words and no hit; items without words have no window; several items
may share a window, all of them count; repeated rows are judged one by one; an empty benchmark hits nothing;
a null item_id is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens
from gridloom.llm.common import written

WINDOW = 10
BROADCAST_WINDOWS = 1_000_000
c = F.col
OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<a:long,b:long>>"


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, n, h, words): every distinct window of every item, with its normalised words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in tokens.pieces(batch.column("text"), "alnum"):
                item, n, h, text = [], [], [], []
                for r in range(b - a):
                    lo, hi = int(words.first[r]), int(words.first[r + 1])
                    k = min(size, hi - lo)
                    if not k:
                        continue
                    at = np.arange(lo, hi - k + 1)
                    item += [batch.column("item")[a + r].as_py()] * len(at)
                    n += [k] * len(at)
                    h.append(_window_hashes(words, at, k))
                    text += [words.text(i, i + k) for i in at]
                if item:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(item, pa.string()), pa.array(n, pa.int32()), pa.array(np.concatenate(h).view(np.int64)),
                         pa.array(text, pa.binary())], names=["item", "n", "h", "words"])

    items = benchmark.where("item_id IS NOT NULL").select(c("item_id").cast("string").alias("item"), "text")
    return items.mapInArrow(run, "item string, n int, h long, words binary").distinct()


def _window_hashes(words: tokens.Words, at: np.ndarray, n: int) -> np.ndarray:
    return tokens.spans(words.hash, "word", at, at + n) * tokens.U(2 * n + 1)


def _judged(first: int, last: int, hits: list[tuple[int, int]], items: set[str]) -> tuple:
    """Result columns of one document from its verified windows (start, length)."""
    runs: list[list[int]] = []
    for s, n in sorted(hits):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s + n)
        else:
            runs.append([s, s + n])
    n_hit = sum(b - a for a, b in runs)
    named = ",".join(sorted(items))
    return (last - first, n_hit, len(items), hashlib.sha256(named.encode()).hexdigest(), n_hit > 0,
            [{"a": a - first, "b": b - first} for a, b in runs])


def _result(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
    fresh = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"]
    return pa.RecordBatch.from_arrays([*batch.columns, *fresh], names=[*batch.schema.names, *names])


def _scan_broadcast(shared):
    """Hits of every document against the broadcast windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        known = {n: np.array(sorted(h for m, h in table if m == n), np.uint64) for n in {m for m, _ in table}}
        for batch in batches:
            rows: list[tuple] = []
            for a, b, words in tokens.pieces(batch.column("text"), "alnum"):
                hits: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                for n, hashes in known.items():
                    at = np.arange(max(0, len(words.hash) - n + 1))
                    at = at[words.row[at] == words.row[at + n - 1]] if len(at) else at
                    h = _window_hashes(words, at, n)
                    spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    for i in np.flatnonzero(hashes[spot] == h):
                        text, start = words.text(at[i], at[i] + n), int(at[i])
                        for item in table[n, int(h[i])].get(text, ()):
                            hits.setdefault(int(words.row[start]), []).append((start, n))
                            items.setdefault(int(words.row[start]), set()).add(item)
                rows += [_judged(int(words.first[r]), int(words.first[r + 1]), hits.get(r, []), items.get(r, set())) for r in range(b - a)]
            yield _result(batch, rows)

    return run


def _joined_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(th, hits): verified windows per distinct text, by a shuffled join of document and benchmark windows."""
    lengths = [r["n"] for r in windows.select("n").distinct().collect()]  # at most ``size`` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in tokens.pieces(batch.column("text"), "alnum"):
                for n in lengths:
                    at = np.arange(max(0, len(words.hash) - n + 1))
                    at = at[words.row[at] == words.row[at + n - 1]] if len(at) else at
                    row = words.row[at]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("th").take(pa.array(row + a)), pa.array(at - words.first[row]),
                         pa.array(np.full(len(at), n, np.int32)), pa.array(_window_hashes(words, at, n).view(np.int64)),
                         pa.array([words.text(i, i + n) for i in at], pa.binary())], names=["th", "at", "n", "h", "words"])

    texts = docs.select(F.sha2("text", 256).alias("th"), "text").where("text IS NOT NULL").dropDuplicates(["th"])
    found = texts.mapInArrow(run, "th string, at long, n int, h long, words binary").join(
        windows.groupBy("n", "h", "words").agg(F.collect_set("item").alias("items")), ["n", "h", "words"])
    return found.groupBy("th").agg(F.collect_list(F.struct("at", "n", "items")).alias("hits"))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        found = batch.column("_hits").to_pylist()
        for a, b, words in tokens.pieces(batch.column("text"), "alnum"):
            for r in range(b - a):
                hits = found[a + r] or []
                rows.append(_judged(0, int(words.first[r + 1] - words.first[r]), [(h["at"], h["n"]) for h in hits],
                                    {i for h in hits for i in h["items"]}))
        yield _result(batch.drop_columns(["_hits"]), rows)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, keep: list[str] = (),
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, columns in ``keep``, and the hit columns.

    ``hit_spans`` counts words from 0, end exclusive.
    """
    spark = docs.sparkSession
    windows = written(benchmark_windows(benchmark, size), "windows")
    d = docs.select("doc_id", "text", *[k for k in keep if k not in ("doc_id", "text")])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema], OUT])
    if windows.count() <= broadcast_windows:
        table: dict[tuple[int, int], dict[bytes, list[str]]] = {}
        for w in windows.toLocalIterator():
            table.setdefault((w["n"], w["h"] % 2**64), {}).setdefault(bytes(w["words"]), []).append(w["item"])
        return d.mapInArrow(_scan_broadcast(spark.sparkContext.broadcast(table)), schema)
    hits = _joined_hits(d, windows)
    j = d.join(hits, F.sha2("text", 256) == c("th"), "left").withColumnRenamed("hits", "_hits").drop("th")
    return j.mapInArrow(_finish, schema)


def _without_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the bytes from the first to the last word of every hit span cut out."""
    for batch in batches:
        texts: list[str | None] = []
        spans, old = batch.column("hit_spans").to_pylist(), batch.column("text")
        for a, b, words in tokens.pieces(old, "alnum"):
            for r in range(b - a):
                runs = spans[a + r]
                if not runs:
                    texts.append(old[a + r].as_py())
                    continue
                base, at, parts = int(words.first[r]), int(words.row_bytes[r]), []
                for x in runs:
                    parts.append(words.data[at:words.start[base + x["a"]]].tobytes())
                    at = int(words.end[base + x["b"] - 1])
                parts.append(words.data[at:words.row_bytes[r + 1]].tobytes())
                texts.append(b"".join(parts).decode("utf-8"))
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(texts, pa.string()), batch.column("contaminated")],
                                         names=["_doc", "_clean", "contaminated"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents (mode "documents") or without the hit words (mode "spans")."""
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[c(f"`{n}`") for n in names]).alias("_doc"))
    judged = contamination(packed, benchmark, size, keep=["_doc"])
    if mode == "documents":
        return judged.where(~c("contaminated")).select(*[c("_doc")[n].alias(n) for n in names])
    doc_type = packed.schema["_doc"].dataType.simpleString()
    cut = judged.select("_doc", "text", "hit_spans", "contaminated").mapInArrow(
        _without_hits, f"_doc {doc_type}, _clean string, contaminated boolean")
    fresh = {"text": c("_clean"), "n_chars": F.length("_clean").cast("long")}
    return cut.select(*[F.when(c("contaminated"), fresh[n]).otherwise(c("_doc")[n]).alias(n) if n in fresh else c("_doc")[n].alias(n)
                        for n in names])
