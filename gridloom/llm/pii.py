"""Operator 7, personal data: fixed patterns plus boosted trees over high-recall candidates.

Base spans come from fixed patterns with checks (Luhn, number ranges, digit counts) and always stay.  The
method adds spans: loose generators propose overlapping candidates (dotted, spaced or bracketed numbers alone or in lists, obfuscated
addresses), each candidate gets format and context features, one boosted-tree model per kind scores it, and a
threshold calibrated on held-out candidates for a set precision selects.  Of overlapping candidates the best
one stays; none may touch a base span.

The models are fitted on a bounded sample of documents (``Training.documents``), labelled by the checks: a
candidate that a base pattern accepts is a positive of its kind, every other candidate a negative.  Features hide
the marks that base patterns insist on (a leading plus, a plain @), so the trees learn the rest of the form and its
surroundings.  With fewer than ``Training.least`` held-out positives a kind adds nothing.  Fitting is
deterministic; all documents are scanned whole, in linear time, one batch at a time.

Defined cases: a null text counts as empty; repeated rows are judged one by one; an empty table trains nothing and
gives an empty result; only doc_id and text (and the columns named in ``keep``) are read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only begin a run of digits anew, so the look-behind changes nothing but the running time.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")
NOT_DIGIT = re.compile(r"[^0-9]+")

NUMBER_LIKE = re.compile(r"[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9])+")
LEAST_DIGITS, MOST_DIGITS = 7, 19
BLOCK = 10_000  # candidates scored at a time
AT_LIKE = re.compile(r"\x20?(?:@|[(\[]at[)\]])\x20?", re.I)
DOMAIN_LIKE = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]+)*", re.I)
WORDS_BEFORE = [re.compile(p, re.I) for p in (
    r"(phone|tel|call|mobile|fax|telefon|teléfono|móvil)\W*$", r"(mail|contact|write|correo|courriel)\W*$",
    r"(card|visa|credit|karte|tarjeta|carte)\W*$", r"(ip|host|server|address|adresse)\W*$")]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    short = digits.lstrip("0") or "0"
    return len(short) <= 3 and int(short) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so a long run of letters is read once."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            last = domain.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base match, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(_octet(p) for p in m.groups())]
        for kind, pattern, low, high in ((2, CARD, 14, 19), (3, PHONE, 10, 15)):
            for m in pattern.finditer(text):
                digits = NOT_DIGIT.sub("", m[0])
                if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                    out.append((m.start(), kind, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Loose, possibly overlapping spans.

    A run of digit groups of any length gives every stretch of consecutive groups with 7 to 19 digits (no kind has more), with
    and without a bracket or plus before it: at most 13 stretches begin at a group, so the work is linear in the run.
    """
    out = set()
    if DIGIT.search(text):
        for m in NUMBER_LIKE.finditer(text):
            groups = [g.span() for g in DIGITS.finditer(text, m.start(), m.end())]
            for i, (a, _) in enumerate(groups):
                gap = groups[i - 1][1] if i else m.start()
                mark = next((k for k in range(gap, a) if text[k] in "+("), a)
                digits = 0
                for k in range(i, len(groups)):
                    b = groups[k][1]
                    digits += b - groups[k][0]
                    if digits > MOST_DIGITS:
                        break
                    if digits >= LEAST_DIGITS:
                        out |= {(a, b), (mark, b)}
    for m in AT_LIKE.finditer(text):
        # Neither side can hold another such mark, so every character is read once.
        start = m.start()
        while start > 0 and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN_LIKE.match(text, m.end())
        if domain and start < m.start():
            out.add((start, domain.end()))
    return sorted(out)


def features(text: str, a: int, b: int) -> list[float]:
    span = text[a:b]
    digits = NOT_DIGIT.sub("", span)
    groups = re.findall(r"[0-9]+", span)
    before, after = text[max(0, a - 24):a], text[b:b + 2]
    left = before[-1:] or " "
    return [float(len(span)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)),
            float(min(map(len, groups), default=0)), float(bool(digits) and luhn(digits)),
            float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)), float(len(set(digits))),
            float(span.count(".")), float(span.count("-")), float(span.count(" ")), float(span.count("(")),
            float(len(span) - len(digits) - sum(span.count(x) for x in ".- ()+/")),
            float(bool(re.search(r"\.[A-Za-z]{2,}$|dot[)\]]\x20?[A-Za-z]{2,}$", span, re.I))),
            float(left.isalnum()), float(left in "#$€£=\"'/"), float(after[:1].isalnum()), float(after[:1] in "%€\"'/"),
            *_words_before(before)]


@functools.lru_cache(64)
def _words_before(before: str) -> list[float]:
    return [float(bool(p.search(before))) for p in WORDS_BEFORE]


N_FEATURES = len(features("", 0, 0))


@dataclass(frozen=True)
class Training:
    """Bounds and shape of the fit."""

    documents: int = 4000
    rows: int = 40_000
    trees: int = 30
    rate: float = 0.3
    precision: float = 0.98
    least: int = 8


class Trees:
    """Boosted trees of two levels on logistic loss; thresholds are chosen among quantiles of each feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int, rate: float):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))) for f in range(x.shape[1])]
        self.prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        self.trees: list[tuple] = []
        score = np.full(len(y), self.prior)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), 2, rate)
            self.trees.append(tree)
            score += self._apply(tree, x)

    def _grow(self, x, g, h, depth, rate):
        leaf = rate * g.sum() / (h.sum() + 1.0)
        best = (1e-6, None, None)
        if depth and len(g) >= 8:
            whole = g.sum() ** 2 / (h.sum() + 1.0)
            for f, cuts in enumerate(self.cuts):
                for cut in cuts:
                    low = x[:, f] <= cut
                    gl, hl = g[low].sum(), h[low].sum()
                    gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
                    if gain > best[0] and low.any() and not low.all():
                        best = (gain, f, cut)
        if best[1] is None:
            return (None, float(leaf))
        low = x[:, best[1]] <= best[2]
        return (best[1], float(best[2]), self._grow(x[low], g[low], h[low], depth - 1, rate), self._grow(x[~low], g[~low], h[~low], depth - 1, rate))

    def _apply(self, tree, x):
        if tree[0] is None:
            return np.full(len(x), tree[1])
        return np.where(x[:, tree[0]] <= tree[1], self._apply(tree[2], x), self._apply(tree[3], x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum(self._apply(t, x) for t in self.trees) if len(x) else np.zeros(0)


def _accepted(text: str, a: int, b: int, base: list[tuple[int, int, int]]) -> int | None:
    """Kind of a candidate by the checks, -1 for none; None if it reaches over the end of a base span, so that it could never be added.

    Part of a base span is no number of its own: a positive reaches the span's end and lacks at most the mark or what stands
    before a bracket.  Away from base spans (lists of numbers hide them from the greedy patterns) its own text is checked.
    """
    near = [(s, k, e) for s, k, e in base if s < b and a < e]
    if not near:
        return next((k for s, k, e in base_spans(text[a:b]) if (s, e) == (0, b - a)), -1)
    whole = [k for s, k, e in near if s <= a and b == e and 10 * (b - a) >= 6 * (e - s) and (not DIGIT.search(text, s, a) or text[a] == "(")]
    if whole:
        return whole[0]
    return -1 if any(s <= a and b <= e for s, _, e in near) else None


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and label (kind number, -1 for none) of every candidate of the sampled documents."""
    for batch in batches:
        rows, labels, docs = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            text = text or ""
            base = base_spans(text)
            for a, b in candidates(text):
                label = _accepted(text, a, b, base)
                if label is not None:
                    rows.append(features(text, a, b))
                    labels.append(label)
                    docs.append(doc)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(labels, pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
                                         names=["doc_id", "label", "x"])


def fit(docs: DataFrame, training: Training = Training()) -> list[tuple[Trees, float] | None]:
    """One (model, threshold) per kind, or None where the sample has too few positives."""
    n = docs.count()
    share = min(1.0, training.documents / max(1, n))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000 + 1))
    found = chosen.mapInArrow(_labelled, "doc_id long, label int, x array<double>").limit(training.rows).collect()
    found.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["label"], r["x"]))
    if not found:
        return [None] * len(KINDS)
    x, label = np.array([r["x"] for r in found]), np.array([r["label"] for r in found])
    held = np.array([hashlib.sha256(str(r["doc_id"]).encode()).digest()[0] % 3 == 0 for r in found])
    out: list[tuple[Trees, float] | None] = []
    for kind in range(len(KINDS)):
        y = (label == kind).astype(float)
        if y[held].sum() < training.least or y[~held].sum() < training.least:
            out.append(None)
            continue
        model = Trees(x[~held], y[~held], training.trees, training.rate)
        out.append((model, _calibrated(model.scores(x[held]), y[held], training.precision)))
    return out


def _calibrated(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Lowest score from which on the held-out candidates reach the precision at every cut."""
    order = np.lexsort((y, -scores))
    s, good = scores[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    ok = good[ends] / (ends + 1) >= precision
    upto = len(ok) if ok.all() else int(np.argmin(ok))
    return float(s[ends[upto - 1]]) if upto else float("inf")


def _added(text: str, base: list[tuple[int, int, int]], models) -> list[tuple[int, int, int]]:
    """Spans the models add to ``base``."""
    if not any(models):
        return []
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    before = lambda b: bisect_left(starts, b)
    free = [(a, b) for a, b in candidates(text) if not before(b) or reach[before(b) - 1] <= a]
    scored = []
    for at in range(0, len(free), BLOCK):
        block = free[at:at + BLOCK]
        x = np.array([features(text, a, b) for a, b in block])
        for kind, model in enumerate(models):
            if model:
                scored += [(-(s - model[1]), a, b, kind) for s, (a, b) in zip(model[0].scores(x), block) if s >= model[1]]
    out: list[tuple[int, int, int]] = []
    for _, a, b, kind in sorted(scored):
        i = bisect_left(out, (a,))
        if (i == 0 or out[i - 1][2] <= a) and (i == len(out) or out[i][0] >= b):
            out.insert(i, (a, kind, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def personal_data(docs: DataFrame, keep: list[str] = (), training: Training = Training(), mask: str = "[{kind}]") -> DataFrame:
    """One row per row of ``docs``: counts, base digest and all spans of the whole text, and ``redacted_text``."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, training))  # bounded by Training.trees
    d = docs.select("doc_id", "text", *[k for k in keep if k not in ("doc_id", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, texts = [], [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                every = sorted(base + _added(text or "", base, models.value))
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(4)])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                parts, at = [], 0
                for a, k, b in every:
                    if b > at:
                        parts += [text[at:max(a, at)], mask.format(kind=KINDS[k])]
                        at = b
                texts.append("".join(parts) + text[at:] if every else text)
            fresh = [pa.array([x[k] for x in counts], pa.int64()) for k in range(4)]
            fresh += [pa.array(x, pa.string()) for x in (digests, spans, texts)]
            names = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "redacted_text"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *fresh], names=[*batch.schema.names, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema]
    return d.mapInArrow(run, ", ".join([*fields, *[f"n_{k} long" for k in KINDS], "base_sha256 string, spans string, redacted_text string"]))
