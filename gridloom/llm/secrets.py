"""Operator 9, secret scans over a trigram inverted index.

Each rule's pattern is read into a Boolean query over lower-cased trigrams that any match must contain.  The index
holds one posting (trigram, document) for every trigram some rule asks for; intersecting and uniting the
postings per document leaves candidates for each rule, and only these are verified with the pattern.  A rule
without mandatory trigrams scans every text.

All of it is column expressions: postings are grouped with map-side aggregation by document, candidates go back
to the texts by an ordinary join, and positions come from splitting a text at its matches.

Base kinds follow fixed patterns; further rules add spans.  Offsets count code points, ends are exclusive.

Defined cases: a null text is empty; rows without doc_id are scanned by every rule; rows of one doc_id are
verified one by one; an empty table gives an empty table; only doc_id, text and ``keep`` are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let

c = F.col
MAX_CHOICES = 24  # strings that one part of a pattern may stand for before it counts as unknown


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, group whose length counts (0: the match) and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Base rules, in the order in which kinds sort.
BASE = [
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
                   r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the same matches as runs of any length with the shorter ones dropped
]
#: Further rules; their spans are added.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
]

ALWAYS = ("true",)


def trigram_query(pattern: str) -> tuple:
    """Boolean query over trigrams: ("true",), ("gram", g), ("and", ...) or ("or", ...).

    The pattern is walked as a sequence of string choices.  Neighbouring choices are joined while few; a part
    that may be empty or is unknown ends the run of known text.
    """
    def grams(choices: set[str]) -> tuple:
        branches = []
        for s in sorted(choices):
            found = sorted({s[i:i + 3] for i in range(len(s) - 2)})
            if not found:
                return ALWAYS
            branches.append(combine("and", [("gram", g) for g in found]))
        return combine("or", branches)

    def combine(kind: str, parts: list[tuple]) -> tuple:
        if kind == "or" and ALWAYS in parts:
            return ALWAYS
        parts = [q for p in parts if p != ALWAYS for q in (p[1:] if p[0] == kind else [p])]
        parts = list(dict.fromkeys(parts))
        if kind == "or":  # a branch that asks for more than another one adds nothing
            asks = [set(p[1:]) if p[0] == "and" else {p} for p in parts]
            parts = [p for p, a in zip(parts, asks) if not any(b < a for b in asks)]
        return ALWAYS if not parts else parts[0] if len(parts) == 1 else (kind, *parts)

    def walk(tree) -> tuple:
        """Query of a sequence of parsed parts."""
        parts, run = [], {""}

        def close():
            nonlocal run
            if run != {""}:
                parts.append(grams(run))
            run = {""}

        def extend(choices: set[str] | None):
            nonlocal run
            if choices is None:
                close()
            elif len(run) * len(choices) > MAX_CHOICES:
                close()
                run = choices
            else:
                run = {a + b for a in run for b in choices}

        for op, value in tree:
            name = str(op)
            if name == "SUBPATTERN":
                choices = strings(value[-1])
                if choices is None:
                    close()
                    parts.append(walk(value[-1]))
                else:
                    extend(choices)
            elif name == "BRANCH":
                choices = strings([(op, value)])
                if choices is None:
                    close()
                    parts.append(combine("or", [walk(b) for b in value[1]]))
                else:
                    extend(choices)
            elif name.endswith("REPEAT") and value[0] >= 1:
                choices = strings(value[2])
                close()
                if choices is not None and len(choices) == 1:
                    run = {next(iter(choices)) * min(value[0], 8)}
                    close()
                elif choices is None:
                    parts.append(walk(value[2]))
            else:
                extend(strings([(op, value)]))
        close()
        return combine("and", parts)

    def strings(tree) -> set[str] | None:
        """All lower-cased strings a part can stand for, or None when they are many."""
        out = {""}
        for op, value in tree:
            name = str(op)
            if name == "LITERAL":
                one = {chr(value).lower()}
            elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in value):
                codes = [x for o, v in value for x in ([v] if str(o) == "LITERAL" else range(v[0], v[1] + 1))]
                one = {chr(x).lower() for x in codes} if len(codes) <= 2 * MAX_CHOICES else None
            elif name == "SUBPATTERN":
                one = strings(value[-1])
            elif name == "BRANCH":
                each = [strings(b) for b in value[1]]
                one = None if None in each else set().union(*each)
            elif name.endswith("REPEAT") and value[1] == 1:
                inner = strings(value[2])
                one = None if inner is None else inner | ({""} if value[0] == 0 else set())
            else:
                one = None
            if one is None or len(out) * len(one) > MAX_CHOICES:
                return None
            out = {a + b for a in out for b in one}
        return out

    return walk(list(re._parser.parse(pattern)))


def grams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "gram" else set().union(*map(grams_of, query[1:])) if query[0] in ("and", "or") else set()


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id): the part of the inverted trigram index that the rules ask for."""
    low = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lower("text").alias("_low"))
    there = F.array_compact(F.array(*[F.when(c("_low").contains(g), F.lit(g)) for g in grams]))
    return low.select("doc_id", F.explode(there).alias("gram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, kinds): rules whose query the document's postings satisfy."""
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted(set().union(*map(grams_of, asked.values())))
    held = index.groupBy("doc_id").agg(*[F.bool_or(c("gram") == g).alias(f"g{i}") for i, g in enumerate(grams)])

    def holds(query: tuple) -> Column:
        if query[0] == "gram":
            return c(f"g{grams.index(query[1])}")
        parts = [holds(q) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if query[0] == "and" else out | p
        return out

    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in asked.items() if q != ALWAYS]))
    return held.select("doc_id", kinds.alias("_kinds")).where(F.size("_kinds") > 0)


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in a text: array of (start, rank, kind, end)."""
    none = F.array().cast("array<struct<a:int,k:int,kind:string,b:int>>")
    start = lambda found: F.aggregate(
        F.zip_with(F.split(text, rule.pattern), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m"))),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, x: F.when(x["m"].isNull(), s).otherwise(F.struct(
            (s["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"),
            F.concat(s["out"], F.array(F.struct(
                (s["at"] + F.length(x["gap"])).alias("a"), F.lit(rank).alias("k"), F.lit(rule.kind).alias("kind"),
                (s["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("b")))).alias("out"))),
        lambda s: s["out"])
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    if rule.group:
        long_enough = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
        return F.transform(F.filter(F.zip_with(start(found), long_enough, lambda m, ok: F.struct(m.alias("m"), ok.alias("ok"))),
                                    lambda x: x["ok"]), lambda x: x["m"])
    return F.filter(start(found), lambda m: m["b"] - m["a"] >= rule.least)


def secret_spans(docs: DataFrame, keep: list[str] = (), base: list[Rule] = BASE, more: list[Rule] = MORE) -> DataFrame:
    """One row per row of ``docs``: counts per base kind, base digest, all spans, and ``redacted_text``."""
    rules = [*base, *more]
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted(set().union(*map(grams_of, queries.values())))
    found = candidates(postings(docs, grams), rules).select(c("doc_id").alias("_id"), "_kinds")
    carry = [k for k in keep if k not in ("doc_id", "text")]
    d = docs.select("doc_id", "text", *carry, F.coalesce("text", F.lit("")).alias("_t")).join(found, c("doc_id") == c("_id"), "left")
    none = F.array().cast("array<struct<a:int,k:int,kind:string,b:int>>")
    for i, r in enumerate(rules):
        every = matches(c("_t"), r, i)
        if queries[r.kind] == ALWAYS:
            wanted = c("_t").rlike(r.pattern)
        else:
            wanted = (F.array_contains("_kinds", r.kind) | c("doc_id").isNull()) & c("_t").rlike(r.pattern)
        d = d.withColumn(f"_{r.kind}", F.when(F.coalesce(wanted, F.lit(False)), every).otherwise(none))
    span = lambda x: F.concat_ws(":", x["kind"], x["a"], x["b"])
    joined = lambda rs: F.sort_array(F.concat(*[c(f"_{r.kind}") for r in rs]))
    d = d.select("doc_id", "text", *carry, "_t", *[F.size(f"_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base],
                 joined(base).alias("_base"), joined(rules).alias("_all"))
    redacted = let(_pieces(c("_t"), c("_all")), lambda p: F.when(p["at"] == 0, c("text")).otherwise(
        F.concat(p["out"], F.substr("_t", p["at"] + 1))))
    return d.select("doc_id", "text", *carry, *[f"n_{r.kind}" for r in base],
                    F.sha2(F.array_join(F.transform("_base", span), ","), 256).alias("base_sha256"),
                    F.array_join(F.transform("_all", span), ",").alias("spans"), redacted.alias("redacted_text"))


def _pieces(text: Column, spans: Column) -> Column:
    """Struct (at, out): text up to the last span with every span replaced by its kind in brackets."""
    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda s, x: F.when(
        x["b"] <= s["at"], s).otherwise(F.struct(x["b"].alias("at"), F.concat(
            s["out"], F.substr(text, s["at"] + 1, F.greatest(x["a"] - s["at"], F.lit(0))), F.lit("["), x["kind"], F.lit("]")).alias("out"))))
