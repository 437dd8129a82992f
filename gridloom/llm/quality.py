"""Operator 1, quality rules: clean line by line, then reject documents that lose too much.

Every rule is a column expression over one row, so the operator is one scan without any shuffle.  Each
line of a text is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a
document is rejected when its noise and menu lines hold more than ``max_loss`` of its words or when nothing is
left.  A stripped legal line alone does not speak against a document.  Base measures (word count, repeated
five-word windows) reject documents before that.

Defined cases: a null or empty text has no words, fails the base rule and cleans to ''.  Lines without words
are never removed.  Repeated rows are judged one by one, an empty table gives an empty table, and only the
two named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let, removed_chars, split_words

SYMBOLS = "#*$%&|<>"
SENTENCE_MARKS = "[.!?…:;,。！？；：，、।؟]"

#: Lines that are a menu entry and nothing else (compared without case and outer spaces).
NAVIGATION = ["home", "menu", "main menu", "search", "login", "log in", "sign in", "sign up", "register", "next", "previous",
              "next page", "previous page", "back to top", "skip to content", "read more", "show more", "share", "print",
              "contact", "contact us", "about", "about us", "site map", "sitemap"]

#: Phrases of legal and site boilerplate, found in lower-cased lines.
BOILERPLATE = ["all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
               "use of cookies", "uses cookies", "accept cookies", "enable javascript", "subscribe to our newsletter",
               "click here to", "lorem ipsum", "powered by wordpress", "copyright (c)", "copyright ©"]


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the verdict."""

    symbol_share: float = 0.5      # symbols per word from which a line counts as punctuation noise
    shout_share: float = 0.3       # "!!" per word
    unmarked_words: int = 20       # a line of so many words needs a sentence mark
    separator_share: float = 0.25  # menu separators per word, with two at least
    boilerplate_words: int = 40    # longer lines are prose that mentions such a phrase
    max_loss: float = 0.5          # share of the words that may be removed
    min_words: int = 10
    max_repeat_percent: int = 20


def repeated_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in ``words``, first occurrences included.

    Window hashes are sorted with their positions; equal neighbours are repeats, and the sorted start
    positions give the covered words as the sum of min(5, distance to the next start).
    """
    def shifted(a, k):
        return F.slice(a, k, F.greatest(F.size(a), F.lit(1)))

    def window_hashes(w):
        z = F.arrays_zip(*[shifted(w, k).alias(f"w{k}") for k in range(1, 6)])
        win = F.transform(z, lambda x: F.xxhash64(*[x[f"w{k}"] for k in range(1, 6)]))
        return F.slice(win, 1, F.greatest(F.size(w) - 4, F.lit(0)))

    def covered(win):
        s = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(s, lambda s: covered_of(F.arrays_zip(
            s.alias("a"), shifted(s, 2).alias("n"), F.concat(F.slice(s, 1, 1), s).alias("p"))))

    def covered_of(z):
        # p is one place behind; its first entry is the row itself, so the first position is told by index.
        twice = F.filter(z, lambda x, i: x["a"].isNotNull() & (
            (x["a"]["h"] == x["n"]["h"]) | ((i > 0) & (x["a"]["h"] == x["p"]["h"]))))
        starts = F.sort_array(F.transform(twice, lambda x: x["a"]["i"]))
        return let(starts, lambda p: F.aggregate(
            F.zip_with(p, shifted(p, 2), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5)))),
            F.lit(0).cast("long"), lambda t, x: t + F.coalesce(x, F.lit(0))))

    return let(window_hashes(words), lambda win: F.when(
        F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(covered(win)))


def line_faults(line: Column, n_words: Column, symbols: Column, rules: Rules) -> tuple[Column, Column]:
    """(noise or menu, boilerplate): whether the line rules remove a line, and why.

    Each costly test stands behind a cheap one that most lines fail.
    """
    noisy = ((symbols >= n_words * rules.symbol_share) & (symbols >= 3)) | (line.contains("!!") & (
        F.regexp_count(line, F.lit("!!")) >= F.greatest(n_words * rules.shout_share, F.lit(1.0)))) | (
        (n_words >= rules.unmarked_words) & ~line.rlike(SENTENCE_MARKS))
    separators = F.regexp_count(line, F.lit(r"(^|[\x20\x09])[|»›•·>]([\x20\x09]|$)"))
    menu = (line.rlike("[|»›•·>]") & (separators >= F.greatest(n_words * rules.separator_share, F.lit(2.0)))) | (
        (n_words <= 3) & F.lower(F.trim(line)).isin(NAVIGATION))
    phrase = let(F.lower(line), lambda low: functools.reduce(Column.__or__, [low.contains(p) for p in BOILERPLATE]))
    return (n_words > 0) & (noisy | menu), (n_words > 0) & (n_words <= rules.boilerplate_words) & phrase


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text",
                  keep: list[str] = ()) -> DataFrame:
    """One row per row of ``docs``: measures, verdict ``kept`` and ``cleaned_text``; ``keep`` names columns to carry."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*keep, *([] if id_col in keep else [id_col]), text.alias("_t"))
    symbols = lambda x: F.when(x.rlike(f"[{SYMBOLS}]"), removed_chars(x, SYMBOLS)).otherwise(0)
    cut = base.select(*[x for x in base.columns if x != "_t"], F.transform(F.split("_t", "\n"), lambda x: F.struct(
        x.alias("s"), split_words(x).alias("w"), symbols(x).alias("y"))).alias("_l"))
    # A line break separates words, so the words of the text are those of its lines.
    cut = cut.withColumn("_w", F.flatten(F.transform("_l", lambda x: x["w"])))
    judged = cut.select(
        *[x for x in cut.columns if x not in ("_l", "_w")], F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.aggregate("_l", F.lit(0).cast("long"), lambda t, x: t + x["y"]).alias("n_symbols"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.transform("_l", lambda x: F.struct(x["s"].alias("s"), F.size(x["w"]).alias("n"), *[
            fault.alias(name) for fault, name in zip(line_faults(x["s"], F.size(x["w"]), x["y"], rules), ("noise", "boiler"))])).alias("_l"))
    with_word = F.transform(F.filter("_l", lambda x: x["n"] > 0), lambda x: x["s"])
    bad = F.filter("_l", lambda x: x["noise"] | x["boiler"])
    words_of = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x["n"])
    counted = judged.select(
        *[x for x in judged.columns if x != "_l"],
        let(with_word, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")).alias("n_dup_lines"),
        F.size(bad).cast("long").alias("n_removed_lines"),
        words_of(bad).alias("n_removed_words"), words_of(F.filter("_l", lambda x: x["noise"])).alias("n_noise_words"),
        F.array_join(F.transform(F.filter("_l", lambda x: ~(x["noise"] | x["boiler"])), lambda x: x["s"]), "\n").alias("cleaned_text"))
    base_failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    lost = (F.col("n_noise_words") > rules.max_loss * F.col("n_words")) | (F.col("n_removed_words") == F.col("n_words"))
    return counted.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~lost)


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Documents that pass, with their failing lines removed; all columns of ``docs`` in their order."""
    names = docs.columns
    carried = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_doc"), "text")
    judged = quality_rules(carried, rules, id_col="_doc")
    # A filter on the verdict would move below the projections and judge each text once more for it; the result of a
    # generator of one row stays where it is.
    row = F.explode(F.array(F.struct("_doc", "cleaned_text", "n_removed_lines", "kept"))).alias("_r")
    kept = judged.select(row).where("_r.kept").select("_r.*")
    fresh = {"text": F.col("cleaned_text"), "n_chars": F.length("cleaned_text").cast("long")}
    changed = F.col("n_removed_lines") > 0
    return kept.select(*[F.when(changed, fresh[n]).otherwise(F.col("_doc")[n]).alias(n) if n in fresh
                         else F.col("_doc")[n].alias(n) for n in names])
