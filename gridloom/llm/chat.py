"""Operator 6, chat formatting after cumulative-snapshot collapse.

Chat logs often hold a conversation again each time it grows.  Every turn gets two hashes of its place, role and
text; their running sums are rolling hashes of all prefixes of a conversation.  A conversation whose whole
hash is a proper prefix of another one is dropped by an anti join, of equal ones the smallest id stays, and the
maximal ones are rendered.

Equal turns are counted, distinct ones are cut into blocks by ranges of their order (whatever their numbers are), and
places, offsets and running sums are carried over blocks; so a conversation with a third of all rows is many tasks'
work.  Both sides of the anti join hold a prefix once, whatever the number of conversations that share it.  A conversation
of more than ``WHOLE_TURNS`` turns or ``WHOLE_CHARS`` characters is rendered in parts of about ``PART_CHARS`` characters, one
row each; joined in order of ``part`` (numbers rise, but may skip) they are its text.

Defined cases: turns are ordered by number (null first), then by the first 16 characters of role and of text, then by
hashes of both; null role and text count as ''; a null conv_id is one conversation of its own; repeated rows are turns of
their own; an empty table gives an empty table; only the four named columns are read; markers inside texts are defused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import written

BLOCK = 65_536
WHOLE_TURNS = 4096
WHOLE_CHARS = 1 << 24
PART_CHARS = 1 << 22
COPIES = 4096
ORDER = ["conv", "turn", "role", "head", "h1", "h2"]
c = F.col


def render_turn(role: Column, text: Column) -> Column:
    """One turn in chat markup; markers inside role or text lose their form."""
    safe = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def _turns(turns: DataFrame, *more: Column) -> DataFrame:
    """The turns by their order: heads and hashes of role and text instead of the texts."""
    t = turns.select(F.struct("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return t.select("conv", "turn", F.substring("role", 1, 16).alias("r16"), F.substring("text", 1, 16).alias("head"), F.xxhash64("role", "text").alias("h1"),
                    F.xxhash64(F.lit(7), "text", "role").alias("h2"), *more).withColumnRenamed("r16", "role")


def distinct_turns(turns: DataFrame) -> DataFrame:
    """Distinct turns of every conversation with ``n`` copies, their ``size`` as rendered, the first ``place`` (from 1) and ``offset``."""
    t = _turns(turns, F.length(render_turn(c("role"), c("text"))).cast("long").alias("size"))
    t = t.groupBy(*ORDER).agg(F.max("size").alias("size"), F.count("*").alias("n"))
    t = written(t.repartitionByRange(*ORDER).withColumn("_b", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("conv", "_b").orderBy(*ORDER[1:]).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"place": c("n"), "offset": c("n") * c("size")}
    far = t.groupBy("conv", "_b").agg(*[F.sum(v).alias(k) for k, v in sums.items()]).select(
        "conv", "_b", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias("_" + k) for k in sums])
    near = t.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(k) for k, v in sums.items()])
    return near.join(far, ["conv", "_b"]).select(*ORDER, "size", "n", (c("place") + c("_place") + 1).alias("place"), (c("offset") + c("_offset")).alias("offset"))


def _copies(items: DataFrame) -> DataFrame:
    """Every copy of the items, numbered by ``copy`` from 0; many copies are dealt out in chunks before they are made."""
    chunked = items.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((c("n") - 1) / COPIES))))
    last = F.least(c("n"), (c("_chunk") + 1) * COPIES) - 1
    return chunked.withColumn("copy", F.explode(F.sequence(c("_chunk") * COPIES, last))).drop("_chunk")


def prefix_hashes(items: DataFrame) -> DataFrame:
    """(conv, place, s1, s2): rolling hashes of every prefix of every conversation, from its distinct turns."""
    placed = _copies(items.select("conv", "place", "n", "h1", "h2")).withColumn("place", c("place") + c("copy"))
    exact = lambda h, salt: F.xxhash64(F.lit(salt), "place", h).cast("decimal(38,0)")
    placed = placed.select("conv", F.floor(c("place") / BLOCK).alias("_b"), "place", exact("h1", 1).alias("x1"), exact("h2", 2).alias("x2"))
    running = Window.partitionBy("conv", "_b").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("conv", "_b").agg(F.sum("x1").alias("t1"), F.sum("x2").alias("t2")).select(
        "conv", "_b", *[F.coalesce(F.sum(f"t{k}").over(before), F.lit(0)).alias(f"c{k}") for k in (1, 2)])
    local = placed.select("conv", "_b", "place", *[F.sum(f"x{k}").over(running).alias(f"r{k}") for k in (1, 2)])
    return local.join(sums, ["conv", "_b"]).select("conv", "place", *[(c(f"r{k}") + c(f"c{k}")).alias(f"s{k}") for k in (1, 2)])


def maximal(items: DataFrame) -> DataFrame:
    """(conv_id, n_turns, kept) for every conversation, from its distinct turns."""
    prefixes = written(prefix_hashes(items), "prefixes")
    whole = prefixes.groupBy("conv").agg(F.max_by(F.struct("place", "s1", "s2"), "place").alias("w")).select("conv", "w.*")
    key = ["place", "s1", "s2"]
    longest = prefixes.join(whole.select("conv", c("place").alias("_n")), "conv")
    proper = longest.where("place < _n").select(*key).distinct()
    first = whole.groupBy(*key).agg(F.min("conv").alias("conv"))
    kept = first.join(proper, key, "left_anti").select("conv", F.lit(True).alias("_kept"))
    return whole.select("conv", c("place").alias("n_turns")).join(kept, "conv", "left").select(
        "conv.conv_id", c("n_turns").cast("long").alias("n_turns"), F.coalesce("_kept", F.lit(False)).alias("kept"))


def whole_texts(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, part, rendered): one text for each of the conversations ``convs(conv)`` of bounded size."""
    t = _turns(turns, render_turn(c("role"), c("text")).alias("out")).join(convs, "conv", "left_semi")
    item = F.struct(*ORDER[1:], "out")
    return t.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["out"]), "").alias("rendered")).select(
        "conv", F.lit(0).cast("long").alias("part"), "rendered")


def texts_in_parts(turns: DataFrame, convs: DataFrame, items: DataFrame) -> DataFrame:
    """(conv, part, rendered) for conversations of any size: turns grouped by their offset in the whole text."""
    t = _turns(turns, render_turn(c("role"), c("text")).alias("out")).join(convs, "conv", "left_semi").groupBy(*ORDER).agg(F.first("out").alias("out"))
    there = items.join(convs, "conv", "left_semi").select(*[c(k).alias("_" + k) for k in ORDER], "n", "size", "offset")
    same = F.lit(True)
    for k in ORDER:
        same = same & t[k].eqNullSafe(c("_" + k))
    copies = _copies(t.join(there, same)).withColumn("at", c("offset") + c("copy") * c("size"))
    parts = copies.groupBy("conv", F.floor(c("at") / PART_CHARS).alias("part"))
    return parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]), "").alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, kept, part, rendered (null unless kept): a row for every conversation, or for every part of a large one."""
    items = written(distinct_turns(turns), "places")
    chars = items.groupBy("conv").agg(F.sum(c("n") * c("size")).alias("chars"))
    verdict = maximal(items).withColumn("conv", F.struct("conv_id")).join(chars, "conv")
    verdict = written(verdict.withColumn("large", (c("n_turns") > WHOLE_TURNS) | (c("chars") > WHOLE_CHARS)), "maximal")
    kept = verdict.where("kept")
    texts = whole_texts(turns, kept.where("not large").select("conv")).unionByName(
        texts_in_parts(turns, kept.where("large").select("conv"), items))
    return verdict.select("conv", "n_turns", "kept").join(texts, "conv", "left").select(
        "conv.conv_id", "n_turns", "kept", F.coalesce("part", F.lit(0)).cast("long").alias("part"), "rendered")
