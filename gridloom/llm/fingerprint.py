"""Operator 12, document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the ``K`` smallest distinct hashes (64 bits as hex, so that order is text order) of a
text's five-word shingles, letters A-Z lowered.  The smallest of a union are among the smallest of its parts, so
sketches merge; a set of at most ``K`` shingles is kept whole, and its estimates are exact.

Next documents: rows are cut into ranges of doc_id, one exchange carries each text once, and inside a range the next
row is a neighbour.  A range also receives the first row of the range after it (the last one that of the first).

Defined cases: a null text is empty; an empty text has an empty sketch; two empty sketches have likeness 1, an empty and
another one 0; a text of fewer than five words is one shingle; rows that share a doc_id are ordered by the MD5 of their
text; a row without doc_id stands in no order, and its next document is empty; a lone row is its own next one; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import ascii_lower, let, split_words

K = 64
SHINGLE = 5
RANGES_PER_PARTITION = 4

c = F.col


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all word shingles of a non-null text, repeats included."""
    def hashes(words: Column) -> Column:
        n = F.size(words)
        at = F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))
        each = F.transform(at, lambda i: F.substring(F.md5(F.array_join(F.slice(words, i, size), " ")), 1, 16))
        return F.when(n > 0, each).otherwise(F.array().cast("array<string>"))

    return let(split_words(ascii_lower(text)), hashes)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    return smallest(shingle_hashes(F.coalesce(text, F.lit("")), size), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched sets."""
    return smallest(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's smallest hashes that both hold."""
    return let(merged(a, b, k), lambda u: F.when(F.size(u) > 0, F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)).otherwise(1.0))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    # 52 bits of the k-th smallest hash as a share of all hashes.
    reach = (F.conv(F.substring(F.element_at(a, -1), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(2**52))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds; an empty set is contained in any."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), shared / distinct_count(a, k))).otherwise(1.0)


def as_text(a: Column) -> Column:
    return F.array_join(a, "")


def from_text(fingerprint: Column) -> Column:
    """The sketch that a fingerprint string holds."""
    n = F.floor(F.length(fingerprint) / 16).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(fingerprint, (i - 1) * 16 + 1, F.lit(16)))).otherwise(
        F.array().cast("array<string>"))


def group_sketches(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """Sketch of everything under each key, from the rows' sketches: ``keys`` and ``column``.

    A hash goes on once per key and task, and of these the ``k`` smallest per key and task, so a key with a third of
    all rows sends as little as any other.
    """
    hashes = sketches.select(*keys, F.explode(column).alias("_h")).groupBy(*keys, "_h").agg(F.lit(1).alias("_1"))
    first = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(c("_r") <= k)
    found = first.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))
    empty = sketches.select(*keys).distinct().join(found.select(*(c(x).alias(f"_{x}") for x in keys), column), [
        c(x).eqNullSafe(c(f"_{x}")) for x in keys], "left")
    return empty.select(*keys, F.coalesce(column, F.array().cast("array<string>")).alias(column))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch, and next_text, next_sketch of the following document; null texts are empty."""
    spark = docs.sparkSession
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION
    # n borders of the id range and the first id of each range: bounded by n, whatever the table holds.
    shares = F.array(*(F.lit(i / n) for i in range(1, n)))
    borders = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, F.lit(20 * n))).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, borders)).cast("array<long>"), lambda x: x <= c("doc_id")))
    ids = rows.where("doc_id IS NOT NULL").select("doc_id", part.alias("part"))
    firsts = [r for r in ids.groupBy("part").agg(F.min("doc_id").alias("first")).orderBy("part").collect()]
    numbered = rows.withColumn("part", F.when(c("doc_id").isNotNull(), part).otherwise(-1 - F.monotonically_increasing_id() % n).cast("long"))
    inner = numbered.withColumn("guest", F.lit(False))
    if firsts:
        before = {firsts[i]["first"]: firsts[i - 1]["part"] for i in range(len(firsts))}
        at = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), c("doc_id"))
        guests = rows.where(c("doc_id").isin(list(before))).withColumn("part", at).withColumn("guest", F.lit(True))
        inner = inner.unionByName(guests)
    inner = inner.repartition("part").withColumn("sketch", sketch(c("text")))
    order = Window.partitionBy("part").orderBy("guest", "doc_id", F.md5("text"))
    following = inner.withColumns({x: F.when(c("doc_id").isNotNull(), F.lead(y).over(order)) for x, y in (("next_text", "text"), ("next_sketch", "sketch"))})
    return following.where(~c("guest")).select(
        "doc_id", "text", "sketch", F.coalesce("next_text", F.lit("")).alias("next_text"),
        F.coalesce("next_sketch", F.array().cast("array<string>")).alias("next_sketch"))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_text, both sketches, their likeness, and that to the next document, for every row."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited_text"))
    return rows.withColumn("edited_sketch", sketch(c("edited_text"), k)).select(
        "doc_id", "n_chars", "edited_text", "sketch", "edited_sketch",
        resemblance(c("sketch"), c("edited_sketch"), k).alias("near_edited"), resemblance(c("sketch"), c("next_sketch"), k).alias("near_next"),
        distinct_count(c("sketch"), k).alias("n_distinct"), containment(c("sketch"), c("edited_sketch"), k).alias("kept_share"))
