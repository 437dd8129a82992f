"""Operator 8, fixity audit of web archives by Merkle trees.

Pages become WARC records laid out in archive files; every record has a digest over its bytes, and a leaf hashes the
digest with its offset range.  Sixteen nodes in order are hashed into their parent, level by level, up to one root
per replica.  Replicas with equal roots are equal; otherwise the audit descends level by level into the children of
differing nodes only, down to the records that are changed, moved, missing or surplus.

A record's number comes from its page id, so the loss of one record leaves the numbers of the others, and it moves
only the offsets behind it in its own file.  Files hold a fixed range of numbers, so the running offset is a window
over a bounded number of pages, and every level is one aggregation with at most sixteen rows a group.

Defined cases: a null page_id is numbered by a hash of its content; rows that repeat an id share a leaf, which
lists their digests in order; null url and html count as ''; two empty replicas are equal; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import written

RECORDS_PER_FILE = 64
FANOUT = 16
c = F.col


def warc_record(url: Column, html: Column) -> Column:
    """Text of one WARC response record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
                    F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame) -> DataFrame:
    """(number, page_id, file, offset, length, digest): the records of a replica."""
    record = warc_record(c("url"), c("html"))
    number = F.coalesce(c("page_id").cast("long"), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 40)))
    r = pages.select(number.alias("number"), "page_id", F.floor(number / RECORDS_PER_FILE).cast("long").alias("file"),
                     F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    before = Window.partitionBy("file").orderBy("number", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return r.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def _hashed(items: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(items)), lambda x: F.to_json(x)), ","), 256)


def tree(records: DataFrame, depth: int) -> list[DataFrame]:
    """Levels (k, node) of one replica, leaves first: ``depth`` levels of parents and the root, k 0."""
    leaves = records.groupBy(c("number").alias("k")).agg(_hashed(F.struct("offset", "length", "digest")).alias("node"))
    levels = [written(leaves, "leaves")]
    for level in range(depth + 1):
        k = F.floor(c("k") / FANOUT) if level < depth else F.lit(0)
        levels.append(written(levels[-1].groupBy(k.cast("long").alias("k")).agg(_hashed(F.struct(c("k").alias("i"), "node")).alias("node")), "nodes"))
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(number, status) of every record number at which two ``archive`` tables differ.

    changed: other bytes; moved: the same bytes at another place; missing and surplus: only in one replica.
    """
    far = primary.select("number").union(replica.select("number")).agg(F.max(F.abs("number"))).first()[0] or 0
    depth = 0
    while FANOUT**depth <= far:
        depth += 1
    a, b = tree(primary, depth), tree(replica, depth)

    def differing(one: DataFrame, two: DataFrame) -> DataFrame:
        both = one.unionByName(two).groupBy("k").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
        return both.where("n < 2 OR lo <> hi").select("k")

    suspects = written(differing(a[-1], b[-1]), "suspects")
    for level in range(depth, -1, -1):
        parent = F.floor(c("k") / FANOUT).cast("long") if level < depth else F.lit(0).cast("long")
        under = suspects.select(c("k").alias("_p"))
        inside = [x[level].join(under, parent == c("_p"), "left_semi") for x in (a, b)]
        suspects = written(differing(*inside), "suspects")
    content = lambda r, n: r.groupBy("number").agg(F.sort_array(F.collect_list("digest")).alias(n))
    found = suspects.select(c("k").alias("number"))
    both = found.join(content(primary.join(found, "number", "left_semi"), "one"), "number", "left").join(
        content(replica.join(found, "number", "left_semi"), "two"), "number", "left")
    status = F.when(c("two").isNull(), "missing").when(c("one").isNull(), "surplus").when(c("one") != c("two"), "changed").otherwise("moved")
    return both.select("number", status.alias("status"))


def fixity_report(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of ``primary`` (pages) with its place, digest and status against ``replica``; surplus ones follow.

    page_id, file_no, record_offset, record_length, record_sha256, status.
    """
    one, two = written(archive(primary), "primary"), written(archive(replica), "replica")
    bad = written(audit(one, two), "audit")
    kept = one.join(bad, "number", "left").withColumn("status", F.coalesce("status", F.lit("ok")))
    extra = two.join(bad.where("status = 'surplus'"), "number")
    out = kept.unionByName(extra)
    return out.select("page_id", c("file").alias("file_no"), c("offset").alias("record_offset"), c("length").alias("record_length"),
                      c("digest").alias("record_sha256"), "status")
