"""The training-data pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and reads it again as the next stage's documents.  The first four return the columns of
``documents``; the last adds size, source_size, target, copies and taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, line_dedup, mixing, near_dup, quality
from gridloom.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: failing lines go, and documents that fail go."""
    return quality.clean_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: later repeats of passages go, and documents that consist of nothing else."""
    return line_dedup.dedup_documents(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the document with the smallest id of each group of near copies stays."""
    lost = near_dup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, docs["doc_id"] == F.col("_lost"), "left_anti")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents with the copies that the mix takes."""
    return mixing.mixed_documents(docs)


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("MinHash near-dedup", near_dup_stage),
          ("benchmark decontamination", decontaminate_stage), ("mixing sources", mixing_stage)]

#: Rounding rates to copies of a balanced mix is not expressible in SQL; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
