"""Corpus pipeline: toxic documents go, then exact copies, then near duplicates; what stays is packed.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, table
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.jaccard_join import jaccard_join
from millrace.llm.packing import pack
from millrace.llm.toxicity import fit, without_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; null and empty texts stay."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")), 0.3)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the row with the largest doc_id; of rows that repeat both, one."""
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    found = docs.withColumn("kept_sha256", sha).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("kept_sha256") == F.col("text_sha256")), "left_semi")
    return found.dropDuplicates(["doc_id", "kept_sha256"]).drop("kept_sha256")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least doc_id (null last), of equal ids the one whose text has the
    least SHA-256. Each row is judged by its own text; rows that repeat id and text, which exact dedup has removed, alike."""
    gone = jaccard_join(docs, judged=True).filter("not kept").select(F.col("doc_id").alias("gone_id"), "text_sha256")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = docs.withColumn("near_sha256", sha)
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("near_sha256") == F.col("text_sha256")), "left_anti").drop("near_sha256")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences of at most 4096 tokens."""
    return pack(docs)


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_dedup_stage), ("n-gram Jaccard join", near_dedup_stage), ("best-fit packing", packing_stage)]

#: A network and a tokenizer can't be written in SQL; the test holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``; between them a written table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{k + 1}")
    return docs
