"""Exact deduplication by a tree merge of sorted digest runs.

Every partition starts as a *run*: its texts' digests, sorted, each with the best identifier seen. Runs then meet in
binomial rounds. A run has an address of ``bits`` bits. In each round the runs whose addresses differ only in the
next ``fan`` bits exchange parts: a run keeps the digests whose own leading bits match its new address and hands the
others on, so each round merges 2**fan runs at once and replaces ``fan`` address bits by digest bits. What meets is
sorted runs one after another, so the sort (a TimSort) is a multiway merge of them; a window over the merged run keeps the
best identifier of each digest and hands it on in order. After ``bits / fan`` rounds, at least two, an address consists of
digest bits alone and every digest is in one place. No round gathers more than its share, and a digest with a third of
all rows takes part with at most one row for each run.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table


def merge_round(runs: DataFrame, bits: int, done: int, keep: str) -> DataFrame:
    """One round: address = the first ``done`` bits of the digest, then the run's own remaining bits."""
    rest = bits - done
    lead = F.shiftright(F.col("lead"), 16 - bits)
    address = F.shiftleft(F.shiftright(lead, rest), rest).bitwiseOR(F.col("run").bitwiseAND(F.lit((1 << rest) - 1)))
    best = F.col("keep_id").desc_nulls_last() if keep == "max" else F.col("keep_id").asc_nulls_last()
    merged = Window.partitionBy("run", "digest", "check").orderBy(best)
    met = runs.withColumn("run", address).repartition("run")
    sized = F.sum("group_size").over(merged.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return met.select("run", "lead", "digest", "check", "keep_id", sized.alias("group_size"), F.row_number().over(merged).alias("nth")).filter("nth = 1").drop("nth")


def exact_dedup(docs: DataFrame, keep: str = "max", bits: int | None = None, fan: int | None = None, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, byte for byte; a null text counts as empty. Identity is verified by SHA-256 and an
    independent 64-bit hash of the text with its length at every level of the merge. Of equal texts the row with the
    largest (``keep="min"``: smallest) doc_id is kept; null ids lose to all others, and of rows that repeat both id and
    text one is kept. Groups without any id have keep_id null and keep one row. An empty table gives no rows; further
    columns are ignored.
    """
    spark = docs.sparkSession
    if bits is None:
        bits = max(2, min(16, math.ceil(math.log2(int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    fan = fan or max(1, min(4, bits // 2))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = (
        docs.select("doc_id", body.alias("body"))
        .select("doc_id", F.unhex(F.sha2("body", 256)).alias("digest"), F.xxhash64("body", F.length("body")).alias("check"))
        .groupBy("doc_id", "digest", "check")
        .agg(F.count(F.lit(1)).alias("times"))
        .sortWithinPartitions("digest", "check")
    )
    rows = cut(rows, "digest-runs")
    runs = rows.select(
        F.spark_partition_id().bitwiseAND(F.lit((1 << bits) - 1)).alias("run"),
        F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int").alias("lead"),
        "digest",
        "check",
        F.col("doc_id").alias("keep_id"),
        F.col("times").alias("group_size"),
    )
    done = 0
    while done < bits:
        done = min(bits, done + fan)
        runs = merge_round(runs, bits, done, keep)
    groups = runs.filter("group_size > 1").select("digest", "check", "keep_id", "group_size")
    found = F.coalesce(F.col("group_size"), F.lit(1))
    copy = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return (
        rows.join(groups, ["digest", "check"], "left")
        .select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), found.cast("long").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"), copy.alias("copy"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies in all documents; the largest doc_id of each group stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
