"""Consistent snapshots over an append log of versions, fed in batches or by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def as_of(log: DataFrame, keys: list[str], version: str, at, deleted: str | None = None) -> DataFrame:
    """The newest row of each key among the versions up to ``at``; rows marked ``deleted`` are gone. Aggregated partially
    before the exchange, without a window."""
    rest = [c for c in log.columns if c not in keys]
    latest = log.filter(F.col(version) <= F.lit(at)).groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("latest"))
    out = latest.select(*keys, *(F.col(f"latest.{c}").alias(c) for c in rest))
    return out.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def append(rows: DataFrame, path: str, version: int) -> None:
    """One version of rows into the log, in a folder of its own: a version that is written again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def ingest(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch of a stream to the log under its batch number, exactly once."""
    writer = stream.writeStream.foreachBatch(lambda df, n: append(df, path, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
