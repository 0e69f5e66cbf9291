"""k-means over numeric columns by iterated DataFrame aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(df: DataFrame, columns: list[str], centres: list[tuple], name: str = "cluster") -> DataFrame:
    """Each row's nearest centre (Euclidean; ties to the first), as plain arithmetic."""
    distances = [sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(columns, centre, strict=True)), F.lit(0.0)) for centre in centres]
    nearest = F.least(*distances) if len(distances) > 1 else distances[0]
    out = F.lit(len(centres) - 1)
    for k in range(len(centres) - 2, -1, -1):
        out = F.when(distances[k] == nearest, k).otherwise(out)
    return df.withColumn(name, out)


def step(df: DataFrame, columns: list[str], centres: list[tuple]) -> DataFrame:
    """A row for each cluster that has members: cluster, n and its members' means."""
    return assign(df, columns, centres).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in columns))


def k_means(df: DataFrame, columns: list[str], centres: list[tuple], rounds: int = 10, least: float = 1e-9) -> list[tuple]:
    """Centres after at most ``rounds`` rounds; a cluster without members keeps its centre. Only k rows come to the
    driver in each round."""
    for _ in range(rounds):
        moved = {r["cluster"]: tuple(r[c] for c in columns) for r in step(df, columns, centres).collect()}
        new = [moved.get(k, c) for k, c in enumerate(centres)]
        shift = max(abs(a - b) for x, y in zip(new, centres, strict=True) for a, b in zip(x, y, strict=True))
        centres = new
        if shift <= least:
            break
    return centres
