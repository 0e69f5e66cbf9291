"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

HUBS = 1000


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``per_key``, which has a row for each key and in ``n`` how many of the ``total`` rows have it.

    Keys with more than a thousandth of all rows, of which there are fewer than ``HUBS``, are broadcast, so rows of a hot
    key stay where they are; only those of other keys are shuffled. ``per_key`` is written once: made from ``rows`` at each
    use, it makes plans, and what they leave in the driver's memory, large. So does a half of the join without keys."""
    if total < HUBS:  # each key has more than a thousandth
        return rows.join(F.broadcast(per_key), key)
    per_key = cut(per_key, "keys")
    hot = F.col("n") > total / HUBS
    if per_key.filter(hot).isEmpty():
        return rows.join(per_key, key)
    hubs = F.broadcast(per_key.filter(hot))
    plain = rows.join(F.broadcast(per_key.filter(hot).select(key)), key, "left_anti")
    return rows.join(hubs, key).unionByName(plain.join(per_key.filter(~hot), key))


def may_have(rows: DataFrame, wanted: DataFrame, key: str, bits: int = 1 << 23) -> DataFrame:
    """``rows`` without most of those whose key isn't among ``wanted``'s, so that a join after it shuffles less.

    A Bloom filter of one hash: at most bits / 64 rows are broadcast, whatever the number of keys."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), {bits}L) & 63 as int))")
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = rows.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(words), "word")
    return found.filter(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for edges (a, b) of longs; nodes without an edge aren't listed.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller ones. Edges never grow in
    number, the rounds grow as the logarithm of the longest path, and nothing is gathered: what the edges of a hub need is
    broadcast to them. Rounds are written to the shared folder. Null ends and loops are left out.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(spread_join(both, least, "u", 2 * mark[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        least = large.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m"))
        small = spread_join(large, least, "u", mark[0])
        # (u, m) from every edge, and (v, m) from those to a neighbour that isn't the least
        edges = cut(small.select(F.col("u"), F.col("m").alias("v")).union(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v"))).distinct()
