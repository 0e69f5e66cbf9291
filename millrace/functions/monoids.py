"""The monoids that reductions and groupings fold with, by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONOIDS = {
    "sum": F.sum,
    "sum0": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "multiply": F.product,
    "max": F.max,
    "min": F.min,
    "or": F.bool_or,
    "and": F.bool_and,
    "bit_or": F.bit_or,
    "bit_and": F.bit_and,
    "count": F.count,
    "avg": F.avg,
    "bagunion": F.collect_list,
    "union": F.collect_set,
    "append": F.collect_list,
}


def fold(monoid: str, c: Column) -> Column:
    """``c`` folded with a monoid. Nulls don't take part; of nothing, sum is null (sum0: 0), count 0, a bag empty."""
    try:
        return MONOIDS[monoid.lower()](c)
    except KeyError:
        raise ValueError(f"unknown monoid {monoid!r}") from None
