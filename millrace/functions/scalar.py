"""Scalar expressions. All but ``extern`` compile to built-in JVM expressions; standard SQL semantics (three-valued logic, signed MOD)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | int | float | str | bool | None


def lit(value: Value, kind: str | None = None) -> Column:
    """A constant, of Spark type ``kind`` if given."""
    c = value if isinstance(value, Column) else F.lit(value)
    return c.cast(kind) if kind else c


def field(path: str) -> Column:
    """A column or nested field: ``a.b.c``."""
    return F.col(path)


def record(**fields: Value) -> Column:
    """A record of named fields."""
    return F.struct(*(lit(v).alias(k) for k, v in fields.items()))


def if_(test: Column, then: Value, other: Value = None) -> Column:
    return F.when(test, lit(then)).otherwise(lit(other))


def case(*branches: tuple[Column, Value], other: Value = None) -> Column:
    """n-ary CASE: the first branch whose test holds."""
    out = reduce(lambda c, b: c.when(b[0], lit(b[1])), branches[1:], F.when(branches[0][0], lit(branches[0][1])))
    return out.otherwise(lit(other))


def int_div(a: Column, b: Value) -> Column:
    """Integer division, truncating toward zero; 0 as divisor gives null."""
    b = lit(b)
    return F.when(b == 0, F.lit(None)).otherwise(F.call_function("div", a, F.nullif(b, F.lit(0))))


def div(a: Column, b: Value) -> Column:
    """Division as doubles; 0 as divisor gives null."""
    return F.try_divide(a.cast("double"), lit(b).cast("double"))


def mod(a: Column, b: Value) -> Column:
    """Remainder with the sign of the dividend; 0 as divisor gives null."""
    return F.try_mod(a, lit(b))


def shift_left(a: Column, n: int) -> Column:
    return F.shiftleft(a, n)


def shift_right(a: Column, n: int) -> Column:
    return F.shiftright(a, n)


def shift_right_logical(a: Column, n: int) -> Column:
    return F.shiftrightunsigned(a, n)


def xor(a: Column, b: Value) -> Column:
    return a.bitwiseXOR(lit(b))


def largest(*args: Column) -> Column:
    return F.greatest(*args)


def smallest(*args: Column) -> Column:
    return F.least(*args)


def hash_of(*args: Column) -> Column:
    """A 64-bit hash, for routing only: the value is no part of any result."""
    return F.xxhash64(*args)


def rand(seed: int | None = None) -> Column:
    return F.rand(seed)


def hint(c: Column, selectivity: float) -> Column:
    """An expected selectivity. Spark measures at run time, so the expression is unchanged."""
    assert 0 <= selectivity <= 1
    return c


_UNITS = {
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "day": F.dayofmonth,
    "week": F.weekofyear,
    "dow": F.dayofweek,
    "doy": F.dayofyear,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "decade": lambda c: F.floor(F.year(c) / 10),
    "century": lambda c: F.floor((F.year(c) + 99) / 100),
    "millennium": lambda c: F.floor((F.year(c) + 999) / 1000),
    "millisecond": lambda c: F.pmod(F.unix_millis(c.cast("timestamp")), F.lit(1000)),
    "isodow": lambda c: F.weekday(c) + 1,
    "isoyear": lambda c: F.extract(F.lit("YEAROFWEEK"), c),
}


def extract(unit: str, c: Column) -> Column:
    """A date part as int. dow: Sunday is 1. isodow: Monday is 1. millisecond: within the second."""
    return _UNITS[unit.lower().replace("_", "")](c).cast("int")


def extern(name: str, *args: Value) -> Column:
    """A call of a function the session knows: a registered UDF or a built-in."""
    return F.call_function(name, *map(lit, args))


def like(c: Column, pattern: str) -> Column:
    return c.like(pattern)


def between(c: Column, low: Value, high: Value) -> Column:
    return c.between(low, high)


def one_of(c: Column, *values: Value) -> Column:
    return c.isin(*values)
