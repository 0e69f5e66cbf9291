"""A fluent builder of relations over DataFrames. Every step only extends the logical plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.monoids import fold

Expr = Column | str

#: Physical strategies by name, as Spark's join hints; None leaves the choice to Spark.
STRATEGIES = {"hash": None, "morsel": "shuffle_hash", "partitioned": "shuffle_hash", "radix": "shuffle_hash", "out_of_memory": "merge", "broadcast": "broadcast", "default": None}


def size_of(df: DataFrame) -> int:
    """Spark's own estimate of a plan's size in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hinted(df: DataFrame, strategy: str | None, most_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with a join hint. A hash table of a partition must fit in memory, so shuffle_hash is only asked for if there
    are at most ``most_bytes`` a shuffle partition; beyond, Spark chooses."""
    if not strategy or strategy == "shuffle_hash" and size_of(df) > most_bytes * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.hint(strategy)


def col(e: Expr) -> Column:
    return F.col(e) if isinstance(e, str) else e


class Bitmap:
    """A Bloom filter of one hash over a power of two of places: rows of (word, bits), at most size / 64 of them, whatever
    was built into it, so it may always be broadcast."""

    def __init__(self, words: DataFrame, size: int):
        self.words, self.size = words, size

    @staticmethod
    def place(key: Column, size: int) -> Column:
        return F.xxhash64(key).bitwiseAND(F.lit(size - 1))

    def repack(self, size: int) -> Bitmap:
        """The same filter in fewer places (a power of two): halves are laid over one another."""
        if size > self.size or size < 64 or size & (size - 1):
            raise ValueError("a filter is repacked to a smaller power of two, 64 at least")
        word = F.col("word").bitwiseAND(F.lit(size // 64 - 1))
        return Bitmap(self.words.groupBy(word.alias("word")).agg(F.bit_or("bits").alias("bits")), size)


class Relation:
    """A bag of records."""

    def __init__(self, df: DataFrame):
        self.df = df

    # sources
    @classmethod
    def scan(cls, spark: SparkSession, sf_dir: str, name: str, attrs: Sequence[str] | None = None) -> Relation:
        """A Parquet table's columns ``attrs`` (all if None)."""
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return cls(df.select(*attrs) if attrs else df)

    @classmethod
    def values(cls, spark: SparkSession, rows: Sequence[tuple], schema: str) -> Relation:
        return cls(spark.createDataFrame(list(rows), schema))

    # projection and filter
    def project(self, *exprs: Expr, **named: Expr) -> Relation:
        return Relation(self.df.select(*map(col, exprs), *(col(e).alias(n) for n, e in named.items())))

    def with_columns(self, **named: Expr) -> Relation:
        return Relation(self.df.withColumns({n: col(e) for n, e in named.items()}))

    def filter(self, predicate: Expr) -> Relation:
        return Relation(self.df.filter(predicate))

    def not_null(self, e: Expr) -> Relation:
        """Rows whose expression isn't null."""
        return Relation(self.df.filter(col(e).isNotNull()))

    def hint_row_count(self, n: int) -> Relation:
        """An expected row count. AQE measures it, so the plan is unchanged."""
        assert n >= 0
        return self

    def alias(self, name: str) -> Relation:
        return Relation(self.df.alias(name))

    # joins
    def join(self, build: Relation, probe_keys: Sequence[str] | str, build_keys: Sequence[str] | str | None = None, strategy: str = "default", kind: str = "inner", residual: Column | None = None) -> Relation:
        """Equi-join with ``build``, further restricted by ``residual``. Build keys of other names are kept as columns.

        ``kind`` other than inner (left, right, full, semi, anti) goes beyond what the builder's plans need.
        """
        probe_keys = [probe_keys] if isinstance(probe_keys, str) else list(probe_keys)
        build_keys = probe_keys if build_keys is None else [build_keys] if isinstance(build_keys, str) else list(build_keys)
        built = hinted(build.df, STRATEGIES[strategy])
        on: Column | list[str] = probe_keys
        if probe_keys != build_keys or residual is not None:
            on = F.lit(True)
            for p, b in zip(probe_keys, build_keys, strict=True):
                on = on & (self.df[p] == built[b])
            if residual is not None:
                on = on & residual
        return Relation(self.df.join(built, on, {"semi": "left_semi", "anti": "left_anti"}.get(kind, kind)))

    def exists_in(self, other: Relation, keys: Sequence[str] | str, other_keys: Sequence[str] | str | None = None) -> Relation:
        """Rows with a match: IN and EXISTS."""
        return self.join(other, keys, other_keys, kind="semi")

    def bloom_filter(self, build: Relation, key: str, build_key: str | None = None) -> Relation:
        """Rows whose key the build side may have. No match is lost and a collision may stay, so a join follows."""
        return self.bloom_probe(build.bloom_build(build_key or key), key)

    def bloom_build(self, key: Expr, size: int = 1 << 22) -> Bitmap:
        """A filter of ``size`` places (a power of two) over the keys; null keys have none."""
        if size < 64 or size & (size - 1):
            raise ValueError("a filter has a power of two of places, 64 at least")
        place = self.df.filter(col(key).isNotNull()).select(Bitmap.place(col(key), size).alias("place"))
        bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
        return Bitmap(place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")), size)

    def bloom_probe(self, bitmap: Bitmap, key: Expr) -> Relation:
        """Rows whose key's place is set."""
        words = bitmap.words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
        place = Bitmap.place(col(key), bitmap.size)
        df = self.df.filter(col(key).isNotNull()).withColumn("__place", place)
        found = df.join(F.broadcast(words), F.shiftright("__place", 6) == F.col("__word"))
        return Relation(found.filter(F.expr("__bits & shiftleft(1L, cast(__place & 63 as int)) <> 0")).drop("__word", "__bits", "__place"))

    # aggregation
    def reduce(self, **folds: tuple[str, Expr]) -> Relation:
        """One row: name = (monoid, expression)."""
        return Relation(self.df.agg(*(fold(m, col(e)).alias(n) for n, (m, e) in folds.items())))

    def groupby(self, keys: Sequence[Expr], **folds: tuple[str, Expr]) -> Relation:
        """A row for each group: Spark aggregates partially before the exchange and finally after it."""
        return Relation(self.df.groupBy(*map(col, keys)).agg(*(fold(m, col(e)).alias(n) for n, (m, e) in folds.items())))

    def nest(self, keys: Sequence[Expr], where: Column | None = None, null_of: Expr | None = None, **folds: tuple[str, Expr]) -> Relation:
        """Group-by that takes only rows where ``where`` holds and ``null_of`` isn't null; other groups vanish."""
        df = self.df
        if where is not None:
            df = df.filter(where)
        if null_of is not None:
            df = df.filter(col(null_of).isNotNull())
        return Relation(df).groupby(keys, **folds)

    # order
    def sort(self, *keys: Expr | tuple[Expr, str]) -> Relation:
        """Keys as expressions (ascending) or (expression, ASC | DESC | NONE); NONE only carries."""
        order = []
        for k in keys:
            e, direction = k if isinstance(k, tuple) else (k, "ASC")
            if direction.upper() != "NONE":
                order.append(col(e).desc() if direction.upper() == "DESC" else col(e).asc())
        return Relation(self.df.orderBy(*order))

    def limit(self, n: int, offset: int = 0) -> Relation:
        return Relation(self.df.offset(offset).limit(n) if offset else self.df.limit(n))

    # nested data
    def unnest(self, path: str, name: str, predicate: Column | None = None) -> Relation:
        """A row for each item of a collection."""
        out = self.df.withColumn(name, F.explode(path))
        return Relation(out if predicate is None else out.filter(predicate))

    def outer_unnest(self, path: str, name: str, predicate: Callable[[Column], Column] | None = None) -> Relation:
        """As unnest, but a collection without (matching) items, or null, gives one row with a null item."""
        items = F.col(path) if predicate is None else F.filter(path, predicate)
        return Relation(self.df.withColumn(name, F.explode_outer(items)))

    # sets and dataflow
    def union_all(self, *others: Relation) -> Relation:
        out = self.df
        for o in others:
            out = out.unionByName(o.df)
        return Relation(out)

    def split(self, alternatives: int, by: Expr, at: str | None = None) -> list[Relation]:
        """Disjoint parts by a hash of ``by`` that together are the whole. Each part runs the input again, unless ``at``
        names a folder to write it to once, by part, so that a part reads only its own files."""
        return self._parts(F.pmod(F.xxhash64(col(by)), F.lit(alternatives)).cast("int"), alternatives, at)

    def _parts(self, part: Column, n: int, at: str | None) -> list[Relation]:
        df = self.df.withColumn("__part", part)
        if at is not None:
            df.write.partitionBy("__part").parquet(at)
            df = df.sparkSession.read.schema(df.schema).parquet(at).select(*df.columns)
        return [Relation(df.filter(F.col("__part") == k).drop("__part")) for k in range(n)]

    def gsplit(self, *paths: tuple[Expr, Callable[[Relation], Relation]], at: str | None = None) -> Relation:
        """Each row takes the first of ``paths`` (condition, operators) whose condition holds, and what the paths give
        comes together; rows that fit none are left out. ``at`` as in ``split``."""
        route = F.lit(-1)
        for k, (condition, _) in reversed([*enumerate(paths)]):
            route = F.when(F.expr(condition) if isinstance(condition, str) else condition, k).otherwise(route)
        first, *rest = [path(part) for part, (_, path) in zip(self._parts(route, len(paths), at), paths, strict=True)]
        return first.union_all(*rest)

    def router(self, targets: int, by: Expr | None = None) -> Relation:
        """Dealt to ``targets`` partitions, by a hash of ``by`` or evenly."""
        return Relation(self.df.repartition(targets) if by is None else self.df.repartition(targets, col(by)))

    def hash_pack(self, buckets: int, by: Expr, bucket: str | None = None) -> Relation:
        """Dealt by bucket, which ``bucket`` names as a column."""
        out = self.df.repartition(buckets, col(by))
        return Relation(out.withColumn(bucket, F.pmod(F.hash(col(by)), F.lit(buckets))) if bucket else out)

    def broadcast(self, most_bytes: int = 64 << 20) -> Relation:
        """Marked for broadcast if Spark's own estimate of its size is at most ``most_bytes``; unchanged beyond."""
        return Relation(F.broadcast(self.df)) if size_of(self.df) <= most_bytes else self

    def pack(self) -> Relation:
        """Blocks and tuples are Spark's matter."""
        return self

    unpack = pack

    def update(self, where: Column, **values: Expr) -> Relation:
        """Copy on write: the relation with ``values`` where ``where`` holds."""
        return Relation(self.df.withColumns({n: F.when(where, col(e)).otherwise(F.col(n)) for n, e in values.items()}))
