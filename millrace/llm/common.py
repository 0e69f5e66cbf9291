"""Helpers shared by the training-data operators: table reads, durable cuts, shipping code to executors."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``; read by Spark alone, so any store it knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Unset (single-machine tests): a temporary one is set; on a cluster,
    where executors don't share one, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage durably: a lost executor costs a re-read, not a recomputation, and values that depend on
    task placement (partition numbers, sampled range bounds) are fixed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't share the driver's module path: once for each session,
    a zip of it in the shared folder. Whole texts are long, so Arrow batches of them are kept to 1000 rows."""
    sc = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > 1000:
        spark.conf.set(rows, "1000")
    if getattr(sc, "_millrace_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted([_PACKAGE / "__init__.py", *(_PACKAGE / "llm").glob("*.py")]):
            z.write(p, str(p.relative_to(_PACKAGE.parent)))
    path = scratch_path(spark, "millrace") + ".zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path)
    sc._millrace_shipped = True


_held: dict = {}


def held(key, make):
    """What a Python worker keeps between tasks: one value, so tables of an earlier stage don't stay beside it."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def inline(spark: SparkSession, columns: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A few constant rows as a part of the plan; no Python data goes through an RDD."""
    structs = [F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, row, strict=True))) for row in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def texts(docs: DataFrame, *more: str, text: str = "text") -> DataFrame:
    """Only ``doc_id``, the columns in ``more`` and ``text`` with nulls as empty: other columns can't clash."""
    return docs.select("doc_id", *more, F.coalesce(F.col(text), F.lit("")).alias("text"))


def crc_mod(col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (null ids count as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(raws: list, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes or characters together."""
    start = held = 0
    for k, raw in enumerate(raws):
        held += len(raw)
        if held >= size:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(raws):
        yield start, len(raws)
