"""Fixed-width binary rows and columns (little-endian), read and written in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_CODES = {"boolean": "u1", "int": "<i4", "bigint": "<i8", "double": "<f8", "float": "<f4"}


def dtype_of(schema: T.StructType) -> np.dtype:
    """The layout of a row; strings have no fixed width and can't be stored."""
    return np.dtype([(f.name, _CODES[f.dataType.simpleString()]) for f in schema])


def _decode(batches: Iterator[pa.RecordBatch], dtype: np.dtype, types: list, first: dict[str, int] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of files; with ``first``, at which position each file's begin, their positions too."""
    for batch in batches:
        for content, path in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            rows = np.frombuffer(content.as_buffer(), dtype)
            for k in range(0, len(rows), 65_536):
                part = rows[k : k + 65_536]
                columns = [pa.array(part[n]).cast(t) for n, t in zip(dtype.names, types, strict=True)]
                if first is None:
                    yield pa.RecordBatch.from_arrays(columns, list(dtype.names))
                else:
                    place = first[path] + k
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(place, place + len(part))), *columns], ["position", *dtype.names])


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files of fixed-width rows: a task for each file (at most 2 GB)."""
    from pyspark.sql.pandas.types import to_arrow_type

    dtype, types = dtype_of(schema), [to_arrow_type(f.dataType) for f in schema]
    return spark.read.format("binaryFile").load(path).select("content", "path").mapInArrow(lambda b: _decode(b, dtype, types), schema)


def read_columns(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file for each attribute, ``path.attr`` (or a folder of files, in the order of their names), joined by position.
    Positions come from the files' lengths, so each file is a task of its own. Only paths and lengths go to the driver."""
    from pyspark.sql.pandas.types import to_arrow_type

    out = None
    for f in schema:
        dtype, kind = dtype_of(T.StructType([f])), [to_arrow_type(f.dataType)]
        files = spark.read.format("binaryFile").load(f"{path}.{f.name}")
        first, at = {}, 0
        for name, length in sorted(map(tuple, files.select("path", "length").collect())):
            first[name], at = at, at + length // dtype.itemsize
        placed = T.StructType([T.StructField("position", T.LongType()), f])
        one = files.select("content", "path").mapInArrow(lambda b, d=dtype, k=kind, n=first: _decode(b, d, k, n), placed)
        out = one if out is None else out.join(one, "position")
    return out.drop("position")
