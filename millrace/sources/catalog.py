"""Catalogs of tables: name to path, plugin and declared schema."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names and plugin names of catalog files.
TYPES = {"bool": T.BooleanType(), "int": T.IntegerType(), "int64": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "dstring": T.StringType(), "date": T.TimestampNTZType(), "datetime": T.TimestampNTZType()}
COLLECTIONS = ("bag", "list", "set")
CSV_PLUGINS = {"csv": ";", "pm-csv": ";", "pm-tsv": "|"}
PARQUET_PLUGINS = ("block", "distributed-block", "registry-based-block", "gpu", "nvme", "block-remote", "block-local", "block-elastic", "block-elastic-ni", "binary-internal")


def spark_type(kind: dict) -> T.DataType:
    """A catalog type as a Spark type; bag, list and set are arrays."""
    name = kind["type"]
    if name in TYPES:
        return TYPES[name]
    if name == "record":
        return T.StructType([T.StructField(a["attrName"], spark_type(a["type"])) for a in kind["attributes"]])
    if name in COLLECTIONS:
        return T.ArrayType(spark_type(kind["inner"]))
    raise ValueError(f"unknown type {name!r}")


@dataclass
class Entry:
    name: str
    path: str
    plugin: str
    schema: T.StructType | None
    options: dict = field(default_factory=dict)
    constraints: list = field(default_factory=list)
    lines: int | None = None


class Catalog:
    """Tables of a session. ``default`` is what the plugin ``dynamic`` stands for."""

    def __init__(self, spark: SparkSession, root: str = "", default: str = "block"):
        self.spark, self.root, self.default, self.entries = spark, root, default, {}

    def load(self, folder: str) -> Catalog:
        """All catalog.json files under ``folder``."""
        for path in sorted(Path(folder).rglob("catalog.json")):
            for name, entry in json.loads(path.read_text()).items():
                self.add(name, entry)
        return self

    def add(self, name: str, entry: dict) -> Entry:
        """Register an entry of a catalog file; a relation is a bag of records and nothing else."""
        kind = entry["type"]
        if kind["type"] != "bag" or kind["inner"]["type"] != "record":
            raise ValueError(f"{name} isn't a bag of records")
        plugin = dict(entry["plugin"])
        self.entries[name] = e = Entry(name, entry["path"], plugin.pop("type"), spark_type(kind["inner"]), plugin, entry.get("constraints", []), plugin.get("lines") or plugin.get("linehint"))
        return e

    def add_parquet(self, sf_dir: str, *names: str) -> Catalog:
        for n in names:
            self.entries[n] = Entry(n, f"{sf_dir}/{n}.parquet", "block", None)
        return self

    def read(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """The table; only ``columns`` reach the scan."""
        e = self.entries[name]
        plugin = self.default if e.plugin == "dynamic" else e.plugin
        path = e.path if "://" in e.path or e.path.startswith("/") or not self.root else f"{self.root}/{e.path}"
        reader = self.spark.read.schema(e.schema) if e.schema is not None else self.spark.read
        if plugin in CSV_PLUGINS:
            options = {"sep": e.options.get("delimiter", CSV_PLUGINS[plugin]), "header": bool(e.options.get("hasHeader", False)), "mode": "FAILFAST" if e.options.get("strict") else "PERMISSIVE"}
            if not e.options.get("brackets", True):
                options["quote"] = ""
            df = reader.options(**options).csv(path)
        elif plugin == "json":
            df = reader.json(path)
        elif plugin == "jsmn":
            df = reader.option("multiLine", True).json(path)
        elif plugin == "binrow":
            from .binary import read_rows

            df = read_rows(self.spark, path, e.schema)
        elif plugin == "bincol":
            from .binary import read_columns

            df = read_columns(self.spark, path, e.schema)
        elif plugin in PARQUET_PLUGINS:
            df = reader.parquet(path)
        else:
            df = reader.format(plugin).options(**{k: str(v) for k, v in e.options.items()}).load(path)
        return df.select(*columns) if columns else df

    def views(self) -> Catalog:
        """All tables as temporary views."""
        for name in self.entries:
            self.read(name).createOrReplaceTempView(name)
        return self

    def dictionary(self, name: str, column: str, regex: str | None = None) -> DataFrame:
        """A column's distinct values, those that a regular expression matches as a whole."""
        d = self.read(name, [column]).distinct()
        return d if regex is None else d.filter(F.col(column).rlike(f"^(?:{regex})$"))
