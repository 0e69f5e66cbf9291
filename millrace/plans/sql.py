"""The SQL surface: Spark SQL over a catalog, with UNNEST in FROM, prepared statements, inserts and session options."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..sources.catalog import Catalog
from ..sources.sinks import Timings

_UNNEST = re.compile(r"\bUNNEST\s*\(\s*([\w.`]+)\s*\)\s*(?:AS\s+)?(\w+)\s*(?:\(\s*(\w+)\s*\))?", re.IGNORECASE)
_SET = re.compile(r"\s*SET\s+(\w+)\s*=\s*(\w+)\s*;?\s*$", re.IGNORECASE)
# Options of the statement SET.
DEVICES = ("hwmode", "compute", "compute_units", "cu")
DEGREES = ("cpudop", "gpudop")


class Sql:
    """Statements against a catalog's tables, which become temporary views."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.spark, self.options, self.prepared, self.timings = catalog.views(), catalog.spark, {}, {}, Timings()

    def run(self, statement: str, *args, **named) -> DataFrame:
        """Any Spark SQL. ``FROM t, UNNEST(t.items) i`` flattens a collection; ``?`` and ``:name`` are parameters."""
        if m := _SET.match(statement):
            return self.set(m[1].lower(), m[2].lower())
        statement = _UNNEST.sub(lambda m: f"LATERAL explode({m[1]}) AS {m[2]}_({m[3] or m[2]})", statement)
        return self.spark.sql(statement, args=list(args) or named or None)

    def set(self, name: str, value: str) -> DataFrame:
        """Session options. Devices have no meaning here and are only noted; a degree sets the shuffle partitions."""
        if name in DEGREES:
            self.spark.conf.set("spark.sql.shuffle.partitions", str(int(value)))
        elif name not in (*DEVICES, "timings"):
            raise ValueError(f"unknown option {name!r}")
        self.options[name] = value
        if name == "hwmode":
            self.timings.hwmode = value
        return self.spark.createDataFrame([(name, value)], "name string, value string")

    def collect(self, statement: str, *args, **named) -> list:
        """A statement's rows; with ``SET timings = on`` the view SessionTimings has a row about it."""
        if self.options.get("timings") not in ("on", "true", "text", "csv"):
            return self.run(statement, *args, **named).collect()
        rows = self.timings.run(statement[:40], lambda: self.run(statement, *args, **named), statement)
        self.timings.table(self.spark).createOrReplaceTempView("SessionTimings")
        return rows

    def prepare(self, label: str, statement: str) -> None:
        self.prepared[label] = statement

    def execute(self, label: str, *args, **named) -> DataFrame:
        """A prepared statement with parameters; the plan is optimised for each."""
        return self.run(self.prepared[label], *args, **named)

    def explain(self, statement: str) -> str:
        return self.run(statement)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
