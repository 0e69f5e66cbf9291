"""Sinks: results as CSV or JSON, appends, tables from queries, copy-on-write updates, and the log of query times."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.relation import Relation


def print_to(rel: Relation, path: str, plugin: str = "pm-csv") -> None:
    """Write a result. CSV without header; JSON a record a line."""
    w = rel.df.write.mode("overwrite")
    if plugin in ("pm-csv", "csv"):
        w.option("sep", ",").csv(path)
    elif plugin == "json":
        w.json(path)
    else:
        w.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder of ``spark.checkpoint.dir``; unset, a temporary one, but not on a cluster,
    whose executors each have disks of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def printed(spark: SparkSession, path: str, plugin: str, schema) -> DataFrame:
    """What ``print_to`` wrote."""
    reader = spark.read.schema(schema)
    return reader.option("sep", ",").csv(path) if plugin in ("pm-csv", "csv") else reader.json(path) if plugin == "json" else reader.parquet(path)


def insert_into(rel: Relation, path: str) -> None:
    """Append; columns go by name."""
    spark = rel.df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    full = files.exists(at) and any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(at))
    there = spark.read.parquet(path).columns if full else rel.df.columns
    rel.df.select(*there).write.mode("append").parquet(path)


def create_table_as(rel: Relation, name: str) -> None:
    """CREATE TABLE name AS."""
    rel.df.write.mode("errorifexists").saveAsTable(name)


def update(spark: SparkSession, path: str, where: Column, **values) -> str:
    """Copy-on-write update of a Parquet table: a new version beside it, whose path is returned; readers of the old one
    aren't disturbed, and a job that fails leaves nothing half done."""
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    Relation(spark.read.parquet(path)).update(where, **values).df.write.parquet(new)
    return new


# The columns of the system table of query times, milliseconds each.
TIMES = ("total_time", "planning_time", "plan2json_time", "executor_time", "codegen_time", "dataload_time", "code_opt_time", "code_optnload_time", "execution_time")
TEXTS = ("timestamp", "query", "cmd_type", "hwmode", "plan", "query_name")


class Timings:
    """The log of this session's queries. Spark's phases fill the times: analysis is ``plan2json_time``, optimisation
    ``code_opt_time``, physical planning ``codegen_time``; what Spark doesn't tell apart is null."""

    SCHEMA = ", ".join([*(f"{t} long" for t in TIMES), *(f"{t} string" for t in TEXTS)])

    def __init__(self, hwmode: str = "cpuonly"):
        self.hwmode, self.rows = hwmode, []

    def run(self, label: str, make, query: str | None = None) -> list:
        """Plan and run ``make()``, which gives a DataFrame, once; its rows."""
        began = time.time()
        df = make()
        execution = df._jdf.queryExecution()
        plan = execution.executedPlan().toString()
        planned = time.time()
        rows = df.collect()
        ended = time.time()
        phases = execution.tracker().phases()
        spent = {}
        for phase in ("analysis", "optimization", "planning"):
            found = phases.get(phase)
            spent[phase] = int(found.get().durationMs()) if found.isDefined() else None
        whole, planning, running = (round(1e3 * x) for x in (ended - began, planned - began, ended - planned))
        words = (query or "").split()
        self.rows.append((whole, planning, spent["analysis"], running, spent["planning"], None, spent["optimization"], None, running, time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(began)), query, words[0].upper() if words else "PLAN", self.hwmode, plan, label))
        return rows

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.SCHEMA)
