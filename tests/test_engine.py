import json
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import scalar as X
from millrace.operators import kmeans
from millrace.operators.relation import Relation
from millrace.plans.json_plan import Interpreter, PlanError
from millrace.plans.sql import Sql
from millrace.sources.catalog import Catalog
from millrace.sources.sinks import Timings, create_table_as, insert_into, print_to, update
from millrace.streaming.snapshots import append, as_of, ingest, read_log

from .conftest import rows

# Small tables and their rows, to which the expected results below belong.
SAILORS = [
    "22;Dustin;7;45",
    "29;Brutus;1;33",
    "31;Lubber;8;55.5",
    "32;Andy;8;25.5",
    "58;Rusty;10;35",
    "64;Horatio;7;35",
    "71;Zorba;10;16",
    "74;Horatio;9;35",
    "85;Art;3;25.5",
    "95;Bob;3;63.5",
]
RESERVES = [
    "22;101;Monday",
    "22;102;Monday",
    "22;103;Tuesday",
    "22;104;Tuesday",
    "31;102;Wednesday",
    "31;103;Wednesday",
    "31;104;Thursday",
    "64;101;Thursday",
    "64;102;Friday",
    "74;103;Friday",
]
BOATS = [
    "101;Interlake;blue",
    "102;Interlake;red",
    "103;Clipper;green",
    "104;Marine;red",
]
EMPLOYEES = [("John", 20, [("Huey", 101), ("Lewey", 11), ("Dewey", 12)]), ("Doe", 48, [("Tom", 22), ("Jerry", 9)]), ("Ma", 66, [("Joe", 50), ("Jack", 40), ("William", 41), ("Averel", 52), ("John", 66)]), ("None", 30, []), ("Null", 31, None)]


def entry(path, plugin, **attrs):
    inner = {"type": "record", "attributes": [{"type": t if isinstance(t, dict) else {"type": t}, "relName": path, "attrName": n} for n, t in attrs.items()]}
    return {"path": path, "type": {"type": "bag", "inner": inner}, "plugin": plugin}


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("inputs")
    for name, lines in (("sailors", SAILORS), ("reserves", RESERVES), ("boats", BOATS)):
        (d / f"{name}.csv").write_text("\n".join(lines) + "\n")
    children = {"type": "list", "inner": {"type": "record", "attributes": [{"attrName": "name", "type": {"type": "string"}}, {"attrName": "age2", "type": {"type": "int"}}]}}
    (d / "employees.json").write_text("\n".join(json.dumps({"name": n, "age": a, "children": None if c is None else [{"name": x, "age2": y} for x, y in c]}) for n, a, c in EMPLOYEES))
    (d / "whole.json").write_text(json.dumps([{"a": 1, "c": [{"c1": 5}]}, {"a": 2, "c": []}]))
    (d / "rows.bin").write_bytes(b"".join(struct.pack("<iqd", k, k * 10, k / 2) for k in range(70_000)))
    for name, code in (("x", "i"), ("y", "d")):
        (d / f"cols.{name}").write_bytes(struct.pack(f"<5{code}", *range(5)))
    csv = {"type": "csv", "brackets": False, "lines": 10, "delimiter": ";", "policy": 2}
    files = {
        "sailors": entry("sailors.csv", csv, sid="int", sname="string", rating="int", age="float"),
        "reserves": entry("reserves.csv", csv, sid="int", bid="int", day="string"),
        "boats": entry("boats.csv", csv, bid="int", bname="string", color="string"),
        "employees": entry("employees.json", {"type": "json", "lines": 5}, name="string", age="int", children=children),
        "whole": entry("whole.json", {"type": "jsmn", "lines": 2}, a="int", c={"type": "list", "inner": {"type": "record", "attributes": [{"attrName": "c1", "type": {"type": "int"}}]}}),
        "fixed": entry("rows.bin", {"type": "binrow"}, k="int", w="int64", f="float"),
        "cols": entry("cols", {"type": "bincol"}, x="int", y="float"),
    }
    (d / "catalog.json").write_text(json.dumps(files))
    return Catalog(spark, str(d)).load(str(d))


def rel(catalog, name):
    return Relation(catalog.read(name))


def test_catalog_rejects_what_is_no_relation(catalog):
    with pytest.raises(ValueError):
        catalog.add("x", {"path": "x", "type": {"type": "int"}, "plugin": {"type": "csv"}})


def test_golden_reductions(catalog):
    s = rel(catalog, "sailors")
    folds = {"hi": ("max", "sid"), "total": ("sum", "sid"), "n": ("count", F.lit(1))}
    assert rows(s.reduce(**folds).df) == [(95, 561, 10)]
    assert rows(s.filter("age > 40").reduce(**folds).df) == [(95, 148, 3)]
    assert rows(rel(catalog, "boats").reduce(hi=("max", "bid"), total=("sum", "bid"), n=("count", "bid")).df) == [(104, 410, 4)]
    assert rows(s.filter("age > 40").project("sid", "age").df) == [(22, 45.0), (31, 55.5), (95, 63.5)]


def test_golden_joins_and_nest(catalog):
    j = rel(catalog, "sailors").join(rel(catalog, "reserves"), "sid").join(rel(catalog, "boats"), "bid")
    assert rows(j.reduce(hi=("max", "sid"), total=("sum", "sid"), n=("count", F.lit(1))).df) == [(74, 383, 10)]
    n = rel(catalog, "reserves").nest(["sid"], n=("count", F.lit(1)), hi=("max", "bid"))
    assert rows(n.df) == [(22, 4, 104), (31, 3, 104), (64, 2, 102), (74, 1, 103)]


@pytest.mark.parametrize("strategy", ["hash", "morsel", "partitioned", "radix", "out_of_memory", "broadcast"])
def test_join_strategies_agree(catalog, strategy):
    assert rel(catalog, "sailors").join(rel(catalog, "reserves"), "sid", strategy=strategy).df.count() == 10


def test_unnest(catalog):
    e = rel(catalog, "employees")
    assert [r[0] for r in e.unnest("children", "c").project(a="c.age2").df.collect()] == [101, 11, 12, 22, 9, 50, 40, 41, 52, 66]
    assert e.unnest("children", "c", F.col("c.age2") > 40).df.count() == 5
    outer = e.outer_unnest("children", "c", lambda c: c["age2"] > 60).project("name", a="c.age2")
    assert rows(outer.df) == [("Doe", None), ("John", 101), ("Ma", 66), ("None", None), ("Null", None)]
    assert Sql(catalog).run("SELECT e.name, c.age2 FROM employees e, UNNEST(e.children) c WHERE c.age2 > 60").count() == 2
    assert rows(Relation(catalog.read("whole")).unnest("c", "i").project("a", c="i.c1").df) == [(1, 5)]


def test_binary_sources(catalog):
    assert catalog.read("fixed").agg(F.count("k"), F.sum("w"), F.sum("f")).first() == (70_000, 24_499_650_000, 1_224_982_500.0)
    assert rows(catalog.read("cols")) == [(k, float(k)) for k in range(5)]


def attr(r, n, **more):
    return {"expression": "recordProjection", "e": {"expression": "argument"}, "attribute": {"relName": r, "attrName": n}} | more


def scan(r, *names):
    return {"operator": "scan", "plugin": {"name": r, "type": "csv", "projections": [{"relName": r, "attrName": n} for n in names]}}


def test_json_plans(catalog):
    run = Interpreter(catalog, [8]).run
    join = {"operator": "join", "p": {"expression": "eq", "left": attr("sailors", "sid"), "right": attr("reserves", "sid")}, "leftInput": scan("sailors", "sid", "rating"), "rightInput": scan("reserves", "sid", "bid")}
    where = {"operator": "select", "p": {"expression": "ge", "left": attr("sailors", "rating"), "right": {"expression": "placeholder", "index": 0}}, "input": join}
    out = run({"operator": "reduce", "accumulator": ["sum", "max"], "e": [attr("reserves", "bid"), attr("sailors", "rating")], "input": where})
    assert rows(out) == [(102 + 103 + 104 + 103, 9)] and out.columns == ["sum_bid", "max_rating"]
    nest = {"operator": "nest", "f": {"expression": "recordConstruction", "attributes": [{"name": "sid", "e": attr("reserves", "sid")}]}, "g": attr("reserves", "sid"), "p": {"expression": "bool", "v": True}, "e": [{"expression": "int", "v": 1}, attr("reserves", "bid")], "accumulator": ["sum", "max"], "aggrLabels": ["n", "hi"], "input": scan("reserves", "sid", "bid")}
    assert rows(run(nest)) == [(22, 4, 104), (31, 3, 104), (64, 2, 102), (74, 1, 103)]
    un = {"operator": "outer_unnest", "p": {"expression": "gt", "left": {"expression": "recordProjection", "e": attr("employees", "c"), "attribute": {"attrName": "age2"}}, "right": {"expression": "int", "v": 60}}, "path": {"name": "c", "e": attr("employees", "children")}, "input": {"operator": "scan", "plugin": {"name": "employees"}}}
    assert run(un).count() == 5
    part = {"operator": "split", "split_id": 1, "numOfParents": 2, "input": scan("sailors", "sid")}
    both = {"operator": "union-all", "input": [part, {"operator": "router", "numOfParents": 3, "input": {"operator": "pack", "input": part}}]}
    assert run({"operator": "reduce", "accumulator": ["sum"], "e": [attr("sailors", "sid")], "input": both}).first()[0] == 561
    calc = {"operator": "project", "input": {"operator": "values", "relName": "v", "values": [{"attrName": "a", "type": {"type": "int"}, "v": [7, -7]}]}, "e": [{"expression": "div", "left": attr("v", "a"), "right": {"expression": "int", "v": 2}}, {"expression": "mod", "left": attr("v", "a"), "right": {"expression": "int", "v": 2}}, {"expression": "neg", "e": attr("v", "a")}, {"expression": "if", "cond": {"expression": "is_null", "e": attr("v", "a")}, "then": {"expression": "int", "v": 0}, "else": {"expression": "cast", "type": {"type": "float"}, "e": attr("v", "a")}}]}
    assert rows(run(calc)) == [(-3, -1, 7, -7.0), (3, 1, -7, 7.0)]
    hashed = {"operator": "hash-rearrange", "buckets": 3, "e": attr("sailors", "sid"), "hashProject": {"relName": "sailors", "attrName": "h"}, "input": {"operator": "sort", "e": [{"direction": "DESC", "expression": attr("sailors", "sid")}], "input": scan("sailors", "sid")}}
    assert {r.h for r in run(hashed).collect()} <= {0, 1, 2}
    assert rows(run({"operator": "dict-scan", "relName": "boats", "attrName": "color", "regex": "r.*"})) == [("red",)]
    with pytest.raises(PlanError):
        run({"operator": "teleport"})


def test_scalar_traps(spark):
    df = spark.sql("SELECT * FROM VALUES (-7, 2), (7, 0), (CAST(NULL AS INT), 3) AS t(a, b)")
    out = df.select(X.int_div(F.col("a"), F.col("b")), X.mod(F.col("a"), F.col("b")), X.if_(F.col("a") > 0, "p", "n"))
    assert out.collect() == [(-3, -1, "n"), (None, None, "p"), (None, None, "n")]
    ts = spark.sql("SELECT TIMESTAMP_NTZ '2001-01-07 13:14:15.678' AS t")
    assert tuple(ts.select(*(X.extract(u, F.col("t")) for u in ("dow", "doy", "century", "millennium", "millisecond", "week", "iso_year"))).first()) == (1, 7, 21, 3, 678, 1, 2001)


def test_extern_calls(spark, catalog):
    spark.udf.register("twice_and", lambda a, b: None if a is None else 2 * a + b, "long")
    df = spark.sql("SELECT * FROM VALUES (3L), (CAST(NULL AS BIGINT)) AS t(a)")
    assert df.select(X.extern("twice_and", F.col("a"), 1), X.extern("abs", -2)).collect() == [(7, 2), (None, 2)]
    call = {"expression": "extern", "name": "twice_and", "args": [{"expression": "int", "v": 3}, {"expression": "int", "v": 4}]}
    assert df.select(Interpreter(catalog).expression(call, df)).first()[0] == 10


def test_sinks(spark, catalog, tmp_path):
    s = rel(catalog, "sailors")
    print_to(s, str(tmp_path / "c"))
    assert spark.read.schema(s.df.schema).csv(str(tmp_path / "c")).count() == 10
    print_to(s, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 10
    insert_into(s, str(tmp_path / "t"))
    insert_into(s.project("age", "rating", "sname", "sid"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.sum("sid")).first()[0] == 1122
    new = update(spark, str(tmp_path / "t"), F.col("sid") == 22, age=F.lit(0.0))
    assert spark.read.parquet(new).filter("age = 0").count() == 2 and spark.read.parquet(str(tmp_path / "t")).filter("age = 0").count() == 0
    create_table_as(s, "made")
    assert spark.table("made").count() == 10
    spark.sql("DROP TABLE made")
    log = Timings()
    assert len(log.run("all", lambda: s.df)) == 10
    assert len(log.run("all", lambda: s.df, "select * from sailors")) == 10
    r = log.table(spark).filter("query is not null").first()
    assert len(log.table(spark).columns) == 15 and (r.cmd_type, r.query_name) == ("SELECT", "all") and 0 <= r.execution_time <= r.total_time


def test_sql_surface(spark, catalog):
    s = Sql(catalog)
    s.prepare("older", "SELECT sid FROM sailors WHERE age > :age")
    assert rows(s.execute("older", age=40)) == [(22,), (31,), (95,)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    s.run("SET cpudop = 3")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert s.run("SET hwmode = gpu").count() == 1
    with pytest.raises(ValueError):
        s.run("SET nothing = 1")


def test_snapshots(spark, tmp_path):
    log = str(tmp_path / "log")
    for v, data in enumerate([[(1, "a", False)], [(1, "b", False), (2, "c", False)], [(2, "c", True)]]):
        append(spark.createDataFrame(data, "k int, v string, gone boolean"), log, v)
    df = read_log(spark, log)
    assert rows(as_of(df, ["k"], "version", 0).select("k", "v")) == [(1, "a")]
    assert rows(as_of(df, ["k"], "version", 1).select("k", "v")) == [(1, "b"), (2, "c")]
    assert rows(as_of(df, ["k"], "version", 2, "gone").select("k", "v")) == [(1, "b")]
    source = str(tmp_path / "in")
    spark.range(10).write.parquet(source)
    ingest(spark.readStream.schema("id long").parquet(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert read_log(spark, str(tmp_path / "out")).count() == 10


def test_k_means(spark):
    df = spark.createDataFrame([(x, y) for x in (0.0, 0.2) for y in (0.0, 0.2)] + [(x, y) for x in (9.0, 9.2) for y in (9.0, 9.2)], "x double, y double")
    assert [tuple(round(v, 6) for v in c) for c in kmeans.k_means(df, ["x", "y"], [(1.0, 0.0), (2.0, 2.0)])] == [(0.1, 0.1), (9.1, 9.1)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.integers(-5, 5), st.one_of(st.none(), st.integers(-100, 100))), max_size=30), n=st.integers(1, 4))
def test_dataflow_keeps_rows(spark, data, n):
    r = Relation(spark.createDataFrame(data, "k int, v int"))
    first, *rest = r.split(n, "k")
    assert rows(first.union_all(*rest).df) == rows(r.df)
    grouped = r.groupby(["k"], n=("count", F.lit(1)), s=("sum", "v"))
    assert rows(r.router(3, "k").groupby(["k"], n=("count", F.lit(1)), s=("sum", "v")).df) == rows(grouped.df)
    build = Relation(r.df.filter("v > 0").select(F.col("k").alias("b")))
    exact = rows(r.exists_in(build, "k", "b").df)
    assert set(exact) <= set(rows(r.bloom_filter(build, "k", "b").df))


def test_plans(spark):
    d = "/root/testdata/sf0.001"
    line, nation = Relation.scan(spark, d, "lineitem"), Relation.scan(spark, d, "nation")
    plan = lambda r: r.df._jdf.queryExecution().executedPlan().toString()
    small = plan(line.filter("l_quantity < 10").project("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity" in small and "l_comment" not in small
    assert plan(line.groupby(["l_suppkey"], n=("sum", "l_linenumber"))).count("HashAggregate") == 2
    assert "BroadcastHashJoin" in plan(Relation.scan(spark, d, "customer").join(nation.broadcast(), "c_nationkey", "n_nationkey"))
    assert "ShuffledHashJoin" in plan(line.join(Relation.scan(spark, d, "orders"), "l_orderkey", "o_orderkey", "radix"))


@pytest.mark.parametrize("size", [64, 1 << 12])
def test_bloom_filters_lose_no_match(spark, size):
    build = Relation(spark.range(0, 3000, 7).withColumnRenamed("id", "k").union(spark.sql("SELECT CAST(NULL AS BIGINT)")))
    probe = Relation(spark.range(3000).selectExpr("id AS k", "id AS word", "id AS bits"))
    bitmap = build.bloom_build("k", size)
    wanted = {k for k in range(0, 3000, 7)}
    kept = {r.k for r in probe.bloom_probe(bitmap, "k").df.collect()}
    assert wanted <= kept and bitmap.words.count() <= size // 64
    if size > 64:
        small = bitmap.repack(size // 4)
        assert len(kept) < 1000 and kept <= {r.k for r in probe.bloom_probe(small, "k").df.collect()} and small.words.count() <= size // 256
        assert {tuple(r) for r in small.words.collect()} == {tuple(r) for r in build.bloom_build("k", size // 4).words.collect()}
    with pytest.raises(ValueError):
        build.bloom_build("k", 100)
    with pytest.raises(ValueError):
        bitmap.repack(2 * size)
    assert probe.bloom_probe(Relation(build.df.limit(0)).bloom_build("k", 64), "k").df.count() == 0


def test_split_writes_its_input_once(spark, tmp_path):
    r = Relation(spark.range(100).selectExpr("id", "CAST(id % 3 AS INT) AS m"))
    parts = r.split(4, "id", at=str(tmp_path / "split"))
    assert sum(p.df.count() for p in parts) == 100 and parts[0].df.columns == ["id", "m"]
    assert "PartitionFilters: [isnotnull(__part" in parts[0].df._jdf.queryExecution().executedPlan().toString()
    got = r.gsplit(("m = 0", lambda p: p.project("id")), (F.col("id") > 50, lambda p: p.filter("id < 60").project("id")))
    assert rows(got.df) == rows(spark.range(100).filter("id % 3 = 0 OR id > 50 AND id < 60"))


def test_hash_tables_are_only_asked_for_under_a_size(spark):
    r = Relation(spark.range(1000).selectExpr("id AS k", "id AS v"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan(r.join(r.project("k", w="v"), "k", strategy="radix").df)
    from millrace.operators.relation import hinted

    assert "ShuffledHashJoin" not in plan(r.df.join(hinted(r.df, "shuffle_hash", 10), "k"))


def test_json_outer_unnest_reads_its_input_once(spark, catalog):
    arg = {"expression": "argument", "argNo": 0}
    proj = lambda e, rel_, a: {"expression": "recordProjection", "e": e, "attribute": {"relName": rel_, "attrName": a}}
    age = proj(proj(arg, "employees", "c"), "employees", "age2")
    test = {"expression": "gt", "left": age, "right": {"expression": "int", "v": 45}}
    plan = {"operator": "outer_unnest", "path": {"name": "c", "e": proj(arg, "employees.json", "children")}, "p": test, "input": {"operator": "scan", "plugin": {"name": "employees"}}}
    plan["path"]["e"]["attribute"]["relName"] = "employees"
    df = Interpreter(catalog).run(plan)
    assert sorted((r.name, r.c and r.c.age2) for r in df.collect()) == [("Doe", None), ("John", 101), ("Ma", 50), ("Ma", 52), ("Ma", 66), ("None", None), ("Null", None)]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_binary_columns_of_many_files(spark, tmp_path):
    for name, code in (("x", "i"), ("y", "d")):
        (tmp_path / f"t.{name}").mkdir()
        for part, many in enumerate((3, 0, 70_000, 5) if name == "x" else (70_008,)):
            start = (0, 3, 3, 70_003)[part]
            (tmp_path / f"t.{name}" / f"{part}.bin").write_bytes(struct.pack(f"<{many}{code}", *range(start, start + many)))
    c = Catalog(spark, str(tmp_path))
    c.add("t", entry("t", {"type": "bincol"}, x="int", y="float"))
    df = c.read("t")
    assert df.count() == 70_008 and df.filter("x <> y").count() == 0


def test_only_a_missing_package_is_passed_over(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as e

    real = builtins.__import__

    def without(missing):
        def load(name, *args, **more):
            if name.startswith(missing):
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return real(name, *args, **more)

        return load

    try:
        with monkeypatch.context() as m:
            m.setattr(builtins, "__import__", without("corpus_pipeline"))
            assert not any(n.startswith("op") or n == "pipeline" for n in importlib.reload(e).queries())
        with monkeypatch.context() as m:
            m.setattr(builtins, "__import__", without("public_tokenizers_of_nobody"))
            importlib.reload(e)
    finally:
        importlib.reload(e)


def test_statements_create_tables_views_and_functions(spark, catalog):
    s = Sql(catalog)
    s.run("CREATE TABLE made_here (a INT, b STRING) USING parquet")
    s.run("INSERT INTO made_here VALUES (1, 'x'), (2, 'y')")
    s.run("CREATE OR REPLACE TEMPORARY VIEW seen AS SELECT b FROM made_here WHERE a = 2")
    s.run("CREATE OR REPLACE TEMPORARY FUNCTION twice(n INT) RETURNS INT RETURN n * 2")
    assert rows(s.run("SELECT b, twice(21) AS n FROM seen")) == [("y", 42)]
    s.run("DROP VIEW seen")
    s.run("DROP TABLE made_here")
    s.run("SET timings = on")
    assert s.collect("SELECT count(*) AS n FROM boats")[0].n == 4
    assert spark.table("SessionTimings").count() == 1
