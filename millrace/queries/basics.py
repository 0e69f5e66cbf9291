"""A query for each operator and expression family, with SQL that gives the same rows.

Sums of doubles are taken over whole units of the smallest digit, so that they don't depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import kmeans
from ..operators.relation import Relation
from ..plans.json_plan import Interpreter
from ..plans.sql import Sql
from ..sources.catalog import Catalog, Entry
from ..sources.sinks import scratch_path
from ..streaming.snapshots import as_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function (t, spark, sf_dir) -> Relation or DataFrame under its name; ``t`` scans a table."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda name, *attrs: Relation.scan(spark, sf_dir, name, attrs or None), spark, sf_dir)
            return out.df if isinstance(out, Relation) else out

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def units(c: str | F.Column, digits: int = 2):
    """A decimal in a double as a whole number of its last digit."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 10**digits + 0.5)


def total(c: str, digits: int = 2):
    return F.sum(units(c, digits)).cast("double") / 10**digits


# scans, projections and filters


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def scan_project(t, spark, d):
    return t("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT count(*) AS n FROM lineitem")
def scan_count_only(t, spark, d):
    return t("lineitem").reduce(n=("count", F.lit(1)))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05 AND l_shipdate < TIMESTAMP '1997-01-01'")
def filter_conj(t, spark, d):
    return t("lineitem").filter((F.col("l_quantity") < 24) & (F.col("l_discount") >= 0.05) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))).project("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#1', 'Brand#7', 'Brand#12')")
def filter_between_in(t, spark, d):
    return t("part").filter(X.between(F.col("p_size"), 10, 20) & X.one_of(F.col("p_brand"), "Brand#1", "Brand#7", "Brand#12")).project("p_partkey", "p_brand", "p_size")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1_'")
def filter_like(t, spark, d):
    return t("part").filter(X.like(F.col("p_brand"), "Brand#1_")).project("p_partkey", "p_brand")


@query("SELECT event_id, user_id FROM events WHERE NOT (event_type = 'click') AND user_id IS NOT NULL")
def null_filter(t, spark, d):
    return t("events").not_null("user_id").filter(~(F.col("event_type") == "click")).project("event_id", "user_id")


# expressions


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS class FROM orders")
def case_when(t, spark, d):
    p = F.col("o_totalprice")
    return t("orders").project("o_orderkey", **{"class": X.case((p > 200000, "high"), (p > 100000, "middle"), other="low")})


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 - l_linenumber AS a, -l_linenumber AS b, l_quantity / 4 AS c FROM lineitem")
def arith_mix(t, spark, d):
    return t("lineitem").project("l_orderkey", "l_linenumber", a=F.col("l_quantity") * 2 + 1 - F.col("l_linenumber"), b=-F.col("l_linenumber"), c=X.div(F.col("l_quantity"), 4))


@query("SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, (3 - o_orderkey) // 7 AS nq, (3 - o_orderkey) % 7 AS nr FROM orders")
def int_div_mod(t, spark, d):
    k = F.col("o_orderkey")
    return t("orders").project("o_orderkey", q=X.int_div(k, 7), r=X.mod(k, 7), nq=X.int_div(3 - k, 7), nr=X.mod(3 - k, 7))


@query("SELECT p_partkey, p_size << 2 AS l, p_size >> 1 AS r, xor(p_size, 21) AS x FROM part")
def bit_ops(t, spark, d):
    s = F.col("p_size")
    return t("part").project("p_partkey", l=X.shift_left(s, 2), r=X.shift_right_logical(s, 1), x=X.xor(s, 21))


@query("SELECT l_orderkey, l_linenumber, greatest(l_partkey, l_suppkey) AS hi, least(l_partkey, l_suppkey) AS lo FROM lineitem")
def greatest_least(t, spark, d):
    return t("lineitem").project("l_orderkey", "l_linenumber", hi=X.largest(F.col("l_partkey"), F.col("l_suppkey")), lo=X.smallest(F.col("l_partkey"), F.col("l_suppkey")))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS f, CAST(trunc(l_extendedprice) AS BIGINT) AS i FROM lineitem")
def cast_numeric(t, spark, d):
    return t("lineitem").project("l_orderkey", "l_linenumber", f=F.col("l_linenumber").cast("double"), i=F.col("l_extendedprice").cast("long"))


@query("""SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(quarter(ts) AS INTEGER) AS q, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS dd,
 CAST(dayofweek(ts) + 1 AS INTEGER) AS dow, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s,
 CAST(year(ts) // 10 AS INTEGER) AS dec, CAST((year(ts) + 99) // 100 AS INTEGER) AS cen, CAST((year(ts) + 999) // 1000 AS INTEGER) AS mil, CAST(isodow(ts) AS INTEGER) AS iso,
 CAST(millisecond(ts) % 1000 AS INTEGER) AS ms FROM events""")
def extract_units(t, spark, d):
    names = {"y": "year", "q": "quarter", "m": "month", "dd": "day", "dow": "dow", "doy": "doy", "h": "hour", "mi": "minute", "s": "second", "dec": "decade", "cen": "century", "mil": "millennium", "iso": "isodow", "ms": "millisecond"}
    return t("events").project("event_id", **{k: X.extract(u, F.col("ts")) for k, u in names.items()})


@query("SELECT count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (v IS NOT NULL) AS others FROM (SELECT nullif(l_linenumber, 1) AS v FROM lineitem)")
def null_tests(t, spark, d):
    v = F.nullif(F.col("l_linenumber"), F.lit(1))
    return t("lineitem").project(v=v).reduce(nulls=("sum", X.if_(F.col("v").isNull(), 1, 0)), others=("sum", X.if_(F.col("v").isNotNull(), 1, 0)))


@query("SELECT n_nationkey, n_name AS name, n_regionkey + 1 AS place FROM nation")
def struct_build_project(t, spark, d):
    return t("nation").project("n_nationkey", r=X.record(name=F.col("n_name"), at=X.record(region=F.col("n_regionkey")))).project("n_nationkey", name=X.field("r.name"), place=X.field("r.at.region") + 1)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-12-01' - INTERVAL 90 DAY AND o_orderdate < TIMESTAMP '1998-12-01' + INTERVAL 1 MONTH")
def date_interval(t, spark, d):
    at = F.expr("TIMESTAMP_NTZ '1998-12-01'")
    return t("orders").filter((F.col("o_orderdate") >= at - F.expr("INTERVAL 90 DAY")) & (F.col("o_orderdate") < at + F.expr("INTERVAL 1 MONTH"))).project("o_orderkey")


# aggregation


@query("SELECT count(*) AS n, max(l_orderkey) AS hi, min(l_orderkey) AS lo, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def reduce_multi(t, spark, d):
    return t("lineitem").reduce(n=("count", F.lit(1)), hi=("max", "l_orderkey"), lo=("min", "l_orderkey"), total=("sum", "l_linenumber"))


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS total0 FROM lineitem WHERE l_quantity < 0")
def reduce_empty_input(t, spark, d):
    return t("lineitem").filter("l_quantity < 0").reduce(n=("count", F.lit(1)), total=("sum", "l_linenumber"), total0=("sum0", "l_linenumber"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY ALL")
def groupby_sum_count(t, spark, d):
    return t("lineitem").groupby(["l_returnflag", "l_linestatus"], n=("count", F.lit(1)), lines=("sum", "l_linenumber"))


@query("SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(sum(o_custkey) AS DOUBLE) / count(*) AS mean FROM orders GROUP BY ALL")
def groupby_minmax_avg(t, spark, d):
    return t("orders").groupby(["o_orderpriority"], lo=("min", "o_totalprice"), hi=("max", "o_totalprice"), mean=("avg", "o_custkey"))


@query("SELECT l_orderkey, product(l_linenumber) AS p FROM lineitem GROUP BY l_orderkey")
def groupby_product(t, spark, d):
    return t("lineitem").groupby(["l_orderkey"], p=("multiply", "l_linenumber"))


@query("SELECT o_custkey, bool_or(o_totalprice > 300000) AS some, bool_and(o_totalprice > 50000) AS every FROM orders GROUP BY o_custkey")
def groupby_bool_monoids(t, spark, d):
    return t("orders").groupby(["o_custkey"], some=("or", F.col("o_totalprice") > 300000), every=("and", F.col("o_totalprice") > 50000))


@query("SELECT p_brand, bit_or(p_size) AS o, bit_and(p_size) AS a FROM part GROUP BY p_brand")
def groupby_bit_monoids(t, spark, d):
    return t("part").groupby(["p_brand"], o=("bit_or", "p_size"), a=("bit_and", "p_size"))


@query("SELECT o_orderkey, l_linenumber FROM (SELECT l_orderkey AS o_orderkey, unnest(list(l_linenumber)) AS l_linenumber FROM lineitem GROUP BY l_orderkey)")
def groupby_collect_bag(t, spark, d):
    return t("lineitem").groupby([F.col("l_orderkey").alias("o_orderkey")], bag=("bagunion", "l_linenumber")).unnest("bag", "l_linenumber").project("o_orderkey", "l_linenumber")


@query("SELECT DISTINCT p_type, p_brand FROM part")
def groupby_collect_set(t, spark, d):
    return t("part").groupby(["p_type"], s=("union", "p_brand")).unnest("s", "p_brand").project("p_type", "p_brand")


@query("SELECT l_suppkey, count(*) AS n, CAST(sum(floor(l_extendedprice * 100 + 0.5)) AS DOUBLE) / 100 AS total FROM lineitem GROUP BY l_suppkey")
def partial_final_agg(t, spark, d):
    return t("lineitem").df.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), total("l_extendedprice").alias("total"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_discount > 0.02 GROUP BY l_partkey HAVING count(*) > 25")
def having_filter(t, spark, d):
    return t("lineitem").filter("l_discount > 0.02").groupby(["l_partkey"], n=("count", F.lit(1))).filter("n > 25")


@query("SELECT l_returnflag, max(l_orderkey) AS hi, count(*) AS n FROM lineitem WHERE l_quantity > 10 AND l_suppkey IS NOT NULL GROUP BY l_returnflag")
def nest_radix(t, spark, d):
    return t("lineitem").nest(["l_returnflag"], F.col("l_quantity") > 10, "l_suppkey", hi=("max", "l_orderkey"), n=("count", F.lit(1)))


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t, spark, d):
    return t("orders").join(t("customer"), "o_custkey", "c_custkey").project("o_orderkey", "c_name")


_PAIRS = "SELECT a.l_orderkey, a.l_linenumber, b.n FROM lineitem a JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey"


@query(_PAIRS)
def join_composite_key(t, spark, d):
    b = t("lineitem").groupby(["l_partkey", "l_suppkey"], n=("count", F.lit(1)))
    return t("lineitem").join(b, ["l_partkey", "l_suppkey"]).project("l_orderkey", "l_linenumber", "n")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_linenumber < o_custkey")
def join_residual(t, spark, d):
    return t("lineitem").join(t("orders"), "l_orderkey", "o_orderkey", residual=(F.col("l_shipdate") > F.col("o_orderdate")) & (F.col("l_linenumber") < F.col("o_custkey"))).project("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast(t, spark, d):
    return t("customer").join(t("nation").broadcast(), "c_nationkey", "n_nationkey").project("c_custkey", "n_name")


def _strategy(strategy):
    def f(t, spark, d):
        return t("lineitem").join(t("orders"), "l_orderkey", "o_orderkey", strategy).groupby(["o_orderpriority"], n=("count", F.lit(1)), lines=("sum", "l_linenumber"))

    return f


for _name in ("shuffle_hash", "partitioned", "radix", "out_of_memory"):
    _f = _strategy({"shuffle_hash": "morsel"}.get(_name, _name))
    _f.__name__ = f"join_{_name}"
    query("SELECT o_orderpriority, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")(_f)


@query("SELECT n_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_three_way(t, spark, d):
    return t("lineitem").join(t("orders"), "l_orderkey", "o_orderkey").join(t("customer"), "o_custkey", "c_custkey").join(t("nation").broadcast(), "c_nationkey", "n_nationkey").groupby(["n_name"], n=("count", F.lit(1)))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def semi_exists(t, spark, d):
    return t("orders").exists_in(t("lineitem").filter("l_quantity > 45"), "o_orderkey", "l_orderkey").project("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def semi_in(t, spark, d):
    return t("customer").exists_in(t("orders").filter("o_totalprice > 250000"), "c_custkey", "o_custkey").project("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_size > (SELECT avg(p_size) FROM part)")
def scalar_subquery(t, spark, d):
    return Sql(Catalog(spark).add_parquet(d, "part")).run("SELECT p_partkey FROM part WHERE p_size > (SELECT avg(p_size) FROM part)")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 15)")
def bloom_semi_join(t, spark, d):
    small = t("part").filter("p_size = 15")
    return t("lineitem").bloom_filter(small, "l_partkey", "p_partkey").join(small, "l_partkey", "p_partkey").project("l_orderkey", "l_linenumber")


# order, nesting, sets


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC")
def sort_multi(t, spark, d):
    return t("orders").sort("o_orderpriority", ("o_totalprice", "DESC"), ("o_orderkey", "NONE")).project("o_orderkey", "o_totalprice")


_ITEMS = "SELECT l_orderkey, list(struct_pack(part := l_partkey, qty := l_quantity) ORDER BY l_linenumber) AS items FROM lineitem GROUP BY l_orderkey"


def _nested(t):
    return Relation(t("lineitem").df.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"))).alias("items")))


@query("SELECT l_orderkey, l_partkey AS part FROM lineitem")
def unnest_array(t, spark, d):
    return _nested(t).unnest("items", "i").project("l_orderkey", part=X.field("i.part"))


@query("SELECT l_orderkey, l_partkey AS part FROM lineitem WHERE l_quantity > 40")
def unnest_pred(t, spark, d):
    return _nested(t).unnest("items", "i", F.col("i.qty") > 40).project("l_orderkey", part=X.field("i.part"))


@query("SELECT o.k AS l_orderkey, l.l_partkey AS part FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o LEFT JOIN lineitem l ON l.l_orderkey = o.k AND l.l_quantity > 40")
def unnest_outer(t, spark, d):
    return _nested(t).outer_unnest("items", "i", lambda i: i["qty"] > 40).project("l_orderkey", part=X.field("i.part"))


@query("SELECT vec_id, count(*) AS n FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) WHERE v > 0 GROUP BY vec_id")
def unnest_sql(t, spark, d):
    return Sql(Catalog(spark).add_parquet(d, "embeddings")).run("SELECT e.vec_id, count(*) AS n FROM embeddings e, UNNEST(e.embedding) v WHERE v > 0 GROUP BY e.vec_id")


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_props_unnest(t, spark, d):
    return t("events").project("event_type", p=F.from_json("props", "k BIGINT")).groupby(["event_type"], k=("sum", X.field("p.k")))


@query("SELECT n_name, label FROM nation JOIN (VALUES (0, 'a'), (1, 'b'), (3, 'c')) v(k, label) ON n_regionkey = k")
def values_join(t, spark, d):
    return t("nation").join(Relation.values(spark, [(0, "a"), (1, "b"), (3, "c")], "k int, label string"), "n_regionkey", "k").project("n_name", "label")


@query("SELECT DISTINCT p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#2[0-4]')")
def dict_scan(t, spark, d):
    return Catalog(spark).add_parquet(d, "part").dictionary("part", "p_brand", "Brand#2[0-4]")


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t, spark, d):
    return t("customer").project(k="c_nationkey").union_all(t("supplier").project(k="s_nationkey"))


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem")
def split_union(t, spark, d):
    first, *rest = t("lineitem").split(3, "l_orderkey")
    return first.union_all(*rest).reduce(n=("count", F.lit(1)), lines=("sum", "l_linenumber"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def hash_repartition_agg(t, spark, d):
    return t("lineitem", "l_suppkey").router(8, "l_suppkey").groupby(["l_suppkey"], n=("count", F.lit(1)))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def hash_pack_agg(t, spark, d):
    return t("lineitem", "l_orderkey", "l_returnflag").hash_pack(4, "l_orderkey", "bucket").groupby(["l_returnflag", "bucket"], m=("count", F.lit(1))).groupby(["l_returnflag"], n=("sum", "m"))


# changes, snapshots, plans


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 10 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_copy_on_write(t, spark, d):
    return t("supplier").update(F.col("s_nationkey") == 3, s_acctbal=F.col("s_acctbal") + 10).project("s_suppkey", "s_acctbal")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY user_id")
def snapshot_as_of(t, spark, d):
    events = t("events", "user_id", "event_id", "event_type").df
    return as_of(events, ["user_id"], "event_id", events.agg(F.max("event_id")).first()[0] // 2)


@query("""SELECT CASE WHEN da <= db AND da <= dc THEN 0 WHEN db <= dc THEN 1 ELSE 2 END AS cluster, count(*) AS n, CAST(sum(p_size) AS DOUBLE) / count(*) AS p_size
 FROM (SELECT p_size, (p_size - 5.0) * (p_size - 5.0) AS da, (p_size - 20.0) * (p_size - 20.0) AS db, (p_size - 40.0) * (p_size - 40.0) AS dc FROM part) GROUP BY 1""")
def kmeans_step(t, spark, d):
    return kmeans.step(t("part", "p_size").df, ["p_size"], [(5.0,), (20.0,), (40.0,)])


def _attr(rel, name):
    return {"expression": "recordProjection", "e": {"expression": "argument", "argNo": 0}, "attribute": {"relName": rel, "attrName": name}}


def _scan(rel, *names):
    return {"operator": "scan", "plugin": {"name": rel, "type": "block", "projections": [{"relName": rel, "attrName": n} for n in names]}}


@query("SELECT o_orderpriority, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 30 GROUP BY o_orderpriority")
def json_plan(t, spark, d):
    plan = {
        "operator": "groupby",
        "k": [_attr("orders", "o_orderpriority")],
        "e": [{"e": _attr("lineitem", "l_linenumber"), "m": "sum", "register_as": {"relName": "out", "attrName": "lines"}}],
        "input": {
            "operator": "hashjoin-chained",
            "build_k": _attr("orders", "o_orderkey"),
            "probe_k": _attr("lineitem", "l_orderkey"),
            "build_input": {"operator": "unpack", "input": _scan("orders", "o_orderkey", "o_orderpriority")},
            "probe_input": {"operator": "select", "p": {"expression": "lt", "left": _attr("lineitem", "l_quantity"), "right": {"expression": "float", "v": 30.0}}, "input": _scan("lineitem", "l_orderkey", "l_linenumber", "l_quantity")},
        },
    }
    return Interpreter(Catalog(spark).add_parquet(d, "lineitem", "orders")).run(plan)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
def prepared_statement(t, spark, d):
    s = Sql(Catalog(spark).add_parquet(d, "orders"))
    s.prepare("dear", "SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?")
    return s.execute("dear", 150000, "F")


# beyond the reference's own operators


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def superset_limit_topk(t, spark, d):
    return t("orders").sort(("o_totalprice", "DESC"), "o_orderkey").limit(10).project("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INTEGER) AS r FROM orders")
def superset_window_rank(t, spark, d):
    return Sql(Catalog(spark).add_parquet(d, "orders")).run("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
def superset_distinct_agg(t, spark, d):
    return t("lineitem").df.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def superset_rollup(t, spark, d):
    return t("lineitem").df.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def superset_left_outer(t, spark, d):
    return t("customer").join(t("orders"), "c_custkey", "o_custkey", kind="left").project("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def superset_anti_join(t, spark, d):
    return t("customer").join(t("orders").filter("o_totalprice > 400000"), "c_custkey", "o_custkey", kind="anti").project("c_custkey")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def superset_intersect(t, spark, d):
    return t("customer").project(k="c_nationkey").df.intersect(t("supplier").project(k="s_nationkey").df)


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def superset_except(t, spark, d):
    return t("customer").project(k="c_nationkey").df.subtract(t("supplier").filter("s_acctbal > 5000").project(k="s_nationkey").df)


# filters of stated size, generalized routing, plans that print, functions by name


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7")
def bloom_build_probe(t, spark, d):
    small = t("part", "p_partkey", "p_brand", "p_size").filter("p_size = 7").project("p_partkey", "p_brand")
    kept = t("lineitem", "l_orderkey", "l_linenumber", "l_partkey").bloom_probe(small.bloom_build("p_partkey", 1 << 16), "l_partkey")
    return kept.join(small, "l_partkey", "p_partkey").project("l_orderkey", "l_linenumber", "p_brand")


@query("SELECT s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY s_nationkey")
def bloom_repack(t, spark, d):
    nations = t("nation").filter("n_regionkey = 2")
    bitmap = nations.bloom_build("n_nationkey", 1 << 12).repack(64)
    kept = t("supplier", "s_nationkey").bloom_probe(bitmap, "s_nationkey").join(nations, "s_nationkey", "n_nationkey")
    return kept.groupby(["s_nationkey"], n=("count", F.lit(1)))


@query("SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_discount > 0.05 THEN 'cheap' ELSE 'rest' END AS path, count(*) AS n, sum(l_linenumber) AS lines FROM lineitem GROUP BY 1")
def gsplit_paths(t, spark, d):
    path = lambda name: lambda r: r.groupby([F.lit(name).alias("path")], n=("count", F.lit(1)), lines=("sum", "l_linenumber"))
    ways = ("l_quantity < 10", path("small")), ("l_discount > 0.05", path("cheap")), ("true", path("rest"))
    return t("lineitem", "l_quantity", "l_discount", "l_linenumber").gsplit(*ways, at=scratch_path(spark, "gsplit"))


@query("SELECT n_nationkey, upper(n_name) AS name, length(n_name) AS n FROM nation")
def extern_call(t, spark, d):
    return t("nation").project("n_nationkey", name=X.extern("upper", F.col("n_name")), n=X.extern("length", F.col("n_name")).cast("long"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def neq_filter(t, spark, d):
    return t("orders").filter(F.col("o_orderstatus") != "F").project("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CAST(-o_orderkey >> 2 AS BIGINT) AS s FROM orders")
def shift_right_arith(t, spark, d):
    return t("orders").project("o_orderkey", s=X.shift_right(-F.col("o_orderkey"), 2))


def _attr(relation, name):
    return {"expression": "recordProjection", "e": {"expression": "argument", "argNo": 0}, "attribute": {"relName": relation, "attrName": name}}


@query("SELECT n_nationkey, n_nationkey * 4 AS shifted, xor(n_nationkey, n_regionkey) AS x, greatest(n_nationkey, n_regionkey) AS most, least(n_nationkey, n_regionkey) AS smallest FROM nation")
def print_json_plan(t, spark, d):
    own, other = _attr("nation", "n_nationkey"), _attr("nation", "n_regionkey")
    named = lambda e, name: e | {"register_as": {"relName": "out", "attrName": name}}
    two = lambda kind, right=other: {"expression": kind, "left": own, "right": right}
    exprs = [named(own, "n_nationkey"), named(two("shl", {"expression": "int", "v": 2}), "shifted"), named(two("xor"), "x"), named(two("max"), "most"), named(two("min"), "smallest")]
    plan = {"operator": "print", "e": exprs, "plugin": {"type": "pm-csv", "path": scratch_path(spark, "print")}, "input": {"operator": "scan", "plugin": {"name": "nation"}}}
    return Interpreter(Catalog(spark).add_parquet(d, "nation")).run(plan)


@query("SELECT l_orderkey, qty FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_quantity END AS qty, count(*) FILTER (l_quantity > 25) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM lineitem) WHERE qty IS NOT NULL OR n = 0 AND nth = 1")
def json_outer_unnest(t, spark, d):
    path = scratch_path(spark, "nested")
    t("lineitem", "l_orderkey", "l_quantity").df.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("items")).write.parquet(path)
    catalog = Catalog(spark)
    catalog.entries["orders"] = Entry("orders", path, "block", None)
    test = {"expression": "gt", "left": _attr("orders", "qty"), "right": {"expression": "float", "v": 25.0}}
    plan = {"operator": "outer_unnest", "path": {"name": "qty", "e": _attr("orders", "items")}, "p": test, "input": {"operator": "scan", "plugin": {"name": "orders"}}}
    return Interpreter(catalog).run(plan).select("l_orderkey", "qty")


@query("SELECT r_regionkey, r_name FROM region")
def pm_tsv_scan(t, spark, d):
    path = scratch_path(spark, "tsv")
    t("region").df.write.option("sep", "|").csv(path)
    kind = {"type": "bag", "inner": {"type": "record", "attributes": [{"attrName": "r_regionkey", "type": {"type": "int"}}, {"attrName": "r_name", "type": {"type": "string"}}]}}
    catalog = Catalog(spark)
    catalog.add("region", {"path": path, "type": kind, "plugin": {"type": "pm-tsv"}})
    return catalog.read("region")


@query("SELECT * FROM (VALUES ('select count(*) from region', 'SELECT', 'cpuonly'), ('select max(n_name) from nation', 'SELECT', 'gpuonly')) AS v(query, cmd_type, hwmode)")
def session_timings(t, spark, d):
    sql = Sql(Catalog(spark).add_parquet(d, "region", "nation"))
    sql.run("SET timings = on")
    sql.collect("select count(*) from region")
    sql.run("SET hwmode = gpuonly")
    sql.collect("select max(n_name) from nation")
    return sql.timings.table(spark).filter("total_time >= 0").select("query", "cmd_type", "hwmode")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t, spark, d):
    return t("customer").project(k="c_nationkey").union_all(t("supplier").project(k="s_nationkey")).df.distinct()
