"""Star-schema, decision-support and mixed-workload suites, adapted to the tables at hand.

There is no date dimension, no partsupp and no commit or receipt date: years come from o_orderdate, categories from p_type,
the supply cost from p_retailprice. The SQL is the same for Spark and for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.sql import Sql
from ..sources.catalog import Catalog


def total(expr: str, digits: int) -> str:
    """An exact sum of decimals kept in doubles: over whole units of the last digit."""
    scale = 10**digits
    return f"CAST(sum(floor(({expr}) * {scale} + 0.5)) AS DOUBLE) / {scale}"


REVENUE = total("l_extendedprice * (1 - l_discount)", 4)
PROFIT = total("l_extendedprice * (1 - l_discount) - p_retailprice", 4)
YEAR = "CAST(year(o_orderdate) AS INTEGER)"
STAR = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
NATIONS = "JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey"


def _flight1(where: str) -> str:
    return f"SELECT {total('l_extendedprice * l_discount', 4)} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {where}"


def _flight2(where: str) -> str:
    return f"SELECT {YEAR} AS d_year, p_brand, {REVENUE} AS revenue FROM {STAR} JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE {where} GROUP BY 1, 2 ORDER BY d_year, p_brand"


def _flight3(a: str, b: str, where: str) -> str:
    return f"SELECT {a} AS c_place, {b} AS s_place, {YEAR} AS d_year, {REVENUE} AS revenue FROM {STAR} {NATIONS} WHERE {where} GROUP BY 1, 2, 3 ORDER BY d_year, revenue DESC"


def _flight4(keys: dict[str, str], where: str) -> str:
    names = ", ".join(f"{e} AS {n}" for n, e in keys.items())
    places = ", ".join(map(str, range(1, len(keys) + 1)))
    return f"SELECT {names}, {PROFIT} AS profit FROM {STAR} {NATIONS} WHERE {where} GROUP BY {places} ORDER BY {', '.join(keys)}"


SUITES = {
    "ssb_q1_1": _flight1("year(o_orderdate) = 1996 AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25"),
    "ssb_q1_2": _flight1("year(o_orderdate) = 1996 AND month(o_orderdate) = 1 AND l_discount BETWEEN 0.04 AND 0.06 AND l_quantity BETWEEN 26 AND 35"),
    "ssb_q1_3": _flight1("o_orderdate >= DATE '1996-02-05' AND o_orderdate < DATE '1996-02-12' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity BETWEEN 26 AND 35"),
    "ssb_q2_1": _flight2("p_type LIKE 'S%' AND r_name = 'AMERICA'"),
    "ssb_q2_2": _flight2("p_brand BETWEEN 'Brand#12' AND 'Brand#19' AND r_name = 'ASIA'"),
    "ssb_q2_3": _flight2("p_brand = 'Brand#22' AND r_name = 'EUROPE'"),
    "ssb_q3_1": _flight3("cn.n_name", "sn.n_name", "cr.r_name = 'ASIA' AND sr.r_name = 'ASIA' AND year(o_orderdate) BETWEEN 1995 AND 1997"),
    "ssb_q3_2": _flight3("c_mktsegment", "s_name", "cn.n_name = 'NATION_3' AND year(o_orderdate) BETWEEN 1995 AND 1997"),
    "ssb_q3_3": _flight3("c_mktsegment", "sn.n_name", "(cn.n_name = 'NATION_3' OR cn.n_name = 'NATION_7') AND (sn.n_name = 'NATION_3' OR sn.n_name = 'NATION_7') AND year(o_orderdate) BETWEEN 1995 AND 1997"),
    "ssb_q3_4": _flight3("c_mktsegment", "sn.n_name", "(cn.n_name = 'NATION_3' OR cn.n_name = 'NATION_7') AND (sn.n_name = 'NATION_3' OR sn.n_name = 'NATION_7') AND year(o_orderdate) = 1997 AND month(o_orderdate) = 12"),
    "ssb_q4_1": _flight4({"d_year": YEAR, "c_nation": "cn.n_name"}, "cr.r_name = 'AMERICA' AND sr.r_name = 'AMERICA' AND (p_brand = 'Brand#1' OR p_brand = 'Brand#2')"),
    "ssb_q4_2": _flight4({"d_year": YEAR, "s_nation": "sn.n_name", "p_type": "p_type"}, "cr.r_name = 'AMERICA' AND sr.r_name = 'AMERICA' AND (year(o_orderdate) = 1996 OR year(o_orderdate) = 1997)"),
    "ssb_q4_3": _flight4({"d_year": YEAR, "s_name": "s_name", "p_brand": "p_brand"}, "cr.r_name = 'AMERICA' AND sn.n_name = 'NATION_1' AND (year(o_orderdate) = 1996 OR year(o_orderdate) = 1997)"),
    "tpch_q1": f"SELECT l_returnflag, l_linestatus, {total('l_quantity', 2)} AS sum_qty, {total('l_extendedprice', 2)} AS sum_base, {REVENUE} AS sum_disc, {total('l_quantity', 2)} / count(*) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-11-01' - INTERVAL '90' DAY GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    "tpch_q4": "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority ORDER BY o_orderpriority",
    "tpch_q5": f"SELECT n_name, {REVENUE} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name ORDER BY revenue DESC",
    "tpch_q6": f"SELECT {total('l_extendedprice * l_discount', 4)} AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "tpch_q7": f"SELECT supp_nation, cust_nation, l_year, {total('volume', 4)} AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(YEAR FROM l_shipdate) AS INTEGER) AS l_year, l_extendedprice * (1 - l_discount) AS volume FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) shipping GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year",
    "tpch_q9": f"SELECT n_name AS nation, {YEAR} AS o_year, {PROFIT} AS sum_profit FROM {STAR} JOIN nation ON s_nationkey = n_nationkey WHERE p_type LIKE '%E%' GROUP BY 1, 2 ORDER BY nation, o_year DESC",
    "tpch_q17": f"SELECT {total('l_extendedprice', 2)} / 7.0 AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#13' AND l_quantity < (SELECT 0.2 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)",
    "tpch_q18": f"SELECT c_name, c_custkey, o_orderkey, o_totalprice, {total('l_quantity', 2)} AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 180) GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey",
    "tpch_q19": f"SELECT {REVENUE} AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10) OR (p_partkey = l_partkey AND p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)",
    "ch_q1": f"SELECT l_linenumber, {total('l_quantity', 2)} AS sum_qty, {total('l_extendedprice', 2)} AS sum_amount, count(*) AS n FROM lineitem WHERE l_shipdate > DATE '1997-01-02' GROUP BY l_linenumber ORDER BY l_linenumber",
    "ch_q4": "SELECT CAST(l_linenumber AS INTEGER) AS lines, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '1996-01-02' AND o_orderdate < DATE '1999-01-02' AND l_shipdate >= o_orderdate GROUP BY 1 ORDER BY 1",
    "ch_q6": f"SELECT {total('l_extendedprice', 2)} AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '2000-01-01' AND l_quantity BETWEEN 1 AND 40",
    "ch_q8": f"SELECT {YEAR} AS l_year, {total("CASE WHEN sn.n_name = 'NATION_3' THEN l_extendedprice ELSE 0 END", 2)} / ({total('l_extendedprice', 2)}) AS mkt_share FROM {STAR} {NATIONS} WHERE cr.r_name = 'EUROPE' AND p_brand LIKE '%2' AND o_orderdate BETWEEN DATE '1995-01-02' AND DATE '2000-01-02' GROUP BY 1 ORDER BY l_year",
    "ch_q12": "SELECT l_linenumber, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 0 ELSE 1 END) AS BIGINT) AS low FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate <= l_shipdate AND l_shipdate < DATE '2000-01-01' GROUP BY l_linenumber ORDER BY l_linenumber",
    "ch_q18": f"SELECT c_custkey, o_orderkey, {total('l_extendedprice', 2)} AS amount FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey, o_orderkey HAVING sum(l_extendedprice) > 300000 ORDER BY amount DESC, o_orderkey",
    "ch_q19": f"SELECT {total('l_extendedprice', 2)} AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (p_brand LIKE 'Brand#1%' AND l_quantity BETWEEN 1 AND 10 AND p_retailprice > 1000) OR (p_brand LIKE 'Brand#2%' AND l_quantity BETWEEN 5 AND 20)",
    "ch_micro_sum": "SELECT CAST(sum(l_orderkey) AS BIGINT) AS total FROM lineitem",
    "ch_micro_stock": f"SELECT l_suppkey, l_partkey, {total('l_quantity', 2)} AS quantity FROM lineitem GROUP BY l_suppkey, l_partkey",
    "nested_subselects": "SELECT lhs.o_orderpriority, count(lhs.l_orderkey) AS n FROM (SELECT l_orderkey, o_orderpriority, l_suppkey FROM (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity < 25) a JOIN (SELECT o_orderkey, o_orderpriority FROM orders) b ON a.l_orderkey = b.o_orderkey) lhs JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) rhs ON lhs.l_suppkey = rhs.s_suppkey GROUP BY lhs.o_orderpriority",
    "from_less_select": "SELECT CAST('plain text' AS VARCHAR(60)) AS t",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _run(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in TABLES if t in SUITES[name]]
        return Sql(Catalog(spark).add_parquet(sf_dir, *used)).run(SUITES[name])

    return run


QUERIES = {name: _run(name) for name in SUITES}
