import duckdb
import pytest

from millrace.queries import basics, suites

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr([value(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", [*basics.QUERIES, *suites.QUERIES])
def test_query_equals_sql(spark, oracle, name):
    df = (basics.QUERIES | suites.QUERIES)[name](spark, D)
    out = oracle.execute((basics.SQL | suites.SUITES)[name])
    names = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, df.collect()) == canonical(names, out.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["d_year", "p_brand", "revenue"]
