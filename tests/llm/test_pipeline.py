"""The queries and the pipeline on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import registry, toxicity

from .test_operators import check_packed, shingle_set

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    out = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in out.description]
    df = registry.QUERIES[name](spark, D)
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(out.fetchall())


def test_pipeline_equals_brute_force(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    net = toxicity.fit(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"))
    scores = toxicity.text_scores(net, toxicity.Known(net, 1000), [t for _, t in docs])
    kept = [d for d, s in zip(docs, scores, strict=True) if s < 0.3]
    last = {t: d for d, t in sorted(kept)}
    kept = [(d, t) for d, t in kept if last[t] == d]
    sets = {d: shingle_set(t) for d, t in kept}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    kept = [(d, t) for d, t in kept if root[d] == d]
    check_packed(kept, corpus_pipeline.run(spark, D).collect(), 4096)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 5), (2, None, "en", "s", 5), (3, "", "en", "s", 5), (3, "", "en", "s", 5), (None, "a b c d e f", "en", "s", 5), (7, None, "fr", "t", None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, D)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), D).count() == 0
    assert sorted(r.doc_id for r in out.collect()) == [1, 7]


def test_near_dedup_judges_each_row_by_its_own_text(spark):
    words = [[f"{c}{k}" for k in range(60)] for c in "abcd"]
    text = lambda w, *more: " ".join([*words[w], *more])
    data = [(1, text(0)), (5, text(0, "x")), (5, text(1)), (None, text(2)), (None, text(2, "y")), (7, text(3)), (7, text(3, "z")), (8, text(3, "v")), (None, text(0, "w")), (9, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, docs, D).collect()]
    assert {(1, text(0)), (5, text(1)), (9, None)} < set(got)
    assert sorted((d is None, d or 0) for d, _ in got) == [(False, 1), (False, 5), (False, 7), (False, 9), (True, 0)]
