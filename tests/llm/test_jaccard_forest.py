"""The parts of the Jaccard join, and its recall against all pairs."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import jaccard_join as jj
from millrace.llm.components import may_have, spread_join

from .test_operators import rows as rows_of
from .test_operators import shingle_set

D = "/root/testdata/sf0.01"


def test_floor_has_the_target_recall_at_the_threshold():
    targets = (0.9, 0.999999, 0.9999999999)
    floors = [jj.floor_depth(0.8, r) for r in targets]
    assert floors == sorted(floors, reverse=True) and floors[:2] == [jj.DEPTH, 4]
    for r, n in zip(targets, floors, strict=True):
        assert jj.found_share(0.8, n) >= r


def noisy(rng, base, n, change):
    out = np.repeat(base[None], n, 0)
    hit = rng.random(out.shape) < change
    out[hit] = rng.integers(0, 256, hit.sum())
    return out


def partition(root):
    by = defaultdict(set)
    for k, r in enumerate(root):
        by[int(r)].add(k)
    return {frozenset(v) for v in by.values()}


@pytest.mark.parametrize("seed", range(4))
def test_match_connects_what_agrees(seed):
    rng = np.random.default_rng(seed)
    least, bucket, tree, rows = 120, [], [], []
    for k, n in enumerate([1, 2, 5, 12, 13, 40, 3, 90]):
        own_tree = int(rng.integers(jj.TREES))
        part = np.concatenate([noisy(rng, rng.integers(0, 256, jj.VALUES), m, 0.22) for m in np.bincount(rng.integers(0, 3, n))])
        part[:, own_tree * jj.DEPTH : own_tree * jj.DEPTH + 4] = 7  # the floor prefix
        label = part[:, own_tree * jj.DEPTH : (own_tree + 1) * jj.DEPTH]
        part = part[np.lexsort(label.T[::-1])]
        rows.append(part.astype(np.uint8))
        bucket += [k] * n
        tree += [own_tree] * n
    rows, bucket, tree = np.concatenate(rows), np.asarray(bucket), np.asarray(tree)
    root, depth = jj.match(bucket, tree, rows, least, 0.8, 1.0, 4)  # this target only the floor has
    near = ((rows[:, None] == rows[None]).sum(2) >= least) & (bucket[:, None] == bucket[None])
    assert partition(root) == partition(jj._roots(near))
    assert set(depth) <= {4, 5, 6}


def test_prefixes_shorten_until_the_recall_is_reached():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, jj.VALUES)
    alike = noisy(rng, base, 60, 0.01)
    alike[:, :4] = base[:4]
    alike = alike[np.lexsort(alike[:, : jj.DEPTH].T[::-1])]
    other = noisy(rng, base, 60, 0.2)
    other[:, :4] = base[:4]
    other = other[np.lexsort(other[:, : jj.DEPTH].T[::-1])]
    both = np.concatenate([alike, other]).astype(np.uint8)
    root, depth = jj.match(np.repeat([0, 1], 60), np.zeros(120, int), both, 120, 0.8, 0.999999, 4)
    assert set(depth[:60]) <= {5, 6} and len(set(root[:60])) == 1  # connected at once: never shortened to the floor
    assert set(depth[60:]) == {4}


def test_intersections_equal_sets():
    rng = np.random.default_rng(2)
    for n, pool, most in ((2, 10, 9), (9, 60, 50), (70, 400, 300), (40, 12, 12)):
        sets = [set(rng.integers(0, pool, rng.integers(0, most)).tolist()) for _ in range(n)]
        got = jj.intersections([np.asarray(sorted(s), np.uint64).tobytes() for s in sets])
        for i, j in combinations(range(n), 2):
            assert got[i, j] == got[j, i] == len(sets[i] & sets[j])
    assert not jj.intersections([b"", b""]).any()


def test_long_texts_are_hashed_in_segments(monkeypatch):
    raws = [b"a bb  ccc\tdd e " * 3000, b"", b"x" * 5000, b"one two three", b" ".join(b"w%d" % k for k in range(4000))]
    whole = jj.shingles(raws)
    segments = jj.segments
    monkeypatch.setattr(jj, "segments", lambda raw: segments(raw, 100))
    cut = jj.shingles(raws)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert np.diff(whole[1]).tolist() == [len(shingle_set(r.decode())) for r in raws]


def test_recall_against_all_pairs(spark):
    sets = {r.doc_id: shingle_set(r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    having = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    shared = Counter(p for ds in having.values() for p in combinations(sorted(ds), 2))
    links = Counter()
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links.update((a, b))
    blank = [d for d, s in sets.items() if not s]
    links.update({d: len(blank) - 1 for d in blank})
    got = {r.doc_id: r.n_links for r in jj.op1_jaccard_join(spark, D).collect()}
    assert sum(links.values()) > 100 and got == {d: links[d] for d in sets}


def test_filter_keeps_every_wanted_row(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("word"))
    wanted = spark.range(0, 5000, 50)
    kept = {r.id for r in may_have(rows.select("id"), wanted, "id", 1 << 12).collect()}
    assert {r.id for r in wanted.collect()} <= kept and len(kept) < 500
    assert may_have(rows.select("id"), wanted.limit(0), "id").count() == 0


def test_spread_join_equals_join(spark):
    rows = spark.range(3000).select((F.when(F.col("id") < 2000, 1).otherwise(F.col("id") % 500)).alias("k"), "id")
    per_key = rows.filter("k <> 3").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for total in (3000, 1):
        assert rows_of(spread_join(rows, per_key, "k", total)) == rows_of(rows.join(per_key, "k"))


def _times_made(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_plans_make_their_rows_once_or_twice(spark):
    """What the driver holds grows with the plans: each use of ``rows`` more is one more copy of all they are made of."""
    made = spark.range(3000).select("id", (F.col("id") % 500).alias("k")).mapInArrow(lambda b: b, "id long, k long")
    per_key = made.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert _times_made(spread_join(made, per_key, "k", 3000), "MapInArrow") <= 2
    assert _times_made(spread_join(made, per_key, "k", 30_000), "MapInArrow") == 1  # without hubs
    rows = made.select(F.col("id").alias("row"), "k", F.when(F.col("k") < 3, 4).otherwise(1).alias("blocks"))
    met = jj._met(rows, "k", "row")
    assert _times_made(met, "MapInArrow") == 1
    by = defaultdict(list)
    for r in met.collect():
        by[r.meeting].append((r.side, r.row))
    together = Counter()
    for members in by.values():
        for (s, a), (t, b) in combinations(members, 2):
            if s == 0 or s != t:
                together[min(a, b), max(a, b)] += 1
    assert together == Counter(p for k in range(500) for p in combinations(range(k, 3000, 500), 2))
    assert all(len(by[k]) == 6 and {s for s, _ in by[k]} == {0} for k in range(3, 500))
