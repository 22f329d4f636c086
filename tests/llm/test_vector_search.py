import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import vector_search as vs


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in queries:
        s = (x * x[ids == q][0]).sum(axis=1)
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))
    return out


def held(got, rows, want, k=20):
    x = dict(rows)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
        assert abs(r.score - float(np.dot(np.array(x[r.query_id], np.float64), np.array(x[r.vec_id], np.float64)))) < 1e-9
    hit = total = 0
    for q, best in want.items():
        g = sorted(by.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in g] == list(range(1, len(best) + 1))
        assert [(-r.score, r.vec_id) for r in g] == sorted((-r.score, r.vec_id) for r in g)
        hit += len({r.vec_id for r in g} & {i for i, _ in best})
        total += len(best)
    return hit / total


def lists_of(index, x):
    own = index.assign(x)
    away = ((x - index.centroids[own]) ** 2).sum(axis=1)
    number, at, n = np.unique(index.lists(own, away), return_inverse=True, return_counts=True)
    far = np.zeros(len(number))
    np.maximum.at(far, at, away)
    return vs.Lists(number, n, index.centroids[number // vs.SHELLS], np.sqrt(np.bincount(at, weights=away) / n), np.sqrt(far))


def skewed(kind, n=8000, dim=32):
    rng = np.random.default_rng(3)
    x, near = rng.normal(size=(n, dim)), rng.normal(size=(40, dim))[rng.integers(0, 40, n)]
    if kind == "lengths":
        return x * rng.lognormal(0, 0.7, (n, 1))
    if kind == "few long":
        return x * np.where(rng.random((n, 1)) < 0.01, 6, 1)
    if kind == "heavy rows":
        return near + 0.15 * x * np.abs(rng.standard_cauchy((n, 1)))
    return near + 0.3 * rng.standard_t(2, size=(n, dim))


@pytest.mark.parametrize("kind", ["lengths", "few long", "heavy rows", "heavy components"])
def test_recall_on_skewed_vectors(spark, kind):
    """Vectors whose residuals are no normal sample: recall by brute force, and all of the nearest where nothing may be missed."""
    rows = [(i, v.tolist()) for i, v in enumerate(skewed(kind))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    asked = [i for i, _ in rows if i % 20 == 0]
    want = brute(rows, asked, 20)
    assert held(vs.search(df, F.col("vec_id") % 20 == 0).collect(), rows, want) >= 0.95
    assert held(vs.search(df, F.col("vec_id") % 20 == 0, missed=0).collect(), rows, want) == 1


def test_no_list_that_can_reach_is_left_out():
    """The bound holds for every row of a list, also where the usual length says nothing."""
    for kind in ("few long", "heavy components"):
        x = skewed(kind, 2000)
        index = vs.Index(vs.kmeans(x[:500], 20), [], 32, 0.5)
        lists = lists_of(index, x)
        own = index.assign(x)
        at = index.lists(own, ((x - index.centroids[own]) ** 2).sum(axis=1))
        for q in x[::100]:
            score = x @ q
            least = np.sort(score)[-20]
            assert set(at[score >= least].tolist()) <= set(lists.reach(q, least).tolist())
            assert len(lists.reach(q, np.inf)) == 0 and len(lists.reach(q, -np.inf)) == len(lists.number)


def test_recall_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = vs.search(df, F.col("vec_id") % 20 == 0).collect()
    assert held(got, rows, brute(rows, [i for i, _ in rows if i % 20 == 0], 20)) >= 0.9


def test_many_copies_small_groups_and_ties(spark, monkeypatch):
    monkeypatch.setattr(vs, "GROUP", 64)
    monkeypatch.setattr(vs, "BLOCK", 7)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    x[300:700] = x[300]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = vs.search(df, F.col("vec_id") % 20 == 0).collect()
    assert held(got, rows, want) >= 0.9
    tied = sorted((r for r in got if r.query_id == 400), key=lambda r: r.rank)
    assert [r.vec_id for r in tied] == list(range(300, 320))


def test_a_dense_group_of_a_third_of_the_rows(spark):
    """Near copies that the quantiser cannot tell apart, beside clusters: recall by brute force, and few lists probed."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(60, 32))
    x = np.concatenate([centers[0] * 1.5 + rng.normal(size=(4000, 32)) * 0.02, centers[rng.integers(0, 60, 8000)] + rng.normal(size=(8000, 32)) * 0.15])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(12_000), x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = sorted(i for i, _ in rows if i % 20 == 0)
    got = vs.search(df, F.col("vec_id") % 20 == 0).collect()
    want = brute(rows, asked, 20)
    dense = {i for (i, _), d in zip(rows, [True] * 4000 + [False] * 8000, strict=True) if d}
    for some in (set(asked) & dense, set(asked) - dense):
        assert held([r for r in got if r.query_id in some], rows, {q: want[q] for q in some}) >= 0.9
    index = vs.fit(vs.vectors(df), 12_000, 32)
    lists = lists_of(index, x)
    number, n = lists.number, lists.rows
    held_rows = dict(zip(number.tolist(), n.tolist(), strict=True))
    share = [sum(held_rows[i] for i in lists.probes(x[j], 20, vs.MISSED).tolist()) / 12_000 for j in range(4000, 12_000, 100)]
    assert np.mean(share) < 0.25


def test_no_candidate_within_its_error_is_lost():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, k = int(rng.integers(1, 400)), int(rng.integers(1, 9))
        exact = rng.normal(size=n).round(1)
        error = rng.uniform(0, 1.5, n)
        approx = exact + error * rng.uniform(-1, 1, n)
        out = rng.random(n) < 0.2
        approx[out] = -np.inf
        at, score = vs.candidates(approx, error, lambda rows, e=exact: e[rows], k)
        able = np.flatnonzero(~out)
        assert len(set(at.tolist())) == len(at) and not out[at].any() and (score == exact[at]).all()
        assert sorted(score)[::-1][:k] == sorted(exact[able])[::-1][:k]


def test_tail_of_the_normal():
    z = np.linspace(-6, 6, 241)
    assert np.abs(vs.tail(z) - [0.5 * math.erfc(v / math.sqrt(2)) for v in z]).max() < 1e-6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (None, [1.0, 1.0], 1), (20, [0.5, 0.5], 1), (21, [2.0, 0.0], 1), (22, [2.0, 0.0], 1), (23, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code int").withColumn("list", F.lit(3)).withColumn("v", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vs.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 21, 2.0), (0, 2, 22, 2.0), (0, 3, 20, 0.5), (20, 1, 21, 1.0), (20, 2, 22, 1.0), (20, 3, 0, 0.5)]
    assert vs.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert vs.search(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0
