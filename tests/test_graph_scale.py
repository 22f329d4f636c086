"""Queries that have no SQL, and ways around hubs, by brute force on small fixtures."""

from collections import Counter
from itertools import combinations
from random import Random

from pyspark.sql import functions as F

from sedimenta.operators import community as M
from sedimenta.operators import graph as G
from sedimenta.operators import resolve as R


def test_pairs_of_entities_that_share_chunks(spark):
    rng = Random(3)
    rows = [(f"c{rng.randint(0, 20)}", f"e{rng.randint(0, 30)}") for _ in range(300)] + [("c1", "e1")] * 3 + [("c99", "alone")]
    got = {(r.src, r.dst): r.n for r in G.co_mentions(spark.createDataFrame(rows, "chunk_id string, entity_id string")).collect()}
    by = {}
    for c, e in rows:
        by.setdefault(c, set()).add(e)
    assert got == Counter(p for m in by.values() for p in combinations(sorted(m), 2))
    assert G.co_mentions(spark.createDataFrame([], "chunk_id string, entity_id string")).count() == 0


def test_trails_to_a_goal_and_cycles(spark):
    rng = Random(8)
    edges = {(f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}", rng.choice("xy")) for _ in range(22)} | {(f"leaf{i}", "n1", "x") for i in range(20)} | {("n2", f"end{i}", "x") for i in range(20)}
    df = spark.createDataFrame(sorted(edges), "src string, dst string, type string")
    key = lambda r: (tuple(r.nodes), tuple(r.types), r.hops)
    for a, b in (("n1", "n2"), ("n3", "n3"), ("n1", "nowhere")):
        want = sorted(map(key, G.trails(df, F.col("node") == a, 3).where(F.col("node") == b).collect()))
        assert sorted(map(key, G.trails_between(df, a, b, 3).collect())) == want
    every = sorted(map(key, G.trails(df, F.lit(True), 4, directed=True).where("node = start").collect()))
    assert sorted(map(key, G.cycles(df, F.lit(True), 4).collect())) == every and every


def test_conflicts_are_those_of_all_pairs_of_ids(spark):
    rng = Random(2)
    rows = [(f"g{i % 3}", f"i{i}", [t for t in "abcd" if rng.random() < 0.4]) for i in range(60)]
    df = spark.createDataFrame(rows, "group string, id string, types array<string>")
    got = {(r.group, r.a, r.b): (r.share, r.members_a, r.members_b) for r in R.jaccard_conflict(df, 0.5).collect()}
    pairs = {}
    for (g, _, s), (h, _, t) in combinations(rows, 2):
        if g == h and s and t and len(set(s) & set(t)) / len(set(s) | set(t)) < 0.5:
            a, b = sorted((",".join(s), ",".join(t)))
            pairs[g, a, b] = pairs.get((g, a, b), 0) + 1
    assert {k: a * b for k, (_, a, b) in got.items()} == pairs
    degrees = spark.createDataFrame([("i0", 5), ("i3", 5), ("i1", 1)], "id string, degree int")
    assert {r.group: r.winner for r in R.most_related(df, degrees).collect()} == {"g0": "i0", "g1": "i1", "g2": "i11"}


def test_few_hops_read_few_files(spark):
    df = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "x") for i in range(6)] + [("n0", None, "x"), (None, "n0", "x")] * 2, "src string, dst string, type string")
    d = G.distances(df.where("src is not null and dst is not null"), F.col("node") == "n0", 4)
    assert {(r.node, r.hops) for r in d.collect()} == {(f"n{i}", i) for i in range(5)}
    assert len(d.where("hops <= 1").inputFiles()) < len(d.inputFiles())


def test_propagation_meets_edges_where_they_lie(spark):
    """What nodes say meets the edges without a shuffle of edges, and labels are those of plain rounds."""
    rng = Random(5)
    rows = [(f"n{a}", f"n{b}", float(rng.randint(1, 3))) for a, b in ((rng.randint(0, 14), rng.randint(0, 14)) for _ in range(50))] + [(None, "n1", 1.0), ("n3", "n3", 9.0)]
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    w = {}
    for a, b, x in rows:
        if a and a != b:
            for e in ((a, b), (b, a)):
                w[e] = w.get(e, 0.0) + x
    label = {a: a for a, _ in w}
    for _ in range(5):
        votes = {a: {label[a]: 1e-6} for a in label}
        for (a, b), x in w.items():
            votes[a][label[b]] = votes[a].get(label[b], 0.0) + x
        label = {a: min(v, key=lambda c: (-round(v[c], 6), c)) for a, v in votes.items()}
    assert {r.node: r.label for r in R.label_propagation(df).collect()} == label
    table = M.Bucketed(spark.range(200).select((F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b")), 200)
    plan = table.said(spark.range(5).select(F.col("id").alias("b")))._jdf.queryExecution().executedPlan().toString()
    table.drop()
    scan = plan[plan.index("FileScan") - 400 : plan.index("FileScan")]
    assert "Bucketed: true" in plan and "Exchange" not in scan.split("ShuffledHashJoin")[-1]


def test_only_pairs_near_the_cutoff_are_scored_in_double_precision(monkeypatch):
    """All pairs once were; those at the cutoff after rounding still count."""
    import numpy as np

    from sedimenta.operators import vector as V

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    angle = np.arccos([0.6 + e for e in (-2e-6, -6e-7, -4e-7, 0.0, 4e-7, 2e-6)])
    plane = np.zeros((7, 16))
    plane[0, 0] = 1
    plane[1:, 0], plane[1:, 1] = np.cos(angle), np.sin(angle)
    x = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), plane])
    ids, n = np.arange(len(x)) * 3, 300
    want = {(i, j) for i, j in zip(*np.nonzero(np.round(x @ x.T, 6) >= 0.6), strict=True) if i < j}
    rounded = []
    near = np.round
    monkeypatch.setattr(V.np, "round", lambda a, k: (rounded.append(a.size), near(a, k))[1])
    for kind in (V._Pairs, V._Links):
        m = kind(0.6)
        m.hold(ids[:n], np.ones(n, np.int64))
        told = m.meet(x[:n], x[:n], 0, 0)
        at = m.more(ids[n:], np.ones(len(x) - n, np.int64))
        told += m.meet(x[:n], x[n:], 0, at)
        first = {(i, j) for i, j in want if i < n}
        if kind is V._Pairs:
            assert {(a // 3, b // 3) for t in told for a, b in zip(t[0].tolist(), t[1].tolist(), strict=True)} == first
        else:
            assert m.degree.tolist() == [sum(i in p for p in first) for i in range(len(x))]
    assert {(600, 604), (600, 605), (600, 606)} <= want and (600, 601) not in want
    assert max(rounded) < n * n / 16
