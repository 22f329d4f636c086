"""Leiden: connected communities, no level that loses modularity, refinement inside communities."""

import itertools
import random
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import community as M
from sedimenta.operators import resolve as R

EDGES = "src string, dst string, weight double"


def planted(seed, groups=5, size=10, inside=0.5, outside=0.03):
    rng = random.Random(seed)
    names = [f"g{g}n{i:02d}" for g in range(groups) for i in range(size)]
    return [(a, b, float(rng.choice([1, 2]))) for a, b in combinations(names, 2) if rng.random() < (inside if a[:2] == b[:2] else outside)]


def quality(rows, members):
    """Modularity by level, in another engine."""
    con = duckdb.connect()
    con.execute("create table e (a varchar, b varchar, w double)")
    con.executemany("insert into e values (?, ?, ?)", rows)
    con.execute("create table p (node varchar, level int, c bigint)")
    con.executemany("insert into p values (?, ?, ?)", members)
    return dict(
        con.sql("""with x as (select p.level, p.c ca, q.c cb, w from e join p on a = p.node join q on b = q.node and q.level = p.level), d as (select level, c, sum(w) k from (select level, ca c, w from x union all select level, cb, w from x) group by all)
        select level, sum(w) filter (ca = cb) / sum(w) - any_value(s) / (4 * sum(w) * sum(w)) from x join (select level, sum(k * k) s from d group by 1) using (level) group by 1""".replace(" q on", " p q on")).fetchall()
    )


def connected(rows, nodes):
    seen, todo = set(), [next(iter(nodes))]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b if a == x else a for a, b, _ in rows if x in (a, b) and {a, b} <= nodes]
    return seen == nodes


@pytest.fixture(scope="module", params=[1])
def graph(request, spark):
    rows = planted(request.param)
    df = spark.createDataFrame(rows, EDGES).cache()
    return rows, df, [tuple(r) for r in M.leiden(df, levels=3, seed=request.param).collect()]


def test_communities_are_connected(graph):
    rows, _, members = graph
    for level in {n for _, n, _ in members}:
        for c in {c for _, n, c in members if n == level}:
            assert connected(rows, {x for x, n, y in members if n == level and y == c})


def test_no_level_loses_modularity(graph, spark):
    rows, df, members = graph
    q = quality(rows, members)
    assert sorted(q) == list(range(len(q))) and all(q[i + 1] >= q[i] - 1e-9 for i in range(len(q) - 1))
    ours = {r["level"]: r["modularity"] for r in M.modularity(df, spark.createDataFrame(members, "node string, level int, community long")).collect()}
    assert ours == {n: round(x, 9) for n, x in q.items()}
    labels = R.label_propagation(df)
    assert q[max(q)] >= R.modularity(df, labels) - 1e-9
    truth = quality(rows, [(x, 0, int(x[1])) for x in {y for a, b, _ in rows for y in (a, b)}])[0]
    assert q[max(q)] >= 0.97 * truth


def test_every_node_once_a_level(graph):
    rows, _, members = graph
    nodes = {x for a, b, _ in rows for x in (a, b)}
    for level in {n for _, n, _ in members}:
        assert sorted(x for x, n, _ in members if n == level) == sorted(nodes)


def test_refined_parts_stay_inside_and_connected(spark):
    """Two cliques joined by one edge, called one community: refinement joins no node across where chance gives more."""
    rows = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "ab" for i, j in combinations(range(6), 2)] + [("a0", "b0", 1.0), ("a1", "c0", 1.0), ("c0", "c1", 1.0)]
    ids = {x: i for i, x in enumerate(sorted({y for a, b, _ in rows for y in (a, b)}))}
    level = spark.createDataFrame([(ids[x], ids[y], w) for a, b, w in rows for x, y in ((a, b), (b, a))], "a long, b long, w double")
    k = level.groupBy("a").agg(F.sum("w").alias("k"))
    part = k.select(F.col("a").alias("node"), F.when(F.col("a") >= ids["c0"], 1).otherwise(0).alias("c"), "k")
    m = len(rows)
    got = {r["node"]: r["r"] for r in M._refined(level, part, m, 1.0, 8, 3, 0.05).collect()}
    name = {i: x for x, i in ids.items()}
    parts = [{name[i] for i in got if got[i] == r} for r in set(got.values())]
    assert len(got) == len(ids) and all(connected(rows, p) for p in parts)
    assert not any(p & {"c0", "c1"} and p - {"c0", "c1"} for p in parts), "never over a community's border"
    assert len(parts) <= len(ids) / 2


def test_same_seed_same_result(spark):
    df = spark.createDataFrame(planted(3, groups=3, size=8), EDGES)
    key = lambda d: sorted(map(tuple, M.leiden(d, levels=1, turns=3, seed=5).collect()))
    assert key(df) == key(df.repartition(5, "dst"))


def test_odd_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert M.leiden(none).count() == 0 and M.modularity(none, M.leiden(none)).count() == 0
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), (None, "a", 1.0), ("c", "c", 4.0), ("d", None, 1.0), ("a", "b", 1.0)], EDGES)
    got = {r["node"]: r["community"] for r in M.leiden(df, levels=1, turns=4).where("level = 0").collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == got["b"] != got["c"]


def test_a_turn_deals_edges_out_twice(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 2.0), (3, 2, 2.0)], "a long, b long, w double")
    part = spark.createDataFrame([(1, 1, 1.0), (2, 2, 3.0), (3, 3, 2.0)], "node long, c long, k double")
    moved = M._moved(e, part, 3.0, 1.0, 0)
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 4 and plan.count("RepartitionByExpression") == 1  # two of the joins are of nodes only, not of edges or options
    assert {r.node: r.k for r in moved.collect()} == {1: 1.0, 2: 3.0, 3: 2.0}


def test_a_turn_over_blocks_equals_joins_and_shuffles_no_edge(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.randint(-9, 9) * 10**17, rng.randint(-9, 9) * 10**17, float(rng.randint(1, 3))) for _ in range(300)]
    e = spark.createDataFrame(rows, "a long, b long, w double").where("a <> b or a > 0")
    level = e.union(e.select("b", "a", "w"))
    k = level.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    part = k.select("node", (F.col("node") / 10**17 % 4).cast("long").alias("c"), "k")
    m = level.agg(F.sum("w")).first()[0] / 2
    monkeypatch.setattr(M, "FEW", 100)  # several blocks
    monkeypatch.setattr(M, "PIECE", 7)
    blocks = M.Blocks(level)
    assert blocks.n > 2
    summed = level.where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"))
    for turn in (0, 5):
        got = M._turned(blocks, part, m, 1.0, turn)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M._moved(summed, part, m, 1.0, turn).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FlatMapCoGroupsInArrow"):]
    assert "Exchange" not in scan[: scan.index("Scan")], "edges stay in their blocks"
    blocks.drop()


def test_hashes_are_those_of_spark(spark):
    import numpy as np

    x = np.array([0, 1, -1, 2**62, -(2**63), 123456789], np.int64)
    d = spark.createDataFrame([(int(v), int(v) // 3) for v in x], "a long, b long")
    want = [r[0] for r in d.select(F.xxhash64("a", "b", F.lit(7), F.lit(-2))).collect()]
    assert M._hashed(x, x // 3, 7, -2).view(np.int64).tolist() == want


def test_parts_of_communities_across_blocks(spark, monkeypatch):
    """A long path through many blocks is one part, and a community of two paths is two."""
    monkeypatch.setattr(M, "FEW", 30)
    ids = random.Random(4).sample(range(10**6), 120)
    pairs = [p for some in (ids[:80], ids[80:]) for p in itertools.pairwise(some)]
    level = spark.createDataFrame([(x, y, 1.0) for a, b in pairs for x, y in ((a, b), (b, a))], "a long, b long, w double")
    part = spark.createDataFrame([(i, 5, 1.0) for i in ids], "node long, c long, k double")
    blocks = M.Blocks(level)
    cut, inside = M._connected(blocks, part)
    got = {r.node: r.c for r in cut.collect()}
    blocks.drop()
    assert inside == 2 * len(pairs)
    assert got == {i: min(some) for some in (ids[:80], ids[80:]) for i in some}
