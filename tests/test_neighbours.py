"""Neighbour descent against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.operators.neighbours import neighbours


def exact(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return {ids[i]: {ids[j] for j in np.lexsort((ids, -s[i]))[:k]} for i in range(len(ids))}


def recall(df, ids, x, k):
    want, got = exact(ids, x, k), {}
    for r in df.collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    return float(np.mean([len(want[i] & got.get(i, set())) / k for i in ids]))


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("kind", ["random", "clustered", "dense group"])
def test_recall(spark, kind):
    rng = np.random.default_rng(1)
    n, ids = 1500, np.arange(1500) * 3
    x = rng.normal(0, 1, (n, 24))
    if kind == "clustered":
        x = rng.normal(0, 1, (30, 24))[rng.integers(0, 30, n)] + 0.3 * x
    if kind == "dense group":
        x[: n // 3] = x[0] + 0.01 * x[: n // 3]
    x = x.astype(np.float32)
    assert recall(neighbours(frame(spark, ids, x), k=10), ids, x.astype(float), 10) >= 0.95


def test_on_the_tables(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    p = e.orderBy("vec_id").toPandas()
    ids, x = p.vec_id.to_numpy(), np.stack(p.embedding.to_list()).astype(float)
    df = neighbours(e, k=10)
    assert recall(df, ids, x, 10) >= 0.95
    assert df.count() == 10 * len(ids) and df.where("src = dst").count() == 0


def test_scores_and_ranks(spark):
    rng = np.random.default_rng(2)
    ids, x = np.arange(40), rng.normal(0, 1, (40, 6)).astype(np.float32)
    rows = neighbours(frame(spark, ids, x), k=5).collect()
    want = exact(ids, x.astype(float), 5)
    assert {i: {r["dst"] for r in rows if r["src"] == i} for i in ids} == want, "few rows: all of them are met"
    for i in ids:
        mine = sorted((r["rank"], r["score"]) for r in rows if r["src"] == i)
        assert [r for r, _ in mine] == [1, 2, 3, 4, 5] and [s for _, s in mine] == sorted((s for _, s in mine), reverse=True)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (None, [1.0, 0.0]), (6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("g", "id", "v", "bound", "fresh", "src", "score"):
        df = df.withColumn(c, F.lit("x"))
    assert sorted((r["src"], r["dst"]) for r in neighbours(df, k=1).collect()) == [(1, 2), (2, 1), (6, 2)]
    assert neighbours(df.where("vec_id > 100"), k=3).count() == 0
    assert neighbours(df.where("vec_id = 1"), k=3).count() == 0


def test_names_as_ids(spark):
    df = spark.createDataFrame([(f"n{i}", [1.0, i / 10]) for i in range(9)], "vec_id string, embedding array<double>")
    got = {(r["src"], r["dst"]) for r in neighbours(df, k=1).collect()}
    assert len(got) == 9 and all(abs(int(a[1:]) - int(b[1:])) == 1 for a, b in got)
