"""Delta-maintained codebooks against Lloyd rounds that start anew each time."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label), all usable and of one length. Whole assignments and whole means, in Python integers."""
    q = sorted((i is None, i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows) if all(r[2] is not None for r in rows) else None
    if q is None:
        q = sorted(((i is None, i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows), key=lambda r: r[:3])
    width = len(q[0][2])
    cuts = [0]
    for p in range(parts):
        cuts.append(cuts[-1] + width // parts + (p < width % parts))
    books = [[r[2][a:b] for r in q if not r[0]][:entries] for a, b in zip(cuts, cuts[1:])]
    near = lambda x, book: min((sum((u - w) ** 2 for u, w in zip(x, c)), k) for k, c in enumerate(book))
    assign = lambda: [[near(r[2][a:b], books[p]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))] for r in q]
    for _ in range(rounds):
        at = assign()
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for k in range(len(books[p])):
                mine = [r[2][a:b] for r, s in zip(q, at) if s[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in s) for s in assign()]
    totals = {}
    for r, e in zip(q, errors):
        totals[r[3]] = totals.get(r[3], 0) + e
    return sorted(((r[1], "".join(f"{k:02x}" for _, k in s), e, totals[r[3]], sha) for r, s, e in zip(q, assign(), errors)), key=repr)


def got(df, **kw):
    return sorted(map(tuple, vc.compress(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("n, width, entries, seed", [(300, 8, 16, 0), (40, 6, 256, 1), (120, 4, 3, 2)])
def test_equal_to_full_rounds(spark, n, width, entries, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i) - 5, [float(np.float32(x)) for x in rng.normal(0, 1, width)], None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(n)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=entries) == brute(rows, entries=entries)


def test_ties_copies_and_nulls(spark):
    """Equal vectors, repeated ids, null ids, a label of most rows and labels of one row each."""
    base = [[0.5, -0.5, 0.25, -0.25], [0.5, -0.5, 0.25, 0.75], [-1.0, 1.0, 0.0, 0.0009]]
    rows = [(i // 2, base[i % 3], 1 if i % 3 else 100 + i) for i in range(60)] + [(None, base[0], None), (None, base[2], None)]
    assert got(spark.createDataFrame(rows, SCHEMA), entries=4) == brute(rows, entries=4)


def test_negative_means_go_down(spark):
    rows = [(0, [-0.001] * 4, 0), (1, [-0.002] * 4, 0), (2, [-0.0005] * 4, 0)]
    assert got(spark.createDataFrame(rows, SCHEMA), entries=1) == brute(rows, entries=1)


def test_odd_rows_take_no_part(spark):
    fine = [(i, [i / 7, -i / 3, 0.0, 1.0], i) for i in range(9)]
    odd = [
        (20, None, 1), (21, [], 1), (22, [0.0, None, 1.0, 1.0], 1), (23, [float("nan"), 0.0, 0.0, 0.0], 1), (24, [float("inf"), 0.0, 0.0, 0.0], 1), (25, [1.0, 2.0], 1),
        (26, [1e30, 0.0, 0.0, 0.0], 1), (27, [0.0] * 5, 1),
    ]
    df = spark.createDataFrame(fine + odd, SCHEMA)
    for extra in ("q", "code", "old", "error", "part", "entry", "known", "heavy_error", "label_error"):
        df = df.withColumn(extra, F.lit("x"))
    assert got(df, entries=4) == brute(fine, entries=4)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    only_null = spark.createDataFrame([(1, None, 2), (None, [1.0] * 4, 2)], SCHEMA)
    want = {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
    assert dict(vc.compress(none).dtypes) == want and vc.compress(none).count() == 0
    assert vc.compress(only_null).count() == 0, "no id, so no entry to start from"


def test_large_numbers_are_exact():
    rng = np.random.default_rng(3)
    for top in (1 << 22, 1 << 27):
        x, book = rng.integers(-top, top, (50, 16)), rng.integers(-top, top, (9, 16))
        want = [min((sum((int(u) - int(w)) ** 2 for u, w in zip(r, c)), k) for k, c in enumerate(book)) for r in x]
        at, error = vc.nearest(x, book)
        assert [(int(e), int(k)) for k, e in zip(at, error)] == want


def test_only_moved_parts_are_shuffled(spark):
    """Contributions after a round without moves are none; after one part moves they are a plus and a minus."""
    state = spark.createDataFrame([(1, 0, [1, 2, 3, 4], [0, 1], [0, 1], 0), (2, 0, [5, 6, 7, 8], [0, 1], [1, 1], 0)], "vec_id long, label int, q array<int>, old array<int>, code array<int>, error long")
    books = vc.Codebooks([0, 2, 4], [np.zeros((2, 2), np.int64)] * 2)
    rows = sorted(map(tuple, vc.contributions(state, books).collect()))
    assert rows == [(0, 0, -1, [-5, -6]), (0, 1, 1, [5, 6])]
    assert vc.contributions(state.where("vec_id = 1"), books).count() == 0


def test_first_ids_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(vc, "FEW", 50)
    ids = np.random.default_rng(4).permutation(3000).tolist()
    df = spark.createDataFrame([(i, [float(i), 0.0, 0.0, 0.0], 0) for i in ids], SCHEMA).repartition(7)
    assert [r[0] for r in vc.first_rows(vc.whole(df), 20)] == [1024 * i for i in range(20)]
    same = spark.createDataFrame([(5, [float(i), 0.0, 0.0, 0.0], 0) for i in range(400)], SCHEMA)
    assert [r[0] for r in vc.first_rows(vc.whole(same), 20)] == [1024 * i for i in range(20)], "one id only: no cut, ties by the vector"


def test_same_as_sql(spark, sf):
    import duckdb

    df = vc.compress(spark.read.parquet(f"{sf}/embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(vc.oracle_sql()).fetchall())
