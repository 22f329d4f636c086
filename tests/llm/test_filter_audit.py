"""The audit by joint-failure counts against every order applied to every document."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from sedimenta.llm import filter_audit as fa

COLS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = "doc_id long, quality int, toxic int"


def fails_of(docs):
    """For each (doc_id, text, lang): the letters of the filters it fails."""
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    out = []
    for i, t, _ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        hit = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        out.append({f for f, h in hit.items() if h})
    return out


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    by_part = defaultdict(list)
    for (i, _, lang), f in zip(docs, fails_of(docs)):
        by_part[lang or ""].append((f, i in good, i in toxic))
    rows = []
    for part, members in by_part.items():
        total, mine = Counter(), []
        for order in permutations("ABCDE"):
            left = members
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[0]]
                left = [m for m in left if x not in m[0]]
                total[x] += len(gone)
                failing = [m for m in members if x in m[0]]
                mine.append(
                    (part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(m[0] == {x} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone))
                )
        rows += [(*r, total[r[1][r[2] - 1]]) for r in mine]
    return sorted(rows)


def got(docs, labels):
    return sorted(map(tuple, fa.audit(fa.failures(docs, labels)).select(*COLS).collect()))


def made(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(160)] + ["ABC", "DEFG", "#x", "50%", "é", "ÄÖ"]
    pool = [" ".join(rng.choice(vocab[: rng.choice([30, 166])]) for _ in range(rng.choice([0, 3, 90, 99, 100, 101, 130]))) for _ in range(n // 3)] + [None, "", " ", "A" * 11 + "b" * 89, "A" * 10 + "b" * 90]
    ids = [rng.randrange(n) for _ in range(n)]  # some repeat
    docs = [(None if rng.random() < 0.05 else i, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in ids]
    labels = [(rng.choice(ids) if rng.random() < 0.9 else None, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n // 2)]
    return docs, labels


def test_equal_to_brute_force(spark):
    for seed in (1, 2):
        docs, labels = made(seed, 240)
        d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
        for extra in ("n", "part", "t", "id", "good", "toxic", "quality", "A", "E", "first", "known_id", "mask"):
            d = d.withColumn(extra, F.lit("x"))
        assert got(d, spark.createDataFrame(labels, LABELS)) == brute(docs, labels)


def test_one_text_holds_most_rows(spark):
    """A third of all rows hold one text, in many parts: its rows meet as few sums, and one of them passes."""
    docs = [(i, "same text", f"p{i % 5}") for i in range(300)] + [(1000 + i, f"text {i}", "p0") for i in range(50)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = fa.audit(fa.failures(d, spark.createDataFrame([], LABELS))).where("filter_order = 'EABCD' and step = 1").collect()
    assert {r["part"]: (r["kept"], r["removed"]) for r in rows} == {"p0": (51, 59), **{f"p{i}": (0, 60) for i in range(1, 5)}}


def test_other_filters(spark):
    """Any set of 0/1 columns can be audited; three filters have six orders."""
    df = spark.createDataFrame([("x", 1, 0, 1, True, False, 3), ("x", 0, 0, 0, None, None, 5), ("x", 1, 1, 1, False, True, 2)], "part string, P int, Q int, R int, good boolean, toxic boolean, n long")
    rows = {(r["filter_order"], r["step"]): r for r in fa.audit(df, ["P", "Q", "R"]).collect()}
    assert len(rows) == 18
    assert rows["PQR", 1]["removed"] == 5 and rows["PQR", 2]["removed"] == 0 and rows["PQR", 2]["redundant"] == 2 and rows["QPR", 1]["toxic_lost"] == 2 and rows["QPR", 2]["good_lost"] == 3
    for f in range(3):
        name = "PQR"[f]
        assert all(r["shapley"] == sum(x["removed"] for (o, s), x in rows.items() if o[s - 1] == name) for (o, s), r in rows.items() if o[s - 1] == name)


def test_odd_and_empty(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (99, 1, 1)], LABELS)
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    assert got(odd, labels) == brute(docs, [tuple(r) for r in labels.collect()])
    assert fa.audit(fa.failures(nothing, labels)).count() == 0


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert got(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")) == sorted(con.sql(f"select {','.join(COLS)} from ({fa.ORACLE_SQL})").fetchall())
