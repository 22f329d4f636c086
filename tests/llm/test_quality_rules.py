"""Base counts against brute force; the label model against planted accuracies and the tables' own labels."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import quality_rules as qr

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    under = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(under)


def judged(df):
    c = qr.features(df)
    return qr.judge(c, qr.fit(c))


def test_counts_are_those_of_brute_force(spark):
    rng = random.Random(1)
    bits = ["a", "b", "é", "😀x", "#", "a|b", " ", "  ", "\n", "\t", "\x0b", "\r\n", "\x1c", " ", "w1 w2 w3 w4 w5 w6 w7 w8", "a a a a a a a a a", "\n\n"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(120))) for _ in range(400)]
    texts += ["x " * 7, "x " * 8, "x " * 9, "x " * 20, "", " \n ", None, "a b c d e f g h i " * 2, "w " + "a b c d e f g h " * 3 + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in qr.features(df).select("doc_id", *BASE).collect()} == {i: base(t) for i, t in enumerate(texts)}


def test_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(60_000))
    other = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    assert {r[0]: r[1] for r in qr.features(df).select("doc_id", "n_repeat_words").collect()} == {1: 60_000, 2: 0}


def test_odd_documents(spark, odd, nothing):
    rows = judged(odd).collect()
    assert len(rows) == odd.count() and all(r["quality"] is not None and 0 <= r["quality"] <= 1 for r in rows)
    assert all(tuple(r[c] for c in BASE) == base(t) for r in rows for t in [r0["text"] for r0 in odd.collect() if r0["doc_id"] == r["doc_id"]][:1])
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 20)
    assert judged(nothing).count() == 0


def test_learns_planted_accuracies():
    """Three rules of known accuracy that vote on most documents, one that votes at random, 30 % bad documents."""
    rng = random.Random(7)
    right, patterns, truth = [(0.95, 0.9), (0.9, 0.8), (0.85, 0.9), (0.5, 0.5)], Counter(), Counter()
    for _ in range(20_000):
        good = rng.random() < 0.7
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < (g if good else 1 - b)) else -1) for g, b in right)
        patterns[votes] += 1
        truth[votes, good] += 1
    t = qr.learn(list("wxyz"), dict(patterns))
    assert abs(t.prior - 0.7) < 0.03
    for (g, b), on_good, on_bad in zip(right, t.on_good, t.on_bad):
        assert abs(on_good - g) < 0.03 and abs((1 - on_bad) - b) < 0.05


def test_posterior_is_bayes(spark):
    t = qr.Trust(["a", "b"], 0.8, [0.9, 0.7], [0.2, 0.6])
    df = spark.createDataFrame([(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)], "x int, y int")
    p = lambda v, c: 1.0 if v == 0 else c if v == 1 else 1 - c
    for r in df.withColumn("p", t.posterior([F.col("x"), F.col("y")])).collect():
        g, b = 0.8 * p(r.x, 0.9) * p(r.y, 0.7), 0.2 * p(r.x, 0.2) * p(r.y, 0.6)
        assert r.p == pytest.approx(g / (g + b))


def test_agrees_with_labels(spark):
    """Over the tables' labels, which the model never reads: clean documents stay unless they fail the base, most others go."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = judged(docs).select("doc_id", "kept", "base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean, poor = [r for r in rows if r["quality"] == 1 and not r["base_failed"]], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean) and sum(r["kept"] for r in poor) <= 0.1 * len(poor)


def test_order_of_rows_changes_nothing(spark, docs):
    key = lambda df: sorted(map(tuple, judged(df).select("doc_id", "quality", "kept").collect()))
    assert key(docs) == key(docs.repartition(7, "text"))


def test_native(spark, docs):
    plan = judged(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Exchange" not in judged(docs)._jdf.queryExecution().executedPlan().toString()
