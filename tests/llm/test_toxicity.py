from pyspark.sql import functions as F

from sedimenta.llm import toxicity as tx
from sedimenta.llm.common import held_out


def test_held_out_accuracy(spark, sf):
    at = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = tx.fit(docs, labels)
    got = tx.score(docs, model).join(labels, "doc_id").where(held_out()).collect()
    found = sum(r.predicted for r in got if r.toxic == 1) / sum(r.toxic for r in got)
    wrong = sum(r.predicted for r in got if r.toxic == 0) / sum(1 - r.toxic for r in got)
    assert found >= 0.9 and wrong <= 0.01
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_labels_of_held_out_rows_teach_nothing(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (tx.score(docs, tx.fit(docs, x)).orderBy("doc_id").collect() for x in (labels, other))
    assert a == b


def test_features_by_hand():
    f = dict(zip(tx.FEATURES, tx.features("You are an IDIOT!! you st*pid i.d.i.o.t sooo", tx.Lexicon({"idio*": (50, 0)}, 100, 1000)), strict=True))
    assert f["insults"] > 0 and f["learned_max"] > 4 and f["near_second"] > 0 and f["stretched"] > 0 and f["obfuscated"] > 0 and f["marks"] > 0 and f["shouted"] > 0
    assert tx.features("", tx.Lexicon({}, 1, 1)) == [0.0] * len(tx.FEATURES) == tx.features("123 !!", tx.Lexicon({}, 1, 1))


def test_trees_are_the_trained_ones(spark):
    import numpy as np
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(3)
    rows = [(v.tolist(), float(v[0] * v[1] > 0.2 or v[2] > 0.9)) for v in rng.random((400, 4))]
    d = spark.createDataFrame(rows, "a array<double>, label double").withColumn("features", array_to_vector("a"))
    m = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(d)
    got = m.transform(d).select("a", vector_to_array("rawPrediction")[1].alias("m")).collect()
    ours = tx.Model(tx.Lexicon({}, 1, 1), tx.read_trees(m.toDebugString), np.zeros(1), np.zeros(1), 0.0).margins(np.array([r.a for r in got]))
    assert np.allclose(ours, [r.m for r in got])


def test_a_counted_document_is_taken_off():
    lex = tx.Lexicon({"bad": (tx.LEAST, 0), "worse": (tx.LEAST + 1, 0)}, 50, 500)
    assert lex.weights(["bad", "worse", "good"]) == [lex.weights(["bad"])[0], lex.weights(["worse"])[0], 0.0] and lex.weights(["bad"])[0] > 0
    after = tx.Lexicon({"worse": (tx.LEAST, 0)}, 49, 500)
    assert lex.weights(["bad", "worse"], 1) == [0.0, after.weights(["worse"])[0]]


def test_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    flat = tx.fit(odd, none)
    assert {r.score for r in tx.score(odd, flat).collect()} == {0.0}
    rows = [(i, i % 2) for i in range(1, 200)] + [(5, None), (None, 1), (6, 1)]
    some = spark.createDataFrame(rows, "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, ("you idiot fool " if i % 2 else "the good day ") * (1 + i % 5)) for i in range(1, 200)], "doc_id long, text string")
    model = tx.fit(texts, some)
    got = tx.score(odd, model).collect()
    assert len(got) == odd.count() and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert tx.score(nothing, model).count() == 0 and tx.keep_civil(odd, model).columns == odd.columns


def test_array_tests_let_every_match_through():
    from random import Random

    from sedimenta.llm import toxicity as t

    rng = Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("ab  .-_@$*!|01éß٣ A\n,") for _ in range(rng.randrange(30))).lower()
        stretched, hidden = t.may_hold(text)
        assert stretched or not t.STRETCHED.search(text)
        assert hidden or not t.OBFUSCATED.search(text)


def test_weights_are_the_largest_odds_of_a_word_and_its_beginnings():
    from sedimenta.llm import toxicity as t

    lex = t.Lexicon({"blorf": (50, 3), "blor*": (80, 2), "zark": (40, 0)}, 1000, 9000)
    for y in (-1, 0, 1):
        want = [max(lex._odds(x, y) for x in (w, *(w[:n] + "*" for n in t.STEMS if len(w) > n))) for w in ("blorf", "blorfing", "zark", "zarkens", "other")]
        assert lex.weights(["blorf", "blorfing", "zark", "zarkens", "other"], y) == want
