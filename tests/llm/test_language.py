from itertools import combinations

import numpy as np

from sedimenta.llm import language as la
from sedimenta.llm.common import held_out


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = la.fit(docs)
    got = la.predict(docs, model).join(docs.select("doc_id", "lang", held_out().alias("ho")), "doc_id").where("ho").collect()
    assert len(got) > 150 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_teach_nothing(spark, docs):
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = la.fit(docs), la.fit(other)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_codewords_keep_apart():
    for n in range(3, 40):
        w = la.codewords(n)
        assert len(w) == n and all((x != y).sum() >= max(1, w.shape[1] // 4) for x, y in combinations(w, 2))


def test_an_error_in_one_bit_is_corrected():
    w = la.codewords(5)
    model = la.Model(list("abcde"), w, np.zeros((la.BUCKETS, w.shape[1])), np.ones(w.shape[1]))
    c = np.zeros(la.BUCKETS, np.int64)
    c[0] = 100
    for i in range(5):
        for flip in range(w.shape[1]):
            margin = w[i] * 3.0
            margin[flip] *= -1
            model.weights[0] = margin / 10
            assert model.decode(c)[0] == "abcde"[i]


def test_counts_by_hand():
    c = la.counts("Ab, ab")
    grams = [x for s in (" ab ab ",) for n in la.NGRAMS for x in (s[i : i + n] for i in range(len(s) - n + 1))]
    assert c.sum() == len(grams) and (c > 0).sum() <= len(set(grams))
    assert la.counts("12 !?").sum() == 0 and la.counts("").sum() == 0
    assert np.array_equal(la.counts("ÉTÉ"), la.counts("été"))


def test_odd_rows(spark, odd, nothing):
    model = la.fit(odd)
    got = la.predict(odd, model).collect()
    assert len(got) == odd.count() and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3, 7))
    assert la.fit(nothing).languages == [] and la.predict(odd, la.fit(nothing)).where("lang_pred <> 'und'").count() == 0
    assert la.predict(nothing, model).count() == 0
    one = la.fit(odd.where("lang = 'en'"))
    assert {r.lang_pred for r in la.predict(odd.where("doc_id = 5"), one).collect()} == {"en"}
    assert la.keep_known(odd, model).columns == odd.columns
