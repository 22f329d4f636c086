"""The tagger of names: decoding against all labellings, held-out spans by type, cases of masking."""

import itertools
import random

import numpy as np
import pytest

from sedimenta.operators import names as N
from sedimenta.plans import q_names as Q


def made(spark, ids):
    rows = [(i, *Q.sentence(random.Random(i))) for i in ids]
    return spark.createDataFrame([(i, t, s) for i, t, s in rows], Q.LETTER)


@pytest.fixture(scope="module")
def model(spark):
    return N.fit(made(spark, range(1500)), shards=4)


def scored(rng, n, k):
    return rng.normal(size=(n, k)).astype(np.float32), rng.normal(size=(k, k)).astype(np.float32) + N.ALLOWED


def test_decoding_equals_all_labellings():
    rng = np.random.default_rng(3)
    k = len(N.LABELS)
    for n in (1, 2, 3):
        e, pairs = scored(rng, n, k)
        scores = {y: float(e[0, y[0]] + N.FIRST[y[0]] + sum(pairs[a, b] for a, b in itertools.pairwise(y)) + sum(e[t, y[t]] for t in range(1, n))) for y in itertools.product(range(k), repeat=n)}
        assert tuple(N.viterbi(e[None], pairs, np.array([n]))[0]) == max(scores, key=scores.get)
        top = max(scores.values())
        whole = sum(np.exp(s - top) for s in scores.values())
        p = N.posteriors(e[None].astype(float), pairs.astype(float), np.array([n]))[0]
        for t in range(n):
            for lab in range(k):
                assert p[t, lab] == pytest.approx(sum(np.exp(s - top) for y, s in scores.items() if y[t] == lab) / whole, abs=1e-6)


def test_batches_change_nothing():
    rng = np.random.default_rng(4)
    k = len(N.LABELS)
    _, pairs = scored(rng, 1, k)
    es = [scored(rng, n, k)[0] for n in (1, 7, 3, 12)]
    padded = np.zeros((4, 12, k), np.float32)
    for i, e in enumerate(es):
        padded[i, :len(e)] = e
    lengths = np.array([len(e) for e in es])
    y, p = N.viterbi(padded, pairs, lengths), N.posteriors(padded.astype(float), pairs.astype(float), lengths)
    for i, e in enumerate(es):
        one = np.array([len(e)])
        assert (N.viterbi(e[None], pairs, one)[0] == y[i, :len(e)]).all()
        assert np.allclose(N.posteriors(e[None].astype(float), pairs.astype(float), one)[0], p[i, :len(e)], atol=1e-6)


def test_held_out_spans_of_each_type(model):
    right, made_up, missed = ({k: 0 for k in N.MASKS} for _ in range(3))
    for i in range(10_000, 10_800):
        text, want = Q.sentence(random.Random(i))
        got = {s[:3] for s in N.found(model, [text])[0] if s[3] >= N.THRESHOLD}
        for s in got | set(want):
            (right if s in got and s in want else made_up if s in got else missed)[s[2]] += 1
    for k in N.MASKS:
        assert right[k] >= 20
        assert right[k] / (right[k] + missed[k]) >= 0.95, (k, right, missed)
        assert right[k] / (right[k] + made_up[k]) >= 0.95, (k, right, made_up)


def test_words_without_meaning_have_few_spans(model):
    texts = [Q.noise(random.Random(i)) for i in range(20_000, 20_600)]
    assert sum(s[3] >= N.THRESHOLD for got in N.found(model, texts) for s in got) <= 6


MASKED = [
    ("Contact me at john.doe@example.com for details.", "john.doe@example.com", "EMAIL_ADDRESS"),
    ("Call (555) 867-5309 now.", "867-5309", "PHONE_NUMBER"),
    ("Reach us at 555.867.5309.", "555.867.5309", "PHONE_NUMBER"),
    ("International: +1-555-867-5309.", "867-5309", "PHONE_NUMBER"),
    ("SSN is 123-45-6789.", "123-45-6789", "US_SSN"),
    ("SSN is 123 45 6789.", "123 45 6789", "US_SSN"),
    ("SSN ending in 6789 on file.", "6789", "US_SSN"),
    ("Card: 4111 1111 1111 1111.", "4111 1111 1111 1111", "CREDIT_CARD_NUMBER"),
    ("Card: 4111-1111-1111-1111.", "4111-1111-1111-1111", "CREDIT_CARD_NUMBER"),
    ("John Smith submitted the quarterly report.", "John Smith", "PERSON_NAME"),
    ("Located at 123 Main Street, Boston, MA 02101.", "123 Main Street", "STREET_ADDRESS"),
    ("Born on 01/15/1985.", "01/15/1985", "DATE_OF_BIRTH"),
    ("routing number 021000021 for the transfer.", "021000021", None),
    ("Transfer to GB29NWBK60161331926819.", "GB29NWBK60161331926819", "FINANCIAL_ACCOUNT_NUMBER"),
]
KEPT = ["Revenue grew in 2024.", "Apple Inc. reported strong earnings.", "Results for Q1 2024.", "What was Apple Inc. revenue in Q1 2024?", "The Roth IRA plan of Acme Corp rose."]


def test_masking(spark, model):
    rows = [*[t for t, _, _ in MASKED], *KEPT, "Ask 中 John Smith 🙂 and Mary Jones.", "", None]
    d = spark.createDataFrame(list(enumerate(rows)), "id int, text string").withColumnsRenamed({"id": "spans_of"})
    got = {r.spans_of: r for r in N.masked(d, model).collect()}
    for i, (_, gone, kind) in enumerate(MASKED):
        assert gone not in got[i].masked
        assert kind is None or f"[PII:{kind}]" in got[i].masked, got[i].masked
    for i, t in enumerate(KEPT, len(MASKED)):
        assert got[i].masked == t and got[i].spans == []
    n = len(MASKED) + len(KEPT)
    assert got[n].masked == "Ask 中 [PII:PERSON_NAME] 🙂 and [PII:PERSON_NAME]."
    assert got[n + 1].masked == "" and got[n + 1].spans == []
    assert got[n + 2].masked is None and got[n + 2].spans == []


def test_terms_of_finance_and_shapes_are_no_spans():
    assert len(N.BLOCKLIST) == 21
    assert not any(N.plausible("PERSON", w) for w in ("Roth", "IRA", "NASDAQ", "John smith", "J0hn"))
    assert N.plausible("PERSON", "John A. Smith") and N.plausible("PERSON", "Ana de la Cruz")
    assert not N.plausible("IBAN_CODE", "OUSHED") and not N.plausible("EMAIL_ADDRESS", "that")


def test_threshold_and_long_text(spark, model):
    text = "We asked John Smith today. " * 2000 + "x" * 50_000 + " word" * 20_000
    d = spark.createDataFrame([(text,)], "text string")
    assert len(N.with_spans(d, model).first().spans) == 2000
    assert N.with_spans(d, model, threshold=1.01).first().spans == []


def test_no_labelled_rows(spark):
    m = N.fit(made(spark, range(2)).limit(0))
    assert N.found(m, ["John Smith"]) == [[]]


def test_learning_is_repeatable_and_bounded(spark):
    d = made(spark, range(300))
    a, b = N.fit(d, rows=150, shards=2, rounds=1), N.fit(d.repartition(5), rows=150, shards=2, rounds=1)
    assert a.traits == b.traits and np.allclose(a.weights, b.weights)
    assert len(a.traits) < len(N.fit(d, shards=2, rounds=1).traits)


def test_texts_are_made_once_by_many_tasks(spark, tmp_path):
    spark.range(100).select(Q.F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = Q.letters(spark, str(tmp_path))
    assert made.count() == 100 and len(made.inputFiles()) >= 8


def test_segments_without_spans_need_no_posteriors(monkeypatch):
    """A model without weights labels all tokens O, so no sums are made."""
    m = N.Model({}, np.zeros((0, len(N.WINDOW), len(N.LABELS)), np.float32), np.zeros((len(N.LABELS),) * 2, np.float32))
    monkeypatch.setattr(N, "posteriors", lambda *_: pytest.fail("called"))
    assert N.found(m, ["John Smith", "", "a b"]) == [[], [], []]


def test_no_row_is_left_out(spark):
    """6500 rows without spans, and a few with one: with the 6000 rows that once counted these were never seen."""
    some = spark.range(400).select(Q.F.concat(Q.F.lit("Zork"), Q.F.translate(Q.F.col("id").cast("string"), "0123456789", "abcdefghij"), Q.F.lit(" Quux")).alias("text"))
    last = some.where("pmod(xxhash64(text), 1048576) >= int(0.95 * 1048576) and pmod(xxhash64(text, 7), 8) <> 0").limit(6)
    names = [r.text for r in last.collect()]
    assert len(names) == 6
    rows = [(i, f"alpha beta {i % 50}", []) for i in range(6500)] + [(i, t, [(0, len(t), "PERSON")]) for i, t in enumerate(names)]
    m = N.fit(spark.createDataFrame(rows, Q.LETTER))
    for t in names:
        assert [s[:3] for s in N.found(m, [t])[0]] == [(0, len(t), "PERSON")]
    assert N.found(m, ["alpha beta 3"]) == [[]]


def test_many_shards_learn_the_same_from_any_order(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD_ROWS", 20)
    d = made(spark, range(400))
    a, b = N.fit(d, shards=4, rounds=2), N.fit(d.repartition(5), shards=4, rounds=2)
    assert len(a.traits) > 0 and a.traits == b.traits and (a.weights == b.weights).all() and (a.pairs == b.pairs).all() and a.scale == b.scale


def test_sums_of_chances_equal_sums_of_logs():
    """Of flat scores by products; steep ones, which have no such numbers, by logs."""
    rng = np.random.default_rng(8)
    k, lengths = len(N.LABELS), np.array([1, 4, 7])
    for by in (1, 12, 400):
        e, pairs = rng.normal(size=(3, 7, k)) * by, rng.normal(size=(k, k)) * by + N.ALLOWED
        p = N.posteriors(e, pairs, lengths)
        for i, n in enumerate(lengths):
            f, g = [e[i, 0] + N.FIRST], [np.zeros(k)]
            for t in range(1, n):
                f.append(N._soft(f[-1][:, None] + pairs, 0) + e[i, t])
                g.insert(0, N._soft(pairs + (e[i, n - t] + g[0])[None], 1))
            z = np.array(f) + np.array(g)
            assert np.allclose(p[i, :n], np.exp(z - N._soft(z, 1)[:, None]), atol=1e-9)
