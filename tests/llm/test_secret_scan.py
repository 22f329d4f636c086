import hashlib
import math
import re
from collections import Counter
from itertools import pairwise
from random import Random

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import secret_scan as ss

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base(text):
    """Spans of the fixed patterns, each matched on its own, failing ones dropped after."""
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(s)


@pytest.fixture(scope="module")
def model(spark):
    return ss.train(ss.samples(spark))


def held(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id] or "")
        text = ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == [s for s in text.split(",") if s]


def test_base_spans(spark, docs, model):
    held(ss.digest(ss.scan(docs, model)).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_hard_texts(spark, model):
    texts = [
        "token=token:abcdefgh", "Token = secret=abc", "api_key:'abc.def' APIKEY=\"x\" apikey=1234567", "password : = abcdef", "é😀 passwd=ümlaut passwd=abcdefg", "AKIAAKIA" + "A" * 12, "AKIA" + "B" * 15,
        "x" + "0af" * 8 + "g" + "9" * 23, "secret==abcdef=", "token=" + "ab12" * 8 + " token=" + "cd34" * 8, " ".join(f"secret={i:06d}" for i in range(700)), "token =\t'abcdef'", "K" + "password=abcdef" * 3,
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    held(ss.digest(ss.scan(spark.createDataFrame(rows, "doc_id long, text string"), model)).collect(), dict(rows))


def test_models_tell_random_from_ordinary(spark, model):
    both = ss.samples(spark, 6000).where(F.length("token") >= ss.TOKEN).withColumn("llr", ss.likelihood_ratio(F.col("token"), model))
    r = both.agg(F.avg(F.when(F.col("random"), (F.col("llr") >= ss.RATIO).cast("int"))).alias("hit"), F.avg(F.when(~F.col("random"), (F.col("llr") >= ss.RATIO).cast("int"))).alias("false")).first()
    assert r["hit"] > 0.97 and r["false"] < 0.01


def ratio(token, model):
    """The log-likelihood ratio from its definition."""
    at = [ss.SYMBOLS.find(c) + 1 for c in token]
    return sum(model.ratios[a * ss.N + b] for a, b in pairwise(at))


def test_ratios_from_raw_counts(spark, docs, model):
    tokens = [(r.token, r.random) for r in ss.samples(spark, 50).collect()]
    small = ss.train(spark.createDataFrame([*tokens, (None, True), ("abc", None)], "token string, random boolean"))
    n = {c: Counter((ss.SYMBOLS.find(a) + 1, ss.SYMBOLS.find(b) + 1) for t, r in tokens if r == c for a, b in pairwise(t)) for c in (True, False)}
    chance = lambda c, a, b: (n[c][a, b] + 0.5) / sum(n[c][a, x] + 0.5 for x in range(ss.N))
    want = [math.log(chance(True, a, b) / chance(False, a, b)) for a in range(ss.N) for b in range(ss.N)]
    assert small.ratios == pytest.approx(want)
    rows = spark.createDataFrame([(t,) for t, _ in tokens], "t string").select("t", ss.likelihood_ratio(F.col("t"), model).alias("x")).collect()
    assert all(r.x == pytest.approx(ratio(r.t, model), abs=1e-3) for r in rows)


#: Words that no training list holds.
FOREIGN = (
    "Geschwindigkeitsbegrenzung Rechtsschutzversicherungsgesellschaften Bundesausbildungsfoerderungsgesetz Freundschaftsbezeugungen Unabhaengigkeitserklaerungen Lebensmittelgeschaeft "
    "anticonstitutionnellement electroencefalografista otorrinolaringologico incomprehensibilities counterrevolutionaries deinstitutionalization Donaudampfschifffahrtsgesellschaft "
    "descontextualizadamente interdisciplinariedad bienveillanceperpetuelle"
).split()


def test_held_out_samples_words_and_runs(spark, docs):
    """Precision and recall by kind on samples of other row numbers, words of no list, and runs of one character."""
    model = ss.trained(docs)
    seen = ss.samples(spark, 2000, first=1_000_000).where(F.length("token") >= ss.TOKEN).withColumn("hit", ss.likelihood_ratio(F.col("token"), model) >= ss.RATIO)
    rate = {(r.kind, r.random): r.rate for r in seen.groupBy("kind", "random").agg(F.avg(F.col("hit").cast("int")).alias("rate")).collect()}
    assert all(x > 0.95 if random else x < 0.01 for (_, random), x in rate.items()), rate
    assert all(ratio(w, model) < ss.RATIO for w in FOREIGN if len(w) >= ss.TOKEN), {w: ratio(w, model) for w in FOREIGN}
    assert all(ratio(c * n, model) < ss.RATIO for c in ss.SYMBOLS for n in (20, 40, 200))


def test_redaction_of_any_spans(spark):
    """Against cutting code points, with overlaps, neighbours and many spans."""
    rng = Random(4)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab é😀") for _ in range(rng.randint(0, 900)))
        spans = sorted((a, 0, min(len(text), a + rng.randint(1, 9))) for a in (rng.randrange(len(text)) for _ in range(rng.choice((0, 1, 5, 200)) if text else 0)))
        rows.append((i, text, [(*s, "x") for s in spans]))
    rows.append((60, None, []))
    df = spark.createDataFrame(rows, "id long, text string, spans array<struct<start:int,kind:int,end:int,hit:string>>")
    for r in df.select("id", "text", "spans", ss.redacted(F.col("text"), F.col("spans")).alias("t")).collect():
        want, at = "", 0
        for s in r.spans:
            if s.start >= at:
                want += r.text[at : s.start] + "[secret]"
            at = max(at, s.end)
        assert r.t == (None if r.text is None else want + r.text[at:])


def test_added_spans_and_redaction(spark, model):
    text = "key ghp_Zx81kQpLm2Vb7Yt0RsWq93NdEfGhJk4T of get_user_account_list_manager and token=abcdef1 here"
    df = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in ss.digest(ss.scan(df, model)).collect()}
    assert spans == {1: "markov:4:40,assign:78:91", 2: "", 3: ""}
    red = {r.doc_id: r.t for r in df.select("doc_id", ss.redacted(F.col("text"), ss.found(F.coalesce("text", F.lit("")), model)).alias("t")).collect()}
    assert red == {1: "key [secret] of get_user_account_list_manager and [secret] here", 2: "nothing here", 3: None}


def test_no_python_in_the_plan(spark, docs, model):
    plan = ss.digest(ss.scan(docs, model))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_rows(spark, odd, nothing, model):
    got = ss.digest(ss.scan(odd, model)).collect()
    assert len(got) == odd.count() and ss.scan(nothing, model).count() == 0
    held([r for r in got if r.doc_id is not None], {r.doc_id: r.text for r in odd.collect()})
