from itertools import combinations
from random import Random

import corpus_pipeline as cp
from sedimenta.llm import near_copies as nc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def classes(sets, at=0.8):
    """Smallest id of each connected component, by all pairs."""
    low = {i: i for i in sets}
    root = lambda i: i if low[i] == i else root(low[i])
    for a, b in combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= at:
            x, y = root(a), root(b)
            low[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def planted(rng, n=60, words=200):
    """Texts with copies in which a run of words at the end is replaced, so that similarities spread from about 0.6 to 1."""
    texts = []
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        texts.append(" ".join(base))
        for cut in (1, 4, 8, 12, 16, 18, 20, 22, 24, 30, 40):
            texts.append(" ".join(base[:-cut] + [f"x{rng.randrange(10**9)}" for _ in range(cut)]))
    return texts


def test_recall_against_all_pairs(spark):
    """Pairs by brute force at 0.8 and more all end in one component, and nothing else does."""
    texts = dict(enumerate(planted(Random(5))))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    sets = {i: shingles(t) for i, t in texts.items()}
    want = classes(sets)
    got = {r.doc_id: r.component for r in nc.near_copies(df).collect()}
    pairs = [(jaccard(sets[a], sets[b]), a, b) for a, b in combinations(texts, 2)]
    for low, high in ((0.8, 0.9), (0.9, 0.95), (0.95, 1.01)):
        some = [(a, b) for s, a, b in pairs if low <= s < high]
        met = sum(got[a] == got[b] for a, b in some)
        print("recall", low, met, len(some))
        assert some and met == len(some)
    by = {}
    for i, c in got.items():
        by.setdefault(c, set()).add(i)
    assert {min(m) for m in by.values()} == set(want.values()) and all(want[i] == min(m) for m in by.values() for i in m)


def test_stage_drops_a_planted_copy_at_the_threshold(spark, sf):
    rng = Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near = base[:-25] + [f"y{i}" for i in range(25)]
    far = base[:-80] + [f"z{i}" for i in range(80)]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in ((1, base), (2, near), (3, far))]
    assert 0.8 <= jaccard(shingles(rows[0][1]), shingles(rows[1][1])) < 0.9 and jaccard(shingles(rows[0][1]), shingles(rows[2][1])) < 0.8
    kept = cp.one_of_each(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]


def test_chain_in_a_crowded_bucket(spark, monkeypatch):
    """A chain whose ends are far apart is one component, with groups so small that they are cut up."""
    monkeypatch.setattr(nc, "BLOCK", 4)
    rng = Random(7)
    w = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(40):
        texts.append(" ".join(w))
        w = w[8:] + [f"n{rng.randrange(10**9)}" for _ in range(8)]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert len(set(classes(sets).values())) == 1
    assert len({r.component for r in nc.near_copies(df).collect()}) == 1


def test_odd_rows(spark, odd, nothing):
    assert nc.near_copies(odd).count() == odd.count() and nc.near_copies(nothing).count() == 0
    kept = sorted(r.doc_id for r in nc.keep_one(odd).where("doc_id is not null").collect())
    assert kept == [1, 4, 5, 7, 8, 9, 10] and nc.keep_one(odd).columns == odd.columns
