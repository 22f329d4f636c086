"""Pairs of members of sets by brute force, and what is shuffled for them."""

from collections import Counter, defaultdict
from itertools import combinations
from random import Random

import pyarrow as pa

from sedimenta.operators import graph as G


def brute(rows, least=1):
    sets, times = defaultdict(set), Counter(w for _, w in rows)
    for c, w in rows:
        sets[c].add(w)
    return Counter(p for s in sets.values() for p in combinations(sorted(w for w in s if times[w] >= least), 2))


def test_pairs_are_not_shuffled(spark):
    """Fails where a row or a partial count of each pair is shuffled."""
    rng = Random(1)
    rows = [(f"c{c}", f"{x}{e}") for c in range(40) for e in rng.sample(range(400), 100) for x in rng.choice(["é", "", "😀", "z"])]
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    got = {(r.src, r.dst): r.n for r in G.co_mentions(spark.createDataFrame(rows, "chunk_id string, entity_id string")).collect()}
    assert got == brute(rows) and len(got) > 100_000
    assert shuffled() - before < 1000


def test_blocks_meet_in_pairs(spark, monkeypatch):
    from sedimenta.operators import co_occurrence as C

    rng = Random(2)
    rows = [(f"c{rng.randint(0, 60)}", rng.randint(-50, 50) if rng.random() < 0.9 else 1000 + i) for i in range(1500)]
    sets = defaultdict(list)
    for c, e in rows:
        sets[c].append(e)
    df = spark.createDataFrame([(s,) for s in sets.values()] + [([],), (None,)], "e array<bigint>").repartition(3)
    monkeypatch.setattr(C, "PAIRS", 1500)  # several blocks
    for least in (1, 2, 9):
        out = C.pair_counts(df, least)
        assert {(r.src, r.dst): r.n for r in out.collect()} == brute(rows, least)
    monkeypatch.setattr(C, "SORTED", 5)
    monkeypatch.setattr(C, "ROWS", 3)
    members = sorted({e for _, e in rows}, key=str)
    words, flat = pa.array(members), [(i, members.index(e)) for i, s in enumerate(sets.values()) for e in s]
    side = [words, pa.array([i for i, _ in flat], pa.int32()), pa.array([w for _, w in flat], pa.int32())]
    got = [r for b in C._counted([side + side], 2) for r in b.to_pylist()]
    assert {(r["src"], r["dst"]): r["n"] for r in got} == brute(rows, 2) and len(got) == len(brute(rows, 2))


def test_graph_of_chunks_with_documents_that_are_there_twice(spark, tmp_path):
    from sedimenta.plans import fixtures as fx
    from sedimenta.plans.q_graph import graph_from_chunks

    rng = Random(3)
    text = lambda n: " ".join(rng.choice(["Häuser", "short", "planning", "market's"]) + str(rng.randint(0, 40)) for _ in range(n))
    docs = [(i, text(rng.choice([3, 30, 1200])), rng.choice(["en", None]), "s", 1) for i in range(12)] + [(50, None, "en", "s", 0), (51, "", "en", "s", 0)]
    docs += [(1, "onlyhere1 onlyhere1 twicehere1 planning1", docs[1][2], "s", 1), (1, "twicehere1 planning2", docs[1][2], "s", 1)]
    sizes = {}
    for name, some in (("once", docs[:14]), ("twice", docs), ("none", docs[12:14])):
        at = str(tmp_path / name)
        spark.createDataFrame(some, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
        got = [tuple(r) for r in graph_from_chunks(spark, at).select("src", "dst", "n").collect()]
        want = brute([(r.chunk_id, r.entity_id) for r in fx.mentions(spark, at).distinct().collect()])
        assert sorted(got) == sorted((a, b, n) for (a, b), n in want.items())
        sizes[name] = len(got)
    assert sizes["twice"] > sizes["once"] > sizes["none"] == 0
