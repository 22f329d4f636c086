from itertools import combinations
from random import Random

import xxhash
from pyspark.sql import functions as F

from sedimenta.llm import simhash as sh


def plain(text):
    """The fingerprint by the definition, one bit at a time."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps):
    """Smallest id of each connected component, by all pairs."""
    low = dict.fromkeys(fps)
    for i in low:
        low[i] = i
    root = lambda i: i if low[i] == i else root(low[i])
    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = root(a), root(b)
            low[max(x, y)] = min(x, y)
    return {i: root(i) for i in fps}


def test_against_all_pairs(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: plain(t) for i, t in rows.items()}
    want = classes(fps)
    got = sh.near_duplicates(docs).withColumn("hex", sh.hex_of(F.col("fp"))).collect()
    assert {r.doc_id: r.hex for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == want


def test_masks_cover_every_pair_within_the_radius():
    ms = sh.masks()
    assert len(ms) == 31
    rng = Random(3)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(d & m == 0 for m in ms)


def test_links_of_crowded_buckets(spark, monkeypatch):
    """Chains and clouds of fingerprints, with blocks so small that most buckets are cut up."""
    rng = Random(4)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(3):
        x = rng.getrandbits(64)
        for _ in range(120):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 3)):
                y ^= 1 << b
            fps.add(y)
        for _ in range(20):
            for b in rng.sample(range(64), 4):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    monkeypatch.setattr(sh, "BLOCK", 8)
    from sedimenta.operators.components import connected_components

    df = spark.createDataFrame([(sh._signed(f),) for f in fps], "fp long")
    got = {r.node % (1 << 64): r.component for r in connected_components(sh.links(df)).collect()}
    want = classes(dict(enumerate(fps)))
    part = {}
    for i, f in enumerate(fps):
        part.setdefault(want[i], set()).add(f)
    for members in part.values():
        assert len({got.get(f, ("alone", f)) for f in members}) == 1
    assert len({got.get(f, ("alone", f)) for f in fps}) == len(part)


def test_odd_rows(spark, odd, nothing):
    got = sh.near_duplicates(odd).collect()
    assert len(got) == odd.count() and sh.near_duplicates(nothing).count() == 0
    assert {r.fp for r in got if r.doc_id in (1, 2, 3)} == {0} and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    kept = sorted(r.doc_id for r in sh.keep_one(odd).where("doc_id is not null").collect())
    assert kept == [1, 4, 5, 7, 8, 9, 10] and sh.keep_one(odd).columns == odd.columns
