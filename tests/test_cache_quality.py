from random import Random

from sedimenta.operators import cache as C


def test_quality_of_a_hot_key_in_blocks(spark):
    """A key with nearly all marks is cut into blocks, and the fold of the blocks is that of the marks."""
    rng = Random(8)
    marks = [("hot", i, rng.random() < 0.66) for i in range(4000)] + [(f"k{rng.randrange(40)}", i, rng.random() < 0.5) for i in range(400)]
    rng.shuffle(marks)
    df = spark.createDataFrame(marks, "key string, seq long, positive boolean")
    sizes = [r.n for r in C.quality_blocks(df).where("key = 'hot'").collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000
    want = {}
    for key, _, p in sorted(marks):
        s, v, _ = want.get(key, (0, False, False))
        want[key] = (s + 1 if p else max(-5, s - 2), v or p, p)
    got = {r.key: (r.score, r.verified, r.fast, r.high) for r in C.quality(df).collect()}
    assert got == {k: (s, v, f, v or s > 2 or f) for k, (s, v, f) in want.items()}
