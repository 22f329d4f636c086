import hashlib
from random import Random

from sedimenta.llm import fingerprint as fp


def brute(rows):
    """doc_id: (edited text, next text) by one sort of all rows."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        out[doc] = (text[: len(text) - half] + nxt[:half], nxt)
    return out


def test_against_one_sort(spark, docs):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = fp.edit_likeness(docs).collect()
    assert len(got) == len(want)
    for r in got:
        edited, nxt = want[r.doc_id]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.edited_fingerprint == fp.pack(*fp.vector(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)


def test_multiset_hash_is_homomorphic():
    rng = Random(1)
    lines = [" ".join(rng.choice("abc def ghi jkl mno".split()) for _ in range(9)) for _ in range(30)]
    whole = fp.pack(*fp.vector("\n".join(lines)))
    shuffled = lines[:]
    rng.shuffle(shuffled)
    assert fp.pack(*fp.vector("\n".join(shuffled))) == whole
    some, rest = fp.pack(*fp.vector("\n".join(lines[:7]))), fp.pack(*fp.vector("\n".join(lines[7:])))
    assert fp.combine(some, rest) == whole and fp.combine(whole, rest, -1) == some
    assert fp.pack(*fp.vector("\n".join(lines[:-1]))) != whole
    assert fp.pack(*fp.vector("\n".join([*lines, lines[0]]))) != whole  # a multiset counts repeats


def test_likeness_follows_the_share_of_text():
    rng = Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a = [word() for _ in range(600)]
    for share in (0.0, 0.5, 0.9):
        b = a[: int(600 * share)] + [word() for _ in range(600 - int(600 * share))]
        assert abs(fp.likeness(fp.vector(" ".join(a)), fp.vector(" ".join(b))) - share) < 0.2
    assert fp.likeness(fp.vector(""), fp.vector("\n \n")) == 1.0


def test_odd_rows(spark, odd, nothing):
    got = fp.edit_likeness(odd).collect()
    assert len(got) == odd.count() and fp.edit_likeness(nothing).count() == 0
    assert len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1
    assert {r.n_chars for r in got if r.doc_id == 1} == {0}
    last = next(r for r in got if r.doc_id is None)  # after the last comes the first
    text, first = "The dog with no id at all", "\x00 nul ퟿ <|endoftext|> ▁ x"
    assert last.edited_sha256 == hashlib.sha256((text[:13] + first[:12]).encode()).hexdigest()
    sole = fp.edit_likeness(odd.where("doc_id = 5")).collect()
    assert len(sole) == 1 and sole[0].near_next == 1.0
