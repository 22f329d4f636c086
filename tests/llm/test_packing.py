import zlib
from array import array
from collections import defaultdict
from random import Random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import packing as pk

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def check(got, texts, length=2048):
    """Every piece is the tokenizer's, and sequences are filled without gaps."""
    seqs, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    for doc, ts in texts.items():
        rows = sorted(by_doc[doc], key=lambda r: r.piece)
        for t in set(ts):
            ids = [*whole(t or ""), 0]
            want = [(k, k * length, len(p := ids[k * length : (k + 1) * length]), zlib.crc32(array("I", p).tobytes())) for k in range(-(-len(ids) // length))]
            have = [(r.piece, r.start, r.length, r.ids_crc32) for r in rows]
            assert all(have.count(w) == len(ts) for w in want) and len(have) == len(want) * len(ts)
    return len(seqs)


def test_table(spark, docs):
    got = pk.pack(docs, PATH).collect()
    n = check(got, {r.doc_id: [r.text] for r in docs.collect()})
    least = -(-sum(r.length for r in got) // 2048)
    assert n <= least * 1.01 + 1


def test_odd_rows(spark, odd, nothing):
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(r.text)
    check(pk.pack(odd, PATH, group=3).collect(), texts)
    assert pk.pack(nothing, PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x1c\x85\xa0  　's'ré́İΣς<|endoftext|>")), max_size=60))
def test_words_give_the_text_s_ids(text):
    assert pk.word_ids(PATH).of(text) == array("I", whole(text)).tobytes()


@pytest.mark.parametrize("seed", range(5))
def test_best_two_fit(seed):
    rng = Random(seed)
    lengths = np.array([min(99, 1 + int(rng.expovariate(1 / 30))) for _ in range(400)])
    bins, offsets, n = pk.best_two_fit(lengths, 100)
    fill = np.bincount(bins, weights=lengths, minlength=n)
    assert fill.max() <= 100 and len(fill) == n
    for b in range(n):
        own = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
        assert [o for o, _ in own] == [0, *np.cumsum([x for _, x in own])[:-1]]
    assert n <= -(-lengths.sum() // 100) * 1.02 + 2


def test_two_replace_the_smallest():
    bins, _, n = pk.best_two_fit(np.array([60, 35, 20, 19]), 100)  # 60 + 35 leaves 5: 60 + 20 + 19 is tighter
    assert n == 2 and bins[0] == bins[2] == bins[3] != bins[1]


def test_tokenizers_that_keep_white_space_encode_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "  Hello there,\n\nworld  of 12 things "
    assert not pk.WordIds(path).by_word and pk.WordIds(public_tokenizers.path("word_bpe_49k.json")).by_word
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(pk.WordIds(path).of(text), "<u4").tolist() == ids
