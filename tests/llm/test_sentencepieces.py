import struct
from random import Random

import public_tokenizers
import pytest

from sedimenta.llm import sentencepieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


def number(x):
    out = b""
    while x > 127:
        out += bytes([x & 127 | 128])
        x >>= 7
    return out + bytes([x])


def message(n, body):
    return number(n << 3 | 2) + number(len(body)) + body


def unigram(m, raw):
    """The same model file with its scores as a unigram model's, for the library to encode with."""
    out, i = b"", 0
    for n, v in sp._fields(raw):
        if n == 1:
            out += message(1, message(1, m.pieces[i].encode()) + number(2 << 3 | 5) + struct.pack("<f", m.scores[i]) + number(3 << 3) + number(m.kinds[i]))
            i += 1
        else:
            out += message(n, v)
    return out + message(2, bytes([3 << 3, 1]))


def test_against_the_library_and_round_trip(docs):
    import sentencepiece

    raw = open(PATH, "rb").read()
    changed = unigram(sp.load(PATH), raw)
    ours, lib = sp.Pieces(changed), sentencepiece.SentencePieceProcessor(model_proto=changed)
    score = lambda ids: sum(ours.scores[i] for i in ids)
    texts = [r.text for r in docs.collect()] + ["", " ", "  a  b ", "日本語 text\n\nx", "\t\ttab", "émile 😀 ퟿", "x" * 300, "a\x00b"]
    same = 0
    for t in texts:
        a, b = ours.encode(t), lib.encode(t)
        # The library adds up in single precision: it may take another path of the same score, never a better one.
        assert a == b or score(a) >= score(b) - 1e-6 * abs(score(b))
        same += a == b
        assert ours.decode(a) == lib.decode(a) == t
    assert same >= 0.9 * len(texts)


def exhaustive(m, text):
    """The best score of any segmentation, by recursion over all."""
    best = {0: 0.0}
    pieces = {p: s for p, s, k in zip(m.pieces, m.scores, m.kinds, strict=True) if k == sp.NORMAL}
    for end in range(1, len(text) + 1):
        options = [best[a] + pieces[text[a:end]] for a in range(end) if text[a:end] in pieces]
        best[end] = max(options) if text[end - 1 : end] in pieces else max([*options, best[end - 1] + m.unk_score])
    return best[len(text)]


@pytest.mark.parametrize("seed", range(30))
def test_best_path_is_the_best_of_all(seed):
    m = sp.load(PATH)
    rng = Random(seed)
    text = m.normalize("".join(rng.choice("theandiou s éß日") for _ in range(25)))
    ids = m.best_path(text)
    got = sum(m.scores[i] for i in ids if m.kinds[i] == sp.NORMAL) + m.unk_score * sum(c not in m.pieces for c in text)
    assert got == pytest.approx(exhaustive(m, text))
    assert m.decode(m.best_path(text)) == text[1:].replace(sp.SPACE, " ")


def test_words_are_independent():
    m = sp.load(PATH)
    for text in ("the  end   of a day", " leading", "trailing  ", "x\ny z"):
        assert m.encode(text) == m.best_path(m.normalize(text))


def test_odd_rows(spark, odd, nothing):
    enc = sp.encode(odd, PATH)
    back = sp.decode(enc, PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r.doc_id or 0, (r.text or "").replace(sp.SPACE, " ")) for r in odd.collect())
    assert sp.encode(nothing, PATH).count() == 0 and sp.digest(odd, PATH).where("not same").count() == 1  # the row that holds the space sign itself
