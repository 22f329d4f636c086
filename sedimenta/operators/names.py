"""Names, numbers of persons and of accounts in texts, by a linear-chain tagger.

An averaged perceptron over words in a window of five and over pairs of labels,
trained on all labelled rows by iterative parameter mixing: each round, every
shard of them learns from the mean of all shards' weights. Decoding is Viterbi; a span's
score is the least posterior of its tokens, by forward and backward sums of the
same scores, scaled so that the labels of the rows kept apart are likeliest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.session import settle, unsettle

#: The types found, and what a mask calls them.
MASKS = {
    "EMAIL_ADDRESS": "EMAIL_ADDRESS",
    "PHONE_NUMBER": "PHONE_NUMBER",
    "CREDIT_CARD": "CREDIT_CARD_NUMBER",
    "US_SSN": "US_SSN",
    "PERSON": "PERSON_NAME",
    "US_BANK_NUMBER": "FINANCIAL_ACCOUNT_NUMBER",
    "IBAN_CODE": "FINANCIAL_ACCOUNT_NUMBER",
}
#: ``O``, then a label for the first and one for each later token of each type.
LABELS = ["O", *(f"{p}-{t}" for t in MASKS for p in "BI")]
#: A span counts from this score on.
THRESHOLD = 0.7
#: One of so many parts of the labelled rows sets the scale, the others are learned from in so many rounds, by shards of about so many rows.
SHARDS, ROUNDS, SHARD_ROWS = 8, 4, 4000
#: Traits share so many blocks of weights, by a hash, so the model's size has a bound however many words there are.
BUCKETS = 1 << 16
#: Segments that are labelled by the same weights while these are learned; fractions of weights are counted in units of 1 / UNIT.
TOGETHER, UNIT = 32, 1 << 20
#: Offsets of the words that a token's score reads.
WINDOW = (-2, -1, 0, 1, 2)
SCALES = [0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0]

# Terms of finance that are no persons.
BLOCKLIST = "roth ira fica futa cobra erisa gaap sec fdic finra etf ipo fed fomc nasdaq nyse amex dow vix libor sofr".split()
# Common given and family names.
GIVEN = "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen anna peter maria paul laura daniel emma".split()
FAMILY = "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson thomas taylor moore jackson martin lee perez thompson white harris".split()

#: What a span's text must be like, whatever its score.
SHAPES = {
    "EMAIL_ADDRESS": re.compile(r"[^\s@]+@[^\s@]+\.[^\W\d_]{2,}"),
    "PHONE_NUMBER": re.compile(r"\+?\(?(?:\d[-.\s()]*){7,15}"),
    "CREDIT_CARD": re.compile(r"(?:\d[-\s]?){12,18}\d"),
    "US_SSN": re.compile(r"\d{3}[-\s]?\d{2}[-\s]?\d{4}"),
    "PERSON": re.compile(r"[^\W\d_][^\W\d_'.-]*(?:[\s.'-]+[^\W\d_][^\W\d_]*)*\.?"),
    "US_BANK_NUMBER": re.compile(r"\d{8,17}"),
    "IBAN_CODE": re.compile(r"[A-Z]{2}\d{2}(?:\s?[A-Z0-9]){8,30}"),
}

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
# A sentence ends at a full stop before white space, but not after an initial or a title.
END = re.compile(r"\n|(?<!\b[A-Z])(?<!\bMr)(?<!\bMs)(?<!\bDr)(?<!\bMrs)[.!?](?=\s)")
BLOCKED = frozenset(BLOCKLIST)
PARTICLES = frozenset("de da del van von der la".split())
SETS = [("g", frozenset(GIVEN)), ("f", frozenset(FAMILY)), ("k", BLOCKED)]


def segments(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Tokens (start, end, key) of each line or sentence; a key starts with ``_`` where no space comes before."""
    at = 0
    for stop in [m.end() for m in END.finditer(text)] + [len(text)]:
        out, last = [], -1
        for m in TOKEN.finditer(text, at, stop):
            out.append((m.start(), m.end(), ("_" if m.start() == last else "") + m.group()))
            last = m.end()
        at = stop
        if out:
            yield out


def traits(key: str) -> list[str]:
    """What the scores of a word are added up from; the same at every place of the window."""
    word = key[1:] if len(key) > 1 and key[0] == "_" else key
    low = word.lower()
    form = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    short = re.sub(r"(.)\1+", r"\1+", form)
    out = ["w" + re.sub(r"\d", "d", low), "s" + short, "j" + short + ("_" if key != word else " ")]
    if low.isalpha():
        out += ["e" + low[-2:], "n" + str(min(len(low), 4))]
    elif any(c.isdigit() for c in low):
        out += ["d" + str(min(len(low), 18))]
    return out + [name for name, s in SETS if low in s]


def bucket(trait: str) -> int:
    return crc32(trait.encode()) % BUCKETS


@dataclass
class Model:
    """Weights: of each bucket of traits (its row is told by ``traits``; others have no weight) at each place of the window for each label, of pairs of labels, and the scale of scores."""

    traits: dict[int, int]
    weights: np.ndarray
    pairs: np.ndarray
    scale: float = 1.0

    def scores(self, keys: list[str]) -> np.ndarray:
        """A row a distinct word: its share in the scores of the tokens at each place of the window."""
        out = np.zeros((len(keys), len(WINDOW), len(LABELS)), np.float32)
        for i, k in enumerate(keys):
            for t in traits(k):
                j = self.traits.get(bucket(t))
                if j is not None:
                    out[i] += self.weights[j]
        return out


def _allowed() -> np.ndarray:
    """0 for pairs of labels that may follow each other, else a large negative number: an ``I`` only after its type."""
    n = len(LABELS)
    ok = np.zeros((n, n), np.float32)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            ok[[i for i, a in enumerate(LABELS) if a[2:] != b[2:]], j] = -1e6
    return ok


ALLOWED = _allowed()
FIRST = ALLOWED[0]


def emissions(share: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Scores of the tokens of one segment from their words' shares."""
    n = len(ids)
    out = np.zeros((n, len(LABELS)), np.float32)
    for k, o in enumerate(WINDOW):
        lo, hi = max(0, -o), min(n, n - o)
        if lo < hi:
            out[lo:hi] += share[ids[lo + o:hi + o], k]
    return out


def viterbi(e: np.ndarray, pairs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of a batch of segments (batch, tokens, labels), each of its own length; ties go to the first label."""
    b, n, _ = e.shape
    back = np.zeros(e.shape, np.int8)
    v = e[:, 0] + FIRST
    for t in range(1, n):
        s = v[:, :, None] + pairs
        best = s.argmax(1)
        w = np.take_along_axis(s, best[:, None], 1)[:, 0] + e[:, t]
        on = (t < lengths)[:, None]
        back[:, t] = best
        v = np.where(on, w, v)
    y = np.zeros((b, n), np.int64)
    at = v.argmax(1)
    rows = np.arange(b)
    for t in range(n - 1, -1, -1):
        y[:, t] = np.where(t < lengths, at, 0)
        at = np.where((t < lengths) & (t > 0), back[rows, t, at], at)
    return y


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def posteriors(e: np.ndarray, pairs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Chance of every label of every token, by forward and backward sums; the tokens past a segment's length mean nothing."""
    b, n, k = e.shape
    f, g = np.zeros((b, n, k)), np.zeros((b, n, k))
    may = pairs[pairs > ALLOWED.min() / 2]
    if 2 * (np.ptp(e, axis=2).max() + np.ptp(may)) < 600:  # a label is at most two steps from any other, so no factor that matters is too small for a number
        x, q = np.exp(e - e.max(2, keepdims=True)), np.exp(pairs - may.max())
        f[:, 0] = x[:, 0] * np.exp(FIRST.astype(np.float64))
        for t in range(1, n):
            v = (f[:, t - 1] @ q) * x[:, t]
            f[:, t] = v / v.max(1, keepdims=True)
        g[:, -1] = 1
        for t in range(n - 2, -1, -1):
            v = (x[:, t + 1] * g[:, t + 1]) @ q.T
            g[:, t] = np.where((t + 1 < lengths)[:, None], v / v.max(1, keepdims=True), 1)
        z = f * g
        return z / z.sum(2, keepdims=True)
    f[:, 0] = e[:, 0] + FIRST
    for t in range(1, n):
        f[:, t] = _soft(f[:, t - 1][:, :, None] + pairs, 1) + e[:, t]
    for t in range(n - 2, -1, -1):
        h = _soft(pairs[None] + (e[:, t + 1] + g[:, t + 1])[:, None, :], 2)
        g[:, t] = np.where((t + 1 < lengths)[:, None], h, 0)
    z = f + g
    return np.exp(z - _soft(z, 2)[:, :, None])


def _batches(segs: list[list], cells: int = 60_000) -> Iterator[list[int]]:
    """Numbers of segments of like length, so many that their padded tokens stay within a bound (one segment at least)."""
    order = sorted(range(len(segs)), key=lambda i: len(segs[i]))
    held: list[int] = []
    for i in order:
        if held and len(segs[i]) * (len(held) + 1) > cells:
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def _decoded(m: Model, segs: list[list], spans_only: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Each segment's number, labels, posteriors and log scores; ``spans_only``: of the segments that have a label other than ``O``."""
    words: dict[str, int] = {}
    ids = [np.array([words.setdefault(k, len(words)) for _, _, k in s]) for s in segs]
    share = m.scores(list(words))
    pairs = m.pairs + ALLOWED
    for some in _batches(segs):
        lengths = np.array([len(segs[i]) for i in some])
        e = np.zeros((len(some), lengths.max(), len(LABELS)), np.float32)
        for r, i in enumerate(some):
            e[r, :lengths[r]] = emissions(share, ids[i])
        y = viterbi(e, pairs, lengths)
        if spans_only:  # segments without a span have no score to tell
            on = y.any(1)
            some, lengths, e, y = [i for i, o in zip(some, on, strict=True) if o], lengths[on], e[on], y[on]
            if not some:
                continue
        p = posteriors(e.astype(np.float64) * m.scale, m.pairs.astype(np.float64) * m.scale + ALLOWED, lengths)
        for r, i in enumerate(some):
            yield i, y[r, :lengths[r]], p[r, :lengths[r]], e[r, :lengths[r]]


def plausible(kind: str, said: str) -> bool:
    """Whether a span's text is like its type: ``SHAPES``; names have capitals but for particles, and are no term of finance."""
    if kind == "PERSON" and (said.lower() in BLOCKED or not all(w[0].isupper() or w in PARTICLES for w in said.split())):
        return False
    return SHAPES[kind].fullmatch(said) is not None


def found(m: Model, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """Spans (start, end, type, score) of each text; ends are exclusive. Spans that are not ``plausible`` go."""
    segs, of = [], []
    for d, t in enumerate(texts):
        for s in segments(t):
            segs.append(s)
            of.append(d)
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for i, y, p, _ in _decoded(m, segs, spans_only=True):
        for a, z, kind in spans_of(y):
            score = min(float(p[t, y[t]]) for t in range(a, z))
            start, end = segs[i][a][0], segs[i][z - 1][1]
            if plausible(kind, texts[of[i]][start:end]):
                out[of[i]].append((start, end, kind, score))
    return [sorted(o) for o in out]


def spans_of(y: np.ndarray) -> list[tuple[int, int, str]]:
    """Runs (first token, one past the last, type) of labels."""
    out: list[list] = []
    for t, k in enumerate(y):
        name = LABELS[int(k)]
        if name[0] == "B":
            out.append([t, t + 1, name[2:]])
        elif name[0] == "I" and out:
            out[-1][1] = t + 1
    return [tuple(o) for o in out]


def gold(seg: list[tuple[int, int, str]], spans: list[tuple[int, int, str]]) -> np.ndarray:
    """Labels of a segment's tokens from the spans of its text."""
    y = np.zeros(len(seg), np.int64)
    for a, z, kind in spans:
        first = True
        for t, (s, e, _) in enumerate(seg):
            if s >= a and e <= z:
                y[t] = LABELS.index(("B-" if first else "I-") + kind)
                first = False
    return y


def _learn(rows: list[tuple[list, np.ndarray]], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """One pass over labelled segments from the weights given: places of weights (by bucket, place of the window and label, those of pairs of labels last) and how far they move, in units.

    The end of the pass is the mean of all weights on the way. ``TOGETHER``
    segments at a time are labelled by the same weights; those with a mistake
    are then labelled anew, one by one, and learned from.
    """
    k = len(LABELS)
    words: dict[str, int] = {}
    ids = [np.array([words.setdefault(key, len(words)) for _, _, key in seg]) for seg, _ in rows]
    told = [[bucket(t) for t in traits(w)] for w in words]
    seen = np.unique([b for w in told for b in w])
    w = np.zeros((len(seen) + 1, len(WINDOW), k), np.float32)  # the last one fills up the lists of words with fewer traits
    here = {int(b): i for i, b in enumerate(seen)}
    known = [(i, m.traits[b]) for b, i in here.items() if b in m.traits]
    if known:
        w[[i for i, _ in known]] = m.weights[[j for _, j in known]]
    cols = np.full((len(told), max(map(len, told), default=0)), len(seen))
    for i, bs in enumerate(told):
        cols[i, :len(bs)] = [here[b] for b in bs]
    pairs = m.pairs.copy()
    by_w, late_w = np.zeros(w.shape, np.int32), np.zeros(w.shape, np.int64)
    by_p, late_p = np.zeros((k, k), np.int32), np.zeros((k, k), np.int64)
    n = len(rows) + 1
    for lo in range(0, len(rows), TOGETHER):
        some = range(lo, min(lo + TOGETHER, len(rows)))
        lengths = np.array([len(ids[i]) for i in some])
        on = np.arange(lengths.max()) < lengths[:, None]
        y = np.zeros(on.shape, np.int64)
        y[on] = np.concatenate([rows[i][1] for i in some])
        met, at = np.unique(np.concatenate([ids[i] for i in some]), return_inverse=True)
        share = np.zeros((*on.shape, len(WINDOW), k), np.float32)
        share[on] = w[cols[met]].sum(1)[at]
        e = np.zeros((*on.shape, k), np.float32)
        for j, o in enumerate(WINDOW):
            a, z = max(0, -o), min(on.shape[1], on.shape[1] - o)
            if a < z:
                e[:, a:z] += share[:, a + o:z + o, j]
        wrong = ((viterbi(e, pairs + ALLOWED, lengths) != y) & on).any(1)
        for i in np.array(some)[wrong]:
            word, want = ids[i], rows[i][1]
            got = viterbi(emissions(w[cols[word]].sum(1), np.arange(len(word)))[None], pairs + ALLOWED, lengths[[i - lo]])[0]
            t = np.flatnonzero(got != want)
            for j, o in enumerate(WINDOW):
                inside = t[(t + o >= 0) & (t + o < len(word))]
                for lab, by in ((want, 1), (got, -1)):
                    put = (cols[word[inside + o]], j, lab[inside][:, None])
                    np.add.at(w, put, by)
                    np.add.at(by_w, put, by)
                    np.add.at(late_w, put, by * (i + 1))
            t = np.flatnonzero((want[1:] != got[1:]) | (want[:-1] != got[:-1]))
            for lab, by in ((want, 1), (got, -1)):
                put = (lab[t], lab[t + 1])
                np.add.at(pairs, put, by)
                np.add.at(by_p, put, by)
                np.add.at(late_p, put, by * (i + 1))
            w[-1] = 0
    far = np.rint((by_w[:-1] - late_w[:-1] / n) * UNIT).astype(np.int64)
    i, j, lab = np.nonzero(far)
    cells = (seen[i].astype(np.int64) * len(WINDOW) + j) * k + lab if len(i) else np.zeros(0, np.int64)
    far_p = np.rint((by_p - late_p / n) * UNIT).astype(np.int64).ravel()
    there = np.flatnonzero(far_p)
    return np.r_[cells, there + BUCKETS * len(WINDOW) * k], np.r_[far[i, j, lab], far_p[there]]


def _mixed(m: Model, cells: np.ndarray, by: np.ndarray) -> Model:
    """The model with its weights at ``cells`` moved by ``by``."""
    width = len(WINDOW) * len(LABELS)
    own = cells < BUCKETS * width
    new = sorted(set((cells[own] // width).tolist()) - m.traits.keys())
    places = {**m.traits, **{b: len(m.traits) + i for i, b in enumerate(new)}}
    w, p = np.concatenate([m.weights.reshape(-1, width), np.zeros((len(new), width), np.float32)]), m.pairs.copy().ravel()
    w[[places[b] for b in (cells[own] // width).tolist()], cells[own] % width] += by[own].astype(np.float32)
    p[cells[~own] - BUCKETS * width] += by[~own].astype(np.float32)
    return Model(places, w.reshape(-1, len(WINDOW), len(LABELS)), p.reshape(m.pairs.shape), m.scale)


def fit(labelled: DataFrame, rows: int | None = None, shards: int = SHARDS, rounds: int = ROUNDS) -> Model:
    """Learn from ``labelled`` (``text``, ``spans``: array of start, end, type; null texts are left out).

    All rows count: one of ``shards`` parts of them, by a hash of the text, sets the
    scale, and weights come from all others, cut into as many shards as they
    need to be of about ``SHARD_ROWS`` rows. Only a caller that names ``rows`` gets
    a model of about as many, chosen by a bound on a hash of the text. What shards
    learned is added up by weight, in whole numbers, so the same rows give the same
    model. The driver sees the weights that moved, which ``BUCKETS`` bounds. Spans of
    unknown types and ones that cut a token are not learned. No rows give a
    model that finds nothing.
    """
    d = labelled.where(F.col("text").isNotNull()).select("text", F.coalesce("spans", F.array()).alias("spans"))
    n = d.count()
    if rows is not None and n > rows:
        d = d.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(rows / n * (1 << 20)))
        n = rows
    cuts = max(1, -(-n // (shards * SHARD_ROWS)))
    part, cut = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(shards)), F.pmod(F.xxhash64("text", F.lit(8)), F.lit(cuts))
    d = settle(d.withColumn("shard", ((part - 1) * cuts + cut).cast("int")).withColumn("apart", part == 0), "labelled")

    def lines(pdf: pd.DataFrame) -> list[tuple[list, np.ndarray]]:
        out = []
        for t, sp in zip(pdf["text"], pdf["spans"], strict=True):
            known = [(s["start"], s["end"], s["type"]) for s in sp if s["type"] in MASKS]
            out += [(s, gold(s, known)) for s in segments(t)]
        return out

    k = len(LABELS)
    m = Model({}, np.zeros((0, len(WINDOW), k), np.float32), np.zeros((k, k), np.float32))
    learned = d.where("not apart").select("text", "spans", "shard")
    for _ in range(rounds):
        start = labelled.sparkSession.sparkContext.broadcast(m)

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(batches)
            for _, pdf in pd.concat(parts).groupby("shard") if parts else ():
                cells, by = _learn(lines(pdf.sort_values("text", kind="stable")), start.value)  # noqa: B023  (used within this round)
                yield pd.DataFrame({"cell": np.r_[-1, cells], "by": np.r_[1, by]})  # -1: how many shards there are

        by_shard = learned.repartitionById(max(1, (shards - 1) * cuts), "shard").mapInPandas(learn, "cell long, by long")
        moved = by_shard.groupBy("cell").agg(F.sum("by").alias("by")).where("by <> 0").orderBy("cell").toArrow()
        start.unpersist()
        cells, by = (moved[c].to_numpy() for c in ("cell", "by"))
        if len(cells):
            m = _mixed(m, cells[1:], by[1:] / (by[0] * UNIT))
    last = labelled.sparkSession.sparkContext.broadcast(m)

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            some = lines(pdf)
            for s in SCALES:
                scaled = Model(last.value.traits, last.value.weights, last.value.pairs, s)
                got = sum(float(np.log(np.maximum(p[np.arange(len(p)), some[i][1]], 1e-9)).sum()) for i, _, p, _ in _decoded(scaled, [x for x, _ in some]))
                yield pd.DataFrame({"scale": [s], "ll": [got]})

    best = d.where("apart").select("text", "spans").mapInPandas(likely, "scale double, ll double").groupBy("scale").agg(F.sum("ll").alias("ll")).orderBy(F.desc("ll"), "scale").first()
    last.unpersist()
    unsettle(d)
    return Model(m.traits, m.weights, m.pairs, best[0] if best else 1.0)


SPANS = "array<struct<start:int,end:int,type:string,score:double>>"


def with_spans(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``spans`` of its whole texts: those of a score of ``threshold`` or more, in order; null and empty texts have none.

    A column ``spans`` of ``docs`` is replaced. The model goes out as a
    broadcast; its size is that of ``fit``'s bounded rows.
    """
    m = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            got = found(m.value, [t or "" for t in s])
            yield pd.Series([[{"start": a, "end": z, "type": k, "score": p} for a, z, k, p in x if p >= threshold] for x in got], index=s.index, dtype=object)

    return docs.withColumn("spans", run(F.col(text_col)))


def masked(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``masked``, the text with spans replaced by ``[PII:TYPE]`` and then the rules of ``mask_supplement``, and ``spans``."""
    names = F.create_map(*[F.lit(x) for kv in MASKS.items() for x in kv])
    t, at = F.col(text_col), F.col("_cut")
    put = lambda x, s: F.struct(
        F.concat(x["out"], F.substring(t, x["at"] + 1, s["start"] - x["at"]), F.lit("[PII:"), names[s["type"]], F.lit("]")).alias("out"), s["end"].alias("at"))
    d = with_spans(docs, model, text_col, threshold)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at")).cast("struct<out:string,at:int>")
    d = d.withColumn("_cut", F.aggregate("spans", start, lambda x, s: put(x, s).cast("struct<out:string,at:int>")))
    whole = F.concat(at["out"], F.substring(t, at["at"] + 1, F.char_length(t)))
    return d.withColumn("masked", T.mask_supplement(whole)).drop("_cut")
