"""Operator 12: quality rules as weak supervision. Rules vote or abstain; expectation-maximisation learns how far to trust each. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import SPACE, documents, words

#: Words in a window that must not come twice.
WINDOW = 8
GOOD, BAD, ABSTAIN = 1, -1, 0
#: Posterior chance of good quality from which a document is kept.
KEEP = 0.5
ROUNDS, STILL = 200, 1e-9

# Frequent function words of the languages the corpus is in.
FUNCTION_WORDS = (
    "the of and to in is that for it was on with as be by at from or this an are not have "
    "der die das und ist in den von zu mit ein eine nicht auf dem des im für sich auch "
    "le la les de des et un une est dans que pour du qui sur pas par au avec il "
    "el los las y en que una por con para del se su no es al lo como más"
)


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds; else, and where a condition is null, it abstains."""

    name: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        return F.when(self.bad, F.lit(BAD)).when(self.good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def rules() -> list[Rule]:
    """Rules over the columns of ``features``; their thresholds leave a wide band of abstention between the votes."""
    share = lambda part, of: F.col(part) / F.nullif(F.col(of), F.lit(0))
    n, enough = F.col("n_words"), F.col("n_words") >= 40
    length, symbols = share("word_chars", "n_words"), share("n_symbols", "n_words")
    return [
        Rule("length", n < 20, n >= 60),
        Rule("word_length", (length < 2) | (length > 13), length.between(3, 9)),
        Rule("symbols", symbols > 0.1, symbols < 0.01),
        Rule("lines", (F.col("n_dup_lines") >= 3) & (share("n_dup_lines", "n_lines") > 0.3), (F.col("n_lines") >= 3) & (F.col("n_dup_lines") == 0)),
        Rule("repeats", share("n_repeat_words", "n_words") > 0.2, enough & (F.col("n_repeat_words") == 0)),
        Rule("letters", share("n_letters", "word_chars") < 0.75, share("n_letters", "word_chars") > 0.9),
        Rule("capitals", share("n_capitals", "n_letters") > 0.3, share("n_capitals", "n_letters") < 0.1),
        Rule("function_words", enough & (share("n_function", "n_words") < 0.01), enough & (share("n_function", "n_words") > 0.05)),
        Rule("sentences", enough & (share("n_ends", "n_words") < 0.002), enough & share("n_ends", "n_words").between(0.02, 0.3)),
        Rule("variety", enough & (share("n_distinct", "n_words") < 0.1), enough & (share("n_distinct", "n_words") > 0.3)),
    ]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many words of an array lie in a run of ``window`` words that comes twice or more, each word counted once.

    Runs are told by 64-bit hashes (a chance under 1e-10 of one wrong pair in
    20 000 words). Only arrays with a hash that repeats are sorted.
    """
    last = F.size(w) - window + 1
    run = lambda arr, i: F.xxhash64(F.slice(arr, i, window))

    def covered(at: Column) -> Column:
        """Words under runs that start at these ascending places."""
        gaps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(window)))
        return F.aggregate(gaps, F.lit(window), lambda s, x: s + x)

    def twice(s: Column) -> Column:
        same = lambda x, y: x["h"].eqNullSafe(y["h"])
        marked = F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["at"]))
        return F.sort_array(F.array_compact(marked))

    def sorted_runs(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: run(w, i))
    counted = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(_let(sorted_runs(h), twice), covered)))
    return F.when(last >= 2, counted).otherwise(F.lit(0))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts a document, from its whole text (null: no words).

    No shuffle: repeated rows, null ids and extra columns change nothing, an
    empty table gives an empty one.
    """
    text, w = F.col("text"), F.col("words")
    only = lambda keep: F.char_length(F.regexp_replace(text, f"[^{keep}]+", ""))
    d = documents(df, id_col, text_col).select("doc_id", "text", words(text).alias("words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(SPACE.replace("[", "[^", 1))).alias("lines"))
    function = F.filter(w, lambda x: F.lower(x).isin(*sorted(set(FUNCTION_WORDS.split()))))
    counts = {
        "n_words": F.size(w), "word_chars": F.char_length(F.array_join(w, "")), "n_symbols": only("#*$%&|<>"), "n_lines": F.size("lines"), "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(w), "n_letters": only("\\p{L}"), "n_capitals": only("\\p{Lu}"), "n_function": F.size(function), "n_distinct": F.size(F.array_distinct(w)),
        "n_ends": F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D.!?][.!?](?![^\\x20\\x09-\\x0D])")),
    }
    return d.select("doc_id", *[c.cast("long").alias(name) for name, c in counts.items()])


@dataclass
class Trust:
    """The share of good documents, and of each rule how often it votes good when it votes, on good and on bad ones."""

    names: list[str]
    prior: float
    on_good: list[float]
    on_bad: list[float]

    def posterior(self, votes: list[Column]) -> Column:
        """Chance of good quality given the votes; a rule that abstains says nothing."""
        logit = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, g, b in zip(votes, self.on_good, self.on_bad, strict=True):
            logit = logit + F.when(v == GOOD, F.lit(math.log(g / b))).when(v == BAD, F.lit(math.log((1 - g) / (1 - b)))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))


def learn(names: list[str], patterns: dict[tuple[int, ...], int]) -> Trust:
    """Expectation-maximisation over how many documents vote in each pattern.

    It starts from each pattern's share of good votes. Every count has one
    imagined document of either kind beside it, so that no chance is 0 or 1.
    Of the two classes, good is the one on which rules vote good more often.
    """
    rows = sorted(patterns.items())
    good = [(v.count(GOOD) + 1) / (v.count(GOOD) + v.count(BAD) + 2) for v, _ in rows]
    total, before, k = sum(patterns.values()), -math.inf, len(names)
    for _ in range(ROUNDS):
        prior = (sum(n * g for (_, n), g in zip(rows, good)) + 1) / (total + 2)
        said = [[1.0, 1.0] for _ in range(k)]
        cast = [[2.0, 2.0] for _ in range(k)]
        for (v, n), g in zip(rows, good):
            for j in range(k):
                if v[j] != ABSTAIN:
                    for y, share in ((0, n * g), (1, n * (1 - g))):
                        cast[j][y] += share
                        said[j][y] += share if v[j] == GOOD else 0.0
        chance = [[s / c for s, c in zip(*pair)] for pair in zip(said, cast)]
        likelihood, good = 0.0, []
        for v, n in rows:
            on = [math.log(prior), math.log(1 - prior)]
            for j in range(k):
                if v[j] != ABSTAIN:
                    on = [x + math.log(c if v[j] == GOOD else 1 - c) for x, c in zip(on, chance[j])]
            top = max(on)
            both = sum(math.exp(x - top) for x in on)
            likelihood += n * (top + math.log(both))
            good.append(math.exp(on[0] - top) / both)
        if abs(likelihood - before) <= STILL * max(1, total):
            break
        before = likelihood
    on_good, on_bad = [c[0] for c in chance], [c[1] for c in chance]
    return Trust(names, prior, on_good, on_bad) if sum(on_good) >= sum(on_bad) else Trust(names, 1 - prior, on_bad, on_good)


def fit(counted: DataFrame, checks: list[Rule] | None = None) -> Trust:
    """Accuracies of the rules, without labels. The driver reads one row a pattern of votes (3 to the number of rules at most), however many documents."""
    checks = rules() if checks is None else checks
    votes = counted.select(F.array(*[r.vote() for r in checks]).alias("votes")).groupBy("votes").count().collect()
    return learn([r.name for r in checks], {tuple(r["votes"]): r["count"] for r in votes} or {(ABSTAIN,) * len(checks): 0})


def judge(counted: DataFrame, trust: Trust, checks: list[Rule] | None = None) -> DataFrame:
    """``votes`` (array in the order of the rules), ``quality`` (posterior chance), ``base_failed`` and ``kept`` beside the columns of ``features``.

    A document fails the base for under 20 words or over 30 % of its words in
    repeated windows; all others stay from a posterior of a half on.
    """
    checks = rules() if checks is None else checks
    votes = [r.vote() for r in checks]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = counted.withColumns({"votes": F.array(*votes), "quality": trust.posterior(votes), "base_failed": failed})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))
