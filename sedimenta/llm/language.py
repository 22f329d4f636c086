"""Operator 8: language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import documents, held_out, kept

#: Hash buckets of the character n-grams, and the lengths of these.
BUCKETS, NGRAMS = 8192, (1, 2, 3)
#: About so many labelled rows of each language are learned from.
SAMPLE = 3000
#: Languages a code is made for; a table with more is a mistake in the labels.
LANGUAGES = 500
#: Root of the number of n-grams from which a mean margin counts as settled.
STEADY = 12.0
#: A prediction whose best two languages share this much of each other's odds is ambiguous.
AMBIGUOUS = 0.9
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the text, lower case, with runs of other than letters as one space."""
    low = text.lower()
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = letters()[c]
    if not keep.any():
        return np.zeros(BUCKETS, np.int64)
    c = np.where(keep, c, np.uint32(32))
    c = np.concatenate((np.array([32], np.uint32), c[np.concatenate(([True], keep[1:] | keep[:-1]))], np.array([32], np.uint32)))
    total, h = np.zeros(BUCKETS, np.int64), np.zeros(len(c), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1 :]
        if n in NGRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            total += np.bincount(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return total


def codewords(n: int) -> np.ndarray:
    """A +1 or -1 word for each of ``n`` languages.

    Up to six languages get the exhaustive code, each split of the languages
    once; more get random balanced columns, the best of 50 draws by the least
    distance of two words.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        cols = [[1 if (v >> i) & 1 else -1 for i in range(n)] for v in range(1, 1 << n, 2) if v != (1 << n) - 1]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(8), 15 * max(1, int(np.ceil(np.log2(n))))
    draws = [np.stack([rng.permutation(np.where(np.arange(n) < n // 2, 1.0, -1.0)) for _ in range(bits)], axis=1) for _ in range(50)]
    apart = lambda w: np.max(np.abs(w @ w.T) - 2 * bits * np.eye(n))
    return min(draws, key=apart)


@dataclass
class Model:
    """Languages, their codewords, each bit's weights over buckets and its own weight in decoding."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, c: np.ndarray) -> tuple[str, float, bool]:
        """Language, score and ambiguity for the n-gram counts of one text.

        A bit's margin is the mean log-likelihood ratio of the n-grams, times
        the root of their number up to STEADY, beyond which a longer text is
        no more certain (it may hold two languages); a language's loss is the trust-weighted sum of
        log(1 + exp(-bit x margin)), and the least loss wins. The score is the
        winner's share of exp(-loss).
        """
        n = c.sum()
        if not n or not self.languages:
            return UNKNOWN, 0.0, True
        margin = (c @ self.weights) / n * min(STEADY, np.sqrt(n))
        loss = np.logaddexp(0, -self.words * margin) @ self.trust
        odds = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        second = np.partition(odds, -2)[-2] if len(odds) > 1 else 0.0
        return self.languages[best], float(1 / odds.sum()), bool(second > AMBIGUOUS)


def fit(df: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from about ``sample`` labelled rows of each language, chosen by a hash of their id; held-out rows never count.

    Tasks add up the n-gram counts of their rows by language; the driver gets
    one row of counts per language. Each bit is a naive Bayes classifier of the
    languages whose words have +1 there against the others, every language
    counting alike. A table without labels gives a model that says ``und``.
    """
    d = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS, 1)), np.ones(1))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("lang")), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = counts(text)
                if n := c.sum():  # each text counts alike, up to a thousand n-grams
                    sums[lang] = sums.get(lang, 0) + c * min(1.0, 1000 / n)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["lang", "counts"])

    parts = d.where(drawn).select("lang", "text").mapInArrow(add, "lang string, counts array<double>")
    each = parts.select("lang", F.posexplode("counts").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.collect_list(F.struct("k", "v")).alias("kv")).collect()
    by = {r["lang"]: r["kv"] for r in each}
    table = np.full((len(languages), BUCKETS), 0.5)
    for i, lang in enumerate(languages):
        for k, v in by.get(lang, ()):
            table[i, k] += v
    p = table / table.sum(axis=1, keepdims=True)
    words = codewords(len(languages))
    weights, trust = np.zeros((BUCKETS, words.shape[1])), np.ones(words.shape[1])
    for j in range(words.shape[1]):
        one, zero = p[words[:, j] > 0], p[words[:, j] < 0]
        if len(one) and len(zero):
            weights[:, j] = np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0))
            # How far the languages stand from the wrong side of this bit, the nearest deciding.
            trust[j] = max(1e-3, float((words[:, j] * (p @ weights[:, j])).min()))
    return Model(languages, words, weights, trust / trust.sum() * len(trust))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``ambiguous`` of every whole text. No shuffle.

    Null and empty texts and those without a letter: ``und``, score 0,
    ambiguous. Extra columns are never read; an empty table gives no rows.
    """
    d = documents(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.decode(counts(t)) for t in b.column(1).to_pylist()]
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "lang_pred", "score", "ambiguous"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def keep_known(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is told: neither ``und`` nor ambiguous."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def told(texts: list[str]) -> list[bool]:
        got = [shared.value.decode(counts(t)) for t in texts]
        return [lang != UNKNOWN and not ambiguous for lang, _, ambiguous in got]

    return kept(df, text_col, told)
