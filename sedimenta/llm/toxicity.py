"""Operator 5: toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import Memo, by_hash, documents, held_out, kept, small_batches
from sedimenta.session import settle

#: Labelled rows that are learned from at most: 80 % for lexicon and trees, 20 % for the calibration.
SAMPLE = 30_000
#: Entries of the learned lexicon, the documents that an entry must be in, and its least log-odds.
LEXICON, LEAST, ODDS = 2000, 4, 1.5
#: Lengths of the word beginnings that the lexicon may hold beside whole words.
STEMS = (4, 5, 6)
#: Words from an insult to a second person that count as near.
NEAR = 5
TREES, DEPTH = 30, 4
VECTOR, MARGIN = "vector", "margin"

# Words that insult, and second persons, of the languages that the corpus has.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns fool foolish jerk "
    "freak creep ugly imbecile cretin dimwit halfwit bastard bitch asshole shit fuck fucking crap "
    "dumm dumme dummkopf idiotin trottel arschloch scheisse scheiße abschaum versager widerlich erbärmlich hässlich wertlos "
    "idiota estúpido estúpida tonto tonta imbécil basura asqueroso asquerosa patético patética inútil perdedor payaso mierda "
    "idiote stupide imbécile crétin crétine ordure minable dégoûtant dégoûtante pathétique nul nulle perdant connard merde".split()
)
SECOND = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine deinen deiner euch euer ihr tu te ti tú tus vos usted ustedes vosotros toi ton ta tes vous votre vos".split()
)
FEATURES = ["insults", "learned", "learned_max", "learned_hits", "near_second", "capitals", "shouted", "marks", "punctuation", "obfuscated", "stretched", "disguised", "words", "word_length"]

WORD = re.compile(r"[^\W\d_]+")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
OBFUSCATED = re.compile(r"[^\W\d_][@$*!|0-9]+[^\W\d_]|\b(?:[^\W\d_][.\-_ ]){3,}[^\W\d_]\b")
#: Characters up to 127, and 128 for all others: 1 inside a disguised word, 2 maybe a letter, 3 between spaced letters.
KINDS = np.array([1 if chr(i) in "@$*!|0123456789" else 2 if chr(i).isalpha() or i == 128 else 3 if chr(i) in ".-_ " else 0 for i in range(129)], np.int8)
#: Characters that stand for letters in disguised words.
PLAIN = str.maketrans("@$01345!7|", "asoieasitl")


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def may_hold(text: str) -> tuple[bool, bool]:
    """Whether STRETCHED, and whether OBFUSCATED, can match a text at all: tests over whole arrays that let every match through."""
    c = codes(text)
    same = c[1:] == c[:-1]
    stretched = bool((same[1:] & same[:-1]).any())
    kind = KINDS[np.minimum(c, 128)]
    inside = (kind[1:] == 1) & (kind[:-1] == 2)
    gap = kind == 3
    return stretched, bool(inside.any() or (gap[:-4] & gap[2:-2] & gap[4:]).any())


def units(text: str) -> set[str]:
    """What the lexicon may hold of a text: its words in lower case, and their beginnings (with a *)."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


@dataclass
class Lexicon:
    """In how many toxic and other documents words and word beginnings are, and the weight of any word by that.

    A weight is the log-odds less its standard error, and 0 under ODDS or in
    under LEAST toxic documents. For a document that was counted itself, give
    its label: it is taken off first, so that trees learn from weights as a new
    document would get them.
    """

    counts: dict[str, tuple[int, int]]
    toxic: int
    other: int

    def __post_init__(self) -> None:
        self.odds = {y: {u: o for u in self.counts if (o := self._odds(u, y)) > 0} for y in (0, 1, -1)}
        self.known = [Memo(lambda w, y=y: self._most(w, y), 80_000) for y in (0, 1, -1)]

    def __reduce__(self) -> tuple:  # what is remembered stays where it is
        return Lexicon, (self.counts, self.toxic, self.other)

    def _odds(self, unit: str, label: int) -> float:
        a, b = self.counts.get(unit, (0, 0))
        a, b = a - (label == 1), b - (label == 0)
        if a < LEAST:
            return 0.0
        n1, n0 = self.toxic - (label == 1), self.other - (label == 0)
        odds = math.log((a + 0.5) / (n1 + 1)) - math.log((max(b, 0) + 0.5) / (n0 + 1)) - math.sqrt(1 / (a + 0.5) + 1 / (max(b, 0) + 0.5))
        return odds if odds >= ODDS else 0.0

    def _most(self, word: str, label: int) -> float:
        odds = self.odds[label].get
        return max(odds(word, 0.0), *(odds(word[:n] + "*", 0.0) for n in STEMS)) if len(word) > STEMS[-1] else max(odds(x, 0.0) for x in (word, *(word[:n] + "*" for n in STEMS if len(word) > n)))

    def weights(self, words: list[str], label: int = -1) -> list[float]:
        return list(map(self.known[label].__getitem__, words))


def features(text: str, lexicon: Lexicon, label: int = -1) -> list[float]:
    """The dense features of a text, in the order of FEATURES; all 0 for an empty one."""
    low = text.lower()
    words = WORD.findall(low)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    weights = lexicon.weights(words, label)
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    hits = [i for i, x in enumerate(weights) if x > 0]
    bad = sorted({*fixed, *hits})
    near = 0
    if bad:
        near = sum(not SECOND.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in bad)
    size = len(text)
    capitals = int(np.count_nonzero(codes(text) != codes(low))) if len(low) == size else sum(map(str.isupper, text))
    disguised = 0
    may_stretch, may_hide = may_hold(low)
    odd = [m.group() for m in OBFUSCATED.finditer(low)] if may_hide else []
    if odd:
        disguised = sum(any(w in INSULTS or lexicon.weights([w], label)[0] > 0 for w in WORD.findall(t.translate(PLAIN))) for t in low.split() if not t.isalpha() and OBFUSCATED.search(t))
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    marks = text.count("!") + text.count("?")
    points = sum(text.count(c) for c in ".,;:!?*#$%&@")
    return [
        len(fixed) / n, sum(weights) / n, max(weights), math.log1p(len(hits)), near / n, capitals / size, shouted / n, marks / size,
        points / size, len(odd) / n, sum(1 for _ in STRETCHED.finditer(low)) / n if may_stretch else 0.0, math.log1p(disguised), math.log1p(n), sum(map(len, words)) / n,
    ]


def dense(text: Column, lexicon: Lexicon, spark: SparkSession, label: Column | None = None) -> Column:
    """The array of FEATURES of a text column, null texts as empty ones; ``label`` for rows that the lexicon counted."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(lexicon)  # LEXICON entries at most

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        lex = shared.value
        for texts, labels in batches:
            yield pd.Series([features(t, lex, y) for t, y in zip(texts, labels, strict=True)])

    return run(F.coalesce(text, F.lit("")), F.lit(-1) if label is None else label)


@dataclass
class Tree:
    """A regression tree in arrays: a feature of -1 marks a leaf; smaller or equal goes left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, lines: list[str]) -> Tree:
        """Read one tree of a model's printed form."""
        rows: list[list[float]] = []
        at = 0

        def node() -> int:
            nonlocal at
            i, line = len(rows), lines[at]
            rows.append([-1, 0.0, 0, 0, 0.0])
            at += 1
            if m := re.match(r"If \(feature (\d+) <= (\S+)\)", line):
                left = node()
                at += 1  # the line of the other branch
                rows[i] = [int(m[1]), float(m[2]), left, node(), 0.0]
            else:
                rows[i][4] = float(line.removeprefix("Predict: "))
            return i

        node()
        f, t, left, right, v = zip(*rows, strict=True)
        return cls(np.array(f, int), np.array(t), np.array(left, int), np.array(right, int), np.array(v))

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while (inner := self.feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            n = at[i]
            at[i] = np.where(x[i, self.feature[n]] <= self.threshold[n], self.left[n], self.right[n])
        return self.value[at]


def read_trees(printed: str) -> list[tuple[float, Tree]]:
    """Weights and trees of a boosted model from its printed form."""
    parts = re.split(r"Tree \d+ \(weight (\S+)\):", printed)
    return [(float(w), Tree.of([x.strip() for x in body.strip().split("\n")])) for w, body in zip(parts[1::2], parts[2::2], strict=True)]


@dataclass
class Model:
    """The lexicon, the boosted trees with their weights, and the steps of the calibration; without trees, one score for all."""

    lexicon: Lexicon
    trees: list[tuple[float, Tree]]
    boundaries: np.ndarray
    steps: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return sum((w * t.predict(x) for w, t in self.trees), np.zeros(len(x)))

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.trees:
            return np.full(len(texts), self.base)
        if not texts:
            return np.zeros(0)
        m = self.margins(np.array([features(t, self.lexicon) for t in texts]))
        # A step of the calibration joins many margins; a hundredth of the raw odds keeps them in order.
        return np.clip(0.99 * np.interp(m, self.boundaries, self.steps) + 0.01 / (1 + np.exp(-2 * m)), 0.0, 1.0)


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from at most ``sample`` labelled rows, chosen by a hash of their id; held-out rows never count.

    The labels are drawn first, from their own narrow table, and only the texts
    of those rows move; of equal texts one
    counts, with the largest label. Rows without a label teach nothing; of an id that has
    several labels the largest counts. Without both labels there is no model:
    every score is the share of 1 among the labels (0 without any).
    """
    lab = labels.where(~held_out(id_col)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label")).where("label is not null and doc_id is not null")
    lab = by_hash(lab, sample, "doc_id")
    docs = documents(df, id_col, text_col)
    drawn = docs.join(F.broadcast(lab), "doc_id").groupBy("text").agg(F.max("label").alias("label"))  # at most ``sample`` rows of 16 bytes are broadcast
    drawn = settle(drawn.withColumn("part", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(5))), "toxic")
    sizes = {(r["part"], r["label"]): r["n"] for r in drawn.groupBy((F.col("part") < 4).alias("part"), "label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = (sum(n for (_, y), n in sizes.items() if (y == 1) == one) for one in (True, False))
    base = ones / (ones + zeros) if ones + zeros else 0.0

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit, label = [], []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u = units(t)
                unit += u
                label += [y] * len(u)
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.string()), pa.array(label, pa.int32())], ["unit", "label"])

    n1, n0 = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n1 + 1)) - F.log(b / (n0 + 1)) - F.sqrt(1 / a + 1 / b)
    seen = drawn.where("part < 4").select("text", "label").mapInArrow(members, "unit string, label int").groupBy("unit").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    top = seen.where(F.col("a") >= LEAST).withColumn("odds", odds).where(F.col("odds") >= ODDS).orderBy(F.desc("odds"), F.desc("a"), "unit").limit(LEXICON)
    lexicon = Lexicon({r["unit"]: (r["a"], r["b"]) for r in top.collect()}, n1, n0)
    counted = F.when(F.col("part") < 4, F.col("label")).otherwise(-1)
    rows = drawn.select(array_to_vector(dense(F.col("text"), lexicon, df.sparkSession, counted)).alias(VECTOR), F.col("label").cast("double"), "part")
    rows = settle(rows, "toxic")
    fitting, holding = rows.where("part < 4"), rows.where("part = 4")
    both = lambda x: {r["label"] for r in x.select("label").distinct().collect()} == {0.0, 1.0}
    if not both(fitting):
        return Model(lexicon, [], np.zeros(1), np.zeros(1), base)
    learner = GBTClassifier(featuresCol=VECTOR, maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=5, minInstancesPerNode=5)
    boosted = learner.fit(fitting)
    margins = boosted.transform(holding if both(holding) else fitting).select(vector_to_array("rawPrediction")[1].alias(MARGIN), "label")
    # Equal margins have one step between them, so each is one weighted row: none of them fills a task of the calibration's sort.
    margins = margins.groupBy(MARGIN).agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    steps = IsotonicRegression(featuresCol=MARGIN, weightCol="weight").fit(margins)
    return Model(lexicon, read_trees(boosted.toDebugString), steps.boundaries.toArray(), steps.predictions.toArray(), base)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) of every whole text. No shuffle.

    A null text counts as empty and gets an empty text's score. Only the text
    is an input. An empty table gives no rows.
    """
    d = documents(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # LEXICON entries and TREES small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_civil(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score under 0.5."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return kept(df, text_col, lambda texts: (shared.value.scores(texts) < 0.5).tolist())
