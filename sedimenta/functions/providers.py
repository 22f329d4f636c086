"""Stand-ins for models, the same at every run: embedding, extraction, summary, reranking, names, judging.

Each is a function of columns; a job that has a real model passes its own
function of the same shape instead.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import tokens

#: Given a text column, give an array of double.
Embedder = Callable[[Column], Column]

DIM = 64
WORD = re.compile(r"\w+")
# Finance terms that are never names of persons.
BLOCKLIST = "roth ira fica futa cobra erisa gaap sec fdic finra etf ipo fed fomc".split()
NAME = r"\b[A-Z][a-z]+(?: [A-Z]\.)? [A-Z][a-z]+\b"


def hashing_embedder(text: Column, dim: int = DIM) -> Column:
    """Signed counts of hashed words, of length 1; a zero vector for a text without words, null or empty."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            h = np.array([zlib.crc32(w.encode()) for w in WORD.findall((t or "").lower())], np.int64)
            v = np.bincount(h % dim, weights=1.0 - 2.0 * (h >> 31 & 1), minlength=dim)
            n = np.sqrt(v @ v)
            out.append(v / n if n else v)
        return pd.Series(out)

    return run(text)


def vocabulary_extractor(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Entity tuples, as a model would print them, of the vocabulary's ids (``id``, ``type``) that are a chunk's tokens."""
    t = chunks.select(F.col("id").alias("chunk_id"), F.explode(F.array_distinct("tokens")).alias("token"))
    hit = t.join(vocabulary.select(F.col("id").alias("token"), "type"), "token")
    one = F.format_string('("entity" : "%s" : "%s" : "%s")', "token", "type", F.lit("mentioned"))
    return hit.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set(one)), "\n").alias("result"))


def head_summary(text: Column, chars: int = 500) -> Column:
    """The first characters; a text of under ten gets a fixed message."""
    return F.when(F.char_length(text) < 10, F.lit("No summary available")).otherwise(F.substring(text, 1, chars))


def overlap_score(text: Column, query: str) -> Column:
    """Jaccard overlap of a text's and a query's lower-case tokens."""
    q = F.array(*[F.lit(w) for w in dict.fromkeys(re.findall(r"\w+", query.lower()))])
    t = F.array_distinct(tokens(F.lower(text)))
    return F.size(F.array_intersect(t, q)) / F.size(F.array_union(t, q))


def mask_names(text: Column) -> Column:
    """Two capitalised words in a row become a person, unless one is a finance term."""
    blocked = "(?i:" + "|".join(BLOCKLIST) + ")"
    return F.regexp_replace(text, rf"(?!\b{blocked}\b)(?!\b[A-Z][a-z]+(?: [A-Z]\.)? {blocked}\b){NAME}", "[PII:PERSON_NAME]")


def judge(answer: Column, context: Column, cut: int = 3000) -> Column:
    """Share of an answer's tokens that its context holds, as JSON with a score."""
    a = F.array_distinct(tokens(F.lower(answer)))
    c = F.array_distinct(tokens(F.lower(F.substring(context, 1, cut))))
    share = F.when(F.size(a) == 0, 0.5).otherwise(F.size(F.array_intersect(a, c)) / F.size(a))
    return F.to_json(F.struct(F.round(share, 4).alias("score")))


def passes(verdict: Column, least: float = 0.7) -> Column:
    """Whether a judge's JSON, fenced or not, gives at least ``least``; what cannot be read counts as 0.5."""
    bare = F.regexp_replace(verdict, "^```(?:json)?|```$", "")
    return F.coalesce(F.get_json_object(bare, "$.score").try_cast("double"), F.lit(0.5)) >= least
