"""Lexical search: BM25 over postings, rank fusion and reranking by overlap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.config import DEFAULTS
from sedimenta.session import settle


def bm25(postings: DataFrame, query: list[str], k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> DataFrame:
    """``chunk_id``, ``score`` (six places) of the chunks that hold a term of the query.

    Needs ``chunk_id``, ``term``, ``tf``. Lengths come from one aggregate over
    all postings; only postings of the query's terms are joined to them.
    """
    terms = sorted(set(query))
    length = postings.groupBy("chunk_id").agg(F.sum("tf").alias("dl"))
    stats = length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hit = postings.where(F.col("term").isin(terms)).select("chunk_id", "term", "tf")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))  # a row for each of the query's terms
    s = hit.join(F.broadcast(df), "term").join(length, "chunk_id").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return s.select("chunk_id", part.alias("p")).groupBy("chunk_id").agg(F.round(F.sum("p"), 6).alias("score"))


def term_counts(tokens: Column) -> Column:
    """Array of (term, tf) of an array of texts, each text once: they are sorted, and a run's length is its count. No shuffle."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda a: F.transform(a, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(a, j + 1), F.size(s)) - p).cast("long").alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs)).otherwise(none)


def in_two_or_more(texts: DataFrame) -> DataFrame:
    """Texts (``no``, unique, and the array ``words``, each word once) without the words that no other text has.

    A word that is in one text only is told by its count, and goes back to that
    text by its number. What is shuffled is a count a word and a row a text, not a row a word of each text.
    """
    each = texts.select("no", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.min("no").alias("no"))
    alone = each.where("n = 1").groupBy("no").agg(F.collect_list("word").alias("_alone"))
    left = F.when(F.col("_alone").isNull(), F.col("words")).otherwise(F.array_except("words", "_alone"))
    return texts.join(alone, "no", "left").withColumn("words", left).drop("_alone")


def scan(texts: DataFrame, query: list[str], k: int, per: str) -> DataFrame:
    """The ``k`` best values of the column ``per`` by the BM25 score (six places) of their best text: ``per``, ``score``, ``rank``; ties go to the smaller.

    Needs ``terms`` (array of term and tf, each term once). It reads the texts
    once and keeps of each its length and what it has of the query, so a
    single question costs less than an index of all terms.
    """
    words = sorted(set(query))
    t = texts.where(F.size("terms") > 0).select(per, F.aggregate("terms", F.lit(0).cast("long"), lambda s, x: s + x["tf"]).alias("dl"), F.filter("terms", lambda x: x["term"].isin(words)).alias("hits"))
    t = settle(t, "scan")
    has = [F.count_if(F.array_contains("hits.term", w)) for w in words]
    n, avgdl, *dfs = t.agg(F.count("*"), F.avg("dl"), *has).first()  # one row
    if not any(dfs):
        return top(t.select(per, F.lit(0.0).alias("score")).where("false"), k, per)
    idf = F.create_map(*[F.lit(x) for w, d in zip(words, dfs, strict=True) for x in (w, math.log(1 + (n - d + 0.5) / (d + 0.5)))])
    part = lambda s, x: s + F.element_at(idf, x["term"]) * x["tf"] * (DEFAULTS.bm25_k1 + 1) / (x["tf"] + DEFAULTS.bm25_k1 * (1 - DEFAULTS.bm25_b + DEFAULTS.bm25_b * F.col("dl") / avgdl))
    scored = t.where(F.size("hits") > 0).select(per, F.round(F.aggregate("hits", F.lit(0.0), part), 6).alias("score"))
    return top(scored.groupBy(per).agg(F.max("score").alias("score")), k, per)


def top(scored: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """The ``k`` best with their rank from 1; ties go to the smaller id."""
    best = scored.orderBy(F.desc("score"), id_col).limit(k)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), id_col))  # of k rows
    return best.withColumn("rank", rank.cast("long"))


def fuse(lists: list[DataFrame], k: int = DEFAULTS.rrf_k, id_col: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists: the sum of 1 / (k + rank), to nine places."""
    parts = [x.select(F.col(id_col).alias("id"), (1.0 / (k + F.col("rank"))).alias("s")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.round(F.sum("s"), 9).alias("score"))


def overlap(tokens: list[str], query: list[str]) -> float:
    """Jaccard overlap of a text's and a query's words: the offline stand-in for a reranking model."""
    a, b = set(tokens), set(query)
    return len(a & b) / len(a | b) if a | b else 0.0
