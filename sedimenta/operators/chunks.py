"""Chunks of documents: windows of tokens, sentence-aware chunks, and the records and links of a chunk chain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.config import DEFAULTS


def fixed_windows(docs: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """Windows of ``size`` tokens every ``size - overlap`` of each row's ``tokens``; rows without tokens give none.

    Needs ``file_name``, ``doc_id``, ``tokens``. A window stays with its
    document, so no shuffle is needed.
    """
    stride = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.size("tokens") - overlap) / stride)).cast("int")
    w = docs.where(F.size("tokens") > 0).select("file_name", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("w"))
    cut = w.select("file_name", "doc_id", (F.col("w") + 1).cast("long").alias("position"), F.slice("tokens", F.col("w") * stride + 1, size).alias("tokens"))
    return cut.select(
        F.sha1(F.concat_ws("_", "file_name", F.col("position").cast("string"))).alias("id"), "file_name", "doc_id", "position", "tokens",
        F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("text"),
    )


def with_offsets(chunks: DataFrame) -> DataFrame:
    """``content_offset``: the lengths of the chunks before it in its document (overlaps count twice), and ``length``."""
    w = Window.partitionBy("file_name").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length("text").cast("long")
    return chunks.withColumn("length", length).withColumn("content_offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def next_links(chunks: DataFrame) -> DataFrame:
    """NEXT_CHUNK: from each chunk to the one at the next position of its document."""
    before = F.lag("id").over(Window.partitionBy("file_name").orderBy("position"))
    return chunks.withColumn("src", before).where("src is not null").select("src", F.col("id").alias("dst"))


def first_links(chunks: DataFrame) -> DataFrame:
    """FIRST_CHUNK: from each document to its chunk at position 1."""
    return chunks.where("position = 1").select(F.col("file_name").alias("src"), F.col("id").alias("dst"))


SENTENCE_ENDS = frozenset(".!?。！？")


def sentence_chunks(tokens: list[str], size: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges of chunks that end with a sentence where one ends within ``overlap`` of the size.

    The next chunk starts after the last sentence end before its overlap, if
    that lies inside the chunk, else at the overlap.
    """
    n, start, out = len(tokens), 0, []
    while start < n:
        end = min(start + size, n)
        if end < n:
            for i in range(end, min(n, start + size + overlap)):
                if tokens[i] in SENTENCE_ENDS:
                    end = i + 1
                    break
        out.append((start, end))
        if end >= n:
            break
        nxt = end - overlap
        for i in range(nxt - 1, start, -1):
            if tokens[i] in SENTENCE_ENDS:
                nxt = i + 1
                break
        start = nxt if nxt > start else end
    return out


def chunk_sentences(docs: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """``file_name``, ``position`` (from 1), ``start``, ``end`` of sentence-aware chunks; needs ``file_name``, ``tokens``.

    A text of fewer characters than a tenth of ``size`` is one chunk. The rule
    carries state along a document, so it runs on Arrow batches of documents.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, toks in zip(pdf["file_name"], pdf["tokens"], strict=True):
                toks = [] if toks is None else list(toks)
                if not toks:
                    continue
                spans = [(0, len(toks))] if sum(map(len, toks)) < size / 10 else sentence_chunks(toks, size, overlap)
                rows += [(name, k + 1, a, b) for k, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["file_name", "position", "start", "end"])

    return docs.select("file_name", "tokens").mapInPandas(run, "file_name string, position long, start long, end long")


def line_blocks(lines: DataFrame, least: int = 5000) -> DataFrame:
    """Group a file's lines (``file_name``, ``n``, ``line``) into blocks by running length: a block takes the lines that start in its ``least`` characters."""
    w = Window.partitionBy("file_name").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("line") + 1).over(w), F.lit(0))
    b = lines.withColumn("block", F.floor(at / least).cast("long"))
    return b.groupBy("file_name", "block").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line").cast("long")).alias("n_chars"))
