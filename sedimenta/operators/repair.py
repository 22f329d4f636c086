"""Repairs of a graph, write-backs, lookups by id, batches by size, and splitting of large texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY = "[Empty Chunk]"


def fill_empty(chunks: DataFrame) -> DataFrame:
    """Null and empty texts get a fixed one, and a mark."""
    bad = F.col("text").isNull() | (F.col("text") == "")
    return chunks.withColumn("repaired", bad).withColumn("text", F.when(bad, EMPTY).otherwise(F.col("text")))


def missing_first(documents: DataFrame, chunks: DataFrame, links: DataFrame) -> DataFrame:
    """FIRST_CHUNK links for documents without one: to position 1, or else to the least position, nulls first."""
    lone = documents.select("file_name").distinct().join(links.select(F.col("src").alias("file_name")), "file_name", "left_anti")
    first = chunks.groupBy("file_name").agg(F.min_by("id", F.struct(F.col("position") != 1, F.col("position"), F.col("id"))).alias("dst"))
    return lone.join(first, "file_name").select(F.col("file_name").alias("src"), "dst")


def missing_next(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """NEXT_CHUNK links that the order of positions asks for and that are not there."""
    nxt = F.lead("id").over(Window.partitionBy("file_name").orderBy("position"))
    want = chunks.select(F.col("id").alias("src"), nxt.alias("dst")).where("dst is not null")
    return want.join(links, ["src", "dst"], "left_anti")


def entity_text(entities: DataFrame) -> DataFrame:
    """What an entity is embedded by: its id and description, or a name made of the id."""
    t = F.when(F.coalesce("description", F.lit("")) != "", F.concat_ws(" ", "id", "description")).otherwise(F.concat(F.lit("entity_"), F.col("id")))
    return entities.select("id", t.alias("text"))


def mark_changed(chunks: DataFrame, mentions: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of the changed files, and the entities that these mention, to embed again."""
    c = chunks.join(files, "file_name", "left_semi").select("id")
    by_file = "file_name" in mentions.columns  # then the chunks themselves need not be read
    e = mentions.join(files, "file_name", "left_semi") if by_file else mentions.join(c, mentions["chunk_id"] == c["id"], "left_semi")
    e = e.select(F.col("entity_id").alias("id")).distinct()
    return c, e


def uncached(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return requests.join(cache.select(key), key, "left_anti")


def message_ids(message: Column, kind: str) -> Column:
    """The ids that an answer lists as ``'kind':[...]``."""
    inside = F.regexp_extract(message, rf"['\"]?{kind}['\"]?\s*:\s*\[([^\]]*)\]", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.regexp_replace(x, r"^[\s'\"]+|[\s'\"]+$", "")), lambda x: x != "")


def source_kind(source: Column) -> Column:
    """Which table an id of a source names: 40 characters, or the end of ``2,...,id``, are a chunk, others a community."""
    last = F.element_at(F.split(source, ","), -1)
    return F.when(F.char_length(source) == 40, F.struct(F.lit("chunk").alias("kind"), source.alias("id"))).when(source.startswith("2,"), F.struct(F.lit("chunk").alias("kind"), last.alias("id"))).otherwise(
        F.struct(F.lit("community").alias("kind"), last.alias("id"))
    )


def size_batches(files: DataFrame, most: int, id_col: str = "path", size_col: str = "size") -> DataFrame:
    """``path``, ``batch``: files packed in order of path into batches of at most ``most`` bytes, a larger file alone.

    The rule carries state along the order, so each task packs the files of one
    range of paths; batches of different tasks have different numbers.
    """
    d = files.select(F.col(id_col).alias("path"), F.col(size_col).cast("long").alias("size")).repartitionByRange("path").sortWithinPartitions("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, held = 0, 0
        for pdf in batches:
            out = []
            for size in pdf["size"].fillna(0):
                if held and held + size > most:
                    n, held = n + 1, 0
                held += size
                out.append(n)
            yield pd.DataFrame({"path": pdf["path"], "size": pdf["size"], "part": out})

    numbered = d.mapInPandas(run, "path string, size long, part long")
    return numbered.select("path", "size", (F.spark_partition_id().cast("long") * (1 << 33) + F.col("part")).alias("batch"))


ENDS = re.compile(r"(?<=[。！？.!?])")


def pieces(text: str, most: int, least: int = 10_000) -> list[str]:
    """A large text in pieces: paragraphs (or lines, if there are few) packed up to a bound, long ones cut at sentences."""
    if len(text) <= most:
        return [text]
    parts = text.split("\n\n")
    joint = "\n\n"
    if len(parts) < 5:
        parts, joint = text.split("\n"), "\n"
    bound = min(most, max(least, most // 2))
    out: list[str] = []
    held = ""
    for p in parts:
        cut = [p] if len(p) <= bound else [x for y in ENDS.split(p) for x in (y[i : i + bound] for i in range(0, len(y), bound))]
        for k, s in enumerate(cut):
            between = "" if k else joint
            if held and len(held) + len(between) + len(s) > bound:
                out.append(held)
                held = s
            else:
                held = held + between + s if held else s
    return [*out, held] if held else out


def split_large(docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n``, ``piece``: each text in pieces of bounded length; null texts give none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, n, p) for d, t in zip(pdf["id"], pdf["text"], strict=True) if t is not None for n, p in enumerate(pieces(t, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "n", "piece"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, n long, piece string")
