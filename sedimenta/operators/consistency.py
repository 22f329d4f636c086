"""The five checks of a stored graph, and the repair of what they find."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.chunks import next_links
from sedimenta.operators.repair import fill_empty, missing_first, missing_next


@dataclass(frozen=True)
class Graph:
    """``documents`` (file_name), ``chunks`` (id, file_name, position, text), ``first`` and ``following`` links (src, dst), ``entities`` (id), ``edges`` (src, dst)."""

    documents: DataFrame
    chunks: DataFrame
    first: DataFrame
    following: DataFrame
    entities: DataFrame
    edges: DataFrame


def linked(g: Graph) -> DataFrame:
    """Entities at an end of an edge."""
    ends = g.edges.select(F.col("src").alias("id")).union(g.edges.select(F.col("dst").alias("id")))
    return g.entities.join(ends, "id", "left_semi")


def attached(g: Graph) -> DataFrame:
    """Chunks of documents that are there."""
    return g.chunks.join(g.documents.select("file_name"), "file_name", "left_semi")


def checks(g: Graph) -> DataFrame:
    """``check``, ``n``: orphan entities, dangling chunks, empty chunks, documents without a first link, chunks that their predecessor does not link."""
    ends = g.edges.select(F.col("src").alias("id")).union(g.edges.select(F.col("dst").alias("id")))
    broken = {
        "orphan_entities": g.entities.join(ends, "id", "left_anti"),
        "dangling_chunks": g.chunks.join(g.documents.select("file_name"), "file_name", "left_anti"),
        "empty_chunks": g.chunks.where("text is null or text = ''"),
        "broken_document_links": g.documents.join(g.first.select(F.col("src").alias("file_name")), "file_name", "left_anti"),
        "broken_chains": next_links(g.chunks).join(g.following, ["src", "dst"], "left_anti"),
    }
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in broken.items()))


def repaired(g: Graph) -> Graph:
    """Orphans and dangling chunks deleted, empty texts filled, missing links added. Documents without any chunk keep their broken link: there is nothing to link."""
    chunks = fill_empty(attached(g)).drop("repaired")
    first = g.first.join(chunks.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    following = g.following.join(next_links(chunks), ["src", "dst"], "left_semi").select("src", "dst")
    return replace(g, chunks=chunks, first=first.unionByName(missing_first(g.documents, chunks, first)), following=following.unionByName(missing_next(chunks, following)), entities=linked(g))


def report(g: Graph) -> DataFrame:
    """``check``, ``n`` found and ``left`` after the repair."""
    return checks(g).join(checks(repaired(g)).withColumnRenamed("n", "left"), "check")
