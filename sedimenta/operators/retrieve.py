"""Retrieval over sections and stored communities, and lists of suggested merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.operators import graph as G
from sedimenta.operators.facts import any_term

# The item of a form that each section name asks for.
ITEM_OF = {"mda": "7", "risk_factors": "1A", "financials": "8", "business": "1", "legal": "3", "market": "5"}


def find_sections(sections: DataFrame, words: list[str], companies: list[str] = (), form: str = "", section: str = "", limit: int = 5) -> DataFrame:
    """``file_name``, ``item``, ``title``, ``content``, ``pass`` of sections whose title or content holds a word, by item.

    At most five words count, and content is cut at 3000 characters: both are
    part of the lookup. Words and the section's item must fit; the form's name
    in the file name is dropped first when nothing fits, the companies' next.
    Each row takes the number of the strictest pass that it meets, so one scan
    and one top-k decide. Ties of an item go by file and place; no words, no rows.
    """
    fits = any_term(["title", "content"], [w.lower() for w in words[:5]])
    if section in ITEM_OF:
        fits = fits & (F.col("item") == ITEM_OF[section])
    company = any_term(["file_name"], [c.lower() for c in companies]) if companies else F.lit(True)
    step = F.when(company & F.coalesce(F.lower("file_name").contains(form.lower()), F.lit(False)), 0).when(company, 1).otherwise(2)
    top = sections.where(fits).withColumn("pass", step).orderBy("pass", "item", "file_name", "start").limit(limit)
    top = top.withColumn("least", F.min("pass").over(Window.partitionBy(F.lit(1)))).where("pass = least")  # of ``limit`` rows
    return top.select("file_name", "item", "title", F.substring("content", 1, 3000).alias("content"), "pass")


def stored_community(entities: DataFrame, membership: DataFrame, edges: DataFrame, center: str, depth: int = 2) -> DataFrame:
    """``kind``, ``id``, ``other``, ``label``: members of the entity's first community and the edges among them.

    ``membership`` has ``id``, ``community``. Nodes are labelled by their type,
    the entity itself ``Center``; one in no community gets its neighbourhood up
    to ``depth``. Only the community's name passes the driver; members are semi-joined.
    """
    first = membership.where(F.col("id") == center).agg(F.min("community")).head()[0]
    if first is None:
        inside = G.distances(edges, F.col("node") == center, depth).select(F.col("node").alias("id"))
    else:
        inside = membership.where(F.col("community") == first).select("id").distinct()
    node = entities.join(inside, "id", "left_semi")
    label = F.when(F.col("id") == center, "Center").otherwise(F.coalesce("type", F.lit("Unknown")))
    end = lambda c: inside.select(F.col("id").alias(c))
    links = edges.join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi")
    return node.select(F.lit("node").alias("kind"), "id", F.lit(None).cast("string").alias("other"), label.alias("label")).unionByName(
        links.select(F.lit("link").alias("kind"), F.col("src").alias("id"), F.col("dst").alias("other"), F.col("type").alias("label"))
    )


def merge_lists(answer: Column) -> Column:
    """Innermost bracketed lists of quoted names in an answer, each name once, lists of two names or more; null gives none."""
    lists = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[[^\[\]]*\]"), F.lit(0))
    names = lambda x: F.transform(F.regexp_extract_all(x, F.lit("\"[^\"]*\"|'[^']*'"), F.lit(0)), lambda q: F.trim(F.substr(q, F.lit(2), F.char_length(q) - 2)))
    return F.filter(F.transform(lists, lambda x: F.array_distinct(names(x))), lambda g: F.size(g) >= 2)


def filled_graphs(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks with a node or an edge at least; ``nodes`` and ``edges`` have ``chunk_id``."""
    some = nodes.select("chunk_id").union(edges.select("chunk_id")).distinct()
    return chunks.join(some.withColumnRenamed("chunk_id", "id"), "id", "left_semi")
