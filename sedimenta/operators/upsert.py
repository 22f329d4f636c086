"""Keyed upserts, extraction parsing, merging by time, and incremental change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY = r'\("entity" : "(.+?)" : "(.+?)" : "(.+?)"\s*\)'
RELATION = r'\("relationship" : "(.+?)" : "(.+?)" : "(.+?)" : "(.+?)" : (.+?)\)'


def merge_latest(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The union of two tables with one row of each key, that with the largest ``order`` (the new one, if equal)."""
    rest = [c for c in old.columns if c not in key]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("_new"))).alias("s")).select(*key, "s.*")


def overlay(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge: what is new and not null wins, else what was there."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return old.join(n, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def parse_entities(results: DataFrame) -> DataFrame:
    """``id``, ``type``, ``description`` of entity tuples in ``result`` texts: of an id the first by (chunk_id, place)."""
    groups = [F.regexp_extract_all("result", F.lit(ENTITY), F.lit(i)) for i in (1, 2, 3)]
    rows = results.select("chunk_id", F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("id", "type", "description"), strict=True)])).alias("n", "e"))
    first = F.min_by(F.struct("e.type", "e.description"), F.struct("chunk_id", "n"))
    return rows.groupBy(F.col("e.id").alias("id")).agg(first.alias("s")).select("id", "s.type", "s.description")


def parse_relations(results: DataFrame) -> DataFrame:
    """``chunk_id``, ``src``, ``dst``, ``type``, ``weight`` of relation tuples; a chunk with a weight that is no number gives none."""
    names = ("src", "dst", "type", "description", "weight")
    groups = [F.regexp_extract_all("result", F.lit(RELATION), F.lit(i)).alias(n) for i, n in enumerate(names, 1)]
    rows = results.select("chunk_id", F.arrays_zip(*groups).alias("r"))
    good = F.forall("r", lambda x: F.expr("true") & x["weight"].try_cast("double").isNotNull())
    return rows.where(good).select("chunk_id", F.explode("r").alias("x")).select("chunk_id", "x.src", "x.dst", "x.type", F.col("x.weight").cast("double").alias("weight"))


def complete_endpoints(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities and the ends of relations that are none of them, as Unknown."""
    ends = relations.select(F.col("src").alias("id")).union(relations.select(F.col("dst").alias("id"))).distinct()
    missing = ends.join(entities, "id", "left_anti").select("id", F.lit("Unknown").alias("type"), F.lit("No additional data").alias("description"))
    return entities.select("id", "type", "description").unionByName(missing)


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path``, ``change`` (added, modified or deleted) of two manifests of ``path``, ``hash``; unchanged files are left out."""
    o = old.select("path", F.col("hash").alias("_o"))
    n = new.select("path", F.col("hash").alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(F.col("_o") != F.col("_n"), "modified")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def needs_embedding(embedding: Column, flag: Column, updated: Column, embedded: Column) -> Column:
    """No vector, a raised flag, or an update after the last embedding."""
    stale = updated.isNotNull() & (embedded.isNull() | (updated > embedded))
    return embedding.isNull() | F.coalesce(flag, F.lit(False)) | F.coalesce(stale, F.lit(False))


def delete_cascade(mentions: DataFrame, gone_files: DataFrame) -> DataFrame:
    """Entities that only chunks of the gone files mention: what a deletion takes with it."""
    count = lambda m, n: m.groupBy("entity_id").agg(F.count("*").alias(n))
    gone = count(mentions.join(gone_files.select("file_name"), "file_name", "left_semi"), "gone")  # counted on both sides before they meet
    return count(mentions, "refs").join(gone, "entity_id").where("refs = gone").select("entity_id", "refs")
