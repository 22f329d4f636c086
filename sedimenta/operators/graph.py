"""Reasoning over a property graph: paths, cycles, neighbourhoods, views, and changes to it.

Edges are DataFrames of ``src``, ``dst``, ``type``. Paths follow trail
semantics: no edge twice, nodes may repeat. Every walk starts from the rows of
its start nodes and joins one hop at a time, so its cost is that of the trails
it enumerates, bounded by the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.co_occurrence import pair_counts
from sedimenta.session import settle


def numbered(edges: DataFrame) -> DataFrame:
    """Edges with an id from their content, the same at every run."""
    return edges.withColumn("eid", F.sha1(F.concat_ws("|", "src", "type", "dst")))


def both_ways(edges: DataFrame) -> DataFrame:
    """``a``, ``b``, ``eid``, ``type`` of each edge in both directions; loops once."""
    e = numbered(edges)
    back = e.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), "eid", "type")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "eid", "type").unionByName(back)


def trails(edges: DataFrame, start: Column, depth: int, directed: bool = False) -> DataFrame:
    """All trails of 1 to ``depth`` edges from the nodes that meet ``start`` (a condition on ``node``).

    Gives ``start``, ``node`` (the last), ``hops``, ``nodes``, ``eids``, ``types``.
    """
    e = numbered(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"), "eid", "type") if directed else both_ways(edges)
    first = e.withColumn("node", F.col("a")).where(start)
    level = first.select(F.col("a").alias("start"), F.col("b").alias("node"), F.lit(1).alias("hops"), F.array("a", "b").alias("nodes"), F.array("eid").alias("eids"), F.array("type").alias("types"))
    out = level
    for n in range(2, depth + 1):
        level = level.join(e, level.node == e.a).where(~F.array_contains("eids", F.col("eid")))
        level = level.select("start", F.col("b").alias("node"), F.lit(n).alias("hops"), F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("eids", F.col("eid")).alias("eids"), F.array_append("types", F.col("type")).alias("types"))
        out = out.unionByName(level)
    return out


def trails_between(edges: DataFrame, a: str, b: str, depth: int) -> DataFrame:
    """All trails of 1 to ``depth`` edges from ``a`` to ``b``, as ``trails`` gives them.

    Distances to the goal come first, so a walk only enters nodes from which
    the goal is still in reach; hubs that lead elsewhere are not expanded.
    """
    togo = distances(edges, F.col("node") == b, depth).select(F.col("node").alias("_n"), F.col("hops").alias("_togo"))
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type", F.lit(True).alias("_on"))
    e = e.unionByName(edges.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), "type", F.lit(False).alias("_on")))
    # ids of edges are made of those on a walk, not of all
    eid = F.sha1(F.when(F.col("_on"), F.concat_ws("|", "a", "type", "b")).otherwise(F.concat_ws("|", "b", "type", "a")))
    level = e.where(F.col("a") == a).join(togo.where(F.col("_togo") <= depth - 1), F.col("b") == F.col("_n")).withColumn("eid", eid)
    level = level.select(F.col("a").alias("start"), F.col("b").alias("node"), F.lit(1).alias("hops"), F.array("a", "b").alias("nodes"), F.array("eid").alias("eids"), F.array("type").alias("types"))
    out = level
    for n in range(2, depth + 1):
        inner = e.join(togo.where(F.col("_togo") <= depth - n), F.col("b") == F.col("_n"))
        level = level.join(inner, F.col("node") == F.col("a")).withColumn("eid", eid).where(~F.array_contains("eids", F.col("eid")))
        level = level.select("start", F.col("b").alias("node"), F.lit(n).alias("hops"), F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("eids", F.col("eid")).alias("eids"), F.array_append("types", F.col("type")).alias("types"))
        out = out.unionByName(level)
    return out.where(F.col("node") == b)


def fetch(entities: DataFrame, ids: list[str]) -> DataFrame:
    """``id``, ``type`` (Unknown without one), ``description`` of the entities of a list of ids; unknown ids give no row."""
    return entities.where(F.col("id").isin(ids)).select("id", F.coalesce("type", F.lit("Unknown")).alias("type"), "description")


def co_mentions(mentions: DataFrame) -> DataFrame:
    """Pairs ``src`` < ``dst`` of entities with the number ``n`` of chunks that mention both.

    The pairs of a chunk are bounded by its length, not by the corpus; they
    are made and counted where all chunks of both entities are, and not shuffled.
    """
    return pair_counts(settle(mentions.groupBy("chunk_id").agg(F.collect_set("entity_id").alias("e")).select("e"), "mentioned", "zstd"))


def distances(edges: DataFrame, start: Column, depth: int) -> DataFrame:
    """``node``, ``hops``: fewest edges, in either direction, from the nodes that meet ``start``; at most ``depth``.

    Breadth first: each round joins the frontier with the edges at either end
    and drops what was reached before; the edges themselves are never sorted or made distinct.
    """
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    front = settle(ends.where(start).distinct(), "bfs")
    seen = front.withColumn("hops", F.lit(0))
    for n in range(1, depth + 1):
        met = [front.join(edges, front.node == edges[x]).select(F.col(y).alias("node")) for x, y in (("src", "dst"), ("dst", "src"))]
        front = settle(met[0].union(met[1]).distinct().join(seen, "node", "left_anti"), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("hops", F.lit(n)))  # a constant, so that a plan that asks for few hops reads no other
    return seen


def shortest_nodes(edges: DataFrame, a: str, b: str, depth: int = 3) -> DataFrame:
    """``nodes``, ``hops`` of one shortest path from ``a`` to ``b``, either direction of edges: the smallest by its nodes; no row if there is none."""
    near = distances(edges, F.col("node") == b, depth).select(F.col("node").alias("n"), F.col("hops").alias("togo"))
    found = near.where(F.col("n") == a).first()
    if found is None:
        return near.select(F.array("n").alias("nodes"), F.lit(0).cast("long").alias("hops")).where("false")
    e = both_ways(edges).select("a", "b")
    level = near.where(F.col("n") == a).select(F.col("n").alias("node"), F.array("n").alias("nodes"))
    for left in range(found["togo"] - 1, -1, -1):  # only towards the goal
        step = e.join(near.where(F.col("togo") == left), e.b == near.n).select("a", "b")
        level = level.join(step, level.node == step.a).select(F.col("b").alias("node"), F.array_append("nodes", F.col("b")).alias("nodes"))
        level = level.groupBy("node").agg(F.min("nodes").alias("nodes"))
    return level.select("nodes", F.lit(found["togo"]).cast("long").alias("hops"))


def shortest_path(edges: DataFrame, a: str, b: str, depth: int = 3) -> DataFrame:
    """``path``, ``hops``: ``shortest_nodes`` with its nodes joined by arrows."""
    return shortest_nodes(edges, a, b, depth).select(F.array_join("nodes", " > ").alias("path"), "hops")


def common_neighbors(edges: DataFrame, a: str, b: str) -> DataFrame:
    e = both_ways(edges)
    of = lambda x: e.where(F.col("a") == x).select(F.col("b").alias("node"))
    return of(a).intersect(of(b))


def cycles(edges: DataFrame, start: Column, depth: int = 4) -> DataFrame:
    """Directed trails of 1 to ``depth`` edges (4 at most) that end where they start.

    Edges from a node that none leads to, or to one that none leaves, are on no
    cycle; dropped before, they keep leaves and hubs of a tree out of the walk.
    """
    edges = edges.select("src", "dst", "type")
    for _ in range(2):
        edges = edges.join(edges.select(F.col("dst").alias("_n")).distinct(), F.col("src") == F.col("_n"), "left_semi")
        edges = edges.join(edges.select(F.col("src").alias("_n")).distinct(), F.col("dst") == F.col("_n"), "left_semi")
        edges = settle(edges, "cycles")
    return trails(edges, start, min(depth, 4), directed=True).where("node = start")


def ego(edges: DataFrame, ids: list[str]) -> DataFrame:
    """Edges inside the given nodes and from them to their neighbours, each once."""
    return edges.where(F.col("src").isin(ids) | F.col("dst").isin(ids)).select("src", "dst", "type").distinct()


def induced(edges: DataFrame, nodes: DataFrame, col: str = "node") -> DataFrame:
    n = nodes.select(F.col(col).alias("_n")).distinct()
    return edges.join(n, edges.src == n["_n"], "left_semi").join(n, F.col("dst") == n["_n"], "left_semi")


# Changes: each gives the new table and leaves the old one as it is.


def create_entity(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Add rows whose id is not there yet; of new rows that share an id the smallest stays."""
    fresh = new.join(entities.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("type", "description")).alias("s")).select("id", "s.type", "s.description")
    return entities.unionByName(fresh)


def update_entity(entities: DataFrame, change: DataFrame) -> DataFrame:
    """Set what the change holds and is not null; one change an id."""
    c = change.select("id", F.col("type").alias("_t"), F.col("description").alias("_d"))
    return entities.join(c, "id", "left").select("id", F.coalesce("_t", "type").alias("type"), F.coalesce("_d", "description").alias("description"))


def delete_entity(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids and the edges at them."""
    gone = ids.select(F.col("id").alias("_id"))
    e = edges.join(gone, edges.src == gone["_id"], "left_anti").join(gone, F.col("dst") == gone["_id"], "left_anti")
    return entities.join(gone, entities.id == gone["_id"], "left_anti"), e


def create_relation(edges: DataFrame, entities: DataFrame, new: DataFrame) -> DataFrame:
    """Add edges whose ends exist and that are not there yet."""
    ids = entities.select("id").distinct()
    ok = new.join(ids, new.src == ids.id, "left_semi").join(ids, F.col("dst") == ids.id, "left_semi")
    return edges.unionByName(ok.join(edges, ["src", "type", "dst"], "left_anti").select(*edges.columns).dropDuplicates(["src", "type", "dst"]))


def update_relation(edges: DataFrame, change: DataFrame) -> DataFrame:
    """Give edges of (src, type, dst) a new type or weight where the change has one."""
    c = change.select("src", "type", "dst", F.col("new_type").alias("_t"), F.col("new_weight").alias("_w"))
    return edges.join(c, ["src", "type", "dst"], "left").select("src", "dst", F.coalesce("_t", "type").alias("type"), F.coalesce("_w", "weight").alias("weight"))


def delete_relation(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["src", "type", "dst"], "left_anti").select(*edges.columns)
