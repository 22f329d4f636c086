"""One entry to the kinds of graph reasoning, with checked arguments and rows of one shape.

Each kind gives ``kind``, ``id``, ``other``, ``label``: a row a node (``other``
null, ``label`` its type or role), a row a link (``id`` to ``other`` of type
``label``), or a single row of kind ``error`` whose label says what is wrong.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators import graph as G
from sedimenta.operators.retrieve import stored_community
from sedimenta.session import settle

#: Paths and cycles shown of one question: the first by length, then by nodes.
SHOWN = 10
#: Depths that a question may ask for; others are moved to the nearer end.
LEAST, MOST = 1, 5


@dataclass
class Question:
    """The graph, and what is asked of it; ``depth`` is clamped and names are trimmed by ``reason``."""

    entities: DataFrame
    edges: DataFrame
    a: str
    b: str
    depth: int
    membership: DataFrame | None


def _row(kind: str, other: object, label: object) -> list:
    text = lambda x, n: (F.lit(x) if x is None else x).cast("string").alias(n)
    return [F.lit(kind).alias("kind"), "id", text(other, "other"), text(label, "label")]


def _nodes(q: Question, ids: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Nodes of ``ids`` (``id``, distinct) with their types; ids that are no entity count as ``unknown``."""
    e = q.entities.select(F.col("id").alias("_id"), "type")
    return ids.join(e, F.col("id") == F.col("_id"), "left").select(*_row("node", None, F.coalesce("type", F.lit(unknown))))


def _links(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id"), "dst", "type").select(*_row("link", F.col("dst"), F.col("type"))).distinct()


def _of_trails(q: Question, trails: DataFrame) -> DataFrame:
    """The nodes and links of some trails, each once."""
    trails = settle(trails.select("nodes", "eids", "types"), "trails")
    ids = trails.select(F.explode("nodes").alias("id")).distinct()
    walked = trails.select("nodes", F.posexplode("types").alias("i", "type")).select(F.get("nodes", F.col("i")).alias("src"), F.get("nodes", F.col("i") + 1).alias("dst"), "type")
    walked = settle(walked.union(walked.select("dst", "src", "type")).distinct(), "walked")  # written, so that its size tells how it is joined
    eids = trails.select(F.explode("eids").alias("eid")).distinct()
    there = G.numbered(q.edges.join(walked, ["src", "dst", "type"], "left_semi"))
    return _nodes(q, ids).unionByName(_links(there.join(eids, "eid", "left_semi")))


def _first(trails: DataFrame) -> DataFrame:
    return trails.orderBy("hops", "nodes", "eids").limit(SHOWN)


def _shortest(q: Question) -> DataFrame:
    path = G.shortest_nodes(q.edges, q.a, q.b, q.depth)
    steps = path.select(F.posexplode("nodes").alias("i", "a"), "nodes").select("a", F.get("nodes", F.col("i") + 1).alias("b"))
    there = steps.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(steps.select("b", "a"))
    return _nodes(q, path.select(F.explode("nodes").alias("id"))).unionByName(_links(q.edges.join(there, ["src", "dst"], "left_semi")))


def _common(q: Question) -> DataFrame:
    shared = G.common_neighbors(q.edges, q.a, q.b).select(F.col("node").alias("id")).where(~F.col("id").isin(q.a, q.b))
    ends = q.entities.sparkSession.createDataFrame([(q.a, "Source"), (q.b, "Target")], "id string, role string")
    at = shared.select(F.col("id").alias("_x"))
    one = F.col("src").isin(q.a, q.b) & (F.col("dst") == F.col("_x"))
    two = F.col("dst").isin(q.a, q.b) & (F.col("src") == F.col("_x"))
    links = q.edges.join(at, one, "left_semi").unionByName(q.edges.join(at, two, "left_semi"))
    return ends.select(*_row("node", None, F.col("role"))).unionByName(_nodes(q, shared, "Common")).unionByName(_links(links))


def _influence(q: Question) -> DataFrame:
    """All nodes within the depth (2 if over 3) by level, and all edges on trails of that length."""
    depth = q.depth if q.depth <= 3 else 2
    near = G.distances(q.edges, F.col("node") == q.a, depth).select(F.col("node").alias("id"), "hops")
    label = F.when(F.col("hops") == 0, "Center").otherwise(F.concat(F.lit("Level"), F.col("hops")))
    inner = near.where(F.col("hops") < depth).select(F.col("id").alias("_x"))
    links = q.edges.join(inner, F.col("src") == F.col("_x"), "left_semi").unionByName(q.edges.join(inner, F.col("dst") == F.col("_x"), "left_semi"))
    return near.select(*_row("node", None, label)).unionByName(_links(links))


def _community(q: Question) -> DataFrame:
    none = q.entities.select("id", F.lit(None).cast("string").alias("community")).where("false")
    return stored_community(q.entities, q.membership if q.membership is not None else none, q.edges, q.a, q.depth)


#: Kinds by name: whether they need a second entity, and what answers them.
KINDS: dict[str, tuple[bool, Callable[[Question], DataFrame]]] = {
    "shortest_path": (True, _shortest),
    "one_two_hop": (True, lambda q: _of_trails(q, G.trails_between(q.edges, q.a, q.b, 2))),
    "common_neighbors": (True, _common),
    "all_paths": (True, lambda q: _of_trails(q, _first(G.trails_between(q.edges, q.a, q.b, q.depth)))),
    "entity_cycles": (False, lambda q: _of_trails(q, _first(G.cycles(q.edges, F.col("node") == q.a, q.depth)))),
    "entity_influence": (False, _influence),
    "entity_community": (False, _community),
}


def reason(entities: DataFrame, edges: DataFrame, kind: str, a: str, b: str | None = None, depth: int = 3, membership: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """The answer to one question: ``kind``, ``id``, ``other``, ``label``.

    ``depth`` is moved into 1 to 5. A missing entity, a missing second one where
    the kind needs it, and an unknown kind give one row of kind ``error``;
    entities that are not in the graph give no paths. ``membership`` (``id``,
    ``community``) is for ``entity_community``, which without it takes the
    neighbourhood. Rows of ``edges`` that are equal count once; ``distinct``: there are none.
    """
    a, b = (a or "").strip(), (b or "").strip()
    needs, answer = KINDS.get(kind, (False, None))
    wrong = "unknown kind of reasoning" if answer is None else "an entity is needed" if not a else f"{kind} needs two entities" if needs and not b else None
    if wrong:
        return entities.sparkSession.createDataFrame([("error", None, None, wrong)], "kind string, id string, other string, label string")
    edges = edges.select("src", "dst", "type") if distinct else settle(edges.select("src", "dst", "type").distinct(), "edges")
    return answer(Question(entities, edges, a, b, min(max(LEAST, depth), MOST), membership))
