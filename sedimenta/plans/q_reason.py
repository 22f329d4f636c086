"""Every kind of graph reasoning through its one entry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.reason import reason
from sedimenta.plans import fixtures as fx
from sedimenta.plans.q_graph import BOTH, TRAIL, A, B
from sedimenta.plans.registry import query
from sedimenta.session import settle

NONE = "CAST(NULL AS VARCHAR)"


def _shown(kind: str, trails: str) -> str:
    """SQL of the nodes and links of some trails."""
    return f"""SELECT '{kind}' AS reasoning, 'node' AS kind, x.id, {NONE} AS other, coalesce(entity.type, 'Unknown') AS label FROM (SELECT DISTINCT unnest(nodes) AS id FROM ({trails})) x LEFT JOIN entity ON entity.id = x.id
UNION ALL SELECT DISTINCT '{kind}', 'link', src, dst, type FROM geo WHERE src || '|' || type || '|' || dst IN (SELECT unnest(eids) FROM ({trails}))"""


def _between(depth: int) -> str:
    return TRAIL(f"a = '{A}'", depth) + f" SELECT * FROM t WHERE node = '{B}'"


CYCLES = f"""WITH RECURSIVE {BOTH}, d AS (SELECT src AS a, dst AS b, eid FROM e), t AS (SELECT a AS start, b AS node, 1 AS hops, [a, b] AS nodes, [eid] AS eids FROM d WHERE a = '{A}'
UNION ALL SELECT start, b, hops + 1, list_append(nodes, b), list_append(eids, eid) FROM t JOIN d ON t.node = d.a WHERE hops < 3 AND NOT list_contains(eids, eid)) SELECT * FROM t WHERE node = start ORDER BY hops, nodes, eids LIMIT 10"""
NEAR = TRAIL(f"a = '{A}'", 2)
COMMON = f"(WITH {BOTH} SELECT b AS id FROM u WHERE a = '{A}' INTERSECT SELECT b FROM u WHERE a = '{B}')"
SQL = " UNION ALL ".join([
    _shown("shortest_path", _between(3) + " QUALIFY dense_rank() OVER (ORDER BY hops, nodes) = 1"),
    _shown("one_two_hop", _between(2)),
    _shown("all_paths", _between(2) + " ORDER BY hops, nodes LIMIT 10"),
    _shown("entity_cycles", CYCLES),
    f"SELECT 'common_neighbors', 'node', id, {NONE}, role FROM (VALUES ('{A}', 'Source'), ('{B}', 'Target')) v(id, role)",
    f"SELECT 'common_neighbors', 'node', c.id, {NONE}, coalesce(entity.type, 'Common') FROM {COMMON} c LEFT JOIN entity USING (id)",
    f"SELECT DISTINCT 'common_neighbors', 'link', src, dst, type FROM geo WHERE (src IN ('{A}', '{B}') AND dst IN {COMMON}) OR (dst IN ('{A}', '{B}') AND src IN {COMMON})",
    f"SELECT 'entity_influence', 'node', node, {NONE}, CASE WHEN h = 0 THEN 'Center' ELSE 'Level' || h END FROM (SELECT node, min(hops) AS h FROM (SELECT '{A}' AS node, 0 AS hops UNION ALL SELECT node, hops FROM ({NEAR} SELECT * FROM t)) GROUP BY node)",
    f"SELECT DISTINCT 'entity_influence', 'link', src, dst, type FROM geo WHERE src || '|' || type || '|' || dst IN (SELECT unnest(eids) FROM ({NEAR} SELECT * FROM t))",
    f"SELECT 'entity_community', 'node', id, {NONE}, CASE WHEN id = '{A}' THEN 'Center' ELSE coalesce(type, 'Unknown') END FROM entity WHERE id = '{A}' OR id IN ({NEAR} SELECT node FROM t WHERE hops = 1)",
    f"SELECT DISTINCT 'entity_community', 'link', src, dst, type FROM geo WHERE (src = '{A}' OR src IN ({NEAR} SELECT node FROM t WHERE hops = 1)) AND (dst = '{A}' OR dst IN ({NEAR} SELECT node FROM t WHERE hops = 1))",
    f"SELECT 'common_neighbors', 'error', {NONE}, {NONE}, 'common_neighbors needs two entities'",
])
ASKED = [("shortest_path", B, 3), ("one_two_hop", B, 3), ("all_paths", B, 2), ("entity_cycles", None, 3), ("common_neighbors", B, 3), ("entity_influence", None, 2), ("entity_community", None, 1), ("common_neighbors", " ", 3)]


@query(SQL)
def kg_reasoning(spark: SparkSession, sf: str) -> DataFrame:
    """Seven kinds asked of one graph, and one question without its second entity."""
    # written once, as every question walks all of it
    entities, edges = settle(fx.entities(spark, sf), "entities"), settle(fx.edges(spark, sf).select("src", "dst", "type").distinct(), "edges")
    said = [reason(entities, edges, kind, A, b, depth, distinct=True).select(F.lit(kind).alias("reasoning"), "*") for kind, b, depth in ASKED]
    return reduce(DataFrame.unionByName, said)
