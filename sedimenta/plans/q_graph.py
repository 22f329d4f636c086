"""Queries over the property graph: reasoning, views, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import graph as G
from sedimenta.operators.co_occurrence import pair_counts
from sedimenta.operators.components import connected_components
from sedimenta.plans import fixtures as fx
from sedimenta.plans.registry import query

BOTH = """e AS (SELECT src || '|' || type || '|' || dst AS eid, * FROM geo), u AS (SELECT src AS a, dst AS b, eid, type FROM e UNION ALL SELECT dst, src, eid, type FROM e WHERE src <> dst)"""
A, B = "NATION_6", "NATION_18"


def TRAIL(start: str, depth: int, of: str = "u") -> str:
    return f"""WITH RECURSIVE {BOTH}, t AS (SELECT a AS start, b AS node, 1 AS hops, [a, b] AS nodes, [eid] AS eids, [type] AS types FROM {of} WHERE {start}
 UNION ALL SELECT start, b, hops + 1, list_append(nodes, b), list_append(eids, eid), list_append(types, type) FROM t JOIN {of} ON t.node = {of}.a WHERE hops < {depth} AND NOT list_contains(eids, eid))"""


def geo(spark: SparkSession, sf: str) -> DataFrame:
    return fx.edges(spark, sf).select("src", "dst", "type")


@query("SELECT DISTINCT type FROM edge")
def relation_types(spark: SparkSession, sf: str) -> DataFrame:
    return fx.edges(spark, sf).select("type").distinct()


@query("SELECT DISTINCT type FROM entity")
def entity_types(spark: SparkSession, sf: str) -> DataFrame:
    return fx.entities(spark, sf).select("type").distinct()


@query("SELECT id, type FROM entity WHERE type = 'Company' AND contains(id, '00001') ORDER BY id LIMIT 20")
def search_entities(spark: SparkSession, sf: str) -> DataFrame:
    return fx.entities(spark, sf).where((F.col("type") == "Company") & F.col("id").contains("00001")).select("id", "type").orderBy("id").limit(20)


@query("SELECT id, type, description FROM entity WHERE id IN ('NATION_6', 'Customer#000000007', 'Part#000000003', 'BUILDING', 'nobody')")
def entity_fetch(spark: SparkSession, sf: str) -> DataFrame:
    return G.fetch(fx.entities(spark, sf), ["NATION_6", "Customer#000000007", "Part#000000003", "BUILDING", "nobody"])


@query("SELECT src, dst, type, coalesce(weight, 0.5) AS weight FROM edge WHERE dst = 'NATION_6' AND type = 'OPERATES_IN'")
def search_relations(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.edges(spark, sf).where((F.col("dst") == "NATION_6") & (F.col("type") == "OPERATES_IN"))
    return e.select("src", "dst", "type", F.coalesce("weight", F.lit(0.5)).alias("weight"))


@query(TRAIL("a = 'NATION_6'", 3) + " SELECT array_to_string(min(nodes), ' > ') AS path, CAST(hops AS BIGINT) AS hops FROM t WHERE node = 'NATION_18' AND hops = (SELECT min(hops) FROM t WHERE node = 'NATION_18') GROUP BY hops")
def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    return G.shortest_path(geo(spark, sf), A, B, 3)


@query(TRAIL("a = 'NATION_6'", 2) + " SELECT array_to_string(nodes, ' > ') AS path, array_to_string(types, ',') AS types FROM t")
def paths_1_2_hop(spark: SparkSession, sf: str) -> DataFrame:
    return G.trails(geo(spark, sf), F.col("node") == A, 2).select(F.array_join("nodes", " > ").alias("path"), F.array_join("types", ",").alias("types"))


@query(TRAIL("a = 'NATION_6'", 3) + " SELECT array_to_string(nodes, ' > ') AS path, CAST(hops AS BIGINT) AS hops FROM t WHERE node = 'NATION_18' ORDER BY hops, path LIMIT 10")
def all_paths(spark: SparkSession, sf: str) -> DataFrame:
    t = G.trails_between(geo(spark, sf), A, B, 3)
    return t.select(F.array_join("nodes", " > ").alias("path"), F.col("hops").cast("long")).orderBy("hops", "path").limit(10)


@query(f"WITH {BOTH} SELECT b AS node FROM u WHERE a = 'NATION_6' INTERSECT SELECT b FROM u WHERE a = 'NATION_11'")
def common_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return G.common_neighbors(geo(spark, sf), "NATION_6", "NATION_11")


@query(f"""WITH RECURSIVE {BOTH}, d AS (SELECT src AS a, dst AS b, eid, type FROM e), t AS (SELECT a AS start, b AS node, 1 AS hops, [a, b] AS nodes, [eid] AS eids FROM d
 UNION ALL SELECT start, b, hops + 1, list_append(nodes, b), list_append(eids, eid) FROM t JOIN d ON t.node = d.a WHERE hops < 4 AND NOT list_contains(eids, eid))
 SELECT start, array_to_string(nodes, ' > ') AS path, CAST(hops AS BIGINT) AS hops FROM t WHERE start = node""")
def cycles(spark: SparkSession, sf: str) -> DataFrame:
    return G.cycles(geo(spark, sf), F.lit(True), 4).select("start", F.array_join("nodes", " > ").alias("path"), F.col("hops").cast("long"))


@query(TRAIL("a = 'NATION_6'", 2) + " SELECT type, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(types) AS type FROM t) GROUP BY type")
def influence_stats(spark: SparkSession, sf: str) -> DataFrame:
    return G.trails(geo(spark, sf), F.col("node") == A, 2).select(F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query(TRAIL("a = 'NATION_6'", 3) + " SELECT node, CAST(min(hops) AS BIGINT) AS hops FROM t WHERE node <> 'NATION_6' GROUP BY node")
def neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    d = G.distances(geo(spark, sf), F.col("node") == A, 3)
    return d.where("hops > 0").select("node", F.col("hops").cast("long"))


@query(TRAIL("a = 'NATION_6'", 2) + " SELECT src, dst, type FROM geo WHERE src IN (SELECT node FROM t UNION SELECT 'NATION_6') AND dst IN (SELECT node FROM t UNION SELECT 'NATION_6')")
def simple_community(spark: SparkSession, sf: str) -> DataFrame:
    g = geo(spark, sf)
    return G.induced(g, G.distances(g, F.col("node") == A, 2)).select("src", "dst", "type")


@query("SELECT DISTINCT src, dst, type FROM edge WHERE src IN ('NATION_6', 'NATION_18') OR dst IN ('NATION_6', 'NATION_18')")
def ego_graph(spark: SparkSession, sf: str) -> DataFrame:
    return G.ego(fx.edges(spark, sf), [A, B])


@query("WITH n AS (SELECT id FROM entity WHERE type <> 'Company' ORDER BY id LIMIT 50) SELECT src, dst, type FROM edge WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def graph_overview(spark: SparkSession, sf: str) -> DataFrame:
    n = fx.entities(spark, sf).where("type <> 'Company'").orderBy("id").limit(50)
    return G.induced(fx.edges(spark, sf), n, "id").select("src", "dst", "type")


@query()
def graph_from_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return pair_counts(fx.long_word_sets(spark, sf), 2)  # as of mentions: words of two chunks or more


@query("SELECT id, type, description FROM entity UNION ALL SELECT 'Q-NEW', 'Company', 'added'")
def crud_create_entity(spark: SparkSession, sf: str) -> DataFrame:
    new = spark.createDataFrame([("Q-NEW", "Company", "added"), ("NATION_6", "Company", "rejected")], "id string, type string, description string")
    return G.create_entity(fx.entities(spark, sf), new)


@query("SELECT id, CASE WHEN id = 'NATION_6' THEN 'Country' ELSE type END AS type, CASE WHEN id = 'NATION_18' THEN 'islands' ELSE description END AS description FROM entity")
def crud_update_entity(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.createDataFrame([("NATION_6", "Country", None), ("NATION_18", None, "islands")], "id string, type string, description string")
    return G.update_entity(fx.entities(spark, sf), c)


@query("SELECT src, dst, type, weight FROM edge WHERE src <> 'NATION_6' AND dst <> 'NATION_6'")
def crud_delete_entity(spark: SparkSession, sf: str) -> DataFrame:
    gone = spark.createDataFrame([("NATION_6",)], "id string")
    return G.delete_entity(fx.entities(spark, sf), fx.edges(spark, sf), gone)[1]


@query("SELECT src, dst, type, weight FROM edge UNION ALL SELECT 'NATION_6', 'NATION_18', 'COMPETES_WITH', CAST(2 AS DOUBLE)")
def crud_create_relation(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("NATION_6", "NATION_18", "COMPETES_WITH", 2.0), ("NATION_6", "AMERICA", "SEGMENT_OF", 9.0), ("NATION_6", "ATLANTIS", "OWNS", 1.0)]
    return G.create_relation(fx.edges(spark, sf), fx.entities(spark, sf), spark.createDataFrame(rows, "src string, dst string, type string, weight double"))


@query("SELECT src, dst, CASE WHEN src = 'NATION_6' AND type = 'SEGMENT_OF' THEN 'LIES_IN' ELSE type END AS type, CASE WHEN src = 'NATION_18' AND type = 'SEGMENT_OF' THEN 3.5 ELSE weight END AS weight FROM edge")
def crud_update_relation(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("NATION_6", "SEGMENT_OF", "AMERICA", "LIES_IN", None), ("NATION_18", "SEGMENT_OF", "EUROPE", None, 3.5)]
    return G.update_relation(fx.edges(spark, sf), spark.createDataFrame(rows, "src string, type string, dst string, new_type string, new_weight double"))


@query("SELECT src, dst, type, weight FROM edge WHERE NOT (src = 'NATION_6' AND type = 'SEGMENT_OF')")
def crud_delete_relation(spark: SparkSession, sf: str) -> DataFrame:
    return G.delete_relation(fx.edges(spark, sf), spark.createDataFrame([("NATION_6", "SEGMENT_OF", "AMERICA")], "src string, type string, dst string"))


@query("""WITH RECURSIVE u AS (SELECT src AS a, dst AS b FROM alike UNION SELECT dst, src FROM alike), r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a)
SELECT node, min(reach) AS component FROM r GROUP BY node""")
def similar_components(spark: SparkSession, sf: str) -> DataFrame:
    return connected_components(fx.similar_graph(spark, sf)[0])


@query("""WITH RECURSIVE u AS (SELECT src AS a, dst AS b FROM alike UNION SELECT dst, src FROM alike), r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT n AS size, CAST(count(*) AS BIGINT) AS components FROM (SELECT component, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY component) GROUP BY n""")
def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    c = connected_components(fx.similar_graph(spark, sf)[0])
    return c.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


@query("SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(count(*) AS BIGINT) AS weight FROM edge GROUP BY 1, 2")
def undirected_projection(spark: SparkSession, sf: str) -> DataFrame:
    return fx.edges(spark, sf).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("weight"))


@query("WITH d AS (SELECT id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge) GROUP BY id) SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 100")
def degree_top(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.edges(spark, sf)
    ends = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(100)
