"""Queries over sections, stored communities, suggested merges and the graph's consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import consistency as C
from sedimenta.operators import retrieve as V
from sedimenta.operators.chunks import first_links, next_links
from sedimenta.operators.sections import sections
from sedimenta.plans import fixtures as fx
from sedimenta.plans.q_parse import SECTIONS
from sedimenta.plans.registry import query
from sedimenta.session import settle, table


@query(rf"""WITH {SECTIONS}, p AS (SELECT doc.file_name, item, title, s.content, s.start, CASE WHEN contains(lower(doc.file_name), 'src1') THEN 1 ELSE 2 END AS pass FROM s JOIN doc USING (doc_id)
WHERE (contains(lower(title), 'schlich') OR contains(lower(s.content), 'schlich') OR contains(lower(title), 'section of') OR contains(lower(s.content), 'section of')) AND item = '1')
SELECT file_name, item, title, substr(content, 1, 3000) AS content, CAST(pass AS INTEGER) AS pass FROM p WHERE pass = (SELECT min(pass) FROM p) ORDER BY item, file_name, start LIMIT 5""")
def section_lookup(spark: SparkSession, sf: str) -> DataFrame:
    s = sections(fx.headed(spark, sf)).join(fx.documents(spark, sf).select("doc_id", "file_name"), "doc_id")
    return V.find_sections(s, ["Schlich", "section of"], ["src1"], "10-k", "business")


MEMBERS = """m AS (SELECT n_name AS id, '0-' || n_regionkey AS community FROM nation UNION ALL SELECT c_name, '0-' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_name, '0-' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(f"""WITH {MEMBERS}, x AS (SELECT id FROM m WHERE community = (SELECT min(community) FROM m WHERE id = 'NATION_6'))
SELECT 'node' AS kind, id, CAST(NULL AS VARCHAR) AS other, CASE WHEN id = 'NATION_6' THEN 'Center' ELSE type END AS label FROM entity WHERE id IN (SELECT id FROM x)
UNION ALL SELECT 'link', src, dst, type FROM edge WHERE src IN (SELECT id FROM x) AND dst IN (SELECT id FROM x)""")
def stored_community(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", F.concat(F.lit("0-"), "n_regionkey").alias("community"))
    of = lambda n, key, name: table(spark, sf, n).join(nation, F.col(key) == F.col("n_nationkey")).select(F.col(name).alias("id"), "community")
    member = nation.select(F.col("n_name").alias("id"), "community").unionByName(of("customer", "c_nationkey", "c_name")).unionByName(of("supplier", "s_nationkey", "s_name"))
    return V.stored_community(fx.entities(spark, sf), member, fx.edges(spark, sf), "NATION_6")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'c' || o_custkey || '|' || 'o''' || o_custkey ELSE 'c' || o_custkey || '|' || o_orderstatus END AS members FROM orders""")
def merge_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with two bracketed lists, one of them of one name twice, parsed to groups of names."""
    c = F.concat(F.lit("c"), F.col("o_custkey"))
    other = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("\"o'"), F.col("o_custkey"), F.lit('"'))).otherwise(F.concat(F.lit("'"), F.col("o_orderstatus"), F.lit("'")))
    answer = F.concat(F.lit("These are the same: [['"), c, F.lit("', "), other, F.lit(", '"), c, F.lit("'], ['x', 'x'], []]."))
    o = table(spark, sf, "orders").select("o_orderkey", F.explode(V.merge_lists(answer)).alias("g"))
    return o.select("o_orderkey", F.array_join("g", "|").alias("members"))


@query("SELECT id FROM chunk WHERE id IN (SELECT chunk_id FROM mention)")
def filled_graphs(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.mentions(spark, sf)
    short = F.length("entity_id") < 9
    return V.filled_graphs(fx.chunks(spark, sf).select("id"), m.where(short), m.where(~short))


@query("""WITH k AS (SELECT file_name FROM doc WHERE n_chars > 500), e AS (SELECT id FROM entity UNION ALL SELECT 'alone ' || r_name FROM region)
SELECT 'orphan_entities' AS "check", CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS "left" FROM e WHERE id NOT IN (SELECT src FROM edge UNION SELECT dst FROM edge)
UNION ALL SELECT 'dangling_chunks', count(*), 0 FROM chunk WHERE file_name NOT IN (SELECT file_name FROM k)
UNION ALL SELECT 'empty_chunks', count(*), 0 FROM chunk WHERE position % 5 = 0
UNION ALL SELECT 'broken_document_links', count(*), count(*) FILTER (file_name NOT IN (SELECT file_name FROM chunk)) FROM k WHERE file_name NOT IN (SELECT file_name FROM chunk WHERE position = 1 AND doc_id % 9 <> 0)
UNION ALL SELECT 'broken_chains', count(*), 0 FROM chunk WHERE position > 1 AND position % 3 = 0""")
def consistency_report(spark: SparkSession, sf: str) -> DataFrame:
    """A graph with lone entities, documents that went, emptied chunks and lost links: what the checks find, and what is left after the repair."""
    c = fx.chunks(spark, sf).select("id", "file_name", "doc_id", "position", F.when(F.col("position") % 5 != 0, F.col("text")).alias("text"))
    c = settle(c, "chunks", "zstd")  # written once: the checks and the repair read chunks and edges many times
    follow = next_links(c).join(c.where("position % 3 <> 0").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    lone = table(spark, sf, "region").select(F.concat(F.lit("alone "), "r_name").alias("id"))
    docs = fx.documents(spark, sf).where("n_chars > 500").select("file_name")
    return C.report(C.Graph(docs, c, first_links(c.where("doc_id % 9 <> 0")), follow, fx.entities(spark, sf).select("id").union(lone), settle(fx.edges(spark, sf).select("src", "dst"), "edges")))
