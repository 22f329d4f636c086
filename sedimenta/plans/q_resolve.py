"""Queries over entity resolution, validation, repair and incremental changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import resolve as R
from sedimenta.operators import upsert as U
from sedimenta.operators.chunks import first_links, next_links
from sedimenta.operators.components import connected_components
from sedimenta.plans import fixtures as fx
from sedimenta.plans.registry import query
from sedimenta.session import scratch_dir, table
from sedimenta.sources.keyed_store import KeyedStore

COMP = """u AS (SELECT src AS a, dst AS b FROM alike UNION SELECT dst, src FROM alike), r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a), c AS (SELECT node, min(reach) AS component FROM r GROUP BY node)"""
DEG = "d AS (SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS node FROM alike UNION ALL SELECT dst FROM alike) GROUP BY node)"


MENTIONS = ("NATION_", "NATION_99", "AMERICAS", "Custmer#00000012", "ATLANTIS")


@query(f"""WITH RECURSIVE {COMP}, e AS (SELECT id, component FROM aligned JOIN c ON vec_id = node)
SELECT a.id AS a, b.id AS b, CAST(levenshtein(lower(a.id), lower(b.id)) AS BIGINT) AS distance FROM e a JOIN e b ON a.component = b.component AND a.id < b.id WHERE levenshtein(lower(a.id), lower(b.id)) < 3""")
def dup_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = connected_components(fx.similar_graph(spark, sf)[0])
    e = fx.aligned(spark, sf).join(c, F.col("vec_id") == F.col("node")).select("id", "component")
    return R.edit_pairs(e, "component", 3)


@query(f"""WITH RECURSIVE {COMP}, {DEG}, x AS (SELECT node, component, row_number() OVER (PARTITION BY component ORDER BY coalesce(degree, 0) DESC, node) AS k, count(*) OVER (PARTITION BY component) AS n FROM c LEFT JOIN d USING (node))
SELECT a.node, b.node AS canonical_id FROM x a JOIN x b ON a.component = b.component AND b.k = 1 WHERE a.k > 1""")
def canonical_assign(spark: SparkSession, sf: str) -> DataFrame:
    links, degrees = fx.similar_graph(spark, sf)
    return R.canonical(connected_components(links), degrees)


@query(f"""WITH RECURSIVE {COMP}, {DEG}, x AS (SELECT node, component, row_number() OVER (PARTITION BY component ORDER BY coalesce(degree, 0) DESC, node) AS k FROM c LEFT JOIN d USING (node)),
m AS (SELECT a.node, b.node AS canonical_id FROM x a JOIN x b ON a.component = b.component AND b.k = 1 WHERE a.k > 1)
SELECT canonical_id, CAST(count(*) AS BIGINT) AS members FROM m GROUP BY canonical_id HAVING count(*) >= 2""")
def alignment_groups(spark: SparkSession, sf: str) -> DataFrame:
    links, degrees = fx.similar_graph(spark, sf)
    return R.canonical(connected_components(links), degrees).groupBy("canonical_id").agg(F.count("*").alias("members")).where("members >= 2")


@query("""WITH m AS (SELECT id AS node, left(id, 8) AS canonical_id FROM entity WHERE type = 'Brand'), n AS (SELECT coalesce(a.canonical_id, src) AS src, type, coalesce(b.canonical_id, dst) AS dst FROM edge LEFT JOIN m a ON src = a.node LEFT JOIN m b ON dst = b.node)
SELECT DISTINCT src, type, dst FROM n WHERE src <> dst""")
def merge_entities_edges(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.entities(spark, sf).where("type = 'Brand'").select(F.col("id").alias("node"), F.substring("id", 1, 8).alias("canonical_id"))
    return R.repoint(fx.edges(spark, sf), m).select("src", "type", "dst")


@query("WITH s AS (SELECT src, dst FROM alike UNION ALL SELECT dst, src FROM alike) SELECT DISTINCT src, dst FROM s WHERE NOT (src > dst AND EXISTS (SELECT 1 FROM s t WHERE t.src = s.dst AND t.dst = s.src))")
def edge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.similar(spark, sf).select("src", "dst")
    both = s.union(s.select("dst", "src")).distinct()
    back = both.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src > dst")
    return both.join(back, ["src", "dst"], "left_anti")


@query("""WITH m AS (SELECT unnest(['NATION_', 'NATION_99', 'AMERICAS', 'Custmer#00000012', 'ATLANTIS']) AS mention), s AS (SELECT mention, id, round(1 - levenshtein(lower(mention), lower(id)) / CAST(greatest(length(mention), length(id)) AS DOUBLE), 6) AS score FROM m CROSS JOIN entity)
SELECT mention, id, score FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) AS r FROM s WHERE score >= 0.7) WHERE r <= 5""")
def string_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(spark, sf).select("mention", "id", "score")


def _recall(spark: SparkSession, sf: str) -> DataFrame:
    return R.recalled(fx.entities(spark, sf), spark.createDataFrame([(x,) for x in MENTIONS], "mention string"))


@query("""WITH m AS (SELECT DISTINCT left(id, 2) || substr(id, 4) || CASE type WHEN 'Brand' THEN 'x' ELSE '' END AS mention FROM entity WHERE type <> 'Part' AND type <> 'Company'),
s AS (SELECT mention, id, round(1 - levenshtein(lower(mention), lower(id)) / CAST(greatest(length(mention), length(id)) AS DOUBLE), 6) AS score FROM m CROSS JOIN (SELECT DISTINCT id FROM entity))
SELECT mention, id, score, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) AS r FROM s WHERE score >= 0.7) WHERE r <= 5""")
def mention_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Names with a letter left out (and one put in, for brands) as mentions, each linked to the five ids most like it."""
    e = fx.entities(spark, sf)
    wrong = F.concat(F.substring("id", 1, 2), F.substring(F.col("id"), F.lit(4), F.char_length("id")), F.when(F.col("type") == "Brand", "x").otherwise(""))
    return R.recalled(e, e.where("type <> 'Part' and type <> 'Company'").select(wrong.alias("mention")))


@query("""WITH m AS (SELECT unnest(['NATION_', 'NATION_99', 'AMERICAS', 'Custmer#00000012', 'ATLANTIS']) AS mention), s AS (SELECT mention, max(round(1 - levenshtein(lower(mention), lower(id)) / CAST(greatest(length(mention), length(id)) AS DOUBLE), 6)) AS best FROM m CROSS JOIN entity GROUP BY mention)
SELECT mention, best < 0.7 AS nil FROM s""")
def disambiguate_nil(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.createDataFrame([(x,) for x in MENTIONS], "mention string")
    best = _recall(spark, sf).groupBy("mention").agg(F.max("score").alias("best"))
    return m.join(best, "mention", "left").select("mention", (F.coalesce("best", F.lit(0.0)) < 0.7).alias("nil"))


SETS = f"""{COMP}, {DEG}, x AS (SELECT node, component, row_number() OVER (PARTITION BY component ORDER BY coalesce(degree, 0) DESC, node) AS k FROM c LEFT JOIN d USING (node)),
g AS (SELECT a.node, b.node AS canon FROM x a JOIN x b ON a.component = b.component AND b.k = 1),
n AS (SELECT canon, id, list_sort(list(DISTINCT type)) AS types FROM aligned JOIN g ON vec_id = node JOIN edge ON id = src GROUP BY canon, id)"""


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """``group`` (canonical vector), ``id``, ``types`` (of outgoing relations) of all aligned entities."""
    links, degrees = fx.similar_graph(spark, sf)
    names = R.canonical(connected_components(links), degrees)
    names = names.unionByName(names.select(F.col("canonical_id").alias("node"), "canonical_id").distinct())
    e = fx.aligned(spark, sf).join(names, F.col("vec_id") == F.col("node")).select("id", F.col("canonical_id").alias("group"))
    return e.join(fx.edges(spark, sf).select(F.col("src").alias("id"), "type").distinct(), "id").groupBy("group", "id").agg(F.collect_set("type").alias("types"))


@query(f"""WITH RECURSIVE {SETS}, s AS (SELECT canon, array_to_string(types, ',') AS t, types, CAST(count(*) AS BIGINT) AS members FROM n GROUP BY canon, types)
SELECT a.canon AS "group", a.t AS a, b.t AS b, round(len(list_intersect(a.types, b.types)) / CAST(len(list_distinct(list_concat(a.types, b.types))) AS DOUBLE), 6) AS share, a.members AS members_a, b.members AS members_b FROM s a JOIN s b ON a.canon = b.canon AND a.t < b.t WHERE share < 0.5""")
def conflict_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return R.jaccard_conflict(_typed(spark, sf))


@query(f"""WITH RECURSIVE {SETS} SELECT canon AS "group", id, array_to_string(types, ',') AS types FROM n""")
def conflict_members(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf).select("group", "id", F.array_join(F.array_sort("types"), ",").alias("types"))


@query(f"""WITH RECURSIVE {SETS}, o AS (SELECT src AS id, count(*) AS degree FROM edge GROUP BY src)
SELECT canon AS "group", id AS winner FROM (SELECT canon, id, row_number() OVER (PARTITION BY canon ORDER BY coalesce(degree, 0) DESC, id) AS r FROM n LEFT JOIN o USING (id)) WHERE r = 1""")
def conflict_resolved(spark: SparkSession, sf: str) -> DataFrame:
    degrees = fx.edges(spark, sf).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return R.most_related(_typed(spark, sf), degrees)


@query("""WITH m AS (SELECT * FROM (VALUES ('Custmer#00000012', 3), ('Supplier#00000001', 9)) t(mention, vec)), s AS (SELECT mention, vec, id, round(1 - levenshtein(lower(mention), lower(id)) / CAST(greatest(length(mention), length(id)) AS DOUBLE), 6) AS score FROM m CROSS JOIN entity),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) AS r FROM s WHERE score >= 0.7) WHERE r <= 5),
b AS (SELECT mention, id, round(0.4 * score + 0.6 * round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), 6) AS blend FROM r JOIN aligned USING (id) JOIN embeddings v USING (vec_id) JOIN embeddings q ON q.vec_id = r.vec)
SELECT mention, id, blend FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY blend DESC, id) AS k FROM b) WHERE k <= 3""")
def disambiguate_rerank(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.createDataFrame([("Custmer#00000012", 3), ("Supplier#00000001", 9)], "mention string, vec int")
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    of = fx.aligned(spark, sf).join(v, "vec_id").select("id", "v")
    asked = m.join(v, F.col("vec") == F.col("vec_id")).select("mention", F.col("v").alias("q"))
    return R.rerank(R.recalled(fx.entities(spark, sf), m), of, asked)


@query("SELECT id FROM entity WHERE id NOT IN (SELECT dst FROM edge) AND id NOT IN (SELECT src FROM edge)")
def graph_orphans(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.edges(spark, sf)
    ends = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id")))
    return fx.entities(spark, sf).select("id").join(ends, "id", "left_anti")


@query("SELECT id FROM chunk WHERE file_name NOT IN (SELECT file_name FROM doc WHERE n_chars > 500)")
def graph_dangling(spark: SparkSession, sf: str) -> DataFrame:
    kept = fx.documents(spark, sf).where("n_chars > 500").select("file_name")
    return fx.chunks(spark, sf).select("id", "file_name").join(kept, "file_name", "left_anti").select("id")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM documents WHERE text IS NULL OR text = ''")
def graph_empty_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is null or text = ''").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM doc WHERE file_name NOT IN (SELECT file_name FROM chunk WHERE position = 1)")
def broken_document_links(spark: SparkSession, sf: str) -> DataFrame:
    first = first_links(fx.chunks(spark, sf)).select(F.col("src").alias("file_name"))
    return fx.documents(spark, sf).join(first, "file_name", "left_anti").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM chunk WHERE position > 1 AND position % 3 = 0")
def graph_chain_breaks(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.chunks(spark, sf).select("id", "file_name", "position")
    links = next_links(c).join(c.where("position % 3 <> 0").select(F.col("id").alias("dst")), "dst", "left_semi")
    return c.where("position > 1").join(links, c.id == links.dst, "left_anti").agg(F.count("*").alias("n"))


@query("SELECT 'entity' AS kind, type AS name, CAST(count(*) AS BIGINT) AS n FROM entity GROUP BY type UNION ALL SELECT 'relation', type, CAST(count(*) AS BIGINT) FROM edge GROUP BY type")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda df, k: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), F.col("type").alias("name"), "n")
    return count(fx.entities(spark, sf), "entity").unionByName(count(fx.edges(spark, sf), "relation"))


@query("SELECT label, CAST(count(embedding) AS BIGINT) AS embedded, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY label")
def embedding_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("embedding").alias("embedded"), F.count("*").alias("n"))


@query("""WITH o AS (SELECT file_name AS path, md5(text) AS hash FROM doc WHERE doc_id % 10 <> 0), n AS (SELECT file_name AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS hash FROM doc WHERE doc_id % 11 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash""")
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.documents(spark, sf)
    old = d.where("doc_id % 10 <> 0").select(F.col("file_name").alias("path"), F.md5("text").alias("hash"))
    new = d.where("doc_id % 11 <> 0").select(F.col("file_name").alias("path"), F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("hash"))
    return U.manifest_diff(old, new)


@query("SELECT entity_id, CAST(count(*) AS BIGINT) AS refs FROM mention GROUP BY entity_id HAVING count(*) = count(*) FILTER (contains(file_name, 'src1'))")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    gone = fx.documents(spark, sf).where(F.col("file_name").contains("src1")).select("file_name")
    return U.delete_cascade(fx.mentions(spark, sf), gone)


@query("SELECT doc_id FROM documents WHERE n_chars IS NULL OR doc_id % 5 = 0 OR n_chars > 3000")
def reembed_select(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.where(U.needs_embedding(F.col("text"), F.col("doc_id") % 5 == 0, F.col("n_chars"), F.lit(3000))).select("doc_id")


@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v, o_custkey AS t FROM orders), n AS (SELECT l_orderkey AS k, max(l_extendedprice) AS v, CAST(max(l_suppkey) * 20 AS BIGINT) AS t FROM lineitem GROUP BY l_orderkey)
SELECT k, CASE WHEN n.t IS NOT NULL AND (o.t IS NULL OR n.t >= o.t) THEN n.v ELSE o.v END AS v, greatest(coalesce(o.t, n.t), coalesce(n.t, o.t)) AS t FROM o FULL JOIN n USING (k)""")
def graph_merge_ts(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_custkey").alias("t"))
    new = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("v"), (F.max("l_suppkey") * 20).alias("t"))
    return U.merge_latest(old, new, ["k"], "t")


@query("SELECT id, type, description FROM entity")
def entity_tuples(spark: SparkSession, sf: str) -> DataFrame:
    one = F.format_string('("entity" : "%s" : "%s" : "%s")', "id", "type", "description")
    texts = fx.entities(spark, sf).select(F.col("id").alias("chunk_id"), F.concat(one, F.lit("\n"), one).alias("result"))
    return U.parse_entities(texts)


@query("SELECT src, dst, type, weight FROM edge")
def relation_tuples(spark: SparkSession, sf: str) -> DataFrame:
    one = F.format_string('("relationship" : "%s" : "%s" : "%s" : "%s" : %s)', "src", "dst", "type", F.lit("said"), F.col("weight").cast("string"))
    e = fx.edges(spark, sf)
    texts = e.select(F.sha1(F.concat_ws("|", "src", "type", "dst")).alias("chunk_id"), one.alias("result"))
    return U.parse_relations(texts).select("src", "dst", "type", "weight")


@query("SELECT id, type, description FROM entity WHERE type <> 'Brand' UNION ALL SELECT DISTINCT p_brand, 'Unknown', 'No additional data' FROM part WHERE p_brand IN (SELECT dst FROM edge)")
def endpoint_completion(spark: SparkSession, sf: str) -> DataFrame:
    return U.complete_endpoints(fx.entities(spark, sf).where("type <> 'Brand'"), fx.edges(spark, sf))


@query()
def communities_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return R.label_propagation(fx.edges(spark, sf))


@query("""SELECT n_regionkey AS community, CAST(count(DISTINCT m) AS BIGINT) AS community_rank FROM (SELECT n_regionkey, c_custkey AS m FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, -s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY n_regionkey""")
def community_rank(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", F.col("c_custkey").alias("m"))
    s = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", (-F.col("s_suppkey")).alias("m"))
    return c.union(s).groupBy(F.col("n_regionkey").alias("community")).agg(F.count_distinct("m").alias("community_rank"))


@query("SELECT '0-' || n_regionkey AS community, CAST(0 AS INTEGER) AS level, n_name AS member FROM nation UNION ALL SELECT '1-0', 1, '0-' || r_regionkey FROM region")
def community_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("0-"), F.col("n_regionkey")).alias("community"), F.lit(0).alias("level"), F.col("n_name").alias("member"))
    return n.union(table(spark, sf, "region").select(F.lit("1-0"), F.lit(1), F.concat(F.lit("0-"), F.col("r_regionkey"))))


@query("""SELECT n_regionkey AS community, 'Nodes are:' || chr(10) || string_agg('id: ' || n_name || ', type: Geography', chr(10) ORDER BY n_name) AS text FROM nation GROUP BY n_regionkey""")
def community_describe(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("id: "), F.col("n_name"), F.lit(", type: Geography"))
    g = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("community")).agg(F.array_sort(F.collect_list(F.struct("n_name", line.alias("line")))).alias("x"))
    return g.select("community", F.concat(F.lit("Nodes are:\n"), F.array_join(F.transform("x", lambda s: s["line"]), "\n")).alias("text"))


@query("""WITH o AS (SELECT id, type, description, 1 AS created, 1 AS updated FROM entity),
n AS (SELECT id, type, CASE WHEN type = 'Brand' THEN NULL ELSE 'changed ' || id END AS description FROM entity WHERE type IN ('Supplier', 'Brand')
  UNION ALL SELECT 'NEW_' || id, 'Region', 'added' FROM entity WHERE type = 'Region')
SELECT coalesce(n.id, o.id) AS id, coalesce(n.type, o.type) AS type, coalesce(n.description, o.description) AS description, CAST(coalesce(o.created, 2) AS INTEGER) AS created, CAST(CASE WHEN n.id IS NULL THEN 1 ELSE 2 END AS INTEGER) AS updated
FROM o FULL JOIN n ON o.id = n.id WHERE coalesce(n.id, o.id) NOT LIKE 'NATION%'""")
def graph_store(spark: SparkSession, sf: str) -> DataFrame:
    """Entities written to a keyed store in three commits (all, changed and new ones, nations deleted), the second one tried twice."""
    store = KeyedStore(spark, f"{scratch_dir(spark).rstrip('/')}/graph-{uuid.uuid4().hex}", ("id",), 16)
    e = fx.entities(spark, sf).select("id", "type", "description")
    turn = lambda n: [F.lit(n).alias("created"), F.lit(n).alias("updated")]
    store.upsert(e.select("*", *turn(1)), "load", keep=("created",))
    text = F.when(F.col("type") == "Brand", F.lit(None)).otherwise(F.concat(F.lit("changed "), "id"))
    changed = e.where("type in ('Supplier', 'Brand')").select("id", "type", text.alias("description"), *turn(2))
    new = e.where("type = 'Region'").select(F.concat(F.lit("NEW_"), "id").alias("id"), "type", F.lit("added").alias("description"), *turn(2))
    nameless = e.where("type = 'Region'").select(F.lit(None).cast("string").alias("id"), "type", "description", *turn(2))
    for _ in range(2):
        store.upsert(changed.unionByName(new).unionByName(nameless), "change", keep=("created",))
    store.delete(e.where("id like 'NATION%'").select("id"), "delete nations")
    return store.read()
