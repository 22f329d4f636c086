"""Queries over repairs, write-backs, lookups, messages and communities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.functions.vectors import dot, normalized
from sedimenta.operators import graph as G
from sedimenta.operators import layout as L
from sedimenta.operators import repair as R
from sedimenta.operators.chunks import first_links, next_links
from sedimenta.operators.components import connected_components
from sedimenta.operators.upsert import overlay
from sedimenta.plans import fixtures as fx
from sedimenta.plans.q_graph import TRAIL, geo
from sedimenta.plans.registry import query
from sedimenta.session import scratch_dir, table
from sedimenta.streaming.registry import EVENT, FileRegistry


@query("SELECT doc_id, md5(CASE WHEN text IS NULL OR text = '' OR doc_id % 50 = 0 THEN '[Empty Chunk]' ELSE text END) AS text_md5, text IS NULL OR text = '' OR doc_id % 50 = 0 AS repaired FROM documents")
def repair_empty(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.lit(None)).otherwise(F.col("text")).alias("text"))
    return R.fill_empty(d).select("doc_id", F.md5("text").alias("text_md5"), "repaired")


@query("SELECT file_name AS src, id AS dst FROM chunk WHERE position = 1 AND doc_id % 9 = 0")
def repair_first_links(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.chunks(spark, sf)
    there = first_links(c.where("doc_id % 9 <> 0"))
    return R.missing_first(fx.documents(spark, sf), c, there)


@query("SELECT src, dst FROM (SELECT lag(id) OVER (PARTITION BY file_name ORDER BY position) AS src, id AS dst, position FROM chunk) WHERE src IS NOT NULL AND position % 3 = 0")
def repair_next_links(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.chunks(spark, sf)
    there = next_links(c).join(c.where("position % 3 <> 0").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    return R.missing_next(c, there)


@query("SELECT id, id || ' ' || description AS text FROM entity")
def entity_texts(spark: SparkSession, sf: str) -> DataFrame:
    return R.entity_text(fx.entities(spark, sf))


@query("SELECT id FROM chunk WHERE contains(file_name, 'src3_')")
def mark_changed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    f = fx.documents(spark, sf).where(F.col("file_name").contains("src3_")).select("file_name")
    return R.mark_changed(fx.chunks(spark, sf), fx.mentions(spark, sf), f)[0]


@query("SELECT DISTINCT entity_id AS id FROM mention WHERE contains(file_name, 'src3_')")
def mark_changed_entities(spark: SparkSession, sf: str) -> DataFrame:
    f = fx.documents(spark, sf).where(F.col("file_name").contains("src3_")).select("file_name")
    return R.mark_changed(fx.chunks(spark, sf), fx.mentions(spark, sf), f)[1]


@query("SELECT md5(text) AS key, CAST(count(*) AS BIGINT) AS n FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'de') GROUP BY 1")
def extraction_uncached(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("lang", F.md5("text").alias("key"))
    return R.uncached(d, d.where("lang = 'de'").distinct()).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS length, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8)) AS v FROM embeddings)")
def vectors_normalized(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", normalized(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.sqrt(dot(F.col("v"), F.col("v"))), 6).alias("length"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'URGENT' ELSE o_orderpriority END AS priority, o_orderstatus AS status FROM orders UNION ALL SELECT -1, 'NEW', NULL")
def overlay_properties(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    new = o.where("k % 3 = 0").select("k", F.lit("URGENT").alias("priority"), F.lit(None).cast("string").alias("status"))
    new = new.unionByName(spark.createDataFrame([(-1, "NEW", None)], "k long, priority string, status string"))
    return overlay(o, new, "k", ["priority", "status"])


@query("SELECT doc_id, 'a' || (doc_id % 5) || '|' || 'b' || doc_id AS ids FROM documents")
def message_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    m = F.concat(F.lit("answer {'data': {'Entities':['a"), F.col("doc_id") % 5, F.lit("', 'b"), F.col("doc_id"), F.lit("'], 'Chunks':['x']}}"))
    return d.select("doc_id", F.array_join(R.message_ids(m, "Entities"), "|").alias("ids"))


@query("SELECT id AS source, 'chunk' AS kind, id FROM chunk UNION ALL SELECT '2,x,' || id, 'chunk', id FROM chunk UNION ALL SELECT '0,' || n_nationkey, 'community', CAST(n_nationkey AS VARCHAR) FROM nation")
def source_routing(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.chunks(spark, sf).select("id")
    s = c.select(F.col("id").alias("source")).union(c.select(F.concat(F.lit("2,x,"), F.col("id")))).union(table(spark, sf, "nation").select(F.concat(F.lit("0,"), F.col("n_nationkey"))))
    k = R.source_kind(F.col("source"))
    return s.select("source", k["kind"].alias("kind"), k["id"].alias("id"))


@query("SELECT doc_id, coalesce(c.n, 0) AS n_chunks, coalesce(c.text, 'not found') AS first_text FROM doc LEFT JOIN (SELECT doc_id, CAST(count(*) AS BIGINT) AS n, min(md5(text)) AS text FROM chunk GROUP BY doc_id) c USING (doc_id)")
def source_info_batch(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.chunks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.md5("text")).alias("text"))
    return fx.documents(spark, sf).select("doc_id").join(c, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("text", F.lit("not found")).alias("first_text"))


@query(TRAIL("a = 'NATION_6'", 2) + " SELECT node, CAST(min(hops) AS BIGINT) AS hops, CAST(count(*) AS BIGINT) AS trails, bool_or(hops = 1) AS direct FROM t GROUP BY node")
def influence_nodes(spark: SparkSession, sf: str) -> DataFrame:
    t = G.trails(geo(spark, sf), F.col("node") == "NATION_6", 2)
    return t.groupBy("node").agg(F.min("hops").cast("long").alias("hops"), F.count("*").alias("trails"), F.bool_or(F.col("hops") == 1).alias("direct"))


@query("""WITH RECURSIVE g AS (SELECT 'g' || o_custkey AS a, 'm' || (o_custkey // 3) AS b FROM orders UNION SELECT 'g' || o_custkey, 'm' || ((o_custkey + 1) // 3) FROM orders WHERE o_custkey % 7 = 0), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g), r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a)
SELECT node, min(reach) AS component FROM r WHERE starts_with(node, 'g') GROUP BY node""")
def union_groups(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey").distinct()
    name = lambda k: F.concat(F.lit("m"), F.floor(k / 3).cast("string"))
    group = F.concat(F.lit("g"), F.col("o_custkey").cast("string"))
    e = o.select(group.alias("src"), name(F.col("o_custkey")).alias("dst")).union(o.where("o_custkey % 7 = 0").select(group, name(F.col("o_custkey") + 1)))
    return connected_components(e).where(F.col("node").startswith("g"))


@query("""WITH c AS (SELECT '0-' || n_regionkey AS id, CAST(count(*) AS BIGINT) AS community_rank, string_agg(n_name, ', ' ORDER BY n_name) AS summary FROM nation GROUP BY n_regionkey)
SELECT id, community_rank, summary FROM c WHERE contains(summary, 'NATION_1') ORDER BY coalesce(community_rank, 0) DESC, id LIMIT 3""")
def community_lookup(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "nation").groupBy(F.concat(F.lit("0-"), F.col("n_regionkey")).alias("id"))
    c = g.agg(F.count("*").alias("community_rank"), F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("summary"))
    return c.where(F.col("summary").contains("NATION_1")).orderBy(F.desc(F.coalesce("community_rank", F.lit(0))), "id").limit(3)


@query("SELECT role, CAST(count(*) FILTER (turn % 2 = 0) AS BIGINT) AS local_n, CAST(count(*) FILTER (turn % 2 = 1) AS BIGINT) AS global_n FROM conversations GROUP BY role")
def retrieval_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("role").agg(F.count_if(F.col("turn") % 2 == 0).alias("local_n"), F.count_if(F.col("turn") % 2 == 1).alias("global_n"))


@query("SELECT event_id, CASE WHEN value > 0.5 THEN 'positive' ELSE 'negative' END AS feedback FROM events")
def feedback_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.when(F.col("value") > 0.5, "positive").otherwise("negative").alias("feedback"))


@query("SELECT conv_id, turn, 'because ' || turn AS thinking, text AS answer FROM conversations")
def think_split(spark: SparkSession, sf: str) -> DataFrame:
    full = F.concat(F.lit("<think>because "), F.col("turn"), F.lit("</think>"), F.col("text"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", full.alias("t"))
    return c.select("conv_id", "turn", F.regexp_extract("t", "(?s)<think>(.*?)</think>", 1).alias("thinking"), F.regexp_replace("t", "(?s)<think>.*?</think>", "").alias("answer"))


@query(r"""WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '[^.!?。！？\n]*[.!?。！？\n]\s*|[^.!?。！？\n]+') AS parts FROM conversations)
SELECT conv_id, turn, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS n, regexp_replace(unnest(parts), '([.!?。！？\n])\s*$', '\1') AS sentence FROM p""")
def sentence_stream(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'HTML' WHEN 1 THEN 'PDF' WHEN 2 THEN 'text' ELSE 'Unknown type' END AS kind FROM documents")
def type_labels(spark: SparkSession, sf: str) -> DataFrame:
    from sedimenta.sources.files import type_label

    ext = F.element_at(F.array(F.lit("htm"), F.lit("pdf"), F.lit("txt"), F.lit("zip")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", ext.alias("ext")).select("doc_id", type_label("ext").alias("kind"))


@query("SELECT event_type, CAST(max(event_id) AS BIGINT) AS last_event, arg_max(user_id, event_id) AS last_user, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def registry_update(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.max("event_id").alias("last_event"), F.max_by("user_id", "event_id").alias("last_user"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT 'file ' || user_id AS path, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) END AS hash, event_id AS seq FROM events),
c AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY seq) AS before FROM e),
d AS (SELECT *, CASE WHEN hash IS NOT NULL AND before IS NULL THEN 'added' WHEN hash <> before THEN 'modified' WHEN hash IS NULL AND before IS NOT NULL THEN 'deleted' ELSE 'unchanged' END AS change FROM c)
SELECT path, arg_max(coalesce(hash, ''), seq) AS hash, arg_max(change, seq) AS status, CAST(count(*) FILTER (change <> 'unchanged') AS BIGINT) AS changes, CAST(min(seq) AS BIGINT) AS first_seq, CAST(max(seq) AS BIGINT) AS last_seq FROM d GROUP BY path""")
def file_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Users as files and their events as sightings, taken in by three runs of a stream over a folder that grows; equal to one pass over all of them."""
    base = f"{scratch_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    e = table(spark, sf, "events")
    seen = F.when(F.col("event_type") != "error", (F.floor("value").cast("long") % 3).cast("string"))
    events = e.select(F.concat(F.lit("file "), "user_id").alias("path"), seen.alias("hash"), F.col("event_id").alias("seq"))
    registry = FileRegistry(spark, f"{base}/registry")
    n = e.agg(F.max("event_id")).first()[0] or 0
    for i in range(3):
        events.where(F.col("seq").between(n * i // 3 + (i > 0), n * (i + 1) // 3)).coalesce(1).write.mode("append").parquet(f"{base}/events")
        registry.run(spark.readStream.schema(EVENT).parquet(f"{base}/events"))
    return registry.read().withColumn("hash", F.coalesce("hash", F.lit("")))


@query()
def request_batches(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.documents(spark, sf).select(F.col("file_name").alias("path"), F.octet_length("text").alias("size"))
    return R.size_batches(d, 1_000_000)


@query()
def large_texts_split(spark: SparkSession, sf: str) -> DataFrame:
    return R.split_large(table(spark, sf, "documents"), 20_000).select("doc_id", "n", F.md5("piece").alias("piece_md5"), F.char_length("piece").alias("length"))


@query("""SELECT CAST(l_orderkey AS BIGINT) AS page, string_agg(chr(65 + CAST(l_linenumber AS INTEGER)), chr(10) ORDER BY l_linenumber) AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_linenumber <> 2 GROUP BY l_orderkey""")
def text_outside_tables(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    chars = li.select(F.col("l_orderkey").alias("page"), F.lit(1).alias("x"), (F.col("l_linenumber") * 10).alias("top"), F.expr("char(65 + l_linenumber)").alias("c"))
    boxes = li.select(F.col("l_orderkey").alias("page")).distinct().select("page", F.lit(0).alias("x0"), F.lit(5).alias("x1"), F.lit(15).alias("y0"), F.lit(25).alias("y1"))
    return L.outside_boxes(chars, boxes)


@query("""WITH l AS (SELECT l_orderkey AS page, l_linenumber AS box, min(l_partkey) AS p, CAST(min(l_quantity) AS INTEGER) AS q, CAST(min(l_suppkey) AS INTEGER) AS s FROM lineitem GROUP BY ALL),
b AS (SELECT *, 40 AS x0, 70 + s % 12 * 10 AS x1, box * 120 AS y0 FROM l),
n AS (SELECT page, box * 120 - q - 5 AS top, p_name AS t FROM l JOIN part ON p_partkey = p UNION ALL SELECT page, box * 120 - q - 17, p_brand FROM l JOIN part ON p_partkey = p),
c AS (SELECT page, top, unnest(generate_series(1, length(t))) AS i, t FROM n), d AS (SELECT page, top, top + 10 AS bottom, 32 + 8 * i AS x0, 38 + 8 * i AS x1, substr(t, i, 1) AS c FROM c WHERE substr(t, i, 1) <> ' '),
h AS (SELECT b.page, b.box, d.top, d.x0, d.c, lag(d.top) OVER w AS before, lag(d.x1) OVER w AS x FROM b JOIN d ON b.page = d.page AND d.x0 >= b.x0 AND d.x1 <= b.x1 AND d.top >= b.y0 - 30 AND d.bottom <= b.y0 WINDOW w AS (PARTITION BY b.page, b.box ORDER BY d.top, d.x0)),
s AS (SELECT page, box, string_agg(CASE WHEN top <> before OR x0 - x > 3 THEN ' ' ELSE '' END || c, '' ORDER BY top, x0) AS caption FROM h GROUP BY page, box)
SELECT CAST(b.page AS BIGINT) AS page, CAST(b.box AS BIGINT) AS box, caption FROM b LEFT JOIN s USING (page, box)""")
def table_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as pages, their lines as tables, each with its part's name and brand set above, near or too far, and cut off at the table's right."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("page"), F.col("l_linenumber").cast("long").alias("box"))
    li = li.agg(F.min("l_partkey").alias("p"), F.min("l_quantity").cast("int").alias("q"), F.min("l_suppkey").cast("int").alias("s"))
    boxes = li.select("page", "box", F.lit(40).alias("x0"), (70 + F.col("s") % 12 * 10).alias("x1"), (F.col("box") * 120).alias("y0"), (F.col("box") * 120 + 60).alias("y1"))
    named = li.join(table(spark, sf, "part"), F.col("p") == F.col("p_partkey")).withColumn("top", F.col("box") * 120 - F.col("q") - 5)
    lines = named.select("page", F.explode(F.array(F.struct("top", F.col("p_name").alias("t")), F.struct((F.col("top") - 12).alias("top"), F.col("p_brand").alias("t")))).alias("n"))
    signs = lines.select("page", "n.top", F.posexplode(F.split("n.t", "")).alias("i", "c")).where("c not in (' ', '')")
    chars = signs.select("page", (40 + 8 * F.col("i")).alias("x0"), (46 + 8 * F.col("i")).alias("x1"), "top", (F.col("top") + 10).alias("bottom"), "c")
    return L.captions(chars, boxes)


@query("SELECT c_mktsegment AS community, CAST(count(*) AS BIGINT) AS members, min(c_name) AS first_member FROM customer GROUP BY c_mktsegment HAVING count(*) >= 2")
def community_info(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("community")).agg(F.count("*").alias("members"), F.min("c_name").alias("first_member")).where("members >= 2")


@query("SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY ALL")
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 6 hours"), 0).otherwise(1)
    s = e.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"))
