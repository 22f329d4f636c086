"""Queries over caches, jobs, evaluation, audit events and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.operators import cache as C
from sedimenta.plans import fixtures as fx
from sedimenta.plans.registry import query
from sedimenta.session import table
from sedimenta.streaming.events import audit_lines, tumbling_once

USER = "SELECT conv_id AS thread, turn AS seq, text AS query FROM conversations WHERE role = 'user'"


def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), F.col("text").alias("query"))


@query("SELECT conv_id, turn, md5(trim(text, ' ')) AS simple_key, md5(trim(regexp_replace(text, '^[a-z]+:', ''), ' ')) AS global_key FROM conversations")
def cache_key_simple(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", C.simple_key(t).alias("simple_key"), C.global_key(t).alias("global_key"))


@query(f"""WITH t AS ({USER}) SELECT thread, seq, md5(trim('thread:' || thread || '|ctx:' || coalesce(string_agg(query, ' ') OVER (PARTITION BY thread ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') || '|v' || count(*) OVER (PARTITION BY thread ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || '|' || query, ' ')) AS key FROM t""")
def cache_key_context(spark: SparkSession, sf: str) -> DataFrame:
    return C.context_keys(user_turns(spark, sf))


@query("""SELECT conv_id, turn, md5(trim(text, ' ') || '|' || array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))), ',')) AS key FROM conversations WHERE role = 'user'""")
def cache_key_keywords(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))), ",")
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5(F.concat(F.trim("text"), F.lit("|"), words)).alias("key"))


@query("""WITH m AS (SELECT user_id AS key, event_id AS seq, event_type = 'purchase' OR event_type = 'click' AS positive FROM events WHERE event_type IN ('purchase', 'click', 'error')),
o AS (SELECT key, list(positive ORDER BY seq) AS m FROM m GROUP BY key),
s AS (SELECT key, list_reduce(list_transform(m, lambda p: CASE WHEN p THEN 1 ELSE -2 END), lambda a, x: CASE WHEN x > 0 THEN a + 1 ELSE greatest(-5, a - 2) END, 0) AS score, list_contains(m, true) AS verified, m[len(m)] AS fast FROM o)
SELECT key, CAST(score AS BIGINT) AS score, verified, fast, verified OR score > 2 OR fast AS high FROM s""")
def cache_quality(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "click", "error"))
    return C.quality(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").isin("purchase", "click").alias("positive")))


SCORE = "round(n / greatest(age, 1.0) + 1 / greatest(idle, 1.0) - 0.1 * kb, 6)"
ITEMS = """i AS (SELECT user_id AS key, count(*) AS n, epoch(max(ts) - min(ts)) / 3600.0 AS age, epoch(TIMESTAMP '2024-02-01' - max(ts)) / 3600.0 AS idle, sum(length(props)) / 1024.0 AS kb FROM events GROUP BY user_id)"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    hours = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3.6e9
    g = table(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), (F.sum(F.char_length("props")) / 1024.0).alias("kb"))
    s = C.eviction_score(F.col("n"), hours(F.col("b"), F.col("a")), hours(F.to_timestamp(F.lit("2024-02-01 00:00:00")), F.col("b")), F.col("kb"))
    return g.select("key", F.round(s, 6).alias("score"))


@query(f"WITH {ITEMS} SELECT key, {SCORE} AS score FROM i")
def eviction_score(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf)


@query(f"WITH {ITEMS}, s AS (SELECT key, {SCORE} AS score FROM i) SELECT key, score FROM s ORDER BY score, key LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM s)")
def evict_lowest(spark: SparkSession, sf: str) -> DataFrame:
    return C.evict(_items(spark, sf))


@query("SELECT user_id AS key, max(event_id) AS last FROM events GROUP BY user_id ORDER BY last DESC, key LIMIT 25")
def lru_cache(spark: SparkSession, sf: str) -> DataFrame:
    return C.least_recent(table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq")), 25)


@query("""WITH m AS (SELECT c_custkey AS key, c_name AS value, c_acctbal > 0 AS high FROM customer WHERE c_custkey % 3 = 0), d AS (SELECT c_custkey AS key, c_mktsegment AS value, c_acctbal > 5000 AS high FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(m.key, d.key) AS key, CASE WHEN m.key IS NOT NULL THEN m.value ELSE d.value END AS value, CASE WHEN m.key IS NOT NULL THEN 0 ELSE 1 END AS tier, m.key IS NULL AND d.high AS promote FROM m FULL JOIN d ON m.key = d.key""")
def cache_tiered(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    m = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"), (F.col("c_acctbal") > 0).alias("high"))
    d = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), (F.col("c_acctbal") > 5000).alias("high"))
    return C.tiered(m, d).select("key", "value", "tier", "promote")


@query("SELECT user_id, event_id, ts >= TIMESTAMP '2024-01-24' AS live FROM events")
def cache_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", (F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")).alias("live"))


@query("""SELECT user_id, round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 6) AS exact_rate, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS vector_rate, round(avg(CASE WHEN event_type IN ('view', 'click') THEN 0.0 ELSE 1.0 END), 6) AS miss_rate FROM events GROUP BY user_id""")
def cache_hit_rates(spark: SparkSession, sf: str) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    t = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(rate(t == "view").alias("exact_rate"), rate(t == "click").alias("vector_rate"), rate(~t.isin("view", "click")).alias("miss_rate"))


@query("""WITH p AS (SELECT q.conv_id, q.turn, regexp_split_to_array(lower(trim(q.text, ' ')), '\\s+') AS a, regexp_split_to_array(lower(trim(r.text, ' ')), '\\s+') AS b, r.text AS answer FROM conversations q JOIN conversations r ON q.conv_id = r.conv_id AND r.turn = q.turn + 1 AND q.role = 'user' AND r.role = 'assistant')
SELECT conv_id, turn, length(answer) >= 10 AND (len(a) <= 2 OR len(list_intersect(a, b)) > 0) AS valid FROM p""")
def cache_validation(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.split(F.lower(F.trim("text")), r"\s+").alias("a"))
    r = c.where("role = 'assistant'").select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"), F.split(F.lower(F.trim("text")), r"\s+").alias("b"), F.col("text").alias("answer"))
    j = q.join(r, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")))
    return j.select("conv_id", "turn", ((F.char_length("answer") >= 10) & ((F.size("a") <= 2) | F.arrays_overlap("a", "b"))).alias("valid"))


@query("SELECT source, lang, round(avg(quality), 3) AS quality, round(avg(toxic), 3) AS toxic, CAST(count(*) AS BIGINT) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source, lang")
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels"), "doc_id")
    return j.groupBy("source", "lang").agg(F.round(F.avg("quality"), 3).alias("quality"), F.round(F.avg("toxic"), 3).alias("toxic"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT source, avg(quality) FILTER (lang = 'en') AS a, avg(quality) FILTER (lang <> 'en') AS b FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, CASE WHEN b > 0 THEN round((a - b) / b * 100, 1) END AS delta_pct FROM m""")
def metric_delta(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels"), "doc_id")
    m = j.groupBy("source").agg(F.avg(F.when(F.col("lang") == "en", F.col("quality"))).alias("a"), F.avg(F.when(F.col("lang") != "en", F.col("quality"))).alias("b"))
    return m.select("source", F.when(F.col("b") > 0, F.round((F.col("a") - F.col("b")) / F.col("b") * 100, 1)).alias("delta_pct"))


@query("SELECT upper(string_split(lower(c_mktsegment), 'i')[1]) AS ticker, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 ORDER BY n DESC, ticker LIMIT 30")
def counts_by_company(spark: SparkSession, sf: str) -> DataFrame:
    ticker = F.upper(F.element_at(F.split(F.lower("c_mktsegment"), "i"), 1))
    return table(spark, sf, "customer").groupBy(ticker.alias("ticker")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(30)


@query("SELECT doc_id FROM documents ORDER BY md5('42' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("42"), F.col("doc_id").cast("string"))), "doc_id").limit(50)


@query("""SELECT file_name, CASE WHEN c.n IS NULL THEN 'missing' WHEN c.n < 2 THEN 'partial' ELSE 'ok' END AS status FROM doc LEFT JOIN (SELECT file_name, count(*) AS n FROM chunk GROUP BY file_name) c USING (file_name)""")
def ingestion_check(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.chunks(spark, sf).groupBy("file_name").agg(F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") < 2, "partial").otherwise("ok")
    return fx.documents(spark, sf).select("file_name").join(c, "file_name", "left").select("file_name", status.alias("status"))


@query("SELECT event_type AS endpoint, CAST(count(*) AS BIGINT) AS calls, round(sum(value), 4) AS total, round(avg(value), 4) AS average FROM events GROUP BY event_type")
def endpoint_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("endpoint")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("average"))


@query("SELECT user_id, event_type AS stage, round(100 * sum(value) / sum(sum(value)) OVER (PARTITION BY user_id), 4) AS share FROM events GROUP BY user_id, event_type")
def stage_shares(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.sum("value").alias("v"))
    return s.select("user_id", "stage", F.round(100 * F.col("v") / F.sum("v").over(Window.partitionBy("user_id")), 4).alias("share"))


@query("""SELECT event_id, '{"event_type":"' || event_type || '","session_id":"' || user_id || '","details":' || props || '}' AS line, strftime(ts, '%Y-%m-%d') AS event_date FROM events""")
def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    return audit_lines(table(spark, sf, "events"))


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return tumbling_once(spark, f"{sf}/events.parquet")
