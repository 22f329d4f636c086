"""Queries over scopes, jobs and incremental rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.text import tokens
from sedimenta.operators import scope as S
from sedimenta.operators import upsert as U
from sedimenta.operators.chunks import fixed_windows
from sedimenta.plans import fixtures as fx
from sedimenta.plans.registry import query
from sedimenta.session import table

COMPANIES = ["BLDG", "building", "AUTO", "automobile", "machinery"]


@query("""WITH g AS (SELECT *, CASE WHEN lower(segment) LIKE '%bldg%' OR lower(segment) LIKE '%building%' THEN 0 WHEN lower(segment) LIKE '%auto%' THEN 1 WHEN lower(segment) LIKE '%machinery%' THEN 2 END AS grp FROM fact)
SELECT grp, file_name, context_ref, value FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value DESC, context_ref, file_name, name) AS r FROM g WHERE grp IS NOT NULL) WHERE r <= 5""")
def facts_by_company(spark: SparkSession, sf: str) -> DataFrame:
    groups = S.group_companies(COMPANIES)
    top = S.by_group(fx.facts(spark, sf), groups, "segment", [F.desc("value"), "context_ref", "file_name", "name"], 5)
    return top.select("grp", "file_name", "context_ref", "value")


@query("SELECT user_id AS job, arg_max(event_type, event_id) AS state, min(event_id) AS first, max(event_id) AS last, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id")
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    return S.job_states(table(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("state")))


@query("""WITH s AS (SELECT user_id AS job, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id)
SELECT o_custkey AS job, o_orderkey AS seq, CASE WHEN s.job IS NULL AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 202 ELSE 409 END AS status FROM orders LEFT JOIN (SELECT job FROM s WHERE state IN ('view', 'click')) s ON s.job = o_custkey""")
def job_admission(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("view", "click"), "running").otherwise("completed").alias("state"))
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("seq"))
    return S.admit(r, S.job_states(e))


@query("SELECT id, file_name, position, md5(text) AS text_md5 FROM chunk WHERE doc_id % 11 <> 0")
def incremental_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of an older state of the documents, brought up to date by the difference of the manifests."""
    d = fx.documents(spark, sf)
    build = lambda x: fixed_windows(x.withColumn("tokens", tokens("text"))).select("id", "file_name", "position", F.md5("text").alias("text_md5"))
    old = d.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))
    now = d.where("doc_id % 11 <> 0")
    listed = lambda x: x.select(F.col("file_name").alias("path"), F.md5("text").alias("hash"))
    return S.rebuild(build(old), now, U.manifest_diff(listed(old), listed(now)), build)
