"""Queries over facts, tables, sections and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.operators import facts as X
from sedimenta.plans import fixtures as fx
from sedimenta.plans.registry import query
from sedimenta.session import table

SHOW = ["file_name", "name", "value", "unit", "period_end", "context_ref"]
ORDER = "ORDER BY period_end DESC NULLS FIRST, value DESC NULLS FIRST, name, context_ref, file_name LIMIT 20"
HUMAN = """CASE WHEN abs(value) >= 1e9 THEN printf('%.3fB %s', sign(value) * floor(abs(value / 1e9) * 1000 + 0.5) / 1000, unit)
           WHEN abs(value) >= 1e6 THEN printf('%.3fM %s', sign(value) * floor(abs(value / 1e6) * 1000 + 0.5) / 1000, unit)
           WHEN abs(value) >= 1e3 THEN printf('%.3fK %s', sign(value) * floor(abs(value / 1e3) * 1000 + 0.5) / 1000, unit)
           ELSE printf('%.2f %s', sign(value) * floor(abs(value) * 100 + 0.5) / 100, unit) END"""
TERM = "(lower(name) LIKE '%revenues%' OR lower(context_ref) LIKE '%revenues%' OR lower(segment) LIKE '%revenues%' OR lower(name) LIKE '%building%' OR lower(context_ref) LIKE '%building%' OR lower(segment) LIKE '%building%')"
COLS = "file_name, name, value, unit, period_end, context_ref"


def _terms():
    return X.any_term(["name", "context_ref", "segment"], X.expand_terms(["Revenues", "building"]))


@query(f"SELECT {COLS}, {HUMAN} AS display FROM fact WHERE {TERM} AND period_end BETWEEN '1996-06-15' AND '1996-07-15' AND file_name LIKE '%cust_1%' {ORDER}")
def fact_lookup_period(spark: SparkSession, sf: str) -> DataFrame:
    f = fx.facts(spark, sf).where(_terms() & X.in_period("1996-06-30") & F.col("file_name").contains("cust_1"))
    return X.latest(f).select(*SHOW, T.human_number(F.col("value"), F.col("unit")).alias("display"))


@query(f"SELECT {COLS} FROM fact WHERE {TERM} AND left(period_end, 4) IN ('1996', '1997') {ORDER}")
def fact_lookup_fiscal_year(spark: SparkSession, sf: str) -> DataFrame:
    return X.latest(fx.facts(spark, sf).where(_terms() & X.in_fiscal_year(1997))).select(*SHOW)


@query(f"SELECT {COLS} FROM fact WHERE {TERM} AND contains(context_ref, 'YTD') AND contains(file_name, '10q') {ORDER}")
def fact_lookup_ytd(spark: SparkSession, sf: str) -> DataFrame:
    return X.latest(fx.facts(spark, sf).where(_terms() & X.year_to_date(True) & F.col("file_name").contains("10q"))).select(*SHOW)


@query(f"SELECT {COLS} FROM fact WHERE {TERM} AND NOT contains(context_ref, 'YTD') AND contains(file_name, '10k') {ORDER}")
def fact_lookup_quarterly(spark: SparkSession, sf: str) -> DataFrame:
    return X.latest(fx.facts(spark, sf).where(_terms() & X.year_to_date(False) & F.col("file_name").contains("10k"))).select(*SHOW)


@query(f"""WITH p AS (SELECT *, CASE WHEN contains(file_name, 'cust_999999_') AND contains(context_ref, 'YTD') THEN 0 WHEN contains(file_name, 'cust_999999_') THEN 1 ELSE 2 END AS pass FROM fact WHERE {TERM})
SELECT {COLS}, CAST(pass AS INTEGER) AS pass FROM p WHERE pass = (SELECT min(pass) FROM p) {ORDER}""")
def fact_lookup_relaxed(spark: SparkSession, sf: str) -> DataFrame:
    company = F.col("file_name").contains("cust_999999_")
    steps = [company & X.year_to_date(True), company, F.lit(True)]
    return X.relaxed(fx.facts(spark, sf).where(_terms()), steps).select(*SHOW, "pass")


@query(f"SELECT {COLS}, {HUMAN} AS display FROM fact")
def fact_human_format(spark: SparkSession, sf: str) -> DataFrame:
    return fx.facts(spark, sf).select(*SHOW, T.human_number(F.col("value"), F.col("unit")).alias("display"))


@query("""SELECT name, segment, value, period_end, file_name, context_ref FROM (SELECT *, row_number() OVER (PARTITION BY name, segment ORDER BY fact_seq DESC, fact_sub DESC, value DESC, period_end DESC) AS r FROM fact) WHERE r = 1""")
def fact_upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return X.upsert_last(fx.facts(spark, sf), ["name", "segment"]).select("name", "segment", "value", "period_end", "file_name", "context_ref")


@query("SELECT file_name, CAST(count(*) AS BIGINT) AS n_facts FROM fact GROUP BY file_name")
def has_fact_edges(spark: SparkSession, sf: str) -> DataFrame:
    return fx.facts(spark, sf).groupBy("file_name").agg(F.count("*").alias("n_facts"))


@query("SELECT name, unit, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total, min(period_end) AS first_end, max(period_end) AS last_end FROM fact GROUP BY name, unit")
def fact_totals(spark: SparkSession, sf: str) -> DataFrame:
    return fx.facts(spark, sf).groupBy("name", "unit").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("period_end").alias("first_end"), F.max("period_end").alias("last_end"))


@query("SELECT CAST(unnest(range(1, 7)) AS BIGINT) AS n, unnest(['net revenue', 'revenue', 'risk factors', 'risk', 'factors', 'segment']) AS term")
def term_expansion(spark: SparkSession, sf: str) -> DataFrame:
    terms = X.expand_terms(["Net revenue", "Risk factors", "segment", "risk"])
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(terms)], "n long, term string")


PARTS = "SELECT p_brand AS table_id, 'Parts of ' || p_brand AS caption, p_type AS section, string_agg(p_name || ' | ' || printf('%.2f', p_retailprice), chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY p_brand, p_type"


def price_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A table for each brand and type of part: one row a part, name and price."""
    row = F.struct("p_partkey", F.concat_ws(" | ", "p_name", F.format_string("%.2f", "p_retailprice")).alias("line"))
    t = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return t.select(F.col("p_brand").alias("table_id"), F.concat(F.lit("Parts of "), F.col("p_brand")).alias("caption"), F.col("p_type").alias("section"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("content"))


@query(f"SELECT table_id, caption, section, content FROM ({PARTS})")
def table_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return price_tables(spark, sf)


@query(f"SELECT table_id, caption, section, substr(content, 1, 2000) AS content FROM ({PARTS}) WHERE lower(content) LIKE '%widget%' OR lower(caption) LIKE '%brand#1%' ORDER BY table_id, section LIMIT 5")
def table_lookup(spark: SparkSession, sf: str) -> DataFrame:
    hit = X.any_term(["content"], ["widget"]) | X.any_term(["caption"], ["brand#1"])
    return price_tables(spark, sf).where(hit).orderBy("table_id", "section").limit(5).withColumn("content", F.substring("content", 1, 2000))


@query(r"""SELECT doc_id, regexp_extract_all(content, '(?im)^(item\s+\d{1,2}[a-z]?)[\s.\-–—:]+', 1)[1] AS first_heading, CAST(len(regexp_extract_all(content, '(?im)^(item\s+\d{1,2}[a-z]?)[\s.\-–—:]+', 1)) AS BIGINT) AS n_headings FROM heading_doc""")
def section_headings(spark: SparkSession, sf: str) -> DataFrame:
    heads = F.regexp_extract_all("content", F.lit(r"(?im)^(item\s+\d{1,2}[a-z]?)[\s.\-–—:]+"), F.lit(1))
    return fx.headed(spark, sf).select("doc_id", F.get(heads, F.lit(0)).alias("first_heading"), F.size(heads).cast("long").alias("n_headings"))


@query("""WITH e AS (SELECT name AS source_id, 'Chunk' AS granularity, 0.9 AS score, fact_seq * 10 + fact_sub AS seq FROM fact UNION ALL SELECT id, 'Entity', 0.65, 1 FROM entity UNION ALL SELECT name, 'Chunk', 0.8, fact_seq FROM fact)
SELECT source_id, granularity, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source_id, granularity ORDER BY score DESC, seq) AS r FROM e) WHERE r = 1""")
def merge_evidence(spark: SparkSession, sf: str) -> DataFrame:
    f, e = fx.facts(spark, sf), fx.entities(spark, sf)
    row = lambda df, i, kind, s, seq: df.select(F.col(i).alias("source_id"), F.lit(kind).alias("granularity"), F.lit(s).alias("score"), seq.cast("long").alias("seq"))
    all_ = row(f, "name", "Chunk", 0.9, F.col("fact_seq") * 10 + F.col("fact_sub")).unionByName(row(e, "id", "Entity", 0.65, F.lit(1))).unionByName(row(f, "name", "Chunk", 0.8, F.col("fact_seq")))
    return all_.groupBy("source_id", "granularity").agg(F.max("score").alias("score"))


@query("""SELECT type, string_agg(id, ', ' ORDER BY id) AS ids FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY id) AS r FROM entity) WHERE r <= 5 GROUP BY type""")
def citation_topn(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entities(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy("id"))).where("r <= 5")
    return e.groupBy("type").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("ids"))


@query("SELECT id, CAST(CASE WHEN weight IS NULL THEN 0.6 WHEN weight > 1 THEN least(1, greatest(0, weight / 10)) ELSE least(1, greatest(0, weight)) END AS DOUBLE) AS confidence FROM (SELECT src || '>' || dst AS id, weight FROM edge)")
def relation_confidence(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("weight")
    c = F.when(w.isNull(), 0.6).when(w > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), w / 10))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), w)))
    return fx.edges(spark, sf).select(F.concat_ws(">", "src", "dst").alias("id"), c.alias("confidence"))


@query("SELECT file_name || ':' || context_ref AS id, CASE WHEN period_end IS NULL THEN name ELSE name || '@' || period_end END AS fact_id, format('{} ({}). {}. Retrieved from {}', file_name, left(period_end, 4), name, context_ref) AS apa FROM fact")
def citation_strings(spark: SparkSession, sf: str) -> DataFrame:
    f = fx.facts(spark, sf)
    fact_id = F.when(F.col("period_end").isNull(), F.col("name")).otherwise(F.concat_ws("@", "name", "period_end"))
    return f.select(F.concat_ws(":", "file_name", "context_ref").alias("id"), fact_id.alias("fact_id"), F.format_string("%s (%s). %s. Retrieved from %s", "file_name", F.substring("period_end", 1, 4), "name", "context_ref").alias("apa"))
