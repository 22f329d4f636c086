"""Queries over filings as markup: contexts, units, facts, tables, sections; and stand-in models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.config import DEFAULTS
from sedimenta.functions import providers as P
from sedimenta.operators import community as M
from sedimenta.operators.sections import ITEMS, sections
from sedimenta.plans import fixtures as fx
from sedimenta.plans.registry import query
from sedimenta.session import table
from sedimenta.sources import html as H

PRICE = r"regexp_replace(printf('%.2f', o_totalprice), '(\d)(?=(\d{3})+\.)', '\1,', 'g')"


def filings(spark: SparkSession, sf: str) -> DataFrame:
    """A filing of each customer: a context and a fact for each order, and a table of them."""
    o = table(spark, sf, "orders")
    text = F.format_number("o_totalprice", 2)
    negative = F.col("o_orderstatus") == "F"
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    key = F.col("o_orderkey").cast("string")
    ctx = F.concat(F.lit('<xbrli:context id="c'), key, F.lit('"><xbrli:entity><xbrli:identifier>'), F.col("o_custkey"), F.lit('</xbrli:identifier><xbrli:segment><xbrldi:explicitMember dimension="status">'), F.col("o_orderstatus"), F.lit("</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>"), day, F.lit("</xbrli:instant></xbrli:period></xbrli:context>"))
    sign = F.when(negative, F.lit(' sign="-"')).otherwise(F.lit(""))
    fact = F.concat(F.lit('<p>Order '), key, F.lit(' of <ix:nonFraction name="us-gaap:Orders" contextRef="c'), key, F.lit('" unitRef="u1" scale="3" decimals="2"'), sign, F.lit(">"), text, F.lit("</ix:nonFraction> in all.</p>"))
    row = F.concat(F.lit("<tr><td>"), key, F.lit("</td><td>"), day, F.lit("</td><td>"), text, F.lit("</td></tr>"))
    one = F.struct("o_orderkey", ctx.alias("ctx"), fact.alias("fact"), row.alias("row"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("x"))
    part = lambda name: F.array_join(F.transform("x", lambda s: s[name]), "")
    page = F.concat(F.lit("<html><body><ix:header>"), part("ctx"), F.lit('<xbrli:unit id="u1"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit></ix:header><h1>Orders</h1>'), part("fact"), F.lit("<table><caption>All orders</caption><tr><th>Key</th><th>Date</th><th>Price</th></tr>"), part("row"), F.lit('</table><table role="presentation"><tr><td>page</td></tr></table></body></html>'))
    return g.select(F.col("o_custkey").alias("doc_id"), page.alias("html"))


@query("SELECT o_custkey AS doc_id, 'c' || o_orderkey AS context_ref, CAST(o_custkey AS VARCHAR) AS entity, 'status=' || o_orderstatus AS segment, strftime(o_orderdate, '%Y-%m-%d') AS period_end FROM orders")
def xbrl_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return H.contexts(filings(spark, sf)).select("doc_id", "context_ref", "entity", "segment", "period_end")


@query("SELECT DISTINCT o_custkey AS doc_id, 'u1' AS unit_ref, 'iso4217:USD' AS measure FROM orders")
def xbrl_units(spark: SparkSession, sf: str) -> DataFrame:
    return H.units(filings(spark, sf))


@query("""SELECT o_custkey AS doc_id, 'us-gaap:Orders' AS name, round(CAST(printf('%.2f', o_totalprice) AS DOUBLE) * 1000 * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END, 2) AS value, 'USD' AS unit, strftime(o_orderdate, '%Y-%m-%d') AS period_end, 'c' || o_orderkey AS context_ref, CAST(3 AS INTEGER) AS scale FROM orders""")
def xbrl_facts(spark: SparkSession, sf: str) -> DataFrame:
    n = H.filing_facts(filings(spark, sf))
    return n.select("doc_id", "name", F.round("value", 2).alias("value"), "unit", "period_end", "context_ref", "scale")


@query("SELECT DISTINCT o_custkey AS doc_id, unnest(['table_1', 'table_2']) AS table_id, unnest(['DATA', 'LAYOUT']) AS verdict FROM orders WHERE (SELECT true)")
def table_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return H.classified(H.tables(filings(spark, sf))).select("doc_id", "table_id", "verdict")


@query("SELECT o_custkey AS doc_id, 'Table: All orders' || chr(10) || 'Key | Date | Price' || chr(10) || string_agg(o_orderkey || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' | ' || format('{:,.2f}', o_totalprice), chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey")
def table_texts(spark: SparkSession, sf: str) -> DataFrame:
    t = H.classified(H.tables(filings(spark, sf))).where("verdict = 'DATA'")
    return t.select("doc_id", H.table_text().alias("text"))


@query("SELECT o_custkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS row_header, 'Date' AS column_header, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders")
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    t = H.classified(H.tables(filings(spark, sf))).where("verdict = 'DATA'")
    return H.headed_cells(t).where("column_header = 'Date'").select("doc_id", "row_header", "column_header", "value")


@query()
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    t = H.stripped(table(spark, sf, "pages"), "page_id")
    return t.select(F.col("doc_id").alias("page_id"), F.md5("text").alias("text_md5"), F.char_length("text").alias("n"))


#: Sections of ``heading_doc``, in SQL.
SECTIONS = rf"""l AS (SELECT doc_id, content, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM heading_doc),
o AS (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, regexp_matches(x, '(?i)^item\s+\d{{1,2}}[a-z]?(?:\.\d{{2}})?[\s.\-–—:]+') AS h FROM l),
n AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
g AS (SELECT doc_id, k, min(off) AS off, regexp_replace(string_agg(x, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS body, arg_min(x, i) AS head, any_value(length(content)) AS total FROM n WHERE k > 0 GROUP BY doc_id, k),
e AS (SELECT *, upper(regexp_extract(head, '(?i)^item\s+(\d{{1,2}}[a-z]?)', 1)) AS item, coalesce(lead(off) OVER (PARTITION BY doc_id ORDER BY k), total) AS stop FROM g),
s AS (SELECT doc_id, item, trim(regexp_extract(head, '(?i)^item\s+\d{{1,2}}[a-z]?(?:\.\d{{2}})?[\s.\-–—:]+(.*)$', 1)) AS title, CAST(off AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", body AS content
FROM e WHERE item IN ({', '.join(repr(x) for x in ITEMS['10-K'])}) AND length(body) >= {DEFAULTS.section_min_length})"""


@query(f'WITH {SECTIONS} SELECT doc_id, item, title, start, "end", md5(content) AS content_md5 FROM s')
def filing_sections(spark: SparkSession, sf: str) -> DataFrame:
    return sections(fx.headed(spark, sf)).select("doc_id", "item", "title", "start", "end", F.md5("content").alias("content_md5"))


@query()
def leiden_communities(spark: SparkSession, sf: str) -> DataFrame:
    return M.leiden(fx.edges(spark, sf))


@query("""WITH e AS (SELECT left(src, 4) AS a, left(dst, 4) AS b, weight AS w FROM edge), t AS (SELECT sum(w) AS m FROM e),
d AS (SELECT c, sum(w) AS k FROM (SELECT a AS c, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY c)
SELECT CAST(0 AS INTEGER) AS level, CAST((SELECT count(*) FROM d) AS BIGINT) AS communities, round((SELECT sum(w) FROM e WHERE a = b) / m - (SELECT sum(k * k) FROM d) / (4 * m * m), 9) AS modularity FROM t""")
def partition_modularity(spark: SparkSession, sf: str) -> DataFrame:
    """Modularity of the partition by the first four letters of names: what Leiden's levels are measured with."""
    e = fx.edges(spark, sf)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return M.modularity(e, nodes.select("node", F.lit(0).alias("level"), F.substring("node", 1, 4).alias("community")))


@query()
def sllpa_communities(spark: SparkSession, sf: str) -> DataFrame:
    return M.overlapping(fx.edges(spark, sf))


@query()
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.transform(P.hashing_embedder(F.col("text")), lambda x: F.round(x, 6)).cast("string").alias("vector"))


@query("""SELECT doc_id, CASE WHEN length(text) < 10 THEN 'No summary available' ELSE substr(text, 1, 500) END AS summary FROM documents""")
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", P.head_summary(F.col("text")).alias("summary"))


@query(r"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS t FROM documents), q AS (SELECT ['the', 'nation', 'of', 'schlich'] AS q)
SELECT doc_id, round(len(list_intersect(t, q)) / CAST(len(list_distinct(list_concat(t, q))) AS DOUBLE), 6) AS score FROM t, q ORDER BY score DESC, doc_id LIMIT 10""")
def rerank_overlap(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").select("doc_id", F.round(P.overlap_score(F.col("text"), "the nation of schlich"), 6).alias("score"))
    return s.orderBy(F.desc("score"), "doc_id").limit(10)


@query()
def judged_answers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    q = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("context"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "t"]).select("conv_id", "t", P.judge(F.col("answer"), F.col("context")).alias("verdict"), P.passes(P.judge(F.col("answer"), F.col("context"))).alias("passes"))


@query()
def masked_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", P.mask_names(F.col("text")).alias("masked"))
