"""The driver's tables as a document graph, in SQL: what fixtures.py derives with DataFrames."""

from __future__ import annotations

import re

VIEWS = {
    "fact": """
        SELECT 'us-gaap:' || CASE l_returnflag WHEN 'A' THEN 'Revenues' WHEN 'R' THEN 'SalesReturns' ELSE 'OrderBacklog' END
                 || CASE l_linestatus WHEN 'O' THEN 'Open' ELSE 'Filled' END AS name,
               l_extendedprice AS value, 'USD' AS unit, strftime(l_shipdate, '%Y-%m-%d') AS period_end,
               'c-' || l_orderkey || '-' || l_linenumber || CASE WHEN l_linenumber % 3 = 0 THEN '_YTD' ELSE '' END AS context_ref,
               c_mktsegment AS segment,
               'cust_' || o_custkey || CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '3', '5') THEN '_10k.htm' ELSE '_10q.htm' END AS file_name,
               l_orderkey AS fact_seq, l_linenumber AS fact_sub
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "doc": "SELECT source || '_' || lang || '_' || doc_id || '.txt' AS file_name, doc_id, text, lang, source, n_chars FROM documents",
    "entity": """
        SELECT r_name AS id, 'Region' AS type, 'region ' || r_regionkey AS description FROM region
        UNION ALL SELECT n_name, 'Geography', 'nation in region ' || n_regionkey FROM nation
        UNION ALL SELECT c_name, 'Company', 'customer in segment ' || c_mktsegment FROM customer
        UNION ALL SELECT s_name, 'Supplier', 'supplier of nation ' || s_nationkey FROM supplier
        UNION ALL SELECT 'Part#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), 'Part', 'part of brand ' || p_brand FROM part
        UNION ALL SELECT DISTINCT p_brand, 'Brand', 'brand of parts' FROM part
        UNION ALL SELECT DISTINCT c_mktsegment, 'BusinessSegment', 'market segment' FROM customer""",
    "edge": """
        SELECT n_name AS src, r_name AS dst, 'SEGMENT_OF' AS type, CAST(1 AS DOUBLE) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT c_name, n_name, 'OPERATES_IN', CAST(1 AS DOUBLE) FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT s_name, n_name, 'OPERATES_IN', CAST(1 AS DOUBLE) FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT c_name, c_mktsegment, 'IN_SEGMENT', CAST(1 AS DOUBLE) FROM customer
        UNION ALL SELECT s_name, 'Part#' || lpad(CAST(l_partkey AS VARCHAR), 9, '0'), 'OWNS', CAST(count(*) AS DOUBLE) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, l_partkey
        UNION ALL SELECT 'Part#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), p_brand, 'OF_BRAND', CAST(1 AS DOUBLE) FROM part
        UNION ALL SELECT a.n_name, b.n_name, 'TRADES_WITH', CAST(1 AS DOUBLE) FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7 + 3) % 25 AND a.n_nationkey <> b.n_nationkey""",
    "geo": "SELECT src, dst, type FROM edge",
    "aligned": """
        SELECT c_name AS id, c_custkey AS vec_id FROM customer WHERE c_custkey IN (SELECT vec_id FROM embeddings)
        UNION ALL SELECT s_name, s_suppkey FROM supplier WHERE s_suppkey IN (SELECT vec_id FROM embeddings)""",
    "token": r"""
        SELECT file_name, doc_id, CAST(i AS BIGINT) AS pos, toks[i] AS token
        FROM (SELECT file_name, doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS toks FROM doc) , LATERAL (SELECT unnest(range(1, len(toks) + 1)) AS i)""",
    "chunk": r"""
        SELECT sha1(file_name || '_' || position) AS id, file_name, doc_id, position, tokens, CAST(len(tokens) AS BIGINT) AS n_tokens,
               array_to_string(tokens, ' ') AS text
        FROM (SELECT file_name, doc_id, CAST(w + 1 AS BIGINT) AS position, toks[w * 400 + 1 : w * 400 + 500] AS tokens
              FROM (SELECT file_name, doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS toks FROM doc),
                   LATERAL (SELECT unnest(range(0, greatest(1, CAST(ceil((len(toks) - 100) / 400.0) AS BIGINT)))) AS w)
              WHERE len(toks) > 0)""",
    "term": r"""
        SELECT id AS chunk_id, file_name, position, lower(t) AS term, count(*) AS tf
        FROM (SELECT id, file_name, position, unnest(tokens) AS t FROM chunk) WHERE regexp_matches(t, '[\p{L}\p{N}_]') GROUP BY ALL""",
    "mention": """
        SELECT chunk_id, file_name, term AS entity_id FROM term
        WHERE length(term) >= 6 AND term IN (SELECT term FROM term GROUP BY term HAVING count(*) >= 2)""",
    "alike": """
        SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
        FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
        WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.38""",
    "heading_doc": """
        SELECT doc_id, file_name, 'Form 10-K' || chr(10) || 'Item 1A. Risk factors' || chr(10) || text || chr(10) || 'Item ' || (doc_id % 16) || '. Section of ' || source || chr(10) || text AS content FROM doc""",
}


def with_views(sql: str) -> str:
    """The statement with the views that it names, and those that these name, as common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(VIEWS[name])
                need.append(name)

    visit(sql)
    if not need:
        return sql
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if re.match(r"WITH RECURSIVE\s", body):
        return f"WITH RECURSIVE {views}, {body[len('WITH RECURSIVE') :]}"
    if re.match(r"WITH\s", body):
        return f"WITH {views}, {body[4:]}"
    return f"WITH {views} {body}"
