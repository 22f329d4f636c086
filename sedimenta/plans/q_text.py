"""Queries over raw text: cleaning, form types, masking, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.plans import fixtures as fx
from sedimenta.plans.registry import query
from sedimenta.session import table

MASK = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '[PII:EMAIL]', 'gi'),
  '(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}', '[PII:PHONE]', 'gi'), '\b\d{3}-\d{2}-\d{4}\b', '[PII:SSN]', 'gi'), '\b(?:\d{4}[-\s]?){3}\d{4}\b', '[PII:CREDIT_CARD]', 'gi')"""


@query(f"SELECT doc_id, md5({MASK}) AS masked_md5 FROM documents")
def pii_mask_basic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.mask_basic(F.col("text"))).alias("masked_md5"))


@query(f"SELECT doc_id, contains({MASK}, '[PII:EMAIL]') AS email, contains({MASK}, '[PII:PHONE]') AS phone FROM documents")
def pii_types(spark: SparkSession, sf: str) -> DataFrame:
    found = T.types_basic(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_contains(found, "email").alias("email"), F.array_contains(found, "phone").alias("phone"))


def _replaced(text: str, rules: list[tuple[str, str, str]]) -> str:
    """SQL that applies (pattern, replacement, flags) in turn."""
    quote = lambda x: x.replace("'", "''")
    for pattern, put, flags in rules:
        text = f"regexp_replace({text}, '{quote(pattern)}', '{quote(put)}', '{flags}')"
    return text


# The supplemental patterns as the other engine writes them, without looking back.
SUPPLEMENT = [
    (r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "[PII:US_SSN]", "gi"), (r"(^|[^_])SSN[^\d\[]{0,20}\d{4}\b", r"\1[PII:US_SSN]", "gi"), (r"social\s+security[^\d\[]{0,20}\d{4}\b", "[PII:US_SSN]", "gi"),
    (r"(?:routing|ABA)[^\d]{0,15}\d{9}\b", "[PII:FINANCIAL_ACCOUNT_NUMBER]", "gi"), (r"(?:account|acct)\.?\s*(?:#|number|no\.?)?[^\w]{0,5}\d{8,17}\b", "[PII:FINANCIAL_ACCOUNT_NUMBER]", "gi"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", "[PII:FINANCIAL_ACCOUNT_NUMBER]", "g"), (r"\b\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}\b", "[PII:CREDIT_CARD_NUMBER]", "gi"),
    (r"(?:\+1[-\s]\d{3}[-\s]\d{3}[-\s]\d{4}|\(\d{3}\)\s*\d{3}[-.\s]\d{4}|\b\d{3}-\d{3}-\d{4}\b)", "[PII:PHONE_NUMBER]", "gi"),
    (r"\b\d+\s+(?:(?:[NSEW]\.?|(?i:north|south|east|west))\s+)?(?:\w+\s+){1,5}(?i:boulevard|parkway|highway|terrace|street|avenue|circle|plaza|drive|court|place|trail|road|lane|loop|way|blvd|pkwy|hwy|ter|ave|cir|trl|dr|ct|pl|st|rd|ln)\b\.?(?:\W{1,3}[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)?(?:\W{1,3}[A-Z]{2}\b)?(?:\W{1,3}\d{5}(?:-\d{4})?)?", "[PII:STREET_ADDRESS]", "g"),
    (r"(?:born|birth(?:day|date)?|DOB|date\s+of\s+birth)[^\d]{0,20}(?:\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}[/.-]\d{1,2}[/.-]\d{1,2}|(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},?\s+\d{4})", "[PII:DATE_OF_BIRTH]", "gi"),
]


@query(f"SELECT doc_id, md5({_replaced('text', SUPPLEMENT)}) AS masked_md5 FROM documents")
def pii_mask_supplement(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.mask_supplement(F.col("text"))).alias("masked_md5"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS clean_md5 FROM documents")
def normalize_ws(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(F.trim(T.collapse_space(T.line_endings(F.col("text"))))).alias("clean_md5"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS x FROM documents)
SELECT doc_id, md5(coalesce(string_agg(CASE WHEN trim(x, ' ') = '' THEN x ELSE regexp_replace(regexp_replace(x, '_{3,}', ' ', 'g'), '[-=]{3,}', ' ', 'g') END, chr(10) ORDER BY i) FILTER (NOT regexp_matches(trim(x, ' '), '^[-_—–=]{3,}$')), '')) AS clean_md5 FROM l GROUP BY doc_id""")
def separator_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.without_separators(F.col("text"))).alias("clean_md5"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s]+', '', 'g'), 'sec\.gov/[^\s]+', '', 'gi'), '\.{4,}', ' ', 'g')) AS clean_md5 FROM documents")
def url_removal(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("text")
    for pattern, put in ((r"https?://[^\s]+", ""), (r"(?i)sec\.gov/[^\s]+", ""), (r"\.{4,}", " ")):
        x = F.regexp_replace(x, pattern, put)
    return table(spark, sf, "documents").select("doc_id", F.md5(x).alias("clean_md5"))


HEAD = r"regexp_replace(base, '(?is)<SEC-HEADER>.*?</SEC-HEADER>', '', 'g')"
PDF = _replaced("base", [(pattern, put.replace("$1", r"\1"), "g") for pattern, put in T.PDF_TRACES])
HTML = _replaced(HEAD, [(pattern, "", "g") for pattern in T.XBRL_TRACES])


@query(rf"""WITH d AS (SELECT doc_id, doc_id % 3 AS k, replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), '') AS base FROM documents),
l AS (SELECT doc_id, generate_subscripts(string_split({HEAD}, chr(10)), 1) AS i, unnest(string_split({HEAD}, chr(10))) AS x FROM d WHERE k = 2),
t AS (SELECT doc_id, coalesce(string_agg(CASE WHEN trim(x, ' ') = '' THEN x ELSE regexp_replace(regexp_replace(x, '_{{3,}}', ' ', 'g'), '[-=]{{3,}}', ' ', 'g') END, chr(10) ORDER BY i) FILTER (NOT regexp_matches(trim(x, ' '), '^[-_—–=]{{3,}}$')), '') AS c FROM l GROUP BY doc_id),
c AS (SELECT doc_id, CASE k WHEN 0 THEN {PDF} WHEN 1 THEN {HTML} ELSE t.c END AS c FROM d LEFT JOIN t USING (doc_id))
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(c, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean_md5 FROM c""")
def normalize_document(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("pdf"), F.lit("html"), F.lit("txt")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize(F.col("text"), kind)).alias("clean_md5"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(content, '(?i)\bform\s+(10-?k|10-?q|8-?k)\b') THEN '10-K' ELSE 'UNKNOWN' END AS form_type FROM heading_doc")
def form_type_detect(spark: SparkSession, sf: str) -> DataFrame:
    return fx.headed(spark, sf).select("doc_id", T.form_type(F.col("content")).alias("form_type"))


@query("""SELECT doc_id, CAST(length(text) AS BIGINT) AS length, length(text) > 5000 AS needs_splitting, CAST(len(string_split(text, chr(10) || chr(10))) AS BIGINT) AS paragraphs, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents""")
def text_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.char_length("text").cast("long").alias("length"), (F.char_length("text") > 5000).alias("needs_splitting"),
        F.size(F.split("text", "\n\n")).cast("long").alias("paragraphs"), F.size(F.split("text", "\n")).cast("long").alias("lines"),
    )


@query("SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.rough_token_count(F.col("text")).alias("tokens"))


@query("""SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS total, round(avg(length(text)), 6) AS average, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM documents GROUP BY lang""")
def file_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = F.char_length("text")
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("average"), F.count_distinct("source").alias("sources"))


@query("SELECT l_orderkey, l_linenumber, -l_extendedprice AS amount FROM lineitem")
def display_numbers(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("($"), F.col("l_extendedprice").cast("string"), F.lit(")*")).alias("shown"))
    return li.select("l_orderkey", "l_linenumber", T.display_number(F.col("shown")).alias("amount"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(trim(text, ' ')), '\\s+'), lambda x: NOT list_contains(['a','an','the','is','are','was','were','be','been','being','in','on','at','to','for','with','by','about','of','and','or'], x)) AS ws FROM conversations WHERE role = 'user')
SELECT conv_id, turn, array_to_string(list_filter(ws, lambda x: length(x) > 5)[1:3], ' ') AS high, array_to_string(list_filter(ws, lambda x: length(x) BETWEEN 3 AND 5)[1:5], ' ') AS low FROM w""")
def keyword_fallback(spark: SparkSession, sf: str) -> DataFrame:
    k = T.keywords(F.col("text"))
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(k["high"], " ").alias("high"), F.array_join(k["low"], " ").alias("low"))


@query(r"""SELECT conv_id, turn, regexp_replace(text, '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g') AS escaped FROM conversations""")
def query_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.escape_query(F.col("text")).alias("escaped"))


@query("""SELECT conv_id, turn, length(text) >= 20 AND NOT contains(lower(text), 'error') AND NOT contains(lower(text), 'sorry') AS valid FROM conversations WHERE role = 'assistant'""")
def answer_validation(spark: SparkSession, sf: str) -> DataFrame:
    t = F.lower("text")
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", ((F.char_length("text") >= 20) & ~t.contains("error") & ~t.contains("sorry")).alias("valid"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, coalesce(CAST(props->>'k' AS DOUBLE) / 100, 0.5) >= 0.7 AS passes FROM events")
def faithfulness_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select("event_id", k.alias("k"), (F.coalesce(k / 100, F.lit(0.5)) >= 0.7).alias("passes"))


@query("SELECT doc_id, octet_length(encode(text)) > 100000 AS skipped FROM documents")
def scan_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", (F.octet_length("text") > 100_000).alias("skipped"))


@query("SELECT doc_id, CASE WHEN length(text) >= 20 THEN left(text, 5) || '[DLP:REDACTED:NAME]' || substr(text, 11, 5) || '[DLP:REDACTED:ID]' || substr(text, 19) ELSE text END AS redacted FROM documents")
def span_redaction(spark: SparkSession, sf: str) -> DataFrame:
    s = F.array(F.struct(F.lit(5).alias("start"), F.lit(10).alias("end"), F.lit("NAME").alias("type")), F.struct(F.lit(15).alias("start"), F.lit(18).alias("end"), F.lit("ID").alias("type")))
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.when(F.char_length("text") >= 20, T.redact_spans(F.col("text"), s)).otherwise(F.col("text")).alias("redacted"))
