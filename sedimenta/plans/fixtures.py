"""The driver's tables as a document graph: facts, documents, chunks, entities, relations and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.text import tokens
from sedimenta.operators.chunks import fixed_windows
from sedimenta.operators.lexical import in_two_or_more, term_counts
from sedimenta.operators.text_index import TextIndex
from sedimenta.operators.vector import similar_links, similar_pairs
from sedimenta.session import exists, scratch_dir, settle, stamp, table


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric facts of filings: one for each line item, filed by the order's customer."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    flag = F.when(F.col("l_returnflag") == "A", "Revenues").when(F.col("l_returnflag") == "R", "SalesReturns").otherwise("OrderBacklog")
    form = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "3", "5"), "_10k.htm").otherwise("_10q.htm")
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.concat(F.lit("us-gaap:"), flag, F.when(F.col("l_linestatus") == "O", "Open").otherwise("Filled")).alias("name"),
            F.col("l_extendedprice").alias("value"),
            F.lit("USD").alias("unit"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("period_end"),
            F.concat(F.lit("c-"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"), F.when(F.col("l_linenumber") % 3 == 0, "_YTD").otherwise("")).alias("context_ref"),
            F.col("c_mktsegment").alias("segment"),
            F.concat(F.lit("cust_"), F.col("o_custkey"), form).alias("file_name"),
            F.col("l_orderkey").alias("fact_seq"),
            F.col("l_linenumber").alias("fact_sub"),
        )
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt"))
    return table(spark, sf, "documents").select(name.alias("file_name"), "doc_id", "text", "lang", "source", "n_chars")


def part_id(key: str = "p_partkey") -> Column:
    return F.concat(F.lit("Part#"), F.lpad(F.col(key).cast("string"), 9, "0"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    row = lambda df, i, kind, *text: df.select(F.col(i).alias("id"), F.lit(kind).alias("type"), F.concat(*text).alias("description"))
    parts = [
        row(t("region"), "r_name", "Region", F.lit("region "), F.col("r_regionkey")),
        row(t("nation"), "n_name", "Geography", F.lit("nation in region "), F.col("n_regionkey")),
        row(t("customer"), "c_name", "Company", F.lit("customer in segment "), F.col("c_mktsegment")),
        row(t("supplier"), "s_name", "Supplier", F.lit("supplier of nation "), F.col("s_nationkey")),
        row(t("part").select(part_id().alias("id"), "p_brand"), "id", "Part", F.lit("part of brand "), F.col("p_brand")),
        row(t("part").select("p_brand").distinct(), "p_brand", "Brand", F.lit("brand of parts")),
        row(t("customer").select("c_mktsegment").distinct(), "c_mktsegment", "BusinessSegment", F.lit("market segment")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    nation = t("nation")
    rel = lambda df, a, b, kind, w=F.lit(1.0): df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("type"), w.cast("double").alias("weight"))
    owns = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    a, b = nation.alias("a"), nation.alias("b")
    ring = a.join(b, (F.col("b.n_nationkey") == (F.col("a.n_nationkey") * 7 + 3) % 25) & (F.col("a.n_nationkey") != F.col("b.n_nationkey")))
    return (
        rel(nation.join(t("region"), nation.n_regionkey == F.col("r_regionkey")), "n_name", "r_name", "SEGMENT_OF")
        .unionByName(rel(ring.select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y")), "x", "y", "TRADES_WITH"))
        .unionByName(rel(t("customer").join(nation, F.col("c_nationkey") == nation.n_nationkey), "c_name", "n_name", "OPERATES_IN"))
        .unionByName(rel(t("supplier").join(nation, F.col("s_nationkey") == nation.n_nationkey), "s_name", "n_name", "OPERATES_IN"))
        .unionByName(rel(t("customer"), "c_name", "c_mktsegment", "IN_SEGMENT"))
        .unionByName(rel(owns.withColumn("part", part_id("l_partkey")), "s_name", "part", "OWNS", F.col("n")))
        .unionByName(rel(t("part").withColumn("part", part_id()), "part", "p_brand", "OF_BRAND"))
    )


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """``id``, ``vec_id`` of the companies and suppliers that have a vector, the one of their number."""
    of = lambda n, key, name: table(spark, sf, n).select(F.col(name).alias("id"), F.col(key).alias("vec_id"))
    both = of("customer", "c_custkey", "c_name").unionByName(of("supplier", "s_suppkey", "s_name"))
    return both.join(table(spark, sf, "embeddings").select("vec_id"), "vec_id", "left_semi").select("id", "vec_id")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_windows(documents(spark, sf).withColumn("tokens", tokens("text")))


def chunk_terms(spark: SparkSession, sf: str) -> DataFrame:
    """``id`` (of the chunk), ``file_name``, ``doc_id``, ``position``, ``terms``: its lower-case words with their counts."""
    words = F.transform(F.filter("tokens", lambda t: t.rlike(r"[\p{L}\p{N}_]")), F.lower)
    return chunks(spark, sf).select("id", "file_name", "doc_id", "position", term_counts(words).alias("terms"))


def terms(spark: SparkSession, sf: str) -> DataFrame:
    """``chunk_id``, ``file_name``, ``doc_id``, ``position``, ``term``, ``tf`` of every chunk."""
    return chunk_terms(spark, sf).select(F.col("id").alias("chunk_id"), "file_name", "doc_id", "position", F.inline("terms"))


def index(spark: SparkSession, sf: str) -> TextIndex:
    """The stored index of all chunks' terms; the first call over a table builds it in the shared folder, later ones read it."""
    ix = TextIndex(spark, f"{scratch_dir(spark).rstrip('/')}/lexical-index-{stamp(spark, sf, 'documents')}", ("file_name", "doc_id"))
    ix.append_texts(chunk_terms(spark, sf), "documents")
    return ix


def stored_terms(spark: SparkSession, sf: str) -> DataFrame:
    """``no`` (a number of its own), ``id``, ``file_name``, ``doc_id`` and the array ``words`` of every chunk; the first call over a table writes it to the shared folder, later ones read it."""
    path = f"{scratch_dir(spark).rstrip('/')}/chunk-terms-{stamp(spark, sf, 'documents')}"
    if not exists(spark, f"{path}/_SUCCESS"):
        words = F.array_distinct(F.filter(F.transform("tokens", F.lower), lambda t: t.rlike(r"[\p{L}\p{N}_]")))
        t = chunks(spark, sf).select(F.monotonically_increasing_id().alias("no"), "id", "file_name", "doc_id", words.alias("words"))
        t.write.mode("overwrite").parquet(path, compression="zstd")  # written, so numbers stay
    return spark.read.parquet(path)


def long_words() -> Column:
    return F.filter("words", lambda w: F.char_length(w) >= 6).alias("words")


def long_word_sets(spark: SparkSession, sf: str) -> DataFrame:
    """``words``: the terms of six characters or more of every chunk. Chunks of one id (a document that is there twice) are one, with all their words and repeats."""
    t = stored_terms(spark, sf).select("id", long_words())
    if t.groupBy("id").count().where("count > 1").isEmpty():
        return t.select("words")
    return settle(t.groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words")).select("words"), "words", "zstd")


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """``chunk_id``, ``file_name``, ``entity_id``: terms of six characters or more that are in two chunks or more."""
    return in_two_or_more(stored_terms(spark, sf).select("no", F.col("id").alias("chunk_id"), "file_name", long_words())).select("chunk_id", "file_name", F.explode("words").alias("entity_id"))


def similar(spark: SparkSession, sf: str, cutoff: float = 0.38) -> DataFrame:
    """SIMILAR links: pairs of vectors whose cosine, to six places, reaches the cutoff."""
    return similar_pairs(table(spark, sf, "embeddings"), cutoff)


def similar_graph(spark: SparkSession, sf: str, cutoff: float = 0.38) -> tuple[DataFrame, DataFrame]:
    """Links that connect what SIMILAR links do, and ``node``, ``degree``: their number at each vector."""
    return similar_links(table(spark, sf, "embeddings"), cutoff)


def headed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the form's name and two item headings put in."""
    nl = F.lit("\n")
    content = F.concat(F.lit("Form 10-K"), nl, F.lit("Item 1A. Risk factors"), nl, F.col("text"), nl, F.lit("Item "), F.col("doc_id") % 16, F.lit(". Section of "), F.col("source"), nl, F.col("text"))
    return documents(spark, sf).select("doc_id", "file_name", content.alias("content"))
