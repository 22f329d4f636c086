"""The stored index against BM25 over all postings, appends against a rebuild, and what a query reads."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import lexical as L
from sedimenta.operators import text_index as TI

SCHEMA = "chunk_id string, doc_id long, term string, tf long"


def made(seed=1, n=900):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(n):
        lang = rng.choice([0, 30])
        for t in {words[min(29, int(rng.expovariate(0.2))) + lang] for _ in range(rng.choice([1, 3, 8, 20]))}:
            rows.append((f"c{d:04d}", d // 3, t, rng.choice([1, 1, 1, 2, 5])))
    return rows


@pytest.fixture(scope="module")
def postings(spark):
    return spark.createDataFrame(made(), SCHEMA).cache()


def fresh(spark, **kw):
    return TI.TextIndex(spark, tempfile.mkdtemp(prefix="spark-") + "/index", ("doc_id",), **kw)


@pytest.fixture(scope="module")
def index(spark, postings):
    ix = fresh(spark, buckets=8)
    ix.append(postings, "all")
    return ix


def plain(df, key="id"):
    return [(r[key], r["score"], r["rank"]) for r in df.orderBy("rank").collect()]


QUERIES = [["w0"], ["w0", "w1", "w30"], ["w5", "w28", "w59", "nowhere"], ["w0", "w0", "w31"], ["w29"]]


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("k", [1, 7, 2000])
def test_same_as_all_postings(index, postings, query, k):
    want = L.top(L.bm25(postings, query), k).withColumnRenamed("chunk_id", "id")
    assert plain(index.search(query, k)) == plain(want)


def test_best_of_each_document(index, postings):
    doc = postings.select("chunk_id", "doc_id").distinct()
    for query in QUERIES:
        best = L.bm25(postings, query).join(doc, "chunk_id").groupBy("doc_id").agg(F.max("score").alias("score"))
        assert plain(index.search(query, 9, per="doc_id"), "doc_id") == plain(L.top(best, 9, "doc_id"), "doc_id")


def test_append_equals_rebuild(spark, index, postings):
    parts = fresh(spark, buckets=8)
    for i in range(3):
        parts.append(postings.where(F.crc32(F.col("chunk_id").cast("binary")) % 3 == i), str(i))
    assert parts.segments() == ["0", "1", "2"]
    for query in QUERIES:
        assert plain(parts.search(query, 10)) == plain(index.search(query, 10))
    key = lambda ix: sorted(map(tuple, ix.postings().collect()))
    assert key(parts) == key(index)


def test_a_repeated_append_changes_nothing(spark, index, postings):
    before = sorted(map(tuple, index.postings().collect()))
    index.append(postings, "all")
    index.append(postings, "again")  # every text is known
    assert sorted(map(tuple, index.postings().collect())) == before and index.segments() == ["again", "all"]
    assert plain(index.search(["w0"], 5)) == plain(L.top(L.bm25(postings, ["w0"]), 5).withColumnRenamed("chunk_id", "id"))


def test_a_segment_cut_off_is_not_read(spark, postings):
    """Postings without their stats are what a lost driver leaves; they count for nothing and are written anew."""
    ix = fresh(spark)
    ix.append(postings.where("doc_id < 10"), "a")
    spark.read.parquet(f"{ix.path}/postings/segment=s_a").write.partitionBy("bucket").parquet(f"{ix.path}/postings/segment=s_b")
    small = postings.where("doc_id < 10")
    assert plain(ix.search(["w0", "w30"], 5)) == plain(L.top(L.bm25(small, ["w0", "w30"]), 5).withColumnRenamed("chunk_id", "id"))
    ix.append(postings.where("doc_id between 10 and 20"), "b")
    both = postings.where("doc_id <= 20")
    assert plain(ix.search(["w0", "w30"], 5)) == plain(L.top(L.bm25(both, ["w0", "w30"]), 5).withColumnRenamed("chunk_id", "id"))


def test_reads_its_buckets_and_skips_bands(spark, monkeypatch):
    """A query opens only the folders of its terms, and scores only bands whose bound can reach the best."""
    monkeypatch.setattr(TI, "BAND", 16)
    rows = [(f"c{i:05d}", i, t, 1 + (i % 97 == 0) * (t == "hot") * 30 + (i % 5)) for i in range(3000) for t in ("hot", f"own{i}")]
    ix = fresh(spark, buckets=16)
    ix.append(spark.createDataFrame(rows, SCHEMA), "all")
    files = ix.blocks(["hot"]).inputFiles()
    assert files and {f.split("bucket=")[1].split("/")[0] for f in files} == {str(__import__("zlib").crc32(b"hot") % 16)}
    blocks, part, bound = ix._bounds(["hot"], 1.2, 0.75)
    best = plain(ix.search(["hot"], 5))
    assert best == plain(L.top(L.bm25(spark.createDataFrame(rows, SCHEMA), ["hot"]), 5).withColumnRenamed("chunk_id", "id"))
    assert bound.where(F.col("bound") + TI.ROUNDING >= best[-1][1]).count() < 0.5 * bound.count()
    assert blocks.agg(F.max("n")).first()[0] < 100, "a frequent term is many blocks"
    scored = ix._scores(blocks, part).join(ix.opened(blocks).select("id"), "id")
    assert scored.agg(F.max("score")).first()[0] <= bound.agg(F.max("bound")).first()[0] + TI.ROUNDING


def test_odd_rows_and_empty(spark):
    ix = fresh(spark)
    assert ix.search(["x"], 3).count() == 0 and ix.postings().count() == 0 and ix.segments() == []
    ix.append(spark.createDataFrame([], SCHEMA), "none")
    assert ix.search(["x"], 3).count() == 0
    rows = [("a", 1, "x", 1), ("a", 1, "x", 2), (None, 1, "x", 1), ("b", None, "x", 3), ("c", 2, None, 1), ("d", 2, "y", 0), ("e", 2, "", 4), ("f", 3, "ü😀", 1)]
    ix.append(spark.createDataFrame(rows, SCHEMA).withColumn("band", F.lit("z")).withColumn("dl", F.lit("z")), "odd")
    assert [r[:2] for r in plain(ix.search(["x"], 5))] == [("a", plain(ix.search(["x"], 1))[0][1]), ("b", plain(ix.search(["x"], 1))[0][1])], "equal scores: the smaller id first"
    assert [r[0] for r in plain(ix.search(["ü😀"], 5))] == ["f"] and [r[0] for r in plain(ix.search([""], 5))] == ["e"] and ix.search([], 5).count() == 0
