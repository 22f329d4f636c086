"""Section lookup, stored communities, suggested merges and the consistency report on small tables."""

from pyspark.sql import functions as F

from sedimenta.catalog import QUERIES
from sedimenta.operators import consistency as C
from sedimenta.operators import lexical as L
from sedimenta.operators import retrieve as V
from sedimenta.operators.lexical import in_two_or_more
from sedimenta.plans import fixtures as fx


def sections(spark, rows):
    return spark.createDataFrame(rows, "file_name string, item string, title string, content string, start int")


ROWS = [("acme_10k", "1A", "Risk", "debt " + "x" * 4000, 0), ("acme_10q", "1A", None, "Debt", 5), ("other", "7", "Debt", None, 0), ("other", "1A", "none", "none", 9), (None, "1A", "debt", "", 1)]


def test_sections_of_the_strictest_pass(spark):
    s = sections(spark, ROWS)
    got = lambda *a, **k: [(r["file_name"], r["pass"]) for r in V.find_sections(s, *a, **k).collect()]
    assert got(["DEBT"], ["Acme"], "10k") == [("acme_10k", 0)]
    assert got(["debt"], ["acme"], "8k") == [("acme_10k", 1), ("acme_10q", 1)]
    assert got(["debt"], ["nobody"], "8k", "mda") == [("other", 2)]
    assert got(["debt"], ["nobody"], "8k", "risk_factors") == [(None, 2), ("acme_10k", 2), ("acme_10q", 2)]
    assert got([]) == []
    assert got(["debt"], limit=1) == [("acme_10k", 0)]
    assert max(len(r["content"] or "") for r in V.find_sections(s, ["debt"]).collect()) == 3000
    assert V.find_sections(sections(spark, []), ["debt"]).count() == 0


def test_stored_community_and_its_fallback(spark):
    e = spark.createDataFrame([("a", "X"), ("b", None), ("c", "Y"), ("z", "Z")], "id string, type string")
    g = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("a", "z", "R")], "src string, dst string, type string")
    m = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "2"), ("c", "2"), (None, "1")], "id string, community string")
    rows = {tuple(r) for r in V.stored_community(e, m, g, "a").collect()}
    assert rows == {("node", "a", None, "Center"), ("node", "b", None, "Unknown"), ("link", "a", "b", "R")}
    near = {r["id"] for r in V.stored_community(e, m, g, "z", 1).where("kind = 'node'").collect()}
    assert near == {"z", "a"}


def test_merge_lists(spark):
    cases = {"[['a', 'b', 'a'], ['c', 'c'], []]": [["a", "b"]], "say ['x', \"it's\"] and ['p','q']": [["x", "it's"], ["p", "q"]], "none": [], "['open": [], "": [], None: []}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", V.merge_lists(F.col("t")).alias("g"))
    assert {r["t"]: r["g"] for r in df.collect()} == cases


def test_filled_graphs(spark):
    c = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    of = lambda *k: spark.createDataFrame([(x,) for x in k], "chunk_id string")
    assert sorted(r["id"] for r in V.filled_graphs(c, of("1", "1", None), of("3", "9")).collect()) == ["1", "3"]
    assert V.filled_graphs(c, of(), of()).count() == 0


def test_report_finds_and_mends(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    g = C.Graph(
        one([("f",), ("g",), ("h",)], "file_name string"),
        one([("f1", "f", 1, "x"), ("f2", "f", 2, None), ("f3", "f", 3, ""), ("g1", "g", 1, "y"), ("q1", "gone", 1, "")], "id string, file_name string, position long, text string"),
        one([("f", "f1"), ("gone", "q1")], "src string, dst string"),
        one([("f1", "f2"), ("f1", "q1")], "src string, dst string"),
        one([("a",), ("b",), ("lone",)], "id string"),
        one([("a", "b"), ("a", None)], "src string, dst string"),
    )
    got = {r["check"]: (r["n"], r["left"]) for r in C.report(g).collect()}
    assert got == {"orphan_entities": (1, 0), "dangling_chunks": (1, 0), "empty_chunks": (3, 0), "broken_document_links": (2, 1), "broken_chains": (1, 0)}
    m = C.repaired(g)
    assert {tuple(r) for r in m.following.collect()} == {("f1", "f2"), ("f2", "f3")}
    assert {tuple(r) for r in m.first.collect()} == {("f", "f1"), ("g", "g1")}
    assert C.checks(C.repaired(m)).agg(F.sum("n")).head()[0] == 1


def test_words_of_one_text_only_go(spark):
    rows = [(1, ["alpha", "beta", "own"]), (2, ["alpha", "beta"]), (3, ["alone", "single"]), (4, []), (5, ["beta"])]
    got = in_two_or_more(spark.createDataFrame(rows, "no long, words array<string>")).collect()
    assert {r.no: r.words for r in got} == {1: ["alpha", "beta"], 2: ["alpha", "beta"], 3: [], 4: [], 5: ["beta"]}


def test_mentions_and_one_question_build_no_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "scratch_dir", lambda s: str(tmp_path))
    monkeypatch.setattr(fx, "index", None)  # none of these may ask for it
    text = "The nation mentions that something; something elle with elle. "
    spark.createDataFrame([(i, text + "Unique%d" % i, "en", "src2", 60) for i in range(4)] + [(9, None, "en", "src2", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    m = QUERIES["mention_edges"](spark, str(tmp_path))
    assert sorted({r.dst for r in m.collect()}) == ["mentions", "nation", "something"] and m.count() == 12
    assert {r.id for r in QUERIES["entity_scope_semi"](spark, str(tmp_path)).collect()} == {"mentions", "nation", "something"}
    assert {(r.entity_id, r.refs) for r in QUERIES["delete_cascade"](spark, str(tmp_path)).collect()} == set()
    assert [r.id for r in QUERIES["hybrid_topk"](spark, str(tmp_path)).collect()] == [0, 7, 1]


def test_a_scan_scores_as_the_postings_do(spark):
    rows = [("a", 1, "x", 2), ("a", 1, "y", 1), ("b", 1, "x", 5), ("c", 2, "z", 3), ("d", 3, "x", 1), ("d", 3, "w", 9)]
    p = spark.createDataFrame(rows, "chunk_id string, doc_id long, term string, tf long")
    texts = p.groupBy("chunk_id", "doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    want = {r.chunk_id: r.score for r in L.bm25(p, ["x", "z", "none"]).collect()}
    got = [(r.doc_id, r.score, r["rank"]) for r in L.scan(texts, ["x", "z", "none"], 2, "doc_id").collect()]
    best = sorted(((max(want["a"], want["b"]), 1), (want["c"], 2), (want["d"], 3)), key=lambda x: (-x[0], x[1]))[:2]
    assert got == [(d, s, i) for i, (s, d) in enumerate(best, 1)]
    assert L.scan(texts, ["none"], 2, "doc_id").count() == 0 and L.scan(texts, [], 2, "doc_id").count() == 0


def test_the_report_reads_written_chunks(spark):
    plan = QUERIES["consistency_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "l_suppkey" not in plan  # chunks and edges are not derived anew for each check
