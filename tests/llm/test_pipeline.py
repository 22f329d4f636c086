import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sedimenta.llm import language, secret_scan, toxicity
from sedimenta.llm.packing import pack
from sedimenta.session import settle
from tests.llm.test_near_copies import classes, shingles


def test_stages_by_hand(spark, sf):
    """Each stage against its operator's own results, joined by id, and run() against the last."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    given = docs
    for name, stage in cp.STAGES[:-1]:
        out = settle(stage(spark, given, sf), name)
        assert out.columns == columns and out.schema["doc_id"] == docs.schema["doc_id"]
        before, after = {r.doc_id: r for r in given.collect()}, {r.doc_id: r for r in out.collect()}
        if name == "language":
            want = {r.doc_id for r in language.predict(given, language.fit(given)).collect() if r.lang_pred != "und" and not r.ambiguous}
        elif name == "toxicity":
            want = {r.doc_id for r in toxicity.score(given, toxicity.fit(given, spark.read.parquet(f"{sf}/labels.parquet"))).collect() if not r.predicted}
        elif name == "near_duplicates":
            want = set(classes({r.doc_id: shingles(r.text or "") for r in before.values()}).values())
        else:
            want = set(before)
            found = {r.doc_id: r.found for r in secret_scan.scan(given, secret_scan.trained(given)).collect()}
            for i, r in after.items():
                text, at = "", 0
                for s in found[i]:
                    text += before[i].text[at : s.start] + "[secret]" if s.start >= at else ""
                    at = max(at, s.end)
                text += before[i].text[at:]
                assert (r.text, r.n_chars) == (text, len(text))
        assert set(after) == want
        if name != "secrets":
            assert all(after[i] == before[i] for i in after)
        given = out
    last = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pack(given, public_tokenizers.path("word_bpe_49k.json")).collect())
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in cp.run(spark, sf).collect()) == last


def test_odd_rows(spark, odd, nothing, tmp_path):
    spark.createDataFrame([(5, 0), (6, 1), (8, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (odd, nothing):
        for name, stage in cp.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert out.count() >= 0 and (name == "packing" or out.columns == table.columns)
    clean = cp.STAGES[0][1](spark, odd, str(tmp_path)).where(F.col("doc_id").isin(5, 6, 8)).count()
    assert clean >= 3  # short clean texts stay
