"""The keyed store: merges, repeated and cut-off commits, rejected rows, and what a commit rewrites."""

import os
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sedimenta.sources.keyed_store import KeyedStore

SCHEMA = "id string, kind string, seen int, made int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def store(spark):
    return KeyedStore(spark, tempfile.mkdtemp(prefix="spark-") + "/store", ("id",), 8)


def rows(store):
    return sorted(map(tuple, store.read().collect()))


def files(store):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(store.path, "data").rglob("*.parquet")}


def test_merge_keep_and_repeat(spark, store):
    assert store.read() is None
    store.upsert(frame(spark, [(f"n{i}", "a", i, 1) for i in range(40)]), "one", keep=("made",))
    batch = frame(spark, [("n3", None, 100, 2), ("new", "b", 5, 2), ("n4", "c", 7, 2), ("n4", "d", 9, 2)])
    for _ in range(2):
        assert store.upsert(batch, "two", order="seen", keep=("made",)) == 0
        want = {f"n{i}": (f"n{i}", "a", i, 1) for i in range(40)} | {"n3": ("n3", "a", 100, 1), "n4": ("n4", "d", 9, 1), "new": ("new", "b", 5, 2)}
        assert rows(store) == sorted(want.values())
    assert len(store.manifests()) == 2
    store.delete(spark.createDataFrame([("n3",), ("gone",)], "id string"), "three")
    assert rows(store) == sorted(r for k, r in want.items() if k != "n3")


def test_a_commit_rewrites_only_its_buckets(spark, store):
    store.upsert(frame(spark, [(f"n{i}", "a", i, 1) for i in range(200)]), "one")
    before = files(store)
    store.upsert(frame(spark, [("n7", "z", 0, 0)]), "two")
    after = files(store)
    assert all(after[p] == t for p, t in before.items()) and len({p.split("bucket=")[1][0] for p in set(after) - set(before)}) == 1
    store.vacuum()
    assert len({p.split("bucket=")[1][0] for p in before} & {p.split("bucket=")[1][0] for p in files(store)}) == 8 and len(rows(store)) == 200
    assert not set(files(store)) >= set(before), "the bucket's older state is gone"


def test_bad_rows_do_not_stop_a_batch(spark, store):
    df = frame(spark, [("a", "x", 1, 1), (None, "x", 1, 1), ("b", "x", -1, 1), ("c", "x", None, 1)])
    assert store.upsert(df, "one", valid=F.col("seen") >= 0) == 3
    assert rows(store) == [("a", "x", 1, 1)] and store.rejected("one").count() == 3


def test_a_commit_that_was_cut_off(spark, store, monkeypatch):
    """Data without a manifest is not seen, and the same commit can be tried again."""
    store.upsert(frame(spark, [("a", "x", 1, 1), ("b", "x", 1, 1)]), "one")
    real = KeyedStore.manifests
    monkeypatch.setattr(KeyedStore, "manifests", lambda self: (_ for _ in ()).throw(OSError) if Path(self.path, "data", self._name("two")).exists() else real(self))
    with pytest.raises(OSError):
        store.upsert(frame(spark, [("a", "y", 2, 2)]), "two")
    monkeypatch.undo()
    assert rows(store) == [("a", "x", 1, 1), ("b", "x", 1, 1)]
    store.upsert(frame(spark, [("a", "y", 2, 2)]), "two")
    assert rows(store) == [("a", "y", 2, 2), ("b", "x", 1, 1)]


def test_two_writers(spark, store, monkeypatch):
    store.upsert(frame(spark, [("a", "x", 1, 1)]), "one")
    stale = store._latest()
    store.upsert(frame(spark, [("b", "x", 1, 1)]), "two")
    monkeypatch.setattr(KeyedStore, "_latest", lambda self: stale)
    with pytest.raises(RuntimeError, match="another writer"):
        store.upsert(frame(spark, [("c", "x", 1, 1)]), "three")
    monkeypatch.undo()
    assert [r[0] for r in rows(store)] == ["a", "b"]


def test_odd_batches(spark, store):
    store.upsert(frame(spark, []), "empty")
    assert rows(store) == []
    extra = frame(spark, [("a", "x", 1, 1), ("a", "x", 1, 1)]).withColumn("bucket", F.lit("q")).withColumn("row", F.lit(1)).withColumn("old", F.lit(1))
    store.upsert(extra, "more")
    store.upsert(spark.createDataFrame([("a", 9)], "id string, seen long"), "fewer columns")
    assert rows(store) == [("a", "x", 9, 1)]
    store.delete(spark.createDataFrame([("a",)], "id string"), "all")
    assert rows(store) == []
