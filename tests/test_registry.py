"""The file registry: three triggers against one full build, batches given again, late events."""

import tempfile

import pytest

from sedimenta.streaming.registry import EVENT, FileRegistry

EVENTS = [
    ("a", "1", 1), ("b", "1", 2), ("a", "1", 3), ("a", "2", 4), ("c", None, 5), ("b", None, 6), ("b", "1", 7), ("d", "9", 8), ("d", "9", 8), (None, "1", 9), ("e", "1", None),
    ("a", None, 10), ("a", None, 11), ("c", "3", 12),
]


def full(events):
    files, history = {}, []
    for path, hash_, seq in sorted({(p, h, s) for p, h, s in events if p is not None and s is not None}, key=lambda x: x[2]):
        was = files.get(path, (None, None, 0, seq, None))
        change = "added" if hash_ and not was[0] else "modified" if hash_ and hash_ != was[0] else "deleted" if not hash_ and was[0] else "unchanged"
        if change != "unchanged":
            history.append((path, seq, change))
        files[path] = (hash_, change, was[2] + (change != "unchanged"), was[3], seq)
    return sorted((p, *v) for p, v in files.items()), sorted(history)


@pytest.fixture
def registry(spark):
    return FileRegistry(spark, tempfile.mkdtemp(prefix="spark-") + "/registry", 4)


def state(r):
    files = sorted(map(tuple, r.read().select("path", "hash", "status", "changes", "first_seq", "last_seq").collect()))
    return files, sorted(map(tuple, r.history.read().select("path", "seq", "change").collect()))


def test_three_runs_equal_a_full_build(spark, registry):
    folder = tempfile.mkdtemp(prefix="spark-") + "/events"
    for a, b in ((0, 4), (4, 9), (9, 14)):
        spark.createDataFrame(EVENTS[a:b], EVENT).coalesce(1).write.mode("append").parquet(folder)
        registry.run(spark.readStream.schema(EVENT).parquet(folder))
    assert state(registry) == full(EVENTS)


def test_a_batch_given_again(spark, registry, monkeypatch):
    one, two = (spark.createDataFrame(e, EVENT) for e in (EVENTS[:6], EVENTS[6:]))
    registry.apply(one, 0)
    registry.apply(one, 0)
    real = FileRegistry.files
    # the driver is lost after the history was committed, before the files were
    monkeypatch.setattr(type(registry.files), "upsert", lambda self, *a, _f=type(registry.files).upsert, **k: (_ for _ in ()).throw(OSError) if self.path.endswith("/files") else _f(self, *a, **k))
    with pytest.raises(OSError):
        registry.apply(two, 1)
    monkeypatch.undo()
    assert real and registry.history.committed("batch-1") and not registry.files.committed("batch-1")
    registry.apply(two, 1)
    assert state(registry) == full(EVENTS)


def test_late_events_change_nothing_else(spark, registry):
    registry.apply(spark.createDataFrame([("a", "1", 5)], EVENT), 0)
    registry.apply(spark.createDataFrame([("a", "2", 3), ("a", "3", 6), ("b", "1", 1)], EVENT), 1)
    files, history = state(registry)
    assert files == [("a", "3", "modified", 2, 5, 6), ("b", "1", "added", 1, 1, 1)]
    assert history == [("a", 3, "late"), ("a", 5, "added"), ("a", 6, "modified"), ("b", 1, "added")]


def test_empty_batch(spark, registry):
    registry.apply(spark.createDataFrame([], EVENT), 0)
    assert state(registry) == ([], [])
