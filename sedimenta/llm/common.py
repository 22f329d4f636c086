"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch, so that a worker holds a few megabytes of text at a time.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that has left their size at the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, so that others never reach its shuffles or clash with its own."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def held_out(id_col: Column | str = "doc_id") -> Column:
    """Rows that no model may learn labels from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def by_hash(df: DataFrame, bound: int, *cols: str, rows: int | None = None) -> DataFrame:
    """At most ``bound`` rows, chosen by a hash of ``cols``: the same ones at every run and partitioning.

    ``rows`` is the number of rows, counted if not given. A table over the
    bound is first cut to the share of hashes that holds a tenth more than the
    bound, so that no task sorts or hands on more than its part of these.
    """
    rows = df.count() if rows is None else rows
    if rows <= bound:
        return df
    order = F.xxhash64(*[F.col(c) for c in cols], F.lit("sample"))
    few = df.where(order < min((1 << 63) - 1, int((1.1 * bound + 100) / rows * (1 << 64)) - (1 << 63)))
    return few.orderBy(order, *cols).limit(bound)


class Memo(dict):
    """What a worker remembers of a function of a key: the last ``size`` to twice ``size`` keys, those in use among them.

    Two generations: a full one becomes the old one, from which keys that come
    again move to the new one, and is then dropped.
    """

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def kept(df: DataFrame, text_col: str, keep: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows, with all their columns, whose text (null: empty) ``keep`` wants. Batches are filtered as they pass; no shuffle."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep([t or "" for t in b.column(at).to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


#: White space between words; a word is a run of anything else.
SPACE = "[\\x20\\x09-\\x0D]"


def words(text: Column) -> Column:
    """The words of a text that is not null."""
    return F.array_remove(F.split(text, f"{SPACE}+", -1), "")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def wide(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for ``rows`` rows at ``per_task`` each, and at least the session's number."""
    return max(partitions(spark), math.ceil(rows / max(1, per_task)))
