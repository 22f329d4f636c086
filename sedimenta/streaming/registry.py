"""A registry of files kept by a stream of file events: state by path across triggers, status, and a history of changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.sources.keyed_store import KeyedStore

EVENT = "path string, hash string, seq long"


@dataclass(frozen=True)
class FileRegistry:
    """``path`` holds two keyed stores and the stream's checkpoint, in a folder that all executors reach.

    An event is (``path``, ``hash``, ``seq``): what a scan saw of a file; a
    null hash says that it is gone. ``files``: each path's last hash, status
    (the change that the last event made), number of changes, first and last
    seq. ``history``: every change (added, modified, deleted) by path and seq,
    and events that came after a later one of their path, as late; these
    change nothing else.
    """

    spark: SparkSession
    path: str
    buckets: int = 16

    @property
    def files(self) -> KeyedStore:
        return KeyedStore(self.spark, f"{self.path}/files", ("path",), self.buckets)

    @property
    def history(self) -> KeyedStore:
        return KeyedStore(self.spark, f"{self.path}/history", ("path", "seq"), self.buckets)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take in a micro-batch. One that is given again, whole or after it broke off, changes nothing more.

        Events without a path or seq are left out; of events of a path with
        one seq the largest hash counts. The history is committed first, so a
        batch that breaks off between the two is made again from the same state.
        """
        name = f"batch-{number}"
        if self.files.committed(name):
            return
        e = batch.where("path is not null and seq is not null").groupBy("path", "seq").agg(F.max("hash").alias("hash"))
        known = self.files.read()
        if known is None:
            known = self.spark.createDataFrame([], "path string, hash string, changes long, last_seq long")
        known = known.select("path", F.nullif("hash", F.lit("")).alias("known"), F.col("changes").alias("made"), F.col("last_seq").alias("last"))
        e = e.join(known, "path", "left").withColumn("late", F.coalesce(F.col("seq") <= F.col("last"), F.lit(False)))
        order = Window.partitionBy("path", "late").orderBy("seq")
        before = F.when(F.row_number().over(order) == 1, F.col("known")).otherwise(F.lag("hash").over(order))
        there, was = F.col("hash").isNotNull(), F.col("before").isNotNull()
        change = F.when(F.col("late"), "late").when(there & ~was, "added").when(there & (F.col("hash") != F.col("before")), "modified").when(~there & was, "deleted").otherwise("unchanged")
        e = e.withColumn("before", before).withColumn("change", change)
        self.history.upsert(e.where("change <> 'unchanged'").select("path", "seq", "change", "hash"), name)
        last = e.where(~F.col("late")).groupBy("path").agg(
            F.max_by(F.struct("hash", "change"), "seq").alias("at"), F.count_if(F.col("change") != "unchanged").alias("n"), F.max(F.coalesce("made", F.lit(0))).alias("made"), F.min("seq").alias("first"), F.max("seq").alias("seq")
        )
        # a null would leave the hash that was there, so an empty text stands for a file that is gone
        rows = last.select("path", F.coalesce("at.hash", F.lit("")).alias("hash"), F.col("at.change").alias("status"), (F.col("made") + F.col("n")).alias("changes"), F.col("first").alias("first_seq"), F.col("seq").alias("last_seq"))
        self.files.upsert(rows, name, keep=("first_seq",))

    def run(self, events: DataFrame) -> None:
        """Take in everything that a streaming DataFrame of events has now, and remember how far it came."""
        q = events.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()

    def read(self) -> DataFrame | None:
        """The files as they are known; those that are gone have a null hash."""
        f = self.files.read()
        return None if f is None else f.withColumn("hash", F.nullif("hash", F.lit("")))
