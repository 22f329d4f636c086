"""Event streams: audit lines, and windowed counts with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.session import scratch_dir


def audit_lines(events: DataFrame) -> DataFrame:
    """One JSON line an event (``event_id``, ``line``, ``event_date``); works on batches and streams alike."""
    q = F.lit('"')
    line = F.concat(F.lit('{"event_type":"'), F.col("event_type"), F.lit('","session_id":"'), F.col("user_id"), q, F.lit(',"details":'), F.col("props"), F.lit("}"))
    return events.select("event_id", line.alias("line"), F.date_format("ts", "yyyy-MM-dd").alias("event_date"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and sum of each event type by window; events more than ``late`` behind the newest are dropped in append mode."""
    w = F.window(F.col("ts").cast("timestamp"), size)
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: start, end and number of events with less than ``gap`` between two."""
    s = F.session_window(F.col("ts").cast("timestamp"), gap)
    return events.groupBy("user_id", s.alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def tumbling_once(spark: SparkSession, path: str, size: str = "1 hour") -> DataFrame:
    """Run the windowed count as a stream over all files that are there, in complete mode, and give the table it wrote.

    The state and the result lie in the shared folder, so a lost executor costs a retry.
    """
    base = f"{scratch_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    there = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(there.schema)
    # A file source streams folders; a table that is one file is found in the folder around it.
    alone = [f.rpartition("/")[2] for f in there.inputFiles()] == [name]
    source = stream.option("pathGlobFilter", name).parquet(folder) if alone else stream.parquet(path)
    out = f"{base}/out"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = tumbling(source, size).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
