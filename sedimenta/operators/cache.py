"""Cache operators as tables: keys, quality, eviction, tiers and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def simple_key(q: Column) -> Column:
    return F.md5(F.trim(q))


def global_key(q: Column) -> Column:
    """The key of what follows a ``prefix:``, or of the whole."""
    return F.md5(F.trim(F.regexp_replace(q, "^[a-z]+:", "")))


def context_keys(turns: DataFrame, window: int = 3, most: int = 10) -> DataFrame:
    """Key of each question of a thread (``thread``, ``seq``, ``query``): the last ``window`` questions before it and their number count."""
    w = Window.partitionBy("thread").orderBy("seq")
    context = F.concat_ws(" ", F.collect_list("query").over(w.rowsBetween(-min(window, most), -1)))
    version = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, -1))
    text = F.concat(F.lit("thread:"), F.col("thread"), F.lit("|ctx:"), context, F.lit("|v"), version.cast("string"), F.lit("|"), F.col("query"))
    return turns.select("thread", "seq", F.md5(F.trim(text)).alias("key"))


def quality_blocks(marks: DataFrame) -> DataFrame:
    """Each key's marks cut into blocks of ranges of ``seq``: ``key``, ``at`` (first mark), ``n``, ``low``, ``add``, ``verified``, ``last``.

    A block maps a score s to max(low, s + add); a null ``low`` is no bound. Such
    maps compose, so no task holds more of a key than a range of all marks.
    """
    n = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marks.select("key", "seq", "positive").repartitionByRange(n, "key", "seq", "positive").withColumn("block", F.spark_partition_id())
    step = F.when(F.col("positive"), 1).otherwise(-2).cast("long")
    so_far = F.sum(step).over(Window.partitionBy("key", "block").orderBy("seq", "positive").rowsBetween(Window.unboundedPreceding, 0))
    run = dealt.withColumn("step", step).withColumn("so_far", so_far)
    mark = F.struct("seq", "positive")
    g = run.groupBy("key", "block").agg(
        F.min(mark).alias("at"), F.count("*").alias("n"), F.sum("step").alias("add"), F.min(F.when(F.col("step") < 0, F.col("so_far"))).alias("least"),
        F.max("positive").alias("verified"), F.max(mark).alias("last"),
    )
    return g.select("key", "at", "n", (F.col("add") - 5 - F.col("least")).alias("low"), "add", "verified", "last")


def quality(marks: DataFrame) -> DataFrame:
    """Fold each key's marks (``key``, ``seq``, ``positive``) in order: +1 and verified, or -2 and not below -5.

    Returns score, verified, fast and high (verified, or a score over 2, or fast).
    """
    blocks = F.array_sort(F.collect_list(F.struct("at", "low", "add")))
    g = quality_blocks(marks).groupBy("key").agg(blocks.alias("m"), F.max("verified").alias("verified"), F.max("last")["positive"].alias("fast"))
    score = F.aggregate("m", F.lit(0).cast("long"), lambda s, b: F.greatest(b["low"], s + b["add"]))
    g = g.select("key", score.alias("score"), "verified", "fast")
    return g.withColumn("high", F.col("verified") | (F.col("score") > 2) | F.col("fast"))


def eviction_score(accesses: Column, age_h: Column, idle_h: Column, kb: Column) -> Column:
    """Accesses an hour plus the inverse of idle hours, less a tenth of the size in KB; low scores go first."""
    return accesses / F.greatest(age_h, F.lit(1.0)) + 1 / F.greatest(idle_h, F.lit(1.0)) - 0.1 * kb


def evict(items: DataFrame, share: float = 0.1) -> DataFrame:
    """The lowest ``share`` of items by score, at least those at or under its exact quantile; ties go by key."""
    bound = items.agg(F.floor(F.count("*") * share).alias("n")).first()["n"]
    return items.orderBy("score", "key").limit(int(bound))


def least_recent(accesses: DataFrame, capacity: int) -> DataFrame:
    """What a cache of ``capacity`` keys holds after all accesses (``key``, ``seq``): the keys used last."""
    last = accesses.groupBy("key").agg(F.max("seq").alias("last"))
    return last.orderBy(F.desc("last"), "key").limit(capacity)


def tiered(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """One row of each key, from the first tier that has it; ``promote`` if it came from disk and is of high quality."""
    both = memory.withColumn("tier", F.lit(0)).unionByName(disk.withColumn("tier", F.lit(1)))
    g = both.groupBy("key").agg(F.min_by(F.struct("value", "high", "tier"), "tier").alias("s")).select("key", "s.*")
    return g.withColumn("promote", (F.col("tier") == 1) & F.col("high"))
