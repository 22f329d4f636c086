"""Neighbour descent: the k most similar rows of each row without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.session import settle, unsettle

#: Rows of a random group of the first graph, on average.
GROUP = 16
#: Random groupings of the first graph.
GROUPINGS = 2


def _compared(members: DataFrame, keep: int) -> DataFrame:
    """``src``, ``dst``, ``score``: within each group ``g`` the ``keep`` best others of every member that beat its ``bound``.

    ``members``: g, id, v (unit length), bound, fresh; pairs of two members that
    are not fresh have met before. A task holds one group at a time, of some
    tens of vectors, however many groups it has.
    """
    kind = dict(members.dtypes)["id"]

    def pairs(ids: np.ndarray, x: np.ndarray, bound: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
        s = np.round(x @ x.T, 6)
        ok = (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :]) & (s > bound[:, None])
        if len(ids) > keep:
            best = np.argpartition(np.where(ok, -s, np.inf), keep - 1, axis=1)[:, :keep]
            chosen = np.zeros_like(ok)
            np.put_along_axis(chosen, best, True, axis=1)
            ok &= chosen
        i, j = np.nonzero(ok)
        return ids[i], ids[j], s[i, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            g, ids = t["g"].to_numpy(), np.array(t["id"].to_pylist())
            x = np.stack([np.asarray(v, np.float64) for v in t["v"].to_pylist()])
            bound, fresh = t["bound"].to_numpy(), t["fresh"].to_numpy()
            edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
            found = [pairs(ids[a:b], x[a:b], bound[a:b], fresh[a:b]) for a, b in zip(edges, edges[1:]) if b - a > 1 and fresh[a:b].any()]
            if found:
                src, dst, score = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(score)], ["src", "dst", "score"])

        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held)
            g = t["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
            yield from out(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))

    return members.repartition("g").sortWithinPartitions("g").mapInArrow(run, f"src {kind}, dst {kind}, score double")


def neighbours(df: DataFrame, k: int = 10, rounds: int = 12, width: int | None = None, change: float = 0.001, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``src``, ``dst``, ``score`` (cosine, six places), ``rank``: about the ``k`` most similar rows of each row.

    It starts from random groups and improves lists of ``width`` rows (3 k by
    default) for up to ``rounds`` rounds: the rows of a list, and as many of those that
    have a row in theirs (drawn by a hash), are compared with each other, as
    neighbours of a row are often neighbours themselves. Only what joined a
    list in the last round is compared again; it ends when fewer than
    ``change`` of all entries are new. A round moves ``2 x width`` vectors a row
    and at most ``(2 x width)^2 / 2`` pairs are scored for a row, whatever the
    number of rows. Approximate: ``similar_pairs`` is the exact way.

    Null, empty and zero vectors and null ids take no part; of rows with one
    id one stays. Ties go to the smaller id. Empty tables give empty results.
    """
    width = width or 3 * k
    v = F.col(vec_col).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.exists(vec_col, lambda x: x != 0)).select(F.col(id_col).alias("id"), F.transform(v, lambda x: x / length).alias("v"))
    rows = settle(rows.groupBy("id").agg(F.min("v").alias("v")), "unit")
    groups = max(1, rows.count() // GROUP)
    drawn = F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(groups)) * GROUPINGS + i for i in range(GROUPINGS)]))
    first = rows.select(drawn.alias("g"), "id", "v", F.lit(-2.0).alias("bound"), F.lit(True).alias("fresh"))
    lists = settle(_best(_compared(first, width).withColumn("fresh", F.lit(True)), width), "lists")
    for turn in range(rounds):
        total, new = lists.agg(F.count("*"), F.count_if("fresh")).first()
        if not total or new <= change * total:
            break
        back = lists.select(F.col("dst").alias("g"), F.col("src").alias("id"), "fresh")
        drawn = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("fresh"), F.xxhash64("id", F.lit(turn))))
        back = back.withColumn("n", drawn).where(F.col("n") <= width).drop("n")
        near = lists.select(F.col("src").alias("g"), F.col("dst").alias("id"), "fresh").unionByName(back).groupBy("g", "id").agg(F.max("fresh").alias("fresh"))
        worst = lists.groupBy("src").agg(F.when(F.count("*") >= width, F.min("score")).otherwise(-2.0).alias("bound"))
        told = rows.join(worst, F.col("id") == F.col("src"), "left").select("id", "v", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
        fresh = _compared(near.join(told, "id").select("g", "id", "v", "bound", "fresh"), width)
        both = lists.select("src", "dst", "score", F.lit(False).alias("fresh")).unionByName(fresh.withColumn("fresh", F.lit(True)))
        before, lists = lists, settle(_best(both, width), "lists")
        unsettle(before)
    unsettle(rows)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return lists.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("src", "dst", "score", "rank")


def _best(pairs: DataFrame, width: int) -> DataFrame:
    """The ``width`` best of each list; a pair that was there before is not fresh."""
    one = pairs.groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return one.withColumn("n", rank).where(F.col("n") <= width).drop("n")
