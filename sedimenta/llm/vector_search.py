"""Operator 10: approximate nearest neighbours by an inverted file with product-quantised residuals, and an exact way by bounds of its lists."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import by_hash, partitions, small_batches, wide
from sedimenta.session import settle

#: Rows that centroids and codebooks are fitted on at most; every row is indexed.
SAMPLE = 20_000
#: Neighbours that a query may miss in the lists it does not probe, as a share of ``k``, by the lists' own statistics.
MISSED = 0.02
#: Lists of one centroid: shells of like residual length, STEPS of them while the length doubles, from 2^-16 to 2^16 times the usual length.
SHELLS, STEPS = 64, 2
#: Components in one part of the product quantiser, and codes of a part.
PART, CODES = 4, 256
#: Rows of a group: what one task holds at a time. Each hands on ``k`` rows a query, so there are no more than partitions need, and they do not shrink as partitions grow.
GROUP, LEAST_GROUP = 8192, 1024
#: Queries that are scored at once.
BLOCK = 128


@dataclass
class Index:
    """Coarse centroids, for each part of a vector the codewords of its residuals, and the usual length of a residual."""

    centroids: np.ndarray
    books: list[np.ndarray]
    dim: int
    usual: float = 1.0

    def assign(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1)).argmax(axis=1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = x - self.centroids[lists]
        return np.stack([nearest(r[:, i * PART : (i + 1) * PART], b) for i, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def lists(self, own: np.ndarray, away: np.ndarray) -> np.ndarray:
        """A row's list: its centroid and the shell of its squared distance ``away`` from it."""
        length = np.sqrt(np.clip(away, 1e-300, 1e300)) / self.usual
        return own * SHELLS + np.clip(np.floor(STEPS * np.log2(length)) + SHELLS // 2, 0, SHELLS - 1).astype(np.int64)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x @ centers.T - 0.5 * (centers**2).sum(axis=1)).argmax(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spread rows of ``x``; a center that loses all its rows stays where it is."""
    centers = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=len(centers))
        sums = np.stack([np.bincount(own, weights=x[:, j], minlength=len(centers)) for j in range(x.shape[1])], axis=1)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``v`` (array of double) of the rows that take part.

    Out are null ids, null vectors, zero vectors, and those that hold a null
    or non-finite component.
    """
    v = F.col("v")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    d = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return d.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, good) & F.exists(v, lambda x: x != 0))


def fit(valid: DataFrame, n: int, dim: int, sample: int = SAMPLE) -> Index:
    """Centroids and codebooks from at most ``sample`` of the ``n`` rows, chosen by a hash of their id; in single precision to the driver."""
    drawn = by_hash(valid, sample, "vec_id", rows=n).select(F.col("v").cast("array<float>").alias("v")).toPandas()
    x = np.stack(drawn["v"].to_list()).astype(np.float64)
    x = x[np.isfinite(x).all(axis=1)]  # beyond single precision: indexed, but nothing to learn from
    if not len(x):
        x = np.zeros((1, dim))
    centroids = kmeans(x, max(1, min(4096, int(math.sqrt(n) / 2), len(x) // 8)))
    r = x - centroids[nearest(x, centroids)]
    usual = math.sqrt((r * r).sum(axis=1).mean())
    return Index(centroids, [kmeans(r[:, i : i + PART], CODES) for i in range(0, dim, PART)], dim, usual if 1e-100 < usual < 1e100 else 1.0)


def tail(z: np.ndarray) -> np.ndarray:
    """Chance that a standard normal variable is over ``z`` (to 1e-7; Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    p = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, p, 1 - p)


@dataclass
class Lists:
    """Of each list that has rows: its number, rows, centroid, and the root mean square and the largest of its residuals' lengths."""

    number: np.ndarray
    rows: np.ndarray
    mean: np.ndarray
    length: np.ndarray
    longest: np.ndarray

    def probes(self, q: np.ndarray, k: int, missed: float) -> np.ndarray:
        """The lists that a query needs, best first, so that those left out hold ``missed`` * ``k`` of its ``k`` nearest by expectation.

        A list's residuals are of like length, so its scores are taken as
        normal: its centre's score, and the spread of such residuals times the query's
        length. That gives the score that ``k`` rows reach, and how many of
        these each list holds. Clustered vectors need few lists and random ones
        most of them. Lists with a spread too small to matter count with their
        centre. Lists are taken until they have 2k + 1 rows at least.
        """
        centre, wide = self.mean @ q, np.maximum(self.length * math.sqrt(q @ q / len(q)), 1e-12)
        low, high = float((centre - 9 * wide).min()), float((centre + 9 * wide).max())
        for _ in range(40):
            mid = (low + high) / 2
            if (self.rows * tail((mid - centre) / wide)).sum() >= k:
                low = mid
            else:
                high = mid
        hold = self.rows * tail((low - centre) / wide)
        order = np.lexsort((-centre, -hold))
        rest = hold.sum() - np.cumsum(hold[order])
        upto = int(np.argmax(rest <= missed * k)) + 1 if (rest <= missed * k).any() else len(order)
        upto = max(upto, int(np.searchsorted(np.cumsum(self.rows[order]), 2 * k + 1)) + 1)
        return self.number[order[:upto]]

    def reach(self, q: np.ndarray, least: float) -> np.ndarray:
        """The lists that can hold a row whose score is ``least`` or more, whatever its distribution: no inner product exceeds the product of the lengths."""
        bound = self.mean @ q + math.sqrt(q @ q) * self.longest
        return self.number[~(bound + 1e-9 * (1 + np.abs(bound)) < least)]


def candidates(approx: np.ndarray, error: np.ndarray, exact: Callable[[np.ndarray], np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of all rows that may be among the ``k`` best.

    ``approx`` is -inf for rows that do not count; ``error`` bounds how far an
    exact score may be from it. The rows that look best are scored first; then
    every row whose bound reaches the ``k``-th score found so far, so that
    none of the ``k`` best is lost to the quantiser.
    """
    able = np.flatnonzero(approx > -np.inf)
    first = able if len(able) <= 4 * k else able[np.argpartition(-approx[able], 4 * k)[: 4 * k]]
    score = exact(first)
    if len(first) == len(able):
        return first, score
    least = np.partition(score, -k)[-k]
    more = np.flatnonzero(approx + error >= least - 1e-9 * (1 + abs(least)))
    more = np.setdiff1d(more, first, assume_unique=True)
    return np.concatenate([first, more]), np.concatenate([score, exact(more)])


def search(
    df: DataFrame, queries: Column, k: int = 20, missed: float = MISSED, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE
) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``queries`` is a condition on ``vec_id``. Nearness is the inner product in
    double precision; ties go to the smaller vec_id; rows of the query's own id
    are no candidates. Vectors whose length is not the most frequent one take
    no part, beside those that ``vectors`` leaves out. Rows of an id that
    repeats are candidates each. An empty table gives no rows.

    Each centroid has a list for each shell of residual lengths that has rows
    (``Index.lists``), so that few long vectors do not blur the statistics of
    the others. Rows are grouped by list; a list of more rows than a group holds is split by a hash
    of the row's place, small lists share a group. A query is sent to the groups of the
    lists it probes (``Lists.probes``) and to no other, and no row is copied: a
    task holds one group, the queries pass by. In what is probed the result
    is exact: every row whose approximate score and quantiser error can
    reach the best ``k`` is scored by its own vector. A task hands on ``k``
    rows a query and group.

    ``missed``: the share of the nearest that may be missed, by the lists'
    statistics. 0 is exact: once ``MISSED`` has given each query ``k`` scores,
    it also visits every other list whose bound reaches the ``k``-th
    (``Lists.reach``), which on random vectors are nearly all.
    """
    spark = df.sparkSession
    small_batches(spark)
    valid = vectors(df, id_col, vec_col)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    sizes = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes["d"], sizes["count"]
    valid = valid.where(F.size("v") == dim)
    index = spark.sparkContext.broadcast(fit(valid, n, dim, sample))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            if b.num_rows:
                x = flat(b.column(1), dim)
                own = ix.assign(x)
                code = ix.encode(x, own)
                made = ix.centroids[own] + np.concatenate([book[code[:, i]] for i, book in enumerate(ix.books)], axis=1)
                error = np.sqrt(((x - made) ** 2).sum(axis=1)) * (1 + 1e-9)
                away = ((x - ix.centroids[own]) ** 2).sum(axis=1)
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ix.lists(own, away).astype(np.int32)), codes, pa.array(error), pa.array(away)], ["vec_id", "v", "list", "code", "error", "away"])

    coded = settle(valid.mapInArrow(encode, f"vec_id {kind}, v array<double>, list int, code binary, error double, away double"), "ivf")
    stats = sorted(coded.groupBy("list").agg(F.count("*").alias("n"), F.avg("away").alias("away"), F.max("away").alias("far")).collect(), key=lambda r: r["list"])  # one row a list
    size = max(min(LEAST_GROUP, GROUP), min(GROUP, n // partitions(spark)))
    place, group, room = {}, 0, size  # list: its first group and its number of groups
    for r in stats:
        at, c = r["list"], r["n"]
        if c > size:
            parts = -(-c // size)
            group += room < size
            place[at], group, room = (group, parts), group + parts, size
        else:
            if c > room:
                group, room = group + 1, size
            place[at], room = (group, 1), room - c
    number = np.array([r["list"] for r in stats])
    length = lambda c: np.sqrt(np.minimum(np.array([r[c] for r in stats]), 1e300))
    table = spark.sparkContext.broadcast(Lists(number, np.array([r["n"] for r in stats]), index.value.centroids[number // SHELLS], length("away"), length("far")))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = table.value
        for b in batches:
            x, least = flat(b.column(1), dim), b.column(2).to_pylist()
            at, out = [], []
            for i, q in enumerate(x):
                by: dict[int, list[int]] = {}
                chosen = lists.probes(q, k, missed or MISSED)
                if least[i] is not None:
                    chosen = np.setdiff1d(lists.reach(q, least[i]), chosen)
                for one in chosen.tolist():
                    first, parts = place[one]
                    for g in range(first, first + parts):
                        by.setdefault(g, []).append(one)
                at += [i] * len(by)
                out += by.items()
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in out], pa.int32()), pa.array(np.ones(len(out), np.int32)), rows.column(0), rows.column(1), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary()), pa.nulls(len(out), pa.float64()), pa.array([c for _, c in out], pa.list_(pa.int32()))],
                ["group", "asks", "vec_id", "v", "list", "code", "error", "lists"],
            )

    shape = f"group int, asks int, vec_id {kind}, v array<double>, list int, code binary, error double, lists array<int>"
    where = spark.createDataFrame([(int(i), int(f), int(p)) for i, (f, p) in place.items()], "list int, first int, parts int")
    dealt = coded.join(F.broadcast(where), "list")  # a row for each list: 4096 * SHELLS at most
    dealt = dealt.select((F.col("first") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))).cast("int").alias("group"), F.lit(0).alias("asks"), "vec_id", "v", "list", "code", "error", F.lit(None).cast("array<int>").alias("lists"))
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        held, now, ready = [], None, None
        for batch in batches:
            group_of, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(group_of) != 0) | (np.diff(asks) != 0)) + 1).tolist(), len(group_of)]
            for a, z in pairwise(cuts):
                if a == z:
                    continue
                part = batch.slice(a, z - a)
                if group_of[a] != now:
                    held, now, ready = [], group_of[a], None
                if not asks[a]:
                    held.append(part)
                elif held:
                    ready = ready or Group.of(held, ix)
                    for i in range(0, part.num_rows, BLOCK):
                        yield ready.answer(part.slice(i, BLOCK), ix, k)

    def found(asking: DataFrame) -> DataFrame:
        asked = asking.mapInArrow(probes, shape)
        groups = dealt.unionByName(asked).repartition(wide(spark, group + 1, 4), "group").sortWithinPartitions("group", "asks", "vec_id")
        return groups.mapInArrow(look, f"query_id {kind}, vec_id {kind}, score double")

    def best(some: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return some.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asking = coded.where(queries).select("vec_id", "v")
    some = best(found(asking.withColumn("least", F.lit(None).cast("double"))))
    if missed > 0:
        return some
    some = settle(some, "found")
    upto = some.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    again = asking.join(upto, "vec_id", "left").select("vec_id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    return best(some.select("query_id", "vec_id", "score").unionByName(found(again)))


def flat(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class Group:
    """The rows of one group, by id."""

    kind: pa.DataType
    ids: np.ndarray
    own: np.ndarray
    x: np.ndarray
    codes: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, parts: list[pa.RecordBatch], ix: Index) -> Group:
        t = pa.Table.from_batches(parts).combine_chunks()
        col = lambda name: t.column(name).to_numpy()
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        return cls(t.schema.field("vec_id").type, col("vec_id"), col("list"), np.concatenate([flat(c, ix.dim) for c in t.column("v").chunks]), codes, col("error"))

    def answer(self, asked: pa.RecordBatch, ix: Index, k: int) -> pa.RecordBatch:
        """The ``k`` best rows of this group for each query, of the lists that it probes."""
        q, who = flat(asked.column(3), ix.dim), asked.column(2).to_numpy(zero_copy_only=False)
        approx = (q @ ix.centroids.T)[:, self.own // SHELLS]
        for i, book in enumerate(ix.books):
            approx += (q[:, i * PART : (i + 1) * PART] @ book.T)[:, self.codes[:, i]]
        there, at = np.unique(self.own, return_inverse=True)
        probed = np.stack([np.isin(there, chosen) for chosen in asked.column(7).to_pylist()])
        approx[~probed[:, at] | (who[:, None] == self.ids)] = -np.inf
        long = np.sqrt((q * q).sum(axis=1))
        ids, best, scores = [], [], []
        for r in range(len(q)):
            at, score = candidates(approx[r], long[r] * self.error, lambda rows, r=r: (self.x[rows] * q[r]).sum(axis=1), k)
            order = np.lexsort((self.ids[at], -score))[:k]
            ids.append(np.full(len(order), r))
            best.append(at[order])
            scores.append(score[order])
        at = np.concatenate(best)
        return pa.RecordBatch.from_arrays([asked.column(2).take(pa.array(np.concatenate(ids))), pa.array(self.ids[at], self.kind), pa.array(np.concatenate(scores))], ["query_id", "vec_id", "score"])
