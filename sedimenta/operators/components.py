"""Connected components of an undirected edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import settle, unsettle


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every vertex of ``edges`` with the smallest vertex it can reach.

    Each round points the neighbours of a vertex that are larger than it at the
    smallest neighbour (large star), then does so for the smaller ones (small
    star). The edge list never grows beyond its size and converges in about
    log(diameter) rounds. A round is two aggregations by vertex with map-side
    combining and two equi-joins that AQE can split when one vertex is hot; both
    are sorted and merged, so no label table is ever collected on the driver.

    Nulls at either end and self loops add no link (a vertex seen only in self
    loops is returned with its own label). Repeated edges count once. An empty
    edge list gives an empty result. Returns ``node``, ``component``.
    """
    given = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
    given = settle(given.distinct(), "cc")
    loops, e = given.where("a = b").select(F.col("a").alias("node")), given.where("a <> b")
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).union(loops).distinct()
    last = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a")
        before, e = e, settle(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct(),
            "cc",
        )
        unsettle(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not converge")
    root = e.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(root.hint("merge"), F.col("node") == F.col("a"), "left").select("node", F.coalesce("component", "node").alias("component"))
