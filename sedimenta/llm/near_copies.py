"""Near copies by exact Jaccard similarity of word shingles, for stages of a pipeline.

Operator 6's covering tables link what is within a few bits of SimHash. A pair
at a similarity of 0.8 differs in about 10 of 64 bits, and no covering of that
radius is small enough to be of use, so its tables alone cannot give all links
at 0.8: pairs they leave open are found by keys of minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import simhash
from sedimenta.llm.common import documents, wide
from sedimenta.operators.components import connected_components
from sedimenta.session import settle, unsettle

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Candidates share one of BANDS keys of ROWS minima: a pair at 0.8 shares none with chance (1 - 0.8**ROWS)**BANDS = 0.00005.
BANDS, ROWS = 25, 5
#: Members that are compared with one other text in one group.
BLOCK = 256
#: Members of a bucket that pass by in one group.
PASSING = 4096
#: Rounds in which the members of a bucket are compared with one of them, before all pairs that are left.
LEADERS = 1

_RNG = np.random.default_rng(SEED)
_XOR, _ODD = _RNG.integers(0, np.iinfo(np.uint64).max, (2, BANDS * ROWS, 1), np.uint64)
_ODD = _ODD | np.uint64(1)


def grams(text: str) -> np.ndarray:
    """The set of hashes of a text's shingles, sorted; a shorter text is one shingle, one without words has none."""
    w = text.encode().lower().split()  # of bytes: A-Z and the six ASCII spaces only, as in SimHash
    if not w:
        return np.zeros(0, np.uint64)
    made = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False)) if len(w) > SHINGLE else [b" ".join(w)]
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in made], np.uint64))


def band_keys(g: np.ndarray) -> np.ndarray:
    """One key a band, of the minima of ROWS random orders of the set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(g), 1024):
        low = np.minimum(low, ((g[i : i + 1024] ^ _XOR) * _ODD).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), SEED) for b in low.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of SIMILARITY or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def _sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``node`` (hash of the set), ``n`` (its size), ``fp`` (its SimHash), ``keys``, ``text`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [grams(t) for t in b.column(1).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(g.tobytes(), SEED) for g in sets], np.uint64).view(np.int64)
            keys = np.concatenate([band_keys(g) for g in sets]) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
            fp = np.array([simhash.majority(g) if len(g) else 0 for g in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node), pa.array([len(g) for g in sets], pa.int64()), pa.array(fp), lists, b.column(1)], ["doc_id", "node", "n", "fp", "keys", "text"])

    d = documents(df, id_col, text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, node bigint, n bigint, fp bigint, keys array<bigint>, text string")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``a``, ``b`` whose texts (``node``, ``text``) are alike.

    A group is one text and at most about BLOCK others, which pass by one at a
    time, so neither a text with many partners nor a group fills a task. Texts
    are joined by sorting: a broadcast would pass them through the driver.
    """
    spark = pairs.sparkSession
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    p = pairs.join(many.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("nb")).cast("int").alias("salt"))
    first = many.select("a", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("salt"))
    first = first.join(texts.hint("merge"), first.a == texts.node).select("a", "salt", F.lit(0).alias("k"), F.col("a").alias("b"), "text")
    rest = p.join(texts.hint("merge"), p.b == texts.node).select("a", "salt", F.lit(1).alias("k"), "b", "text")
    groups = first.unionByName(rest).repartition(wide(spark, 0, 1), "a", "salt").sortWithinPartitions("a", "salt", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            src, dst = [], []
            for a, k, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if k == 0:
                    mine = grams(text)
                elif alike(mine, grams(text)):
                    src.append(a)
                    dst.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return groups.mapInArrow(run, "src bigint, dst bigint")


def _open(members: DataFrame, parts: DataFrame) -> DataFrame:
    """``members`` with ``part``, their component so far, of the buckets that hold more than one component."""
    m = members.join(parts.withColumnRenamed("node", "_n").hint("merge"), F.col("node") == F.col("_n"), "left").select(*members.columns, F.coalesce("component", "node").alias("part"))
    several = m.groupBy("t", "key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("t", "key")
    return m.join(several.hint("merge"), ["t", "key"])


def _pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """Distinct pairs that share a bucket, are not of one component and are alike in size, the smaller node first."""
    p = x.alias("x").join(y.alias("y").hint("merge"), [F.col("x.t") == F.col("y.t"), F.col("x.key") == F.col("y.key"), F.col("x.part") != F.col("y.part")])
    p = p.where(F.least("x.n", "y.n") >= SIMILARITY * F.greatest("x.n", "y.n") - 1e-9)
    return p.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def outside(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``src``, ``dst`` of the members outside a bucket's largest component with any that are not of theirs.

    A group holds a block of such members; a part of the bucket passes by, one
    text at a time. No pair becomes a row: only links leave a group, and none
    between parts that the group has joined already. A row is copied once for
    each block of members outside, these once for each part of the bucket.
    """
    spark = left.sparkSession
    sizes = left.groupBy("t", "key", "part").agg(F.count("*").alias("c"))
    top = sizes.groupBy("t", "key").agg(F.max_by("part", F.struct("c", "part")).alias("top"), F.sum("c").alias("m"), F.max("c").alias("most"))
    top = top.select("t", "key", "top", F.ceil((F.col("m") - F.col("most")) / BLOCK).cast("int").alias("nf"), F.ceil(F.col("m") / PASSING).cast("int").alias("nm"))
    x = left.join(top.hint("merge"), ["t", "key"])
    of = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = x.where("part <> top").select("t", "key", of("nf", 0).alias("f"), every("nm").alias("p"), F.lit(0).alias("k"), "node", "part")
    passing = x.select("t", "key", every("nf").alias("f"), of("nm", 1).alias("p"), F.lit(1).alias("k"), "node", "part")
    rows = held.unionByName(passing).join(texts.hint("merge"), "node").select("t", "key", "f", "p", "k", "node", "part", "text")
    groups = rows.repartition(wide(spark, 0, 1), "t", "key", "f", "p").sortWithinPartitions("t", "key", "f", "p", "k", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, root = None, [], {}

        def top_of(part: int) -> int:
            while root.get(part, part) != part:
                part = root[part]
            return part

        for batch in batches:
            src, dst = [], []
            for *group, k, node, part, text in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if group != now:
                    now, mine, root = group, [], {}
                have = set(grams(text).tolist())
                if k == 0:
                    mine.append((node, part, have))
                    continue
                for other, its, held_set in mine:
                    a, b = top_of(part), top_of(its)
                    if a == b or min(len(have), len(held_set)) < SIMILARITY * max(len(have), len(held_set)) - 1e-9:
                        continue
                    both = len(have & held_set)
                    if both >= SIMILARITY * (len(have) + len(held_set) - both) - 1e-9:
                        root[a] = b
                        src.append(other)
                        dst.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return groups.mapInArrow(run, "src bigint, dst bigint")


def covered(nodes: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` that operator 6's tables propose: each fingerprint's first node with its others, and first nodes of linked fingerprints."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("a"), F.min_by("n", "node").alias("an"))
    same = nodes.join(first.hint("merge"), "fp").where("node <> a").select("a", F.col("node").alias("b"), "an", F.col("n").alias("bn"))
    x, y = first.toDF("src", "a", "an"), first.toDF("dst", "b", "bn")
    linked = simhash.links(first.select("fp")).join(x.hint("merge"), "src").join(y.hint("merge"), "dst").select("a", "b", "an", "bn")
    return same.unionByName(linked).where(F.least("an", "bn") >= SIMILARITY * F.greatest("an", "bn") - 1e-9).select("a", "b").distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of every document: ``doc_id``, ``component`` (equal for those that links join).

    Documents link if their sets of five-word shingles are equal or have a
    Jaccard similarity of 0.8 or more, counted exactly for each candidate pair.
    Candidates come from SimHash's covering tables first (``covered``), then
    from keys of bands: all pairs that share one, save those that are
    joined already. Members of a bucket are compared with one of them first,
    then all that are outside the bucket's largest component with all
    that are not of theirs (``outside``). So no bucket gives all of its pairs,
    and no bucket is cut.
    """
    sets = settle(_sets(df, id_col, text_col), "sets")
    nodes = settle(sets.groupBy("node").agg(F.first("keys").alias("keys"), F.first("n").alias("n"), F.first("fp").alias("fp")), "nodes")
    spread = nodes.select("node", "n", F.posexplode("keys").alias("t", "key"))
    full = spread.groupBy("t", "key").agg(F.count("*").alias("c")).where("c > 1").select("t", "key")
    members = settle(spread.join(full.hint("merge"), ["t", "key"]), "members")
    pairs = settle(covered(nodes.where("n > 0")), "pairs")
    wanted = members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    texts = settle(sets.join(wanted.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    links = settle(confirmed(pairs, texts), "links")
    parts = settle(connected_components(links), "parts")
    done = [nodes, members, texts, pairs, links]
    for step in range(LEADERS + 1):
        left = settle(_open(members, parts), "open")
        done.append(left)
        if left.isEmpty():
            break
        if step < LEADERS:
            lead = left.groupBy("t", "key").agg(F.min_by(F.struct("node", "n", "part"), F.xxhash64("node", F.lit(step))).alias("m")).select("t", "key", "m.*")
            pairs = settle(_pairs(lead, left), "pairs")
            found = settle(confirmed(pairs, texts), "links")
            done.append(pairs)
        else:
            found = settle(outside(left, texts), "links")
        done += [found, parts]
        links = links.unionByName(found)
        parts = settle(connected_components(links), "parts")
    unsettle(*done)
    return sets.select("doc_id", "node").join(parts.hint("merge"), "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document with the smallest id stays, with all its columns.

    Rows that repeat that id all stay; an empty table stays empty.
    """
    near = near_copies(df.select(F.col(id_col), F.col(text_col)), id_col, text_col)
    keep = near.groupBy("component").agg(F.min("doc_id").alias("_keep")).select("_keep").distinct()
    return df.join(keep, df[id_col].eqNullSafe(keep["_keep"]), "left_semi")
