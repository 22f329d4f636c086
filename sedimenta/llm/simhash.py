"""Operator 6: SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import documents, wide
from sedimenta.operators.components import connected_components
from sedimenta.session import settle

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints of one bucket that one task holds; a larger bucket is dealt out in pairs of blocks.
BLOCK = 4096


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned number; 0 if it has no words."""
    w = text.encode().lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) > shingle else [b" ".join(w)]
    return majority(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def masks(radius: int = RADIUS) -> list[int]:
    """2**(radius+1) - 1 bit masks of which any two fingerprints within ``radius`` agree on at least one.

    Bit i carries a vector a(i) of radius + 1 bits; mask v keeps the bits whose
    vector has an odd product with v. At most ``radius`` differing bits span
    less than the whole space, so some v other than 0 is orthogonal to all of
    them, and its mask holds none of them. The vectors go round the non-zero
    ones, so that each mask keeps about half of the bits.
    """
    n = 1 << (radius + 1)
    a = [1 + i % (n - 1) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (a[i] & v).bit_count() % 2) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) of every row. Null and empty text: 0. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    d = documents(df, id_col, text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp bigint")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked within ``fps``: breadth-first search over what is not reached yet."""
    left, src, dst = np.unique(fps), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                src.append(np.full(len(found), x))
                dst.append(found)
                queue.extend(found)
                left = left[~near]
    empty = np.zeros(0, fps.dtype)
    return (np.concatenate(src), np.concatenate(dst)) if src else (empty, empty)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``src``, ``dst``: links that connect all distinct fingerprints (column ``fp``) within ``radius`` bits.

    Every fingerprint goes to one bucket of each of the 31 masks; buckets with
    one fingerprint are found by a count that combines before its shuffle and go.
    A bucket of more than BLOCK is cut into blocks, and each pair of blocks is
    one group, so no task holds more than two blocks, and every pair of
    fingerprints in a bucket still meets in one group. A group gives the links
    of a spanning forest, never all of its pairs.
    """
    spark = fps.sparkSession
    tables = len(masks(radius))
    spread = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks(radius)])).alias("t", "key"))
    full = spread.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = spread.join(full.hint("merge"), ["t", "key"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    shared = shared.withColumn("nb", blocks).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    other = F.when(F.col("nb") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))
    pairs = shared.withColumn("o", F.explode(other)).select("t", "key", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "fp")
    groups = pairs.repartition(wide(spark, fps.count() * tables, 2_000_000), "t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def scan(cols: list[np.ndarray], last: bool) -> tuple[list[np.ndarray] | None, list]:
            """Whole groups of what has come; the last group waits, for it may go on."""
            key = np.stack(cols[:4], axis=1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            ends = [*cut.tolist(), len(key)] if last else cut.tolist()
            made, at = [], 0
            for e in ends:
                if e - at == 2:
                    x, y = cols[4][at : at + 2]
                    if np.bitwise_count(x ^ y) <= radius and x != y:
                        made.append((np.array([x]), np.array([y])))
                elif e - at > 2:
                    made.append(forest(cols[4][at:e], radius))
                at = e
            return (None if last else [c[at:] for c in cols]), made

        def batch(made: list) -> Iterator[pa.RecordBatch]:
            if made:
                s, d = (np.concatenate([m[i] for m in made]).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(d)], ["src", "dst"])

        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)] + [b.column(4).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if len(rest[0]):
                rest, made = scan(rest, False)
                yield from batch(made)
        if rest is not None and len(rest[0]):
            yield from batch(scan(rest, True)[1])

    return groups.mapInArrow(run, "src bigint, dst bigint").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Class of every document: ``doc_id``, ``fp``, ``component_id`` (smallest doc_id reachable over links).

    Documents link if their fingerprints differ in at most ``radius`` bits.
    Copies meet by fingerprint before any pair is looked at. Null, empty and
    wordless texts have fingerprint 0 and link like any others. Rows with null
    id keep their row; they never name a component unless it has no other id.
    Repeated rows come back as often as they went in; an empty table is empty.
    Its joins are sorted and merged: tables that grow with the texts never
    pass through the driver for a broadcast.
    """
    fps = settle(fingerprints(df, id_col, text_col, shingle), "fp")
    least = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    cc = connected_components(links(least.select("fp"), radius))
    named = least.join(cc.hint("merge"), F.col("fp") == F.col("node"), "left")
    part = named.where("component is not null").groupBy("component").agg(F.min("least").alias("low"))
    found = named.select("fp", "component", "least").join(part.hint("merge"), "component", "left").select(F.col("fp").alias("f"), F.coalesce("low", "least").alias("component_id"))
    return fps.join(found.hint("merge"), F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document with the smallest id stays, with all its columns.

    Rows that repeat that id all stay; an empty table stays empty.
    """
    near = near_duplicates(df.select(F.col(id_col), F.col(text_col)), id_col, text_col)
    keep = near.groupBy("component_id").agg(F.min("doc_id").alias("keep")).select(F.col("keep").alias("_keep")).distinct()
    left = df.join(keep, df[id_col].eqNullSafe(keep["_keep"]), "left_semi")
    return left
