"""Operator 4: homomorphic multiset hash of paragraphs."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import documents, partitions

#: Lanes of 64 bits that decide equality; lanes of 16 bits that measure likeness.
EQUAL_LANES, LIKE_LANES = 8, 256
#: Words in a window of the likeness lanes.
WINDOW = 3
SIZE = 8 * EQUAL_LANES + 2 * LIKE_LANES


def paragraphs(text: str) -> list[str]:
    """The multiset members: lines without the white space around them, blank ones left out."""
    return [p for p in (x.strip() for x in text.split("\n")) if p]


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the paragraphs' vectors: lanes modulo 2**64 and lanes modulo 2**16.

    A paragraph's wide vector is 512 bits of BLAKE2b, added lane by lane, and a
    signed count of its windows of three words (a shorter paragraph is one
    window), each window adding +1 or -1 to one of 256 narrow lanes. Both sums
    are independent of order, and adding or subtracting a paragraph's vector
    inserts or deletes it.
    """
    ps = paragraphs(text)
    if not ps:
        return np.zeros(EQUAL_LANES, np.uint64), np.zeros(LIKE_LANES, np.int16)
    whole = np.frombuffer(b"".join(hashlib.blake2b(p.encode()).digest() for p in ps), "<u8").reshape(-1, EQUAL_LANES)
    hashes: list[int] = []
    for p in ps:
        w = p.encode().split()
        if len(w) <= WINDOW:
            hashes.append(xxhash.xxh64_intdigest(b" ".join(w)))
        else:
            hashes.extend(map(xxhash.xxh64_intdigest, map(b" ".join, zip(w, w[1:], w[2:], strict=False))))
    h = np.array(hashes, np.uint64)
    lane, sign = (h % np.uint64(LIKE_LANES)).astype(np.int64), 1 - 2 * (h >> np.uint64(63)).astype(np.int64)
    like = np.bincount(lane, weights=sign, minlength=LIKE_LANES).astype(np.int64)
    return whole.sum(axis=0, dtype=np.uint64), like.astype(np.int16)


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of the union of two multisets (sign 1), or of ``a`` without ``b`` (sign -1)."""
    (x, u), (y, v) = unpack(a), unpack(b)
    return pack(x + y if sign > 0 else x - y, (u + v if sign > 0 else u - v).astype(np.int16))


def pack(equal: np.ndarray, like: np.ndarray) -> str:
    return base64.b64encode(equal.astype("<u8").tobytes() + like.astype("<i2").tobytes()).decode()


def unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * EQUAL_LANES], "<u8"), np.frombuffer(raw[8 * EQUAL_LANES :], "<i2")


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Estimated share of windows that two fingerprints have in common, from 0 to 1.

    1 for equal fingerprints, whatever they hold; otherwise twice the inner
    product of the narrow lanes over the sum of their squares, cut to [0, 1].
    Its standard error is about 1 / sqrt(256).
    """
    if np.array_equal(a[0], b[0]):
        return 1.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    both = x @ x + y @ y
    return float(min(1.0, max(0.0, 2 * (x @ y) / both))) if both else 0.0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` of every row; a null text counts as empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(*vector(t)) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    d = documents(df, id_col, text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` whose last floor(n/2) code points give way to the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(df: DataFrame, n: int) -> list:
    cut = df.where("doc_id is not null").select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()
    return sorted(set(cut[0] or [])) if cut else []


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each document, its edited text, and compare with the next document's.

    The next document is the one that follows in descending order of doc_id
    (nulls last; rows of equal id in order of their text's hash, then text);
    after the last one comes the first, and a sole row follows itself. Ranges
    of doc_id hold about equally many rows; the first row of each range is
    copied to the range before, so the texts are shuffled once and each task
    reads one range at a time. Null text: empty. An empty table: no rows.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    spark: SparkSession = df.sparkSession
    d = documents(df, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    cuts = _bounds(d, 8 * partitions(spark))
    n = len(cuts) + 1
    edges = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast(f"array<{kind}>")
    # Bucket 0 holds the largest ids; nulls come last, with the smallest.
    place = F.when(F.col("doc_id").isNull(), n - 1).otherwise(F.size(F.filter(edges, lambda c: c > F.col("doc_id")))) if cuts else F.lit(0)
    d = d.withColumn("bucket", place.cast("int"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    top = d.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()  # one row a bucket
    tops = sorted((r["bucket"], r["top"]) for r in top)
    follows = {b: tops[(i - 1) % len(tops)][0] for i, (b, _) in enumerate(tops)}  # the bucket that needs this one's first row
    if tops:
        names = spark.createDataFrame([(b, t, follows[b]) for b, t in tops], f"bucket int, top {kind}, back int")
        own = d.join(F.broadcast(names), "bucket")  # a row for each range: as many as 8 x partitions
        stay, back = F.struct(F.col("bucket"), F.lit(False).alias("copy")), F.struct(F.col("back").alias("bucket"), F.lit(True).alias("copy"))
        first = F.col("doc_id").eqNullSafe(F.col("top"))
        d = own.withColumn("to", F.explode(F.when(first, F.array(stay, back)).otherwise(F.array(stay))))
        d = d.select("doc_id", "text", "to.bucket", "to.copy")
    else:
        d = d.withColumn("copy", F.lit(False))
    d = d.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "copy", *order)

    names_out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, False  # the row that waits for its next one: (bucket, id, text, vector)
        out: list[list] = [[] for _ in names_out]
        id_type = None

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(out, types, strict=True)], names_out)
            for c in out:
                c.clear()
            return made

        for b in batches:
            id_type = b.schema.field(0).type
            for doc, text, bucket, copy in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and held[0] == bucket and not done:
                    mine = vector(text)
                    e = edited(held[2], text)
                    ev = vector(e) if e != held[2] else held[3]
                    for c, v in zip(out, (held[1], len(held[2]), hashlib.sha256(e.encode()).hexdigest(), pack(*held[3]), pack(*ev), likeness(held[3], ev), likeness(held[3], mine)), strict=True):
                        c.append(v)
                    # Of the copies (all rows of the tied first id) only the first follows.
                    held, done = (bucket, doc, text, mine), copy
                elif not copy:
                    held, done = (bucket, doc, text, vector(text)), False
            if len(out[0]) >= 512:
                yield flush()
        if out[0]:
            yield flush()

    return d.mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
