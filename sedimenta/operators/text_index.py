"""A stored full-text index: postings in blocks with score bounds, segments that are appended, and an exact top-k that skips blocks by their bounds."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.config import DEFAULTS
from sedimenta.operators.lexical import top
from sedimenta.session import exists, settle, unsettle

#: Hash buckets of terms, each a folder of Parquet files: a query opens those of its terms.
BUCKETS = 64
#: Texts of a band, about; a block is what one term has in one band.
BAND = 128
#: Bands hold texts of lengths within this factor, so that a block's largest count and least length bound its scores closely.
WITHIN = 1.25
#: Groups of texts by their commonest term, so that a band's texts share their vocabulary.
KINDS = 16
#: Scores are rounded to six places, and so may exceed their bound by this.
ROUNDING = 1e-6


@dataclass(frozen=True)
class TextIndex:
    """An index under ``path``, a folder that all executors reach.

    Folders are named ``s_`` and the segment's name. ``postings/segment=/bucket=``: a row a block (``term``, ``band``, number of
    postings, largest count, least length, and arrays of the texts' numbers,
    counts and lengths), sorted by term. ``texts/segment=``: of each text its
    number in the segment, band, id, length and the ``payload`` columns, sorted by
    band; a posting carries the number alone, and what is found is named at the
    end. ``stats/segment=``: number and total length of
    its texts, written last: a segment counts once that is there, so a
    build that was cut off leaves nothing behind that is read.
    """

    spark: SparkSession
    path: str
    payload: tuple[str, ...] = ()
    buckets: int = BUCKETS

    def committed(self) -> list[tuple[str, int, int]]:
        """Name, number of texts and their total length of the segments that are complete."""
        if not exists(self.spark, f"{self.path}/stats"):
            return []
        stats = self.spark.read.schema("texts long, total long, segment string").parquet(f"{self.path}/stats")
        return sorted((r["segment"][2:], r["texts"], r["total"]) for r in stats.collect())

    def segments(self) -> list[str]:
        return [name for name, _, _ in self.committed()]

    def append(self, postings: DataFrame, segment: str, id_col: str = "chunk_id") -> None:
        """Index the texts of ``postings`` (``id_col``, ``term``, ``tf`` and the payload) as one more segment.

        A segment that is complete is left as it is, and one that is not is
        written anew, so repeating an append is safe. Texts whose id the index
        has are left out. Rows without id or term, or with a count under one,
        say nothing. All rows of a text must have the same payload.
        """
        if segment in self.segments():
            return
        p = postings.select(F.col(id_col).alias("id"), "term", F.col("tf").cast("long").alias("tf"), *self.payload).where("id is not null and term is not null and tf > 0")
        p = p.groupBy("id", "term", *self.payload).agg(F.sum("tf").alias("tf"))
        self.append_texts(p.groupBy("id", *self.payload).agg(F.collect_list(F.struct("term", "tf")).alias("terms")), segment)

    def append_texts(self, texts: DataFrame, segment: str) -> None:
        """As ``append``, of one row a text: ``id``, ``terms`` (array of term and tf, each term once) and the payload.

        Postings are shuffled once, by a share of the buckets and a part of the
        bands, so that a frequent term's blocks fall to several tasks. A text
        sends each share one row of arrays, which is far less than a row a posting.
        """
        done = self.segments()
        if segment in done:
            return
        if done:
            known = self.spark.read.parquet(f"{self.path}/texts").where(F.col("segment").isin([f"s_{x}" for x in done])).select("id")
            texts = texts.join(known, "id", "left_anti")
        add = lambda s, x: s + x["tf"]
        commonest = F.array_max(F.transform("terms", lambda x: F.struct(x["tf"].alias("tf"), x["term"].alias("term"))))["term"]
        t = texts.where(F.col("id").isNotNull() & (F.size("terms") > 0)).select("id", *self.payload, "terms", F.aggregate("terms", F.lit(0).cast("long"), add).alias("dl"), commonest.alias("commonest"))
        size = F.floor(F.log(F.col("dl").cast("double")) / math.log(WITHIN))
        kind = size * KINDS + F.pmod(F.crc32(F.col("commonest").cast("binary")), F.lit(KINDS))
        t = settle(t.select(F.monotonically_increasing_id().alias("no"), "id", *self.payload, "terms", "dl", kind.alias("kind")), "texts", "zstd")  # written, so numbers stay
        sizes = t.groupBy("kind").agg(F.greatest(F.ceil(F.count("*") / BAND), F.lit(1)).alias("parts"))  # a row a kind: some hundreds, however many texts
        banded = t.join(F.broadcast(sizes), "kind").withColumn("band", F.col("kind") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts")))
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shares = min(self.buckets, max(8, tasks // 4))
        deal = F.pmod(F.xxhash64("band"), F.lit(max(1, 2 * tasks // shares)))
        p = banded.select("no", "dl", "band", deal.alias("deal"), F.explode(self._shares("terms", shares)).alias("x"))
        p = p.select("no", "dl", "band", "deal", "x.share", "x.terms", "x.tfs").repartition(tasks, "share", "deal")
        p = p.select("no", "dl", "band", "share", "deal", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("no", "dl", "band", "share", "deal", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"), self._bucket(F.col("x.terms")).alias("bucket"))
        each = F.sort_array(F.collect_list(F.struct("no", "tf", "dl")))
        blocks = p.groupBy("share", "deal", "bucket", "term", "band").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"), each.alias("e"))
        arrays = [F.col(f"e.{c}").alias(f"{c}s") for c in ("no", "tf", "dl")]
        flat = blocks.select("bucket", "term", "band", "n", "most", "least", *arrays).sortWithinPartitions("bucket", "term", "band")
        flat.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment=s_{segment}")
        named = banded.select("no", "band", "id", "dl", *self.payload).sortWithinPartitions("band", "no")
        named.write.mode("overwrite").parquet(f"{self.path}/texts/segment=s_{segment}")
        total = t.agg(F.count("*").alias("texts"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/segment=s_{segment}")
        unsettle(t)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(term.cast("binary")), F.lit(self.buckets)).cast("int")

    def _shares(self, terms: str, shares: int) -> Column:
        """Array of (share, terms, tfs) of a text's terms: sorted by share, and cut where it changes."""
        let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
        placed = F.array_sort(F.transform(terms, lambda x: F.struct((self._bucket(x["term"]) % shares).alias("share"), x["term"].alias("term"), x["tf"].cast("long").alias("tf"))))
        starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["share"] != F.get(s, i - 1)["share"]))

        def cut(s: Column, a: Column, p: Column, j: Column) -> Column:
            part = F.slice(s, p + 1, F.coalesce(F.get(a, j + 1), F.size(s)) - p)
            return F.struct(F.get(s, p)["share"].alias("share"), part["term"].alias("terms"), part["tf"].alias("tfs"))

        return let(placed, lambda s: let(starts(s), lambda a: F.transform(a, lambda p, j: cut(s, a, p, j))))

    def blocks(self, terms: Sequence[str] | None = None, segments: Sequence[str] | None = None) -> DataFrame | None:
        """Blocks of the given terms, or of all; only the folders of these terms' buckets are opened. None if there is none."""
        at = [f"{self.path}/postings/segment=s_{x}" for x in (self.segments() if segments is None else segments)]
        if terms is not None:
            at = [f"{x}/bucket={i}" for x in at for i in sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})]
        at = [x for x in at if exists(self.spark, x)]
        if not at:
            return None
        b = self.spark.read.option("basePath", f"{self.path}/postings").parquet(*at)
        return b if terms is None else b.where(F.col("term").isin(list(terms)))

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """``id``, ``term``, ``tf``, ``dl`` and the payload of every posting, back from the blocks."""
        blocks = self.blocks(terms)
        return self._nothing().select("id", F.lit("").alias("term"), F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("dl"), *self.payload) if blocks is None else self.opened(blocks)

    def opened(self, blocks: DataFrame) -> DataFrame:
        """A row a posting of some of the index's blocks, with its text's id and payload."""
        return self._named(self._numbered(blocks)).select("id", "term", "tf", "dl", *self.payload)

    def _numbered(self, blocks: DataFrame) -> DataFrame:
        """A row a posting of some of the index's blocks: its segment, its text's number there, ``term``, ``tf`` and ``dl``."""
        arrays = [F.col(f"{c}s").alias(c) for c in ("no", "tf", "dl")]
        return blocks.select("segment", "term", F.explode(F.arrays_zip(*arrays)).alias("x")).select("segment", "x.no", "term", "x.tf", "x.dl")

    def _named(self, numbered: DataFrame) -> DataFrame:
        """Rows with ``segment`` and ``no``, and the id and payload of these texts."""
        texts = self.spark.read.parquet(f"{self.path}/texts").select("segment", "no", "id", *self.payload)
        return numbered.join(texts, ["segment", "no"])

    def search(self, query: Sequence[str], k: int, per: str | None = None, k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> DataFrame:
        """The ``k`` best texts by BM25: ``id``, ``score`` (six places), the payload, ``rank`` from 1; ties go to the smaller id.

        ``per``: a payload column of which each value counts once, with its
        best text; it then takes the place of the id, in ties too.

        Exact. The counts, largest counts and least lengths of blocks give
        every band a bound; the ``k`` bands of the largest bounds are scored
        first, and then only those whose bound reaches the ``k``-th score
        found there. Query terms repeat to no effect. An empty query,
        unknown terms and an empty index give no rows.
        """
        bands = self._bounds(query, k1, b)
        if bands is None:
            return self._top(self._nothing(), k, per)
        blocks, part, bound = bands
        first = bound.orderBy(F.desc("bound"), "segment", "band").limit(k)
        scored = self._scores(blocks.join(F.broadcast(first.select("segment", "band")), ["segment", "band"]), part)
        found = self._top(scored, k, per).collect()
        least = None
        if len(found) >= k:
            least = found[-1]["score"]
            bound = bound.where(F.col("bound") + ROUNDING >= least)
        return self._top(self._scores(blocks.join(bound.select("segment", "band"), ["segment", "band"]), part, least), k, per)

    def scores(self, query: Sequence[str], k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> DataFrame:
        """``id``, ``score`` and the payload of every text that holds a term of the query."""
        bands = self._bounds(query, k1, b)
        return self._nothing() if bands is None else self._scores(bands[0], bands[1])

    def _nothing(self) -> DataFrame:
        cols = [F.lit(None).cast("string").alias(c) for c in ("id", *self.payload)]
        return self.spark.range(0).select(cols[0], F.lit(0.0).alias("score"), *cols[1:])

    def _bounds(self, query: Sequence[str], k1: float, b: float):
        """The query's blocks, the column that scores a posting, and each band's bound; None if nothing matches."""
        terms, there = sorted(set(query)), self.committed()
        blocks = self.blocks(terms, [name for name, _, _ in there]) if terms else None
        if blocks is None:
            return None
        n, total = sum(x for _, x, _ in there), sum(x for _, _, x in there)
        df = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row for each of the query's terms
        if not df:
            return None
        idf = F.element_at(F.create_map(*[F.lit(x) for t, d in sorted(df.items()) for x in (t, math.log(1 + (n - d + 0.5) / (d + 0.5)))]), F.col("term"))

        def part(tf: Column, dl: Column) -> Column:
            return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (total / n)))

        return blocks, part, blocks.groupBy("segment", "band").agg(F.sum(part(F.col("most"), F.col("least"))).alias("bound"))

    def _scores(self, blocks: DataFrame, part, least: float | None = None) -> DataFrame:
        """Scores of the blocks' texts, of those that reach ``least`` if given; only these are named. All blocks of a band are there, so a band's texts are whole."""
        scored = self._numbered(blocks).groupBy("segment", "no").agg(F.round(F.sum(part(F.col("tf"), F.col("dl"))), 6).alias("score"))
        return self._named(scored if least is None else scored.where(F.col("score") >= least)).select("id", *self.payload, "score")

    def _top(self, scored: DataFrame, k: int, per: str | None) -> DataFrame:
        return top(scored.groupBy(per).agg(F.max("score").alias("score")), k, per) if per else top(scored, k, "id")
