"""Operator 11: compression of vectors to codes by delta-maintained Lloyd rounds in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import small_batches
from sedimenta.session import settle, unsettle

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Whole numbers up to this are multiplied as doubles, which is exact for vectors of up to 512 components; others as 64-bit integers.
EXACT = 1 << 22
#: Rows among which the first ones by id are sorted; larger tables are first cut at quantiles of their ids.
FEW = 20_000
#: A label with more than one in so many rows has its sum sent to every task; there are at most so many of these.
SHARE = 1000
STATE = "vec_id {id}, label {label}, q array<int>, old array<int>, code array<int>, error bigint"


@dataclass
class Codebooks:
    """For each part its entries as rows of whole numbers; ``starts`` are the bounds of the parts."""

    starts: list[int]
    books: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components as decimal numbers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def whole(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label``, ``q``: every usable vector as the floors of its components times ``scale``.

    Null and empty vectors and those with null or non-finite components take
    no part, nor do those with a whole number over 2^27 (its squared
    distances would not fit into a long).
    """
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale <= 1 << 27)
    v = F.col(vector_col).cast("array<double>")
    return df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine)).select(
        F.col(id_col).alias("vec_id"), label.alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("int")).alias("q")
    )


def first_rows(rows: DataFrame, n: int) -> list[list[int]]:
    """The vectors of the ``n`` smallest ids, ascending; ties by the vector, null ids never.

    Tables of many rows are cut at a quantile of the ids until few are left,
    so that no task and not the driver sorts them.
    """
    low = rows.where(F.col("vec_id").isNotNull())
    count = low.count()
    while count > max(FEW, 4 * n) and dict(low.dtypes)["vec_id"] in ("tinyint", "smallint", "int", "bigint"):
        cut = low.agg(F.percentile_approx("vec_id", min(0.5, 2.0 * n / count), 10_000).alias("c")).first()["c"]
        lower = low.where(F.col("vec_id") <= cut)
        left = lower.count()
        if left < n or left == count:
            break
        low, count = lower, left
    return [r["q"] for r in low.orderBy("vec_id", "q").limit(n).collect()]


def start(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The first codebooks: parts of the vectors with the smallest ids; None of an empty table.

    The length of vectors is that of the smallest id's. A length that
    ``parts`` does not divide gives the first parts one component more.
    """
    first = first_rows(rows, entries)
    if not first:
        return None
    width = len(first[0])
    x = np.array([v for v in first if len(v) == width], np.int64)
    sizes = [len(p) for p in np.array_split(np.arange(width), parts)]
    starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return Codebooks(starts, [x[:, a:b].copy() for a, b in zip(starts, starts[1:])])


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, both exact; ties to the lower index."""
    small = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) <= EXACT
    x, book = (x.astype(np.float64), book.astype(np.float64)) if small else (x, book)
    at = (book**2).sum(axis=1) - 2 * (x @ book.T)
    best = at.argmin(axis=1)
    return best.astype(np.int32), ((x**2).sum(axis=1) + at[np.arange(len(x)), best]).astype(np.int64)


def assign(state: DataFrame, books: Codebooks) -> DataFrame:
    """Each row with its codes, its codes before (``old``, null in the first round) and its squared distance to the entries chosen."""
    small_batches(state.sparkSession)
    schema = STATE.format(**{"id": dict(state.dtypes)["vec_id"], "label": dict(state.dtypes)["label"]})
    width, starts = books.starts[-1], books.starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.schema.get_field_index("q")).flatten().to_numpy().astype(np.int64).reshape(-1, width)
            got = [nearest(x[:, s:e], book) for s, e, book in zip(starts, starts[1:], books.books)]
            codes, error = np.stack([c for c, _ in got], axis=1), sum(e for _, e in got)
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel(), pa.int32()))
            at = {f: b.column(b.schema.get_field_index(f)) for f in ("vec_id", "label", "q", "old")}
            yield pa.RecordBatch.from_arrays([*at.values(), code, pa.array(error, pa.int64())], ["vec_id", "label", "q", "old", "code", "error"])

    rows = state.where(F.size("q") == width).select("vec_id", "label", "q", (F.col("code") if "code" in state.columns else F.lit(None).cast("array<int>")).alias("old"))
    return rows.mapInArrow(run, schema)


def contributions(state: DataFrame, books: Codebooks) -> DataFrame:
    """``part``, ``entry``, ``n``, ``total``: what parts with a new assignment add to their entry, less what they leave behind at the old one.

    Tasks add up their own rows first, so that at most parts x entries rows
    of each are shuffled, however many vectors meet at one entry.
    """
    widths = [b - a for a, b in zip(books.starts, books.starts[1:])]
    pick = lambda arr, p: F.element_at(F.lit(arr) if isinstance(arr, list) else arr, p + 1)
    part = F.explode(F.filter(F.lit(list(range(len(widths)))), lambda p: F.col("old").isNull() | (pick(F.col("old"), p) != pick(F.col("code"), p))))
    moved = state.select("q", "old", "code", part.alias("part"))
    side = lambda arr, sign: F.struct(pick(F.col(arr), F.col("part")).alias("entry"), F.lit(sign).alias("sign"))
    piece = F.slice("q", pick(books.starts[:-1], F.col("part")) + 1, pick(widths, F.col("part")))
    signed = moved.select("part", piece.alias("x"), F.explode(F.filter(F.array(side("code", 1), side("old", -1)), lambda s: s["entry"].isNotNull())).alias("s"))
    add = lambda i: F.coalesce(F.sum(F.get("x", F.lit(i)).cast("long") * F.col("s.sign")), F.lit(0).cast("long"))
    return signed.groupBy("part", F.col("s.entry").alias("entry")).agg(F.sum(F.col("s.sign").cast("long")).alias("n"), F.array(*[add(i) for i in range(max(widths))]).alias("total"))


def moved_to(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Every entry at the floor of its parts' mean; one without parts stays. The driver reads one row an entry."""
    new = [b.copy() for b in books.books]
    for r in sums.where(F.col("n") > 0).collect():
        w = new[r["part"]].shape[1]
        new[r["part"]][r["entry"]] = [t // r["n"] for t in r["total"][:w]]
    return Codebooks(books.starts, new)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame] | None:
    """Codebooks after ``rounds`` rounds, and the rows of ``whole`` with their last codes before the final assignment; None of an empty table.

    A round reads the table that the last one wrote (vectors and their codes),
    writes it with the new codes, and adds the contributions of the parts that
    moved to the running sums, a written table too: a lost executor repeats
    its part of one round. Tables of finished rounds are removed. Once no part
    moves, the sums and so all later rounds stay as they are, and the rest is skipped.
    """
    books = start(rows, parts, entries)
    if books is None:
        return None
    state, sums = rows, None
    for _ in range(rounds):
        before, state = state, settle(assign(state, books), "codes")
        delta = contributions(state, books)
        if sums is not None:
            each = F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(max(b.shape[1] for b in books.books))])
            delta = sums.unionByName(delta).groupBy("part", "entry").agg(F.sum("n").alias("n"), each.alias("total"))
        old, sums = sums, settle(delta, "sums")
        books = moved_to(books, sums)
        unsettle(*[t for t in (before, old) if t is not None])
        still = F.col("old").isNotNull() & (F.col("old") == F.col("code"))
        if state.where(~still).isEmpty():
            break
    unsettle(sums)
    return books, state


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``label_error`` added: the errors of all rows of one label summed, null labels together.

    Sums of labels that hold over a thousandth of all rows (a thousand labels
    at most) are sent to every task; the rows of the others, a thousandth a
    label at most, meet theirs in a join.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    total = coded.count()
    known = F.struct("label").alias("known")  # never null itself, so that null labels are told from missing ones
    heavy = sums.where(F.col("rows") * SHARE > total).select(known, F.col("label_error").alias("heavy_error"))
    light = sums.where(F.col("rows") * SHARE <= total).select(known, F.col("label_error").alias("light_error"))
    hit = coded.withColumn("known", F.struct("label")).join(F.broadcast(heavy), "known", "left")
    done = hit.where(F.col("heavy_error").isNotNull()).withColumn("label_error", F.col("heavy_error"))
    rest = hit.where(F.col("heavy_error").isNull()).join(light, "known").withColumn("label_error", F.col("light_error")).drop("light_error")
    return done.unionByName(rest).drop("known", "heavy_error")


def hex_code(code: Column) -> Column:
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """``vec_id``, ``code`` (two hex digits a part), ``error``, ``label_error``, ``codebooks_sha256`` of every usable vector.

    Vectors left out: those ``whole`` names, and those of another length than
    the smallest id's. Null ids are coded but never start an entry, repeated
    rows count each time, fewer rows than entries make a smaller codebook, a
    table that is empty or has null ids only gives an empty result, extra
    columns are never read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = settle(whole(df, id_col, vector_col, label_col), "whole")
    got = fit(rows, parts, entries, rounds)
    if got is None:
        return rows.where(F.lit(False)).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books, state = got
    coded = settle(assign(state, books).select("vec_id", "label", "code", "error"), "coded")
    unsettle(state)
    return with_label_errors(coded).select("vec_id", hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL: every round assigns every part anew and takes full means. Ids must not repeat and ``parts`` must divide the length."""
    nearest = lambda r: f"""near{r} as materialized (select vec_id, part, min(d * {entries} + entry) best from (
  select vec_id, x.part, entry, sum((v - c) * (v - c)) d from comp x join book{r} b on x.part = b.part and x.pos = b.pos group by 1, 2, 3) group by 1, 2)"""  # noqa: E731
    update = lambda r: f"""book{r} as materialized (select o.part, o.entry, o.pos, coalesce(m, c) c from book{r - 1} o left join (
  select x.part, best % {entries} entry, pos, floor(sum(v) / count(*))::bigint m from comp x join near{r - 1} n on x.vec_id = n.vec_id and x.part = n.part group by 1, 2, 3) u
  on o.part = u.part and o.entry = u.entry and o.pos = u.pos)"""  # noqa: E731
    turns = ",\n".join(f"{nearest(r - 1)},\n{update(r)}" for r in range(1, rounds + 1))
    return f"""
with rows_of as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) q from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
comp as materialized (select vec_id, (i - 1) // (w // {parts}) part, (i - 1) % (w // {parts}) pos, v from (select vec_id, len(q) w, unnest(q) v, generate_subscripts(q, 1) i from rows_of)),
first_ids as (select vec_id, row_number() over (order by vec_id) - 1 entry from rows_of qualify entry < {entries}),
book0 as materialized (select part, entry, pos, v c from comp join first_ids using (vec_id)),
{turns},
{nearest(rounds)},
coded as (select vec_id, string_agg(printf('%02x', (best % {entries})::int), '' order by part) code, sum(best // {entries})::bigint error from near{rounds} group by 1)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error,
  (select sha256(string_agg(c::varchar, ',' order by part, entry, pos)) from book{rounds}) codebooks_sha256
from coded join rows_of using (vec_id)
"""
