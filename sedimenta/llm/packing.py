"""Operator 9: best-two-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import Memo, documents
from sedimenta.session import settle

LENGTH = 2048
#: Pieces that one group of the packer holds (24 bytes each); a group wastes one sequence at most beside the method's own waste.
GROUP = 100_000
#: Words in one of the two generations that a worker remembers the ids of (about 200 bytes each).
WORDS = 500_000
#: Texts that a tokenizer which keeps or joins white space encodes otherwise than their words.
PROBES = ("a b", " a", "a ", "a  b", "a\nb", "Hello, world!\tx", "  12 3 ...\r\n(x) ", "\u00fcber\u00a0die \u2003 Stra\u00dfe", "the cat sat on the mat")
#: str.split() also splits at these four, which are not white space to the tokenizer.
NOT_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


class WordIds(Memo):
    """Ids of a word as little-endian bytes, looked up once per word and worker.

    Where the tokenizer drops white space and never joins what it separates
    (tried on PROBES), a text's ids are those of its words one after the
    other. With any other tokenizer whole texts are encoded.
    """

    def __init__(self, path: str, size: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(path).encode
        self.whole = lambda text: array("I", encode(text, add_special_tokens=False).ids).tobytes()
        super().__init__(self.whole, size)
        self.by_word = all(self.whole(x) == b"".join(map(self.whole, x.split())) for x in PROBES)

    def of(self, text: str) -> bytes:
        if not self.by_word:
            return self.whole(text)
        words = text.split() if not NOT_SPACE.search(text) else [w for w in SPACE.split(text) if w]
        return b"".join(map(self.__getitem__, words))


_loaded: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, size: int = WORDS) -> WordIds:
    if (path, size) not in _loaded:
        _loaded[path, size] = WordIds(path, size)
    return _loaded[path, size]


def pieces(df: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Cut each document's ids and the closing id 0 into pieces of ``length``; the last may be shorter. No shuffle."""
    d = documents(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer, words)
        for b in batches:
            rows: list[tuple] = []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = ids_of.of(text) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            at, k, start, n, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(n), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins.

    A bin is filled greedily, each time with the longest unpacked document that
    fits. If a gap stays, its smallest document is given back when two unpacked
    ones fill the gap that this leaves more tightly. Bits of one integer tell
    which lengths are left, so a step costs a shift and not a search.
    """
    stock: dict[int, list[int]] = defaultdict(list)
    for i in np.lexsort((-np.arange(len(lengths)), lengths)):
        stock[int(lengths[i])].append(int(i))
    left = 0
    for n in stock:
        left |= 1 << n

    def take(n: int) -> int:
        nonlocal left
        i = stock[n].pop()
        if not stock[n]:
            left &= ~(1 << n)
        return i

    def give(n: int, i: int) -> None:
        nonlocal left
        stock[n].append(i)
        left |= 1 << n

    def two(gap: int, over: int) -> tuple[int, int] | None:
        """The lengths a >= b left with the largest a + b <= gap, over ``over``."""
        best, found, a = over, None, (left & ((1 << gap) - 1)).bit_length() - 1
        while a > 0 and 2 * a > best:
            room = min(gap - a, a)
            b = (left & ((1 << (room + 1)) - 1)).bit_length() - 1
            if b == a and len(stock[a]) < 2:
                b = (left & ((1 << a) - 1)).bit_length() - 1 if a else -1
            if b > 0 and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
            a = (left & ((1 << a) - 1)).bit_length() - 1
        return found

    bins, offsets, n_bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while left:
        held, gap = [], capacity
        while gap and (n := (left & ((1 << (gap + 1)) - 1)).bit_length() - 1) > 0:
            held.append((n, take(n)))
            gap -= n
        if gap and left:
            n, i = held[-1]  # they come in falling order: the last is the smallest
            pair = two(gap + n, n)
            if pair:
                held.pop()
                held += [(m, take(m)) for m in pair]
                give(n, i)
        at = 0
        for n, i in held:
            bins[i], offsets[i] = n_bins, at
            at += n
        n_bins += 1
    return bins, offsets, n_bins


def pack(df: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Pack all documents into as few sequences of ``length`` tokens as best-two-fit finds.

    Texts are tokenised once and only lengths and checksums move on. Pieces
    that fill a sequence take one each, without any shuffle. The others are
    dealt by a hash of the document and piece to groups of about ``group``
    rows, each packed on its own, so no task holds more as the corpus grows
    and no source or id can crowd one. ``words`` bounds what a worker remembers.

    Null text counts as empty and gives the closing id alone. Repeated rows are
    packed as often as they come. A null id stays null; an empty table gives no
    rows. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    cut = settle(pieces(df, tokenizer, length, id_col, text_col, words), "pieces")
    whole = cut.where(F.col("length") == length)
    rest = cut.where(F.col("length") < length)
    n = rest.count()
    groups = max(1, -(-n // group))
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    names = cut.columns

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], kind="stable", ignore_index=True)
        bins, offsets, _ = best_two_fit(rows["length"].to_numpy(), length)
        # Packed sequences have even numbers, whole ones odd.
        return rows[names].assign(sequence_id=2 * ((int(key[0]) << 40) + bins), offset=offsets)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    packed = dealt.groupBy("g").applyInPandas(run, schema)
    alone = whole.withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("bigint"))
    return packed.unionByName(alone)
