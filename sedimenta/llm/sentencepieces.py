"""Operator 3: SentencePiece encoding and decoding by Aho-Corasick and Viterbi."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sedimenta.llm.common import documents

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs below the lowest piece score, as the library has it.
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers the ids of.
WORDS = 300_000
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffers message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, raw[at : at + n]
        at += n


class Pieces:
    """A model file's pieces and scores, the automaton over them, and encoding by the best path.

    A unigram model's scores are taken as they are. Those of a merge (BPE)
    model are ranks and no log-probabilities, which a best path could add up;
    its pieces get Zipf's law over that rank, -ln(1 + rank), instead.

    Supported are models whose normaliser is the identity (the white space
    options apart); others are refused, for their results would differ.
    """

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix = self.squeeze = self.escape = True
        self.bytes_of: dict[int, int] = {}
        self.unk = 0
        charsmap, model_type = b"", UNIGRAM
        for number, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                model_type = next((v for k, v in _fields(value) if k == 3), model_type)
            elif number == 3:
                for k, v in _fields(value):
                    if k == 2:
                        charsmap = v
                    elif k == 3:
                        self.dummy_prefix = bool(v)
                    elif k == 4:
                        self.squeeze = bool(v)
                    elif k == 5:
                        self.escape = bool(v)
        if charsmap:
            raise ValueError("only models with the identity normaliser are supported")
        if model_type == BPE:
            self.scores = [-math.log1p(-s) if k == NORMAL and s < 0 else s for s, k in zip(self.scores, self.kinds, strict=True)]
        self.automaton = ahocorasick.Automaton()
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == BYTE:
                self.bytes_of[int(p[1:-1], 16)] = i
            elif k == UNKNOWN:
                self.unk = i
            elif k in (NORMAL, USER) and p:
                self.automaton.add_word(p, (len(p), self.scores[i], i))
        self.automaton.make_automaton()
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL]
        self.unk_score = (min(normal) if normal else 0.0) - UNKNOWN_PENALTY
        # A piece that goes on past the start of a word would tie words together.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER)) and USER not in self.kinds
        self.known: dict[str, tuple[int, ...]] = {}

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def best_path(self, text: str) -> list[int]:
        """Ids on the best path over ``text``, one pass: each output link of the automaton relaxes its end."""
        n, low = len(text), float("-inf")
        best, back = [0.0] + [low] * n, [(0, -1)] * (n + 1)
        found = self.automaton.iter(text)
        nxt = next(found, None)
        for end in range(1, n + 1):
            single = False
            while nxt is not None and nxt[0] == end - 1:
                size, score, i = nxt[1]
                single |= size == 1
                value = best[end - size] + score
                # Of equal sums the longer last piece wins, which the automaton gives first.
                if value > best[end]:
                    best[end], back[end] = value, (end - size, i)
                nxt = next(found, None)
            if not single and best[end - 1] + self.unk_score > best[end]:
                best[end], back[end] = best[end - 1] + self.unk_score, (end - 1, -1)
        ids: list[int] = []
        at = n
        last_unknown = False
        while at:
            start, i = back[at]
            if i >= 0:
                ids.append(i)
            elif self.bytes_of:
                ids += [self.bytes_of[b] for b in reversed(text[start:at].encode())]
            elif not last_unknown:  # neighbouring unknown characters are one id
                ids.append(self.unk)
            last_unknown = i < 0
            at = start
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        text = self.normalize(text)
        if not self.by_word or not self.bytes_of:
            return self.best_path(text) if text else []
        known, out = self.known, []
        for word in CHUNK.findall(text):
            ids = known.get(word)
            if ids is None:
                if len(known) >= WORDS:
                    known.clear()
                ids = known[word] = tuple(self.best_path(word))
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        out = bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                out.append(int(self.pieces[i][1:-1], 16))
            elif kind == UNKNOWN:
                out += " ⁇ ".encode()
            elif kind != CONTROL:
                out += self.pieces[i].encode()
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = Pieces(f.read())
    return _loaded[path]


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int) of every whole text. Null and empty texts: no ids. No shuffle.

    ``model`` is the path of a SentencePiece model that every executor has.
    """
    d = documents(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            ids = pa.array([m.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``text`` of every array of ids; null ids give an empty text. No shuffle."""
    d = df.select(df[id_col].alias("doc_id"), df[ids_col].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            text = pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text], ["doc_id", "text"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string")


def digest(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_ids``, ``ids_crc32`` (little-endian 32-bit ids), ``same`` (decoding gives the text again)."""
    d = documents(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            n, crc, same = [], [], []
            for t in b.column(1).to_pylist():
                ids = m.encode(t)
                n.append(len(ids))
                crc.append(zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
                same.append(m.decode(ids) == t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "same"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_ids bigint, ids_crc32 bigint, same boolean")
