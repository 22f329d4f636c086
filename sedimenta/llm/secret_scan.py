"""Operator 1: secret scans by fixed patterns and two character Markov models. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import by_hash, documents

KEY = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEY + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A shorter run never matches, and a longer one matches from its start, as with "+" and a filter after it.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "(?<![0-9a-f])[0-9a-f]{24,}"
#: Least lengths of an assignment's value and of a token that the models judge.
VALUE, TOKEN = 6, 20
KINDS = ("assign", "access", "hex", "markov")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Symbols of the models: those above, and 0 for any other.
N = len(SYMBOLS) + 1
#: Log-likelihood ratio from which a token counts as random: odds of a thousand to one against.
RATIO = math.log(1000)
BLOCK = 256
REDACTED = "[secret]"
#: Spans of a text that are replaced in one piece of it.
FEW = 64

# Parts of ordinary identifiers, from which labelled samples are made.
PARTS = (
    "get set add remove update delete create find load save read write open close start stop run build make parse format print send receive user name "
    "account order item list table index value count total size length width height color style text label title page link image file path folder data "
    "base cache queue stack node tree graph edge field column row record event handler listener manager service client server request response session "
    "config option default global local public private static final abstract interface module package import export test example sample main next previous "
    "first last current customer product invoice payment address country language message number string integer double boolean array object function method "
    "class property attribute element document window button input output stream buffer thread process task job worker pool connection database query result "
    "gesellschaft arbeit verwaltung sicherheit zeitung wirtschaft schiff fahrt donau dampf kraft werk stadt land haus recht schutz versicherung entwicklung forschung "
    "desarrollo trabajo ciudad gobierno empresa servicio conocimiento investigacion administracion responsabilidad gouvernement entreprise developpement travail ville "
    "connaissance recherche responsabilite internationalisation communication"
)
#: Documents whose words teach the ordinary class at most, and the least letters of such a word.
WORDS_FROM, WORD = 500, 8


def samples(spark: SparkSession, rows: int = 4000, first: int = 0) -> DataFrame:
    """Labelled tokens to train on: ``token``, ``random`` (true or false), ``kind``.

    Random ones are digests in base 64, hexadecimal and upper case; ordinary
    ones join two to four parts as identifiers and compounds do, or repeat one
    character. All follow from row numbers, so that every run learns the
    same; rows from another ``first`` number are others.
    """
    words = F.split(F.lit(PARTS), " ")
    h = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    part = lambda salt: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(salt)), F.size(words)) + 1).cast("int"))
    number = lambda n: F.pmod(F.col("id"), F.lit(n)).cast("string")
    a, b, c, d = part("a"), part("b"), part("c"), part("d")
    random = {
        "base64": F.substring(F.base64(F.unhex(h("s"))), 1, 40), "hex": F.substring(h("x"), 1, 40), "url": F.substring(F.translate(F.base64(F.unhex(h("u"))), "+/=", "-_"), 1, 32),
        "upper": F.substring(F.translate(F.upper(F.base64(F.unhex(h("k")))), "+/=", "XYZ"), 1, 24),
    }
    ordinary = {
        "snake": F.concat_ws("_", a, b, c), "camel": F.concat(a, F.initcap(b), F.initcap(c), F.initcap(d)), "kebab": F.concat_ws("-", a, b, c, d), "constant": F.upper(F.concat_ws("_", a, b, c)),
        "compound": F.concat(a, b, c), "path": F.concat_ws("/", a, b, c, number(1000)), "numbered": F.concat(F.initcap(d), F.initcap(a), number(100)),
        "dated": F.concat(F.lpad(number(2100), 4, "0"), F.lit("-"), F.lpad(number(12), 2, "0"), F.lit("-"), F.lpad(number(28), 2, "0"), F.lit("-"), a),
        "padded": F.concat(F.repeat(F.substring(a, 1, 1), 12), F.repeat(F.lit("="), 8)), "run": F.repeat(F.substring(F.lit(SYMBOLS), F.pmod(F.col("id"), F.lit(len(SYMBOLS))).cast("int") + 1, F.lit(1)), 24),
    }
    rows_of = lambda kinds, label: [F.struct(t.alias("token"), F.lit(label).alias("random"), F.lit(k).alias("kind")) for k, t in kinds.items()]
    return spark.range(first, first + rows).select(F.inline(F.array(*rows_of(random, True), *rows_of(ordinary, False))))


def corpus_words(df: DataFrame, bound: int = WORDS_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ordinary tokens of the corpus itself: words of letters only that stand in no fixed pattern, from at most ``bound`` documents.

    The documents are chosen by a hash of their id, so that the letters of
    every language count. Columns as those of ``samples``.
    """
    d = by_hash(documents(df, id_col, text_col), bound, "doc_id")
    plain = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    word = F.explode(F.regexp_extract_all(plain, F.lit(f"(?<![A-Za-z0-9+/_=-])[A-Za-z]{{{WORD},}}(?![A-Za-z0-9+/_=-])"), F.lit(0)))
    return d.select(word.alias("token")).select("token", F.lit(False).alias("random"), F.lit("word").alias("kind"))


def trained(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The models of ``samples`` and of the corpus's own words."""
    return train(samples(df.sparkSession).unionByName(corpus_words(df, id_col=id_col, text_col=text_col)))


@dataclass
class Model:
    """For each pair of symbols (row first, column next) the log ratio of its chance in random and in ordinary tokens."""

    ratios: list[float]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _symbols(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(SYMBOLS), c)))


def train(labelled: DataFrame, token_col: str = "token", random_col: str = "random") -> Model:
    """Count the steps from symbol to symbol in both classes of labelled tokens and compare their chances.

    Null tokens or labels teach nothing; unseen steps get half a count. The
    driver gets one row a pair of symbols and class, however many tokens.
    """
    ix = labelled.where(F.col(token_col).isNotNull() & F.col(random_col).isNotNull()).select(F.col(random_col).alias("r"), _symbols(F.col(token_col)).alias("ix"))
    steps = F.zip_with(F.slice("ix", 1, F.greatest(F.size("ix") - 1, F.lit(0))), F.slice("ix", 2, F.greatest(F.size("ix") - 1, F.lit(0))), lambda a, b: a * N + b)
    seen = ix.select("r", F.explode(steps).alias("step")).groupBy("r", "step").count().collect()
    n = {True: [0.5] * (N * N), False: [0.5] * (N * N)}
    for row in seen:
        n[row["r"]][row["step"]] += row["count"]
    ratios = []
    for a in range(N):
        t, f = (sum(n[k][a * N : (a + 1) * N]) for k in (True, False))
        ratios += [math.log(n[True][a * N + b] / t) - math.log(n[False][a * N + b] / f) for b in range(N)]
    return Model(ratios)


def likelihood_ratio(token: Column, model: Model) -> Column:
    """How much likelier, as a logarithm, a token is under the model of random strings."""
    table = F.split(F.lit(" ".join(f"{x:.6f}" for x in model.ratios)), " ").cast("array<double>")  # folded once
    total = lambda ix: F.aggregate(
        F.zip_with(F.slice(ix, 1, F.size(ix) - 1), F.slice(ix, 2, F.size(ix) - 1), lambda a, b: F.element_at(table, (a * N + b + 1).cast("int"))), F.lit(0.0), lambda s, x: s + x
    )
    return _let(_symbols(token), total)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, hit) of a pattern's matches, in order.

    What lies between matches comes from a split; a match starts where the
    lengths of all pieces and matches before it add up to. The sums are taken
    in two levels of blocks, so that a text with many matches costs little.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(h: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(h)), F.char_length)
        steps = F.zip_with(gaps, h, lambda g, x: F.struct(g.alias("gap"), x.alias("hit"), (g + F.char_length(x)).alias("step")))
        blocks = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: F.slice(s, b * BLOCK + 1, BLOCK))
        plus = lambda arr: F.aggregate(arr, F.lit(0), lambda s, x: s + x)
        step_sum = lambda arr: F.aggregate(arr, F.lit(0), lambda s, x: s + x["step"])

        def from_blocks(bs: Column) -> Column:
            return _let(
                F.transform(bs, step_sum),
                lambda sums: F.flatten(
                    F.transform(
                        bs,
                        lambda b, i: _let(
                            plus(F.slice(sums, 1, i)),
                            lambda base: F.transform(
                                b,
                                lambda x, k: _let(
                                    base + step_sum(F.slice(b, 1, k)) + x["gap"],
                                    lambda at: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.char_length(x["hit"])).alias("end"), x["hit"].alias("hit")),
                                ),
                            ),
                        ),
                    )
                ),
            )

        return _let(_let(steps, blocks), from_blocks)

    none = F.array().cast("array<struct<start:int,kind:int,end:int,hit:string>>")
    return _let(hits, lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(none))


def found(text: Column, model: Model, ratio: float = RATIO) -> Column:
    """Array of (start, kind, end, hit) by start, then kind; code points, end exclusive.

    Kinds 0 to 2 are the fixed patterns (assignments whose value is too short
    are dropped after matching, as they still use up their text); kind 3 are
    tokens of at least 20 characters that are likelier random than ordinary by
    ``ratio``, outside assignments and not holding a match of another kind.
    """
    value = lambda s: F.char_length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= VALUE
    token = f"(?:{ASSIGN.replace('([', '(?:[')})|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{TOKEN},}}={{0,2}}"
    other = f"^{KEY}[\"']?\\x20*[:=]|{ACCESS}|{HEX}"
    random = lambda s: F.when(s["hit"].rlike(other), F.lit(False)).otherwise(likelihood_ratio(s["hit"], model) >= ratio)
    return F.array_sort(F.concat(F.filter(_spans(text, ASSIGN, 0), value), _spans(text, ACCESS, 1), _spans(text, HEX, 2), F.filter(_spans(text, token, 3), random)))


def scan(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """``doc_id``, ``text``, ``found`` of every whole text.

    Null text: empty, nothing found. Rows are neither joined nor shuffled, so
    repeated rows, null ids and extra columns change nothing.
    """
    return documents(df, id_col, text_col).withColumn("found", found(F.col("text"), model, ratio))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind and the checksums of spans that the scan's contract names."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    found = F.col("found")
    count = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long")
    base = F.array_join(F.transform(F.filter(found, lambda s: s["kind"] < 3), text), ",")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform(found, text), ",").alias("spans")
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with ``[secret]`` in place of every span; spans that overlap give way together. Null stays null.

    Spans are taken in blocks, each with its own piece of the text, so that a
    text with many spans is not read from its start for each of them.
    """
    end = lambda s: F.coalesce(F.array_max(F.transform(s, lambda x: x["end"])), F.lit(0))
    most = lambda a: F.coalesce(F.array_max(a), F.lit(0))

    def block(t: Column, b: Column, base: Column) -> Column:
        """What the spans of a block make of the text between the end of all before it and its own end."""
        piece = F.substring(t, base + 1, end(b) - base)

        def one(p: Column, s: Column, k: Column) -> Column:
            before = F.greatest(base, end(F.slice(b, 1, k)))
            return F.when(s["start"] >= before, F.concat(F.substring(p, before - base + 1, s["start"] - before), F.lit(REDACTED))).otherwise(F.lit(""))

        return _let(piece, lambda p: F.array_join(F.transform(b, lambda s, k: one(p, s, k)), ""))

    def put(f: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(f) - 1) / F.lit(FEW)).cast("int")), lambda i: F.slice(f, i * FEW + 1, FEW))
        made = lambda bs: _let(
            F.transform(bs, end),
            lambda tops: F.concat(F.array_join(F.transform(bs, lambda b, i: block(text, b, most(F.slice(tops, 1, i)))), ""), F.substring(text, most(tops) + 1, F.char_length(text))),
        )
        return F.when(F.size(f) > 0, _let(blocks, made)).otherwise(text)

    return F.when(text.isNotNull(), _let(spans, put))
