"""Operator 2: URL filtering by association rules that FP-growth mines from labels."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import by_hash
from sedimenta.session import settle

ALLOW, BLOCK = "allow", "block"
#: Labelled URLs that rules are mined from at most.
SAMPLE = 50_000
#: Least share of the labelled URLs that hold a combination, and least share of these that are blocked.
SUPPORT, CONFIDENCE = 0.002, 0.8
#: Most tokens in a rule, and tokens of one URL that FP-growth mines: those that are blocked most often.
WIDTH, TOKENS = 3, 10
#: Least number of labelled URLs behind a rule.
LEAST = 2
#: A label as an item of a transaction; tokens are prefixed with h: or p:, so none can be taken for it.
BLOCKED = "label:block"

# Words of host names that label a URL as one to block, the seed of the labelled sample.
SEED_WORDS = ("ads adserver adult banner bet bets betting bingo cam casino cheap click counterfeit dating escort fake farm free gambling hack jackpot keygen loan loans lottery malware "
              "nude phish phishing pill pills poker popup porn replica scam sex slots spam track tracker tracking viagra virus warez win xxx").split()  # fmt: skip


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without it or for null."""
    after = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.char_length(after) + 4, F.char_length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(url, F.lit("://")), low).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    after = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.char_length(after) + 4, F.char_length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


@dataclass(frozen=True)
class PathRule:
    """A stated rule: it fits the host and all its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, text: str) -> PathRule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def stated(host: Column, path: Column, rules: list[PathRule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none fits. Longer hosts are longer rules, then longer paths."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    null = F.lit(None).cast("string")
    return (null, null) if text is None else (text.otherwise(null), verdict.otherwise(null))


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: labels of the host and their hyphenated parts, and the path's segments, numbers as #."""
    labels = F.split(host, r"\.")
    parts = F.filter(F.flatten(F.transform(labels, lambda x: F.concat(F.array(x), F.split(x, "-")))), lambda x: x != "")
    steps = F.filter(F.split(path, "[/._-]"), lambda x: x != "")
    return F.array_distinct(F.concat(F.transform(parts, lambda x: F.concat(F.lit("h:"), x)), F.transform(steps, lambda x: F.concat(F.lit("p:"), F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)))))


def seeded(host: Column, verdict: Column) -> Column:
    """The label of a URL to learn from: block for a seed word in its host, else the stated rule's verdict, else allow.

    URLs without a label are the background that a rule must stand out from;
    left out, any trait that only they share would look blocked or allowed.
    """
    words = F.split(host, "[.-]")
    return F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in SEED_WORDS])), F.lit(BLOCK)).otherwise(F.coalesce(verdict, F.lit(ALLOW)))


@dataclass
class Rules:
    """Combinations of tokens that mean block, with an index from token to the rules that hold it."""

    sets: list[tuple[str, ...]]
    confidence: list[float]
    index: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        index = defaultdict(list)
        for i, s in enumerate(self.sets):
            for t in s:
                index[t].append(i)
        self.index = dict(index)

    def match(self, have: list[str]) -> int:
        """The most confident rule whose tokens are all there, -1 if none."""
        met: dict[int, int] = defaultdict(int)
        for t in set(have):
            for i in self.index.get(t, ()):
                met[i] += 1
        return max((i for i, n in met.items() if n == len(self.sets[i])), key=lambda i: (self.confidence[i], -i), default=-1)


def _grown(rows: DataFrame, first: list[str], bound: float, width: int) -> DataFrame:
    """``set``, ``confidence`` of every combination of up to ``width`` tokens with one of ``first`` that at least ``bound`` blocked rows (``row``, ``bad``, ``all``) hold.

    Grown token by token in one order, in which those of ``first`` come first:
    only what is frequent is grown, and each combination once. One that is
    always blocked is not grown, nor is another grown by a token that is: no
    rule with such a part adds to it. Rows of equal tokens are counted as one.
    """
    place = F.when(F.col("t").isin(first), F.concat(F.lit("0"), "t")).otherwise(F.concat(F.lit("1"), "t"))
    each = rows.groupBy("all").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("b")).withColumn("row", F.monotonically_increasing_id())
    each = settle(each.select("row", "n", "b", F.explode("all").alias("t")).select("row", "n", "b", place.alias("at")), "grown")
    sums = lambda df, *by: df.groupBy(*by).agg(F.sum("b").alias("blocked"), F.sum("n").alias("freq"))
    pure = sums(each, "at").where("blocked = freq").select("at")
    next_ = settle(each.join(pure, "at", "left_anti").select("row", "at"), "grown")
    level = each.where(F.col("at").startswith("0")).select("row", "n", "b", F.array("at").alias("ats"))
    out = None
    for i in range(width):
        found = settle(sums(level, "ats").where(F.col("blocked") >= bound), "grown")
        out = found if out is None else out.unionByName(found)
        if i + 1 < width:
            more = level.join(found.where("blocked < freq").select("ats"), "ats", "left_semi").join(next_, "row").where(F.col("at") > F.element_at("ats", -1))
            level = more.select("row", "n", "b", F.array_append("ats", F.col("at")).alias("ats"))
    return out.select(F.array_sort(F.transform("ats", lambda x: F.substring(x, F.lit(2), F.char_length(x)))).alias("set"), (F.col("blocked") / F.col("freq")).alias("confidence"))


def mine(labelled: DataFrame, sample: int = SAMPLE, support: float = SUPPORT, confidence: float = CONFIDENCE, width: int = WIDTH, least: int = 1) -> Rules:
    """Rules from rows of ``host``, ``path``, ``label`` (allow or block; other rows teach nothing).

    At most ``sample`` rows, chosen by a hash of all their columns, are mined by
    FP-growth. A combination of up to ``width`` tokens with the block label
    whose support, count (``least``) and confidence reach their bounds is a
    rule, unless a part of it is one already with as much confidence.

    Of a URL's tokens that are frequent with the label, FP-growth takes the
    TOKENS with the largest share of blocked URLs (ties by name), as it would
    look at all 2**n combinations of n tokens. Its counts are whole for
    combinations of tokens that no URL had to leave out; those with a token that
    one did are counted in full by ``_grown``. So no combination is missed.
    """
    t = by_hash(labelled.where(F.col("label").isin(ALLOW, BLOCK)), sample, *labelled.columns)
    rows = t.select((F.col("label") == BLOCK).alias("bad"), tokens(F.col("host"), F.col("path")).alias("tokens"))
    rows = settle(rows.where(F.size("tokens") > 0).withColumn("row", F.monotonically_increasing_id()), "urls")
    n = rows.count()
    if not n:
        return Rules([], [])
    bound = max(least, support * n)
    spread = rows.select("row", "bad", F.explode("tokens").alias("token"))
    share = spread.groupBy("token").agg(F.avg(F.col("bad").cast("int")).alias("share"), F.sum(F.col("bad").cast("int")).alias("n")).where(F.col("n") >= bound).drop("n")
    best = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "token")))
    few = spread.join(share, "token").groupBy("row", "bad").agg(best.alias("best"))
    few = settle(few.select("row", "bad", F.transform("best", lambda x: x["token"]).alias("all")).select("*", F.slice("all", 1, TOKENS).alias("items")), "few")
    items = settle(few.select(F.concat("items", F.when(F.col("bad"), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))).alias("items")), "items")
    m = items.count()
    if not m:
        return Rules([], [])
    frequent = FPGrowth(itemsCol="items", minSupport=min(1.0, max(1, bound) / m), minConfidence=confidence).fit(items).freqItemsets
    with_label = frequent.where(F.array_contains("items", BLOCKED) & (F.size("items") > 1) & (F.size("items") <= width + 1))
    blocked = with_label.select(F.array_sort(F.array_except("items", F.array(F.lit(BLOCKED)))).alias("set"), F.col("freq").alias("blocked"))
    every = frequent.where(~F.array_contains("items", BLOCKED)).select(F.array_sort("items").alias("set"), "freq")
    sure = blocked.join(every, "set").withColumn("confidence", F.col("blocked") / F.col("freq")).where(F.col("confidence") >= confidence)
    left_out = few.select(F.explode(F.slice("all", TOKENS + 1, F.greatest(F.size("all") - TOKENS, F.lit(0)))).alias("token")).distinct()
    left_out = [r["token"] for r in left_out.collect()]  # frequent tokens, of which there are a bounded number
    if left_out:
        sure = sure.where(~F.arrays_overlap("set", F.array(*[F.lit(t) for t in left_out]))).select("set", "confidence")
        sure = sure.unionByName(_grown(few, left_out, max(1, bound), width).where(F.col("confidence") >= confidence))
    kept: dict[tuple[str, ...], float] = {}
    for r in sorted(sure.collect(), key=lambda r: (len(r["set"]), -r["confidence"], r["set"])):
        s = tuple(r["set"])
        if not any(kept.get(c, 0.0) >= r["confidence"] for k in range(1, len(s)) for c in combinations(s, k)):
            kept[s] = r["confidence"]
    return Rules(list(kept), list(kept.values()))


def judge(df: DataFrame, rules: list[PathRule], mined: Rules | None = None, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``mined`` (the tokens of the mined rule that blocks).

    A stated rule decides where one fits; elsewhere a URL is blocked if it
    holds all tokens of a mined rule, and allowed if not. Without ``mined``,
    rules are mined from ``labels`` (``url``, ``label``: allow or block) where
    given, else from these URLs' own: the stated rules' verdicts and the seed
    words. Null urls and those without ``://`` have an empty host
    and path and are allowed. No join and no shuffle of the URLs.
    """
    d = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    d = d.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, verdict = stated(F.col("host"), F.col("path"), rules)
    d = d.withColumns({"rule": text, "stated": verdict})
    if mined is None and labels is not None:
        mined = mine(labels.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label", "url"), least=LEAST)
    elif mined is None:
        mined = mine(d.select("host", "path", seeded(F.col("host"), F.col("stated")).alias("label"), "page_id"), least=LEAST)
    shared = df.sparkSession.sparkContext.broadcast(mined)

    @F.pandas_udf("int")
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for have in batches:
            yield pd.Series([m.match([] if h is None else list(h)) for h in have], dtype="int32")

    names = [F.lit(" ".join(s)) for s in mined.sets]
    d = d.withColumn("hit", matched(F.when(F.col("stated").isNull(), tokens(F.col("host"), F.col("path")))))
    by = F.element_at(F.array(*names), F.col("hit") + 1) if names else F.lit(None).cast("string")
    by = F.when(F.col("hit") >= 0, by)
    return d.select("page_id", "host", "path", "rule", F.coalesce("stated", F.when(F.col("hit") >= 0, F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("verdict"), by.alias("mined"))
