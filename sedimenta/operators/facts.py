"""Retrieval of numeric facts: terms, periods, filings, relaxation and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.config import DEFAULTS

# Words that a term's parts leave out.
SKIP = "total what which with from that this have been were does their company fiscal year quarter report reported annual much many did for the".split()


def expand_terms(words: list[str], most_words: int = 8, most_terms: int = 14) -> list[str]:
    """The keywords and their parts of more than three letters, lower case, each once, in order, cut to ``most_terms``."""
    out: list[str] = []
    for w in words[:most_words]:
        for t in [w, *(p for p in w.split() if len(p) > 3 and p.lower() not in SKIP)]:
            if t.lower() not in out:
                out.append(t.lower())
    return out[:most_terms]


def any_term(columns: list[str], terms: list[str]) -> Column:
    """Whether a lower-cased column holds any of the terms; null columns hold none."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False)) for c in columns for t in terms), F.lit(False))


def in_period(date: str, days: int = DEFAULTS.period_days) -> Column:
    """period_end, an ISO date as text, within ``days`` of the date; compared as text, as such dates order."""
    d = F.lit(date).cast("date")
    return F.col("period_end").between(F.date_sub(d, days).cast("string"), F.date_add(d, days).cast("string"))


def in_fiscal_year(year: int) -> Column:
    """period_end in the year or the one before."""
    return F.substring("period_end", 1, 4).isin(str(year), str(year - 1))


def year_to_date(yes: bool) -> Column:
    c = F.col("context_ref").contains("YTD")
    return c if yes else ~c


def latest(facts: DataFrame, limit: int = DEFAULTS.fact_limit) -> DataFrame:
    """Newest and largest first, nulls before all; ties by name, context and file. A top-k, no full sort."""
    order = [F.desc_nulls_first("period_end"), F.desc_nulls_first("value"), "name", "context_ref", "file_name"]
    return facts.orderBy(*order).limit(limit)


def relaxed(facts: DataFrame, conditions: list[Column], limit: int = DEFAULTS.fact_limit) -> DataFrame:
    """Facts of the first condition that any fact meets, the strictest first, in one pass over the facts.

    Each fact gets the number of the first condition it meets; the least number
    among all decides, and a top-k by (number, order) needs no second scan.
    """
    step = reduce(lambda w, c: w.when(c[1], c[0]), enumerate(conditions[1:], 1), F.when(conditions[0], 0))
    # A fact that meets a strict condition meets the laxer ones; the top-k rows of the least step come first.
    top = facts.withColumn("pass", step).where("pass is not null")
    order = ["pass", F.desc_nulls_first("period_end"), F.desc_nulls_first("value"), "name", "context_ref", "file_name"]
    top = top.orderBy(*order).limit(limit)
    return top.withColumn("least", F.min("pass").over(Window.partitionBy(F.lit(1)))).where("pass = least").drop("least")


def upsert_last(facts: DataFrame, key: list[str]) -> DataFrame:
    """One fact of each key, the last by document and place, then the largest; an aggregate that combines before its shuffle."""
    rest = [c for c in facts.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct("fact_seq", "fact_sub", "value", "period_end"))
    return facts.groupBy(*key).agg(last.alias("s")).select(*key, "s.*")
