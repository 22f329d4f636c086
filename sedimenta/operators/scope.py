"""Scopes and drivers: groups of company terms, retrieval by group, job states, incremental rebuilds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_companies(terms: list[str]) -> list[list[str]]:
    """A ticker (upper case, six signs at most) and the lower-case name after it are one company; any other term is one."""
    groups: list[list[str]] = []
    ticker = False
    for t in terms:
        if ticker and t == t.lower() and any(c.isalpha() for c in t):
            groups[-1].append(t)
            ticker = False
        else:
            groups.append([t])
            ticker = t == t.upper() and len(t) <= 6 and any(c.isalpha() for c in t)
    return groups


def by_group(rows: DataFrame, groups: list[list[str]], column: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group whose ``column`` holds one of its terms, in any case, with the group's number.

    Groups are few and literal: each row gets the numbers it belongs to in one
    pass, so there is no join.
    """
    low = F.lower(F.col(column))
    member = [F.when(F.exists(F.array(*[F.lit(t.lower()) for t in g]), lambda t: low.contains(t)), F.lit(i)) for i, g in enumerate(groups)]
    own = rows.withColumn("grp", F.explode(F.array_compact(F.array(*member))))
    return own.withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def job_states(events: DataFrame) -> DataFrame:
    """The last state of each job (``job``, ``seq``, ``state``), its first and last event and their number."""
    return events.groupBy("job").agg(F.max_by("state", "seq").alias("state"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"))


def admit(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Requests (``job``, ``seq``) with a status: 202 for the first of a job that is not running, 409 for all others."""
    busy = states.where(F.col("state").isin("pending", "running")).select(F.col("job").alias("_j"))
    r = requests.withColumn("_r", F.row_number().over(Window.partitionBy("job").orderBy("seq"))).join(busy, F.col("job") == F.col("_j"), "left")
    return r.select("job", "seq", F.when(F.col("_j").isNull() & (F.col("_r") == 1), 202).otherwise(409).alias("status"))


def rebuild(built: DataFrame, documents: DataFrame, changes: DataFrame, build: Callable[[DataFrame], DataFrame], key: str = "file_name") -> DataFrame:
    """What was built, without the rows of changed and deleted files, and what ``build`` makes of the added and changed ones.

    Equal to building all current documents anew, as long as ``build`` treats
    each document on its own.
    """
    c = changes.select(F.col("path").alias("_p"), "change")
    kept = built.join(c, built[key] == c["_p"], "left_anti")
    fresh = documents.join(c.where("change <> 'deleted'"), documents[key] == c["_p"], "left_semi")
    return kept.unionByName(build(fresh))
