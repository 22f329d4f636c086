"""Operator 13: what each of several filters removes in every order, from joint-failure counts of all their intersections."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimenta.llm.common import SPACE, words

#: The filters' names, in the order of their bits.
NAMES = "ABCDE"
KINDS = ("all", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The four filters that a text fails by itself: too short, few distinct words, many capitals, symbols."""
    w, n = words(text), F.char_length(text)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(w) < 100, "B": 100 * F.size(F.array_distinct(w)) < 80 * F.size(w), "C": 100 * capitals > 10 * n, "D": text.rlike("[#$%&*|]")}


def marks(labels: DataFrame) -> DataFrame:
    """``known_id``, ``good``, ``toxic``: one row a document; one with several rows of labels counts if any of them says so."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("known_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part``, ``good``, ``toxic``, one 0/1 column a filter, and ``n``: documents with these, in several rows.

    A text is told by its SHA-256, and only one row an id, its digest and its
    flags is shuffled. Copies add up by part and label before they meet, so
    a text with a third of all rows is a few rows a part: the smallest id's
    rows pass the filter of copies, all others fail it. An id that repeats is
    not smaller than itself; null ids neither fail nor make others fail.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("t"))
    flags = NAMES[:4]
    d = d.select("id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("text"), *[F.coalesce(c, F.lit(False)).cast("int").alias(f) for f, c in text_failures(F.col("t")).items()])
    d = d.groupBy("id", "part", "text", *flags).agg(F.count("*").alias("n"))
    # rows without an id have no label to meet; their digest keeps them from meeting each other
    m = marks(labels).withColumn("known_text", F.lit(b""))
    d = d.withColumn("alone", F.when(F.col("id").isNull(), F.col("text")).otherwise(F.lit(b"")))
    d = d.join(m, (F.col("id") == F.col("known_id")) & (F.col("alone") == F.col("known_text")), "left")
    marked = [F.coalesce(k, F.lit(False)).alias(k) for k in KINDS[1:]]
    d = d.select("id", "n", "part", "text", *flags, *marked)
    named = F.col("id").isNotNull()
    copies = d.groupBy("text", *flags, "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("unnamed"), F.min(F.when(named, F.struct("id", "n"))).alias("first")
    )
    # the first grouping left one row an id, part and text, so an id's rows of a part are all in its "first"
    copies = copies.withColumn("smallest", F.min("first.id").over(Window.partitionBy("text")))
    passing = F.col("unnamed") + F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(F.lit(0))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("E"), passing.alias("n")), F.struct(F.lit(1).alias("E"), (F.col("n") - passing).alias("n"))))
    return copies.select("part", "good", "toxic", *flags, sides.alias("s")).select("part", "good", "toxic", *flags, F.col("s.E").alias("E"), F.col("s.n").alias("n")).where("n > 0")


def joint_failures(counted: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """A row a part with ``all``, ``good``, ``toxic``: arrays that hold, for each set of filters (bits by position in ``names``), how many documents fail all of the set.

    Documents with the same flags add up first, so the products of flags are
    taken of at most 2^k rows a part and kind of label.
    """
    same = counted.groupBy("part", "good", "toxic", *names).agg(F.sum("n").alias("n"))
    product = F.col("n")
    for i, name in enumerate(names):
        product = product * F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col(name)).otherwise(F.lit(1))
    each = same.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("mask")).withColumn("fail", product)
    of = lambda kind: F.sum("fail" if kind == "all" else F.when(F.col(kind), F.col("fail")).otherwise(F.lit(0).cast("long"))).alias(kind)
    sets = each.groupBy("part", "mask").agg(*[of(k) for k in KINDS])
    return sets.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", *KINDS))).alias("sets")).select("part", *[F.col(f"sets.{k}").alias(k) for k in KINDS])


def inverted(joint: DataFrame, k: int) -> DataFrame:
    """The joint counts, turned into what an audit reads.

    ``kept``, ``good_kept``, ``toxic_kept``: documents that survive each set
    of filters (Möbius inversion over its subsets). ``fails`` and ``unique``
    of each filter: documents that fail it, and it alone. ``shapley``: its
    removed documents summed over all orders, from the dividends of the sets
    that hold it, shared evenly among their members (a set's dividend is
    its joint count, negative if the set is of even size).
    """
    masks, bits = F.sequence(F.lit(0), F.lit((1 << k) - 1)), F.sequence(F.lit(0), F.lit(k - 1))
    even = lambda m: F.bit_count(m) % 2 == 0
    plus = lambda terms: F.aggregate(terms, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0).cast("long")))
    over = lambda kind, term: plus(F.transform(F.col(kind), lambda n, m: term(n, m)))
    holds = lambda m, i: F.get(F.lit([1 << j for j in range(k)]), i).bitwiseAND(m) != 0
    kept = lambda kind: F.transform(masks, lambda p: over(kind, lambda n, m: F.when(m.bitwiseAND(p) == m, F.when(even(m), n).otherwise(-n))))
    alone = lambda i: over("all", lambda n, m: F.when(holds(m, i), F.when(even(m), -n).otherwise(n)))
    share = lambda n, m: n * F.get(F.lit([0, *[factorial(k) // size for size in range(1, k + 1)]]), F.bit_count(m))
    value = lambda i: over("all", lambda n, m: F.when(holds(m, i), F.when(even(m), -share(n, m)).otherwise(share(n, m))))
    fails = F.transform(bits, lambda i: F.get("all", F.get(F.lit([1 << j for j in range(k)]), i)))
    return joint.select(
        "part", kept("all").alias("kept"), kept("good").alias("good_kept"), kept("toxic").alias("toxic_kept"), fails.alias("fails"), F.transform(bits, alone).alias("unique"), F.transform(bits, value).alias("shapley")
    )


def audit(counted: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """A row a part, order of the filters and step in it, with what the step's filter does there.

    ``counted``: ``part``, ``good``, ``toxic``, a 0/1 column for each of
    ``names`` and ``n`` documents, as ``failures`` gives them or as any other
    set of filters does. Documents are read once, for the 2^k joint counts;
    orders and steps follow from these. An empty table gives no rows.
    """
    k = len(names)
    steps = []
    for order in permutations(range(k)):
        done = 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(names[j] for j in order), "step": step, "i": i, "before": done, "after": done | 1 << i})
            done |= 1 << i
    each = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,i:int,before:int,after:int>>")).alias("s")
    at = lambda arr, ix: F.get(arr, F.col(f"s.{ix}"))
    lost = lambda arr: at(arr, "before") - at(arr, "after")
    return inverted(joint_failures(counted, names), k).select("*", each).select(
        "part", "s.filter_order", "s.step", at("kept", "after").alias("kept"), lost("kept").alias("removed"), (at("fails", "i") - lost("kept")).alias("redundant"),
        at("unique", "i").alias("unique_fails"), lost("good_kept").alias("good_lost"), lost("toxic_kept").alias("toxic_lost"), at("shapley", "i").alias("shapley"),
    )


#: The same by brute force, in SQL: every order applied to every document.
ORACLE_SQL = f"""
with docs as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{SPACE.replace("[", "[^", 1)}+') w from documents),
flags as (select d.doc_id, part, len(w) < 100 fa, 100 * len(list_distinct(w)) < 80 * len(w) fb, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) fc,
  regexp_matches(t, '[#$%&*|]') fd, coalesce(min(d.doc_id) over (partition by t) < d.doc_id, false) fe, coalesce(good, false) good, coalesce(toxic, false) toxic
  from docs d left join (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by 1) l on d.doc_id = l.doc_id),
failing as (select part, good, toxic, concat(case when fa then 'A' else '' end, case when fb then 'B' else '' end, case when fc then 'C' else '' end, case when fd then 'D' else '' end,
  case when fe then 'E' else '' end) fails from flags),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
orders as (select concat(a.x, b.x, c.x, d.x, e.x) filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, step, substr(filter_order, step, 1) f, substr(filter_order, 1, step - 1) earlier from orders, (select unnest([1, 2, 3, 4, 5])::int step)),
tried as (select part, good, toxic, filter_order, step, f, fails, contains(fails, f) hit, len(list_filter(string_split(earlier, ''), lambda c: c <> '' and contains(fails, c))) > 0 gone
  from failing, steps),
counted as (select part, filter_order, step, f, count(*) filter (not gone and not hit) kept, count(*) filter (not gone and hit) removed, count(*) filter (gone and hit) redundant,
  count(*) filter (fails = f) unique_fails, count(*) filter (not gone and hit and good) good_lost, count(*) filter (not gone and hit and toxic) toxic_lost from tried group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint shapley from counted
"""
