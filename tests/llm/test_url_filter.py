from itertools import combinations
from random import Random
from time import perf_counter

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import url_filter as uf
from sedimenta.llm.common import by_hash
from sedimenta.llm.queries import PATH_RULES


def split(url):
    """Host and path by the definition."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return host, path[:stop]


def ruled(host, path):
    fit = [r for r in PATH_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


URLS = [
    None, "", "no scheme", "http://", "https://ORG/x", "http://a.Example.org/es/1?x#y", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.com/de/1", "http://com/de/", "x://com?de=/de/",
    "http://a.com#/de/", "http://b.com/de", "http://İ.com/fr/1", "http://u:p@h.net:80/fr/a://b/c", "http://www.cheap-pills.example.net/en/1", "http://a.org", "http://a.com/fr/../de/",
]


def test_hosts_paths_and_rules(spark, sf):
    table = [(i, u) for i, u in enumerate(URLS)] + [(r.page_id + 100, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    df = spark.createDataFrame(table, "page_id long, url string")
    got = {r.page_id: r for r in uf.judge(df, PATH_RULES).collect()}
    assert len(got) == len(table)
    for i, u in table:
        host, path = split(u)
        rule = ruled(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.text)
        assert got[i].verdict == rule.verdict if rule else got[i].verdict in ("allow", "block")


def count(rows, support, confidence):
    """All rules by counting every combination of tokens."""
    out = {}
    every = sorted({t for s, _ in rows for t in s})
    for n in (1, 2, 3):
        for c in combinations(every, n):
            have = [y for s, y in rows if set(c) <= s]
            if have and sum(have) >= support * len(rows) and sum(have) / len(have) >= confidence:
                if not any(set(k) < set(c) and v >= sum(have) / len(have) for k, v in out.items()):
                    out[c] = sum(have) / len(have)
    return out


def test_mined_rules_against_counting(spark):
    rows = []
    for i in range(120):
        host = ("bets" if i % 3 == 0 else "news") + ("-win" if i % 2 else "-day") + ".net"
        path = f"/{'promo' if i % 5 == 0 else 'read'}/{'a' if i % 7 else 'b'}"
        rows.append((host, path, "block" if (i % 3 == 0 and i % 2) or (i % 5 == 0 and i % 7 == 0) else "allow"))
    rows += [("junk.org", "/", None), ("junk.org", "/", "unknown")]
    df = spark.createDataFrame(rows, "host string, path string, label string")
    mined = uf.mine(df, support=0.01, confidence=0.8)
    labelled = df.where("label in ('allow', 'block')").select(uf.tokens(df.host, df.path).alias("t"), "label").collect()
    sets = [(frozenset(r.t), r.label == "block") for r in labelled]
    assert dict(zip(mined.sets, mined.confidence, strict=True)) == pytest.approx(count(sets, 0.01, 0.8))
    for s, _ in sets:
        hits = [i for i, r in enumerate(mined.sets) if set(r) <= s]
        assert mined.match(list(s)) == (max(hits, key=lambda i: (mined.confidence[i], -i)) if hits else -1)


def test_known_bad_hosts_are_blocked_and_others_allowed(spark):
    names = ["cheap-pills", "free-bets", "spam-farm", "thther", "ththre", "ththin"]
    urls = [(i, f"http://www.{names[i % 6]}.example.net/en/{i}") for i in range(600)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: r.verdict for r in uf.judge(df, PATH_RULES).collect()}
    assert all(got[i] == ("block" if i % 6 < 3 else "allow") for i in got)


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "page_id long, url string, host string")
    assert uf.judge(none, PATH_RULES).count() == 0
    assert uf.mine(spark.createDataFrame([], "host string, path string, label string")).sets == []
    clash = spark.createDataFrame([(None, None, "x", 1), (2, "http://a.org/", "y", 2), (2, "http://a.org/", "y", 2)], "page_id long, url string, host string, hit int")
    assert sorted((r.page_id or 0, r.verdict) for r in uf.judge(clash, PATH_RULES).collect()) == [(0, "allow"), (2, "allow"), (2, "allow")]


def test_two_tokens_decide_on_urls_not_seen(spark):
    """Neither token is bad alone: only hosts with both are. Labels are a table; the rules are judged on other URLs."""

    def url(i, at):
        rng = Random(f"{at}{i}")
        free, prize, deep = rng.random() < 0.4, rng.random() < 0.4, rng.choice(("news", "shop", "read"))
        host = ".".join(x for x in (free and "free", prize and "prize", f"h{rng.randint(0, 300)}", "example", "net") if x)
        return f"http://{host}/{deep}/{rng.randint(0, 99)}", "block" if free and prize else "allow"

    taught = spark.createDataFrame([url(i, "a") for i in range(3000)], "url string, label string")
    asked = [(i, *url(i, "b")) for i in range(1000)]
    df = spark.createDataFrame(asked, "page_id long, url string, truth string")
    got = {r.page_id: r for r in uf.judge(df, [], labels=taught).collect()}
    assert all(got[i].verdict == truth for i, _, truth in asked)
    assert {r.mined for r in got.values()} == {None, "h:free h:prize"}


def test_long_and_repeated_urls_are_mined_in_bounded_time(spark):
    long_ = "http://bad-bets.net/" + "/".join(f"part{i}x" for i in range(200))
    rng = Random(1)
    mixed = [("http://casino.net/" + "/".join(f"s{rng.randint(0, 25)}x" for _ in range(40))) for _ in range(300)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([long_] * 1000 + mixed + ["http://good.net/a/b"] * 500)], "page_id long, url string")
    began = perf_counter()
    got = {r.page_id: r.verdict for r in uf.judge(df, PATH_RULES).collect()}
    assert perf_counter() - began < 60
    assert all(got[i] == ("block" if i < 1300 else "allow") for i in got)
    two = spark.createDataFrame([(0, long_), (1, long_)], "page_id long, url string")
    assert {r.verdict for r in uf.judge(two, PATH_RULES).collect()} == {"block"}


def test_sample_is_bounded_and_follows_the_hash(spark):
    df = spark.range(5000).repartition(7).withColumn("x", F.col("id") % 3)
    few = {r.id for r in by_hash(df, 300, "id", "x").collect()}
    order = sorted(((r.h, r.id) for r in df.select("id", F.xxhash64("id", "x", F.lit("sample")).alias("h")).collect()))
    assert few == {i for _, i in order[:300]} and by_hash(df, 5000, "id").count() == 5000


@pytest.mark.parametrize("tokens", [2, 4])
def test_tokens_beyond_those_of_fp_growth(spark, monkeypatch, tokens):
    """URLs with more frequent tokens than FP-growth takes: every combination is found with its whole count."""
    monkeypatch.setattr(uf, "TOKENS", tokens)
    rng = Random(11)
    rows = []
    for _ in range(400):
        bad = rng.random() < 0.4
        path = [f"t{i}" for i in range(9) if rng.random() < (0.75 if bad else 0.3)]
        rows.append((f"x{rng.randrange(3)}", "/" + "/".join(path), uf.BLOCK if bad else uf.ALLOW))
    df = spark.createDataFrame(rows, "host string, path string, label string")
    got = uf.mine(df, support=0.02, confidence=0.7)
    had = [(set(r.tokens), r.label == uf.BLOCK) for r in df.select(uf.tokens(F.col("host"), F.col("path")).alias("tokens"), "label").collect()]
    want = count(had, 0.02, 0.7)
    assert dict(zip(map(tuple, got.sets), got.confidence, strict=True)) == pytest.approx({tuple(sorted(k)): v for k, v in want.items()}) and want
