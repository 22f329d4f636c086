"""Golden cases of operators whose results SQL does not say, and properties that must hold."""

from itertools import combinations
from random import Random

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import providers as P
from sedimenta.functions import text as T
from sedimenta.operators import cache as C
from sedimenta.operators import chunks as K
from sedimenta.operators import community as M
from sedimenta.operators import graph as G
from sedimenta.operators import resolve as R
from sedimenta.operators import upsert as U
from sedimenta.operators import vector as V
from sedimenta.operators.components import connected_components
from sedimenta.operators.sections import sections
from sedimenta.sources import files, html


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "gone", "tag"),
    [
        ("mail me at a.b@c-d.org now", "a.b@c-d.org", "[PII:EMAIL]"), ("call (555) 123-4567 today", "123-4567", "[PII:PHONE]"), ("ring +1-555-123-4567", "4567", "[PII:PHONE]"), ("dial 555.123.4567", "4567", "[PII:PHONE]"),
        ("my number is 123-45-6789", "6789", "[PII:SSN]"),
    ],
)
def test_basic_masking(spark, text, gone, tag):
    out = one(spark, T.mask_basic(F.col("t")), t=text)
    assert gone not in out and tag in out and one(spark, T.mask_basic(F.col("t")), t=out) == out


@pytest.mark.parametrize(
    ("text", "tag"),
    [
        ("the SSN ending in 6789", "US_SSN"), ("id 123 45 6789", "US_SSN"), ("routing number 021000021", "US_SSN"), ("account `9876543210`", "FINANCIAL_ACCOUNT_NUMBER"),
        ("IBAN DE89370400440532013000", "FINANCIAL_ACCOUNT_NUMBER"), ("card 4111-1111-1111-1111", "CREDIT_CARD_NUMBER"), ("phone 555-234-5678", "PHONE_NUMBER"), ("born 01/02/1980 in x", "DATE_OF_BIRTH"),
    ],
)
def test_supplemental_masking(spark, text, tag):
    assert f"[PII:{tag}]" in one(spark, T.mask_supplement(F.col("t")), t=text)


@pytest.mark.parametrize("text", ["revenue for fiscal year 2024", "Q1 2024 results", "the company grew"])
def test_clean_text_stays(spark, text):
    assert one(spark, T.mask_supplement(T.mask_basic(F.col("t"))), t=text) == text
    assert one(spark, T.types_basic(F.col("t")), t=text) == []


@pytest.mark.parametrize(
    ("text", "value"), [("1,234.5", 1234.5), ("$ 12", 12.0), ("(7)", -7.0), ("—", 0.0), ("-", 0.0), ("", None), (None, None), ("n/a", None), ("15(1)", 15.0), ("3*", 3.0), ("(1,000)†", -1000.0)]
)
def test_display_numbers(spark, text, value):
    assert one(spark, T.display_number(F.col("t")), t=text) == value


@pytest.mark.parametrize(
    ("text", "form"),
    [("CONFORMED SUBMISSION TYPE: 10-K/A", "10-K"), ("conformed submission type: S-1", "S-1"), ("see Form 10Q here", "10-Q"), ("on form 8-K", "8-K"), ("our annual report", "10-K"), ("quarterly report", "10-Q"), ("a letter", "UNKNOWN")],
)
def test_form_types(spark, text, form):
    assert one(spark, T.form_type(F.col("t")), t=text) == form


def test_normalizing(spark):
    assert one(spark, T.normalize(F.col("t"), F.lit("txt")), t="<SEC-HEADER>x\ny</SEC-HEADER>a\r\n-----\n\n\n\nb \t c") == "a\n\nb c"
    assert one(spark, T.normalize(F.col("t"), F.lit("html")), t="us-gaap:Cash P1Y\n2024-01-31\n12\ntext") == "text"
    assert one(spark, T.normalize(F.col("t"), F.lit("pdf")), t="--- Page 3 ---\nsee......x https://a.b/c") == "[Page 3]\n\nsee x"


def test_sections(spark):
    body = "x" * 250
    text = f"Form 10-K\nItem 1. Business\n{body}\nItem 99. Nothing\n{body}\nitem 1A - Risks\nshort\nItem 7A: Markets\n{body}"
    got = {r.item: r for r in sections(spark.createDataFrame([(1, text)], "doc_id long, content string")).collect()}
    assert set(got) == {"1", "7A"} and got["1"].title == "Business" and got["7A"].title == "Markets"
    assert all(text[r.start : r.end].strip() == r.content for r in got.values())
    assert got["1"].end == text.index("Item 99")


def test_sentence_chunks():
    toks = ["a"] * 10 + ["."] + ["b"] * 30
    spans = K.sentence_chunks(toks, 8, 4)
    assert spans[0] == (0, 11) and spans[-1][1] == len(toks)
    assert all(a < b for a, b in spans) and all(n[0] <= p[1] for p, n in zip(spans, spans[1:], strict=False))
    assert K.sentence_chunks([], 8, 4) == [] and K.sentence_chunks(["x"], 8, 4) == [(0, 1)]


XBRL = """<xbrli:context id="c1"><xbrli:entity><xbrli:identifier>42</xbrli:identifier><xbrli:segment><xbrldi:explicitMember dimension="d:Axis">m:One</xbrldi:explicitMember></xbrli:segment></xbrli:entity>
<xbrli:period><xbrli:startDate>2023-01-01</xbrli:startDate><xbrli:endDate>2023-12-31</xbrli:endDate></xbrli:period></xbrli:context><xbrli:context><x/></xbrli:context>
<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>
<p>We made <ix:nonFraction name="us-gaap:Cash" contextRef="c1" unitRef="u" scale="6" decimals="INF">(1.5)</ix:nonFraction> and <ix:nonFraction name="us-gaap:Debt" contextRef="none" sign="-">7</ix:nonFraction>, <ix:nonFraction contextRef="c1">9</ix:nonFraction>
<ix:nonNumeric name="dei:Name">Acme</ix:nonNumeric></p><table><tr><td><ix:nonFraction name="us-gaap:Tax" contextRef="c1" scale="x">—</ix:nonFraction></td></tr></table>"""


def test_inline_facts(spark):
    d = spark.createDataFrame([(1, XBRL), (2, None), (3, "")], "doc_id long, html string")
    got = {r.name: r for r in html.numeric_facts(html.inline_facts(d), html.contexts(d), html.units(d)).collect()}
    assert {k: r.value for k, r in got.items()} == {"us-gaap:Cash": -1.5e6, "us-gaap:Debt": -7.0, "us-gaap:Tax": 0.0}
    cash = got["us-gaap:Cash"]
    assert (cash.unit, cash.period_start, cash.period_end, cash.segment, cash.entity, cash.decimals) == ("USD", "2023-01-01", "2023-12-31", "d:Axis=m:One", "42", None)
    assert got["us-gaap:Debt"].period_end is None and got["us-gaap:Tax"].seq > cash.seq


FULL = "<tr><td>a</td><td>b</td></tr>"


@pytest.mark.parametrize(
    ("table", "verdict"),
    [
        (f"<table role=presentation>{FULL}{FULL}</table>", "LAYOUT"), (f"<table>{FULL}<tr><td><ix:nonfraction>1</ix:nonfraction></td></tr></table>", "DATA"), (f'<table style="display: none">{FULL}{FULL}</table>', "LAYOUT"),
        (f"<table>{FULL}</table>", "LAYOUT"), ("<table><tr><td></td></tr><tr><td> </td></tr></table>", "LAYOUT"), (f"<table>{FULL}<tr><td></td></tr><tr><td></td></tr></table>", "LAYOUT"),
        (f"<table>{'<tr><td>a</td><td></td><td></td></tr>' * 3}</table>", "LAYOUT"), (f"<table>{'<tr><td>a</td><td></td></tr>' * 5}</table>", "LAYOUT"), (f"<table>{FULL * 3}</table>", "DATA"),
        ("<table><tr><td><ix:nonnumeric>x</ix:nonnumeric></td></tr></table>", "DATA"),
    ],
)
def test_table_verdicts(spark, table, verdict):
    d = spark.createDataFrame([(1, table)], "doc_id long, html string")
    assert html.classified(html.tables(d)).first()["verdict"] == verdict


def test_grids():
    t = next(n for n in html.tree("<table><thead><tr><th colspan=2>A<th>B</thead><tr><td rowspan=2>1<td>2<td>3<tr><td>4<td>5<table><tr><td>in</table></table>").walk() if n.tag == "table")
    assert html.grid(t)[:2] == [["A", "", "B"], ["1", "2", "3"]] and html.grid(t)[2][:2] == ["", "4"]


def test_stripped_text():
    assert html.strip_tags("<p>a<b>b</b> 1<i>2</i></p><script>x</script><table><tr><td>t</table>c &amp; d").split() == ["ab", "1", "2", "c", "&", "d"]


def graph(seed, n=12, m=18):
    rng = Random(seed)
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice("xy")) for _ in range(m)})


def walk(edges, start, depth, directed):
    """All trails by recursion."""
    steps = [(a, b, i) for i, (a, b, _) in enumerate(edges)] + ([] if directed else [(b, a, i) for i, (a, b, _) in enumerate(edges) if a != b])
    out = []

    def go(nodes, used):
        if used:
            out.append(tuple(nodes))
        if len(used) < depth:
            for a, b, i in steps:
                if a == nodes[-1] and i not in used:
                    go([*nodes, b], [*used, i])

    go([start], [])
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_trails_and_distances(spark, seed):
    edges = graph(seed)
    df = spark.createDataFrame(edges, "src string, dst string, type string")
    for directed in (True, False):
        got = sorted(tuple(r.nodes) for r in G.trails(df, F.col("node") == "n1", 3, directed).collect())
        assert got == walk(edges, "n1", 3, directed)
    near = {}
    for t in sorted(walk(edges, "n1", 4, False), key=len):
        near.setdefault(t[-1], len(t) - 1)
    got = {r.node: r.hops for r in G.distances(df, F.col("node") == "n1", 4).collect() if r.node != "n1"}
    assert got == {k: v for k, v in near.items() if k != "n1"}
    for goal in ("n2", "n5"):
        best = [t for t in walk(edges, "n1", 4, False) if t[-1] == goal and len(t) - 1 == near.get(goal)]
        row = G.shortest_path(df, "n1", goal, 4).collect()
        assert [r.path for r in row] == ([" > ".join(min(best))] if best else [])


def test_changes_leave_the_rest(spark):
    e = spark.createDataFrame([("a", "b", "x", 1.0), ("b", "c", "x", 1.0)], "src string, dst string, type string, weight double")
    n = spark.createDataFrame([("a", "T", "d"), ("b", "T", None)], "id string, type string, description string")
    again = spark.createDataFrame([("a", "b", "x", 9.0), ("a", "b", "y", 2.0), ("a", "zz", "y", 2.0)], e.schema)
    assert sorted(tuple(r) for r in G.create_relation(e, n, again).collect()) == [("a", "b", "x", 1.0), ("a", "b", "y", 2.0), ("b", "c", "x", 1.0)]
    left, rest = G.delete_entity(n, e, spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in left.collect()] == ["b"] and [r.src for r in rest.collect()] == ["b"]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    low = {v: v for p in pairs for v in p}
    for _ in low:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame([*pairs, (None, 3), (7, None)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(df).collect()} == low
    assert connected_components(df.limit(0)).count() == 0


def test_edit_pairs_find_all(spark):
    rng = Random(7)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(40)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    df = spark.createDataFrame([(n, "t") for n in names], "id string, kind string")
    got = {(r.a, r.b): r.distance for r in R.edit_pairs(df, "kind", 3).collect()}
    assert got == {(a, b): d for a, b in combinations(names, 2) if (d := distance(a, b)) < 3}


def test_communities(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abc" for i, j in combinations(range(5), 2)]
    bridges = [("a0", "b0", 1.0), ("b1", "c1", 1.0)]
    df = spark.createDataFrame(cliques + bridges, "src string, dst string, weight double")
    levels = M.leiden(df, levels=2).collect()
    first = {r.node: r.community for r in levels if r.level == 1}
    assert len(first) == 15 and all(len({first[f"{c}{i}"] for i in range(5)}) == 1 for c in "abc") and len(set(first.values())) == 3
    found = spark.createDataFrame(list(first.items()), "node string, label long")
    assert R.modularity(df, found) > 0.5 >= R.modularity(df, found.withColumn("label", F.lit(1)))
    many = M.overlapping(df, turns=12).collect()
    assert {r.node for r in many} == set(first) and all(0.2 <= r.share <= 1 for r in many)
    assert len({r.node for r in R.label_propagation(df).collect()}) == 15


def test_repairs_end_with_nothing_to_repair(spark):
    c = spark.createDataFrame([("f", 1, "x"), ("f", 2, "y"), ("f", 3, "z"), ("g", 1, "w")], "file_name string, position long, id string")
    assert {(r.src, r.dst) for r in K.next_links(c).collect()} == {("x", "y"), ("y", "z")}
    assert {(r.src, r.dst) for r in K.first_links(c).collect()} == {("f", "x"), ("g", "w")}


def test_quality_floor(spark):
    marks = [("k", i, p) for i, p in enumerate([True, False, False, False, False, True])] + [("n", 1, False)]
    got = {r.key: r for r in C.quality(spark.createDataFrame(marks, "key string, seq long, positive boolean")).collect()}
    assert (got["k"].score, got["k"].verified, got["k"].high) == (-4, True, True) and (got["n"].score, got["n"].high) == (-2, False)


def test_extraction_parsing(spark):
    text = '("entity" : "Acme" : "Company" : "makes things")\n("entity" : "Acme" : "Firm" : "late")\n("relationship" : "Acme" : "Bolt" : "OWNS" : "all" : 2.5)'
    bad = '("relationship" : "A" : "B" : "X" : "d" : 1)("relationship" : "A" : "C" : "X" : "d" : heavy)'
    d = spark.createDataFrame([("c1", text), ("c2", bad), ("c3", "")], "chunk_id string, result string")
    rel = U.parse_relations(d)
    assert [(r.src, r.dst, r.weight) for r in rel.collect()] == [("Acme", "Bolt", 2.5)]
    got = {r.id: (r.type, r.description) for r in U.complete_endpoints(U.parse_entities(d), rel).collect()}
    assert got == {"Acme": ("Company", "makes things"), "Bolt": ("Unknown", "No additional data")}


def test_similar_pairs_in_blocks(spark, monkeypatch):
    rng = Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(70)] + [(70, [0.0] * 8), (71, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {(r.src, r.dst): r.score for r in V.similar_pairs(df, 0.5).collect()}
    monkeypatch.setattr(V, "BLOCK", 16)
    assert {(r.src, r.dst): r.score for r in V.similar_pairs(df, 0.5).collect()} == whole and whole


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.TXT").write_bytes("grüße\xff".encode("latin-1"))
    (tmp_path / "y.md").write_text("hello")
    (tmp_path / "z.bin").write_text("no")
    (tmp_path / "t.csv").write_text("p,q\n1,2\n3,4\n")
    f = files.scan(spark, str(tmp_path))
    assert {r.extension for r in f.collect()} == {"txt", "md"} and files.manifest(f).count() == 2
    assert {r.text for r in files.texts(f).collect()} == {"gr��e�", "hello"}
    assert sorted(r.line for r in files.csv_text(spark, str(tmp_path / "t.csv")).collect()) == ["1,2", "3,4"]
    n = spark.createDataFrame([("a", "T")], "id string, type string")
    e = spark.createDataFrame([("a", "b", "x")], "src string, dst string, type string")
    files.write_graph(n, e, str(tmp_path / "g"))
    back, _ = files.read_graph(spark, str(tmp_path / "g"))
    assert [tuple(r) for r in back.select("id", "type").collect()] == [("a", "T")]


def test_stand_in_models(spark):
    v = one(spark, P.hashing_embedder(F.col("t")), t="Alpha beta alpha")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and set(one(spark, P.hashing_embedder(F.col("t")), t=None)) == {0.0}
    assert one(spark, P.mask_names(F.col("t")), t="ask John Smith today") == "ask [PII:PERSON_NAME] today"
    assert one(spark, P.mask_names(F.col("t")), t="the Roth Ira plan") == "the Roth Ira plan"
    assert one(spark, P.passes(F.col("t")), t='```json{"score": 0.8}```') is True and one(spark, P.passes(F.col("t")), t="garbage") is False


def test_size_batches(spark):
    from sedimenta.operators.repair import size_batches

    rows = [(f"p{i:03d}", 10 + (i * 37) % 90) for i in range(200)] + [("big", 5000), ("none", None)]
    got = size_batches(spark.createDataFrame(rows, "path string, size long"), 300).collect()
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append(r.size or 0)
    assert len(got) == len(rows) and all(sum(v) <= 300 or len(v) == 1 for v in by.values())


def test_large_texts_keep_their_characters():
    from sedimenta.operators.repair import pieces

    text = "\n\n".join(f"Paragraph {i} has words. And more! " + "x" * (i * 40) for i in range(60))
    cut = pieces(text, 3000, 1000)
    assert all(len(p) <= 3000 for p in cut) and "".join("".join(cut).split()) == "".join(text.split())
    assert pieces("short", 3000) == ["short"] and pieces("", 10) == [""]


def test_first_links_fall_back_to_the_least_position(spark):
    from sedimenta.operators.repair import missing_first

    c = spark.createDataFrame([("f", 2, "y"), ("f", 3, "z"), ("g", None, "n"), ("g", 4, "m"), ("h", 1, "w")], "file_name string, position long, id string")
    d = spark.createDataFrame([("f",), ("g",), ("h",), ("lone",)], "file_name string")
    links = spark.createDataFrame([("h", "w")], "src string, dst string")
    assert {(r.src, r.dst) for r in missing_first(d, c, links).collect()} == {("f", "y"), ("g", "n")}


def test_company_groups():
    from sedimenta.operators.scope import group_companies

    assert group_companies(["WMT", "walmart", "AAPL", "apple", "tesla", "BRK.B", "F", "ford", "LONGNAME", "x"]) == [["WMT", "walmart"], ["AAPL", "apple"], ["tesla"], ["BRK.B"], ["F", "ford"], ["LONGNAME"], ["x"]]
    assert group_companies([]) == []


def test_masks_read_letters_as_the_sql_does(spark):
    """Words at letters of other scripts, the two signs whose other case is ASCII, vertical tabs, and a number after two context words."""
    import duckdb

    from sedimenta.functions import text as T
    from sedimenta.plans import q_text as Q

    texts = ["é123-45-6789", "123456789ü", "ſSN 1234", "social\x0bsecurity 1234", "social security SSN 1234", "account K12345678", "10 Oak ſtreet", "parKway 3 Main parKway, Boston", "x@ſ.comK", "]a@b.com", "ü4111-1111-1111-1111", "SSN 1234 SSN 5678"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    con = duckdb.connect()
    con.execute("create table t (i int, text varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    want = con.execute(f"select i, {Q._replaced('text', Q.SUPPLEMENT)}, {Q.MASK} from t order by i").fetchall()
    got = df.select("i", T.mask_supplement(F.col("text")), T.mask_basic(F.col("text"))).orderBy("i").collect()
    assert [tuple(r) for r in got] == want


def _copied(spark, seed=3, n=60, copies=12):
    """Vectors with copies of each, among them more than a list holds."""
    import numpy as np

    x = np.random.default_rng(seed).normal(0, 1, (n, 8)).astype(np.float32)
    rows = [(i + n * c, [float(v) for v in x[i]]) for i in range(n) for c in range(copies)]
    return rows, spark.createDataFrame([*rows, (-1, None), (-2, [0.0] * 8)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("block", [2048, 50])
def test_nearest_rows_and_links_among_copies(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "MOST", 4)
    rows, df = _copied(spark)
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    want = {(int(ids[i]), int(ids[j]), r + 1) for i in range(len(ids)) for r, j in enumerate(np.lexsort((ids, -s[i]))[:5])}
    assert {(r.src, r.dst, r["rank"]) for r in V.nearest_rows(df, 5).collect()} == want
    pairs = V.similar_pairs(df, 0.9)
    assert {(r.src, r.dst) for r in pairs.collect()} == {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i, j in np.argwhere(s >= 0.9)}
    links, degrees = V.similar_links(df, 0.9)
    assert {r.node: r.degree for r in degrees.collect()} == {int(a): int(n) for a, n in zip(ids, (s >= 0.9).sum(axis=1)) if n}
    assert links.count() < 2 * len(rows) < pairs.count()
    assert {tuple(r) for r in connected_components(links).collect()} == {tuple(r) for r in connected_components(pairs).collect()}


def test_neighbour_lists_with_many_copies(spark, tmp_path):
    """More ties than a list of the descent holds: the smallest ids are told all the same."""
    import duckdb

    from sedimenta.plans.q_search import neighbour_lists
    from sedimenta.catalog import ORACLE_SQL

    _, df = _copied(spark, n=20, copies=90)
    df.where("vec_id >= 0").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = {tuple(r) for r in neighbour_lists(spark, str(tmp_path)).collect()}
    assert got == set(con.sql(ORACLE_SQL["neighbour_lists"]).fetchall())
