"""Captions and text outside of tables against plain loops over random pages."""

import random

from sedimenta.sources import html
from sedimenta.operators.layout import captions, outside_boxes

CHAR = "page long, x0 double, x1 double, top double, bottom double, c string"
BOX = "page long, box string, x0 double, x1 double, y0 double, y1 double"


def read(cs):
    lines, before = [], None
    for c in sorted(cs, key=lambda c: (c[3], c[1], c[2], c[5])):
        if before is None or c[3] - before > 3:
            lines.append([])
        lines[-1].append(c)
        before = c[3]
    out = []
    for line in lines:
        line.sort(key=lambda c: (c[1], c[2], c[5]))
        for a, b in zip([None, *line], line, strict=False):
            out.append((" " if a is None or b[1] - a[2] > 3 else "") + b[5])
    return " ".join("".join(out).split()) or None


def test_captions_brute_force(spark):
    rng = random.Random(5)
    chars, boxes = [], []
    for page in range(6):
        for _ in range(400 if page else 3000):
            x, y = rng.uniform(0, 600), float(rng.randrange(0, 400)) + rng.choice([0, 0.5])
            chars.append((page, x, x + 6, y, y + 9, rng.choice("abcdef  中")))
        for b in range(8):
            x, y = rng.uniform(-20, 400), rng.uniform(0, 400)
            boxes.append((page, f"t{b}", x, x + rng.uniform(1, 350), y, y + rng.uniform(5, 200)))
    chars += chars[:50]
    want = {}
    for p, b, x0, x1, y0, _ in boxes:
        want[p, b] = read([c for c in chars if c[0] == p and c[1] >= x0 and c[2] <= x1 and c[3] >= max(0, y0 - 30) and c[4] <= y0])
    got = captions(spark.createDataFrame(chars, CHAR).repartition(7), spark.createDataFrame(boxes, BOX))
    assert {(r.page, r.box): r.caption for r in got.collect()} == want
    assert sum(v is not None for v in want.values()) > 20 and None in want.values()


def test_captions_of_nulls_and_nothing(spark):
    chars = spark.createDataFrame([(1, 10.0, 16.0, 80.0, 90.0, "a"), (1, None, 16.0, 80.0, 90.0, "b"), (1, 16.0, 22.0, 80.0, 90.0, None), (None, 10.0, 16.0, 80.0, 90.0, "c")], CHAR)
    boxes = spark.createDataFrame([(1, "t", 0.0, 50.0, 100.0, 150.0), (1, "u", 0.0, None, 100.0, 150.0), (1, "v", 50.0, 0.0, 100.0, 150.0), (None, "w", 0.0, 50.0, 100.0, 150.0)], BOX)
    assert {(r.page, r.box): r.caption for r in captions(chars, boxes).collect()} == {(1, "t"): "a", (1, "u"): None, (1, "v"): None, (None, "w"): None}
    assert captions(chars.limit(0), boxes).where("caption is not null").count() == 0
    assert captions(chars, boxes.limit(0)).count() == 0


def test_outside_brute_force(spark):
    rng = random.Random(6)
    chars = [(p, float(rng.randrange(600)), float(rng.randrange(0, 800, 5)), rng.choice("abc")) for p in range(4) for _ in range(500)]
    boxes = [(p, x, x + rng.randrange(300), y, y + rng.randrange(300)) for p in range(4) for _ in range(3) for x, y in [(float(rng.randrange(400)), float(rng.randrange(600)))]]
    want = {}
    for p, x, y, c in sorted(chars):
        if not any(q == p and a <= x <= b and s <= y <= t for q, a, b, s, t in boxes):
            want.setdefault(p, {}).setdefault(y, []).append((x, c))
    want = {p: "\n".join("".join(c for _, c in sorted(v[y])) for y in sorted(v)) for p, v in want.items()}
    got = outside_boxes(spark.createDataFrame(chars, "page long, x double, top double, c string"), spark.createDataFrame(boxes, "page long, x0 double, x1 double, y0 double, y1 double"))
    assert {r.page: r.text for r in got.collect()} == want


def test_places_meet_by_cells(spark):
    plan = captions(spark.createDataFrame([], CHAR), spark.createDataFrame([], BOX))._jdf.queryExecution().optimizedPlan().toString()
    assert "_gx" in plan and "_gy" in plan and "Cross" not in plan


def test_plain_markup_gives_the_full_parsers_tree():
    def shape(n):
        return n if isinstance(n, str) else (n.tag, n.attrs, [shape(c) for c in n.children])

    def full(markup):
        t = html._Tree()
        t.feed(markup)
        t.close()
        return t.root

    plain = ['a <p>b<p>c</p> d<BR/>e<br>f', '<TABLE Role="x"  id="A"><tr><td>1<td colspan="2">2<tr><th>3</table>t', '<ix:nonFraction name="us-gaap:A" sign="-">1,0</ix:nonFraction></b>', "", "text", '<a x="1" x="2" />']
    other = ["a &amp; b", "<!-- c --><p>x", "<script>a<b</script>", "<a b=c>", "<a b>", "a < b", "<p", "</a >x", "<a b='c'>", "<p>\x00<", "</p/>", '<a b="x&y">', "<title><b></title>"]
    assert all(html._plain_tree(m) is not None for m in plain) and all(html._plain_tree(m) is None for m in other)
    assert [shape(html.tree(m)) for m in plain + other] == [shape(full(m)) for m in plain + other]


def test_facts_of_a_filing_parsed_once_are_those_of_the_joins(spark):
    page = '<xbrli:context id="c"><xbrli:identifier>7</xbrli:identifier><xbrli:instant>2020-01-02</xbrli:instant></xbrli:context>' * 2
    page += '<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><ix:nonFraction name="n" contextRef="c" unitRef="u" scale="3" sign="-">1,5</ix:nonFraction>'
    page += '<ix:nonFraction name="n" contextRef="none" unitRef="none">2</ix:nonFraction><ix:nonFraction contextRef="c">3</ix:nonFraction><ix:nonNumeric name="t">4</ix:nonNumeric><ix:nonFraction name="n">no number</ix:nonFraction>'
    df = spark.createDataFrame([(1, page), (2, page.replace('"c"', '"d"')), (3, None), (4, "")], "doc_id long, html string")
    want = html.numeric_facts(html.inline_facts(df), html.contexts(df), html.units(df))
    got = html.filing_facts(df)
    key = lambda d: sorted(map(repr, d.select(*sorted(d.columns)).collect()))
    assert got.columns == want.columns and key(got) == key(want) and got.count() == 6
