"""Filings as markup: a small tree, stripped text, tables, and inline facts with their contexts and units.

Python parses one document at a time on Arrow batches; what it emits are flat
rows, and everything after (classification, joins, values, texts) is columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import display_number, resolve_unit

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that start a new line, and elements whose content is no text.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr li ol p section tr ul".split())
SKIPPED = frozenset("table script style xbrli:context context xbrli:unit unit ix:header".split())
SPACE = re.compile(r"[\s\xa0]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed([c for c in n.children if isinstance(c, Node)]))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def inside(self, tag: str) -> bool:
        p = self.parent
        while p is not None:
            if p.tag == tag:
                return True
            p = p.parent
        return False


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("td", "th", "tr") and self.top.tag in ("td", "th") and (tag == "tr" or self.top.tag in ("td", "th")):
            self.top = self.top.parent
        if tag == "tr" and self.top.tag == "tr":
            self.top = self.top.parent
        if tag == "p" and self.top.tag == "p":
            self.top = self.top.parent
        n = Node(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.children.append(n)
        if tag not in VOID:
            self.top = n

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.top.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.top))

    def handle_endtag(self, tag: str) -> None:
        n = self.top
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.top = n.parent

    def handle_data(self, data: str) -> None:
        self.top.children.append(data)


#: Plain markup, piece by piece: text, then a tag whose attributes are all in double quotes; no references, comments or declarations.
PLAIN = re.compile(r'''([^<&]*+)(?:<(/?)([A-Za-z][A-Za-z0-9:_-]*+)((?: +[A-Za-z_:][A-Za-z0-9:_.-]*+="[^"&<>]*+")*+) *(/?)>|\Z)''')
ATTRIBUTE = re.compile(r'([^ =]+)="([^"]*)"')
# Elements whose content the full parser reads by rules of its own.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext svg math".split())


def _plain_tree(markup: str) -> Node | None:
    """The tree of plain markup, as the full parser gives it in several times the time; None of any other."""
    t, at, end = _Tree(), 0, len(markup)
    while at < end:
        m = PLAIN.match(markup, at)
        if m is None:
            return None
        at = m.end()
        text, close, tag, attrs, empty = m.groups()
        if text:
            t.handle_data(text)
        if tag is None:
            break
        tag = tag.lower()
        if close:
            if attrs or empty or not m[0].endswith(m[3] + ">"):
                return None
            t.handle_endtag(tag)
        elif tag in RAW:
            return None
        else:
            (t.handle_startendtag if empty else t.handle_starttag)(tag, [(k.lower(), v) for k, v in ATTRIBUTE.findall(attrs)] if attrs else [])
    return t.root


def tree(markup: str) -> Node:
    plain = _plain_tree(markup or "")
    if plain is not None:
        return plain
    t = _Tree()
    t.feed(markup or "")
    t.close()
    return t.root


def local(tag: str) -> str:
    return tag.rpartition(":")[2]


def strip_tags(markup: str) -> str:
    """Text without markup: what tables, scripts, styles, contexts and units hold goes, blocks start lines, other runs are kept apart."""
    out: list[str] = []
    stack: list[Node | str] = [tree(markup)]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if out and out[-1] and n and not out[-1].endswith((" ", "\n")) and not n[0].isspace() and not (out[-1][-1].isalpha() and n[0].isalpha()):
                out.append(" ")
            out.append(n)
        elif n.tag not in SKIPPED:
            if n.tag in BLOCKS:
                out.append("\n")
            stack.extend(reversed(n.children))
    return "".join(out)


def _per_document(df: DataFrame, rows: Callable[[str], list[tuple]], fields: str, id_col: str, html_col: str) -> DataFrame:
    """Rows that ``rows`` makes of each document's tree, with the document's id; null markup makes none."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(doc, *r) for doc, markup in zip(pdf["doc"], pdf["html"], strict=True) if markup for r in rows(markup)]
            yield pd.DataFrame(out, columns=["doc_id", *names])

    return df.select(F.col(id_col).alias("doc"), F.col(html_col).alias("html")).mapInPandas(run, f"doc_id {kind}, {fields}")


def stripped(df: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    return _per_document(df, lambda m: [(strip_tags(m),)], "text string", id_col, html_col)


def _contexts(root: Node) -> list[tuple]:
    out = []
    for n in root.walk():
        if local(n.tag) == "context" and n.attrs.get("id"):
            got: dict[str, str | None] = dict.fromkeys(("identifier", "startdate", "enddate", "instant"))
            segment = []
            for c in n.walk():
                name = local(c.tag)
                if name in got:
                    got[name] = c.text().strip()
                elif name in ("explicitmember", "typedmember"):
                    segment.append((c.attrs.get("dimension", ""), c.text().strip()))
            out.append((n.attrs["id"], got["identifier"], "; ".join(f"{k}={v}" for k, v in segment) or None, got["startdate"], got["instant"] or got["enddate"]))
    return out


def contexts(df: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """``doc_id``, ``context_ref``, ``entity``, ``segment``, ``period_start``, ``period_end``; contexts without id are skipped."""
    return _per_document(df, lambda m: _contexts(tree(m)), "context_ref string, entity string, segment string, period_start string, period_end string", id_col, html_col)


def _units(root: Node) -> list[tuple]:
    out = []
    for n in root.walk():
        if local(n.tag) == "unit" and n.attrs.get("id"):
            out.append((n.attrs["id"], next((c.text().strip() for c in n.walk() if local(c.tag) == "measure"), None)))
    return out


def units(df: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    return _per_document(df, lambda m: _units(tree(m)), "unit_ref string, measure string", id_col, html_col)


def _inline(root: Node) -> list[tuple]:
    found = []
    for n in root.walk():
        if n.tag in ("ix:nonfraction", "ix:nonnumeric"):
            a = n.attrs
            place = 2 if n.inside("table") else 0
            found.append((place, len(found), n.tag == "ix:nonfraction", a.get("name"), a.get("contextref"), a.get("unitref"), a.get("scale"), a.get("sign"), a.get("decimals"), a.get("format"), a.get("id"), SPACE.sub(" ", n.text()).strip()))
    return sorted(found, key=lambda r: r[:2])  # narrative first, then what tables hold


FACT = "place int, seq int, numeric boolean, name string, context_ref string, unit_ref string, scale string, sign string, decimals string, format string, fact_id string, raw string"


def inline_facts(df: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    return _per_document(df, lambda m: _inline(tree(m)), FACT, id_col, html_col)


def _facts(markup: str) -> list[tuple]:
    """Facts with the contexts and units that they refer to in their document: a row each, as left joins give them."""
    root = tree(markup)
    ctx, unit = {}, {}
    for c in _contexts(root):
        ctx.setdefault(c[0], []).append(c[1:])
    for u, measure in _units(root):
        unit.setdefault(u, []).append(measure)
    return [(*f, *c, u) for f in _inline(root) if f[2] and f[3] is not None for c in ctx.get(f[4], [(None,) * 4]) for u in unit.get(f[5], [None])]


def filing_facts(df: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """``numeric_facts`` of whole filings, each parsed once: a fact's context and unit lie in its own document, so nothing is shuffled."""
    fields = f"{FACT}, entity string, segment string, period_start string, period_end string, measure string"
    return _valued(_per_document(df, _facts, fields, id_col, html_col).withColumn("value", _value()).where("value is not null"))


def numeric_facts(facts: DataFrame, ctx: DataFrame, unit: DataFrame) -> DataFrame:
    """Facts with a name and a number: number x 10^scale, negated by sign '-', with period, entity and unit joined on.

    Context and unit are left joins on (document, reference): a fact whose
    context is missing keeps null periods.
    """
    f = facts.where("numeric and name is not null").withColumn("value", _value()).where("value is not null")
    return _valued(f.join(ctx, ["doc_id", "context_ref"], "left").join(unit, ["doc_id", "unit_ref"], "left"))


def _value() -> Column:
    return display_number(F.col("raw")) * F.pow(F.lit(10.0), F.coalesce(F.col("scale").try_cast("int"), F.lit(0))) * F.when(F.col("sign") == "-", -1.0).otherwise(1.0)


def _valued(f: DataFrame) -> DataFrame:
    decimals = F.col("decimals").try_cast("int")
    return f.select("doc_id", "seq", "name", "value", "raw", resolve_unit(F.col("measure")).alias("unit"), "period_start", "period_end", "segment", "context_ref", "entity", F.col("scale").try_cast("int").alias("scale"), decimals.alias("decimals"), "fact_id")


def _rows_of(table: Node) -> list[Node]:
    """Its own rows, direct or in a head, body or foot."""
    out = []
    for c in table.children:
        if isinstance(c, Node):
            if c.tag == "tr":
                out.append(c)
            elif c.tag in ("thead", "tbody", "tfoot"):
                out += [r for r in c.children if isinstance(r, Node) and r.tag == "tr"]
    return out


def grid(table: Node) -> list[list[str]]:
    """Cells by row and column: a spanning cell's text stands at its first place, the rest of its span is empty."""
    taken: dict[tuple[int, int], str] = {}
    width = 0
    rows = _rows_of(table)
    for r, tr in enumerate(rows):
        c = 0
        for cell in (x for x in tr.children if isinstance(x, Node) and x.tag in ("td", "th")):
            while (r, c) in taken:
                c += 1
            down, across = (max(1, int(cell.attrs[k])) if cell.attrs.get(k, "").isdigit() else 1 for k in ("rowspan", "colspan"))
            for i in range(min(down, len(rows) - r)):
                for j in range(min(across, 1000)):
                    taken[(r + i, c + j)] = SPACE.sub(" ", cell.text()).strip() if not i and not j else ""
            c += across
            width = max(width, c)
    return [[taken.get((r, c), "") for c in range(width)] for r in range(len(rows))]


def _tables(markup: str) -> list[tuple]:
    out = []
    for n, t in enumerate((x for x in tree(markup).walk() if x.tag == "table"), 1):
        g = grid(t)
        caption = next((SPACE.sub(" ", c.text()).strip() for c in t.walk() if c.tag == "caption" and (c.parent is t or c.parent.tag == "thead")), None)
        tagged = any(c.tag in ("ix:nonfraction", "ix:nonnumeric") for c in t.walk())
        fraction = any(c.tag == "ix:nonfraction" for c in t.walk())
        out.append((n, caption, t.attrs.get("role"), fraction, tagged, bool(HIDDEN.search(t.attrs.get("style", ""))), t.inside("table"), sum(not HIDDEN.search(r.attrs.get("style", "")) for r in _rows_of(t)), g))
    return out


def tables(df: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """One row a table: its place, caption, traits and grid of cells."""
    fields = "n int, caption string, role string, has_fraction boolean, has_tag boolean, hidden boolean, nested boolean, visible_rows int, cells array<array<string>>"
    return _per_document(df, _tables, fields, id_col, html_col)


def dom_verdict() -> Column:
    """DATA, LAYOUT or UNCERTAIN by role, tags, style and nesting, in this order."""
    return (
        F.when(F.lower("role").isin("presentation", "none"), "LAYOUT").when(F.col("has_fraction"), "DATA").when(F.col("hidden"), "LAYOUT").when(F.col("nested"), "LAYOUT").otherwise("UNCERTAIN")
    )


def content_verdict() -> Column:
    """DATA or LAYOUT by how the cells are filled."""
    full = F.transform("cells", lambda r: F.size(F.filter(r, lambda c: c != "")))
    rows = F.size("cells")
    cells = F.aggregate(F.transform("cells", F.size), F.lit(0), lambda s, x: s + x)
    filled = F.aggregate(full, F.lit(0), lambda s, x: s + x)
    share = lambda test: F.size(F.filter(full, test)) / rows
    return (
        F.when(F.col("has_tag"), "DATA").when(F.col("visible_rows") <= 1, "LAYOUT").when(filled == 0, "LAYOUT")
        .when((rows >= 3) & (share(lambda n: n == 0) > 0.40), "LAYOUT").when((cells >= 6) & (filled / cells < 0.40), "LAYOUT").when((rows >= 3) & (share(lambda n: n <= 1) > 0.80), "LAYOUT").otherwise("DATA")
    )


def classified(t: DataFrame) -> DataFrame:
    v = dom_verdict()
    return t.withColumn("verdict", F.when(v == "UNCERTAIN", content_verdict()).otherwise(v)).withColumn("table_id", F.concat(F.lit("table_"), F.col("n")))


def table_text() -> Column:
    """Caption, then the rows, cells joined by a bar."""
    lines = F.transform("cells", lambda r: F.array_join(r, " | "))
    return F.concat(F.when(F.col("caption").isNotNull(), F.concat(F.lit("Table: "), F.col("caption"), F.lit("\n"))).otherwise(""), F.array_join(lines, "\n"))


def headed_cells(t: DataFrame) -> DataFrame:
    """``doc_id``, ``table_id``, ``row``, ``col``, ``value``, ``column_header``, ``row_header`` of the cells below the first row."""
    r = t.select("doc_id", "table_id", F.get("cells", F.lit(0)).alias("head"), F.posexplode("cells").alias("row", "line")).where("row > 0")
    c = r.select("doc_id", "table_id", "row", "head", F.get("line", F.lit(0)).alias("row_header"), F.posexplode("line").alias("col", "value"))
    return c.select("doc_id", "table_id", "row", "col", "value", F.get("head", F.col("col")).alias("column_header"), "row_header")
