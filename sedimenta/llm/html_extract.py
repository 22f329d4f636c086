"""Operator 7: main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import small_batches

#: What may begin markup; any other "<" is text.
MARK = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:_-]*+))")
#: The rest of a tag. Quotes count after "=" only; every part is possessive, so a match costs the length that it reads.
REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+>")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Elements by what they mean for the text in them.
RAW = frozenset("script style noscript template iframe object canvas textarea title xmp noframes noembed audio video".split())
SKIPPED = frozenset("svg select datalist".split())
BREAKING = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul button caption".split()
)
TELLING = frozenset("nav footer aside form menu button dialog fieldset header article main figure table".split())
CONTENT = frozenset("article main".split())
GOOD = frozenset(".article .content .entry .post .story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening one of the key closes if it is the innermost block.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Words in class, id or role whose log-odds the classifier learns.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner billboard breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus "
    "footer form gdpr header login masthead menu modal nav navbar navigation navi newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion "
    "rail recommend recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar trending widget widgets "
    "article body content entry main post story text title work".split()
)
#: Listed words that mark no boilerplate; the others share one more trait, from which rare ones borrow.
MILD = frozenset("article body content entry main post story text title work".split())
KIND = {**dict.fromkeys(("p", "pre", "blockquote"), "p"), **dict.fromkeys(HEADINGS, "heading"), **dict.fromkeys(("li", "td", "th", "dt", "dd"), "listed")}
#: Words from which length says nothing more, and the largest cost of one label.
LONG, LARGEST = 40, 6.0


@dataclass
class Block:
    """Text between two block boundaries, with the traits of the elements around it."""

    text: str
    linked: int
    tag: str
    parent: int
    away: int  # steps in the document tree from the block before
    traits: frozenset[str]


class _Open:
    __slots__ = ("content", "number", "tag", "traits")

    def __init__(self, tag: str, number: int, content: bool, traits: frozenset[str]):
        self.tag, self.number, self.content, self.traits = tag, number, content, traits


def _traits(tag: str, attrs: str, content: bool) -> set[str]:
    """What an element says of the text in it; the same word may mean another thing inside an article."""
    found = {tag} if tag in TELLING else set()
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            words = {w for w in (x.lower() for x in NAME.findall(value)) if w in WORDS}
            found |= {"." + w for w in words} | ({".any"} if words - MILD else set())
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            found.add("hidden")
    return {("in " if content else "out ") + t for t in found}


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without empty ones; time in proportion to the page.

    Unclosed elements end with their parent, or with the page. A "<" that
    begins no tag is text. Where the page ends inside quotes, tags from there
    on end at their first ">"; a tag without any ">" after it ends at the next "<".
    """
    found: list[Block] = []
    none: frozenset[str] = frozenset()
    stack = [_Open("", 0, False, none)]
    opened: Counter[str] = Counter()
    endless: set[str] = set()
    text: list[str] = []
    linked = links = number = at = start = skip = 0
    depth = lowest = 1
    quotes = ends = True

    def end() -> None:
        nonlocal linked, depth, lowest
        if text:
            joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                top = stack[-1]
                found.append(Block(joined, min(linked, len(joined)), top.tag, stack[-2].number if len(stack) > 1 else 0, depth + len(stack) - 2 * lowest, top.traits))
                depth = lowest = len(stack)
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not skip:
            text.append(piece)
            if links:
                linked += len(piece.strip())

    def close(to: int) -> None:
        nonlocal lowest
        for o in stack[to:]:
            opened[o.tag] -= 1
        del stack[to:]
        lowest = min(lowest, len(stack))

    while m := MARK.search(page, at):
        add(page[start : m.start()])
        tag = m[2]
        if tag is None:
            if page.startswith("<!--", m.start()):
                stop = m.end() if page.startswith((">", "->"), m.end()) else page.find("-->", m.end())
                at = page.find(">", stop) + 1 if stop >= 0 else 0
            else:
                at = page.find(">", m.end()) + 1
            at = start = at or len(page)
            continue
        attrs = ""
        rest = REST.match(page, m.end()) if quotes else None
        if rest:
            attrs, at = rest[0][:-1], rest.end()
        else:
            quotes = False
            stop = page.find(">", m.end()) if ends else -1
            if stop < 0:
                ends = False
                stop = page.find("<", m.end())
                at = stop if stop >= 0 else len(page)
            else:
                attrs, at = page[m.end() : stop], stop + 1
        start = at
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in SKIPPED:
                skip = 0
            elif tag in BREAKING:
                skip = 0
                end()
                if opened[tag] > 0:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in RAW:
            if tag not in endless and (not attrs.endswith("/") or tag in ("script", "style")):
                shut = re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A).search(page, at)
                if shut:
                    at = page.find(">", shut.end()) + 1 or len(page)
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    endless.add(tag)
                start = at
            if tag != "textarea":
                add(" ")
        elif tag in SKIPPED:
            skip = 0 if attrs.endswith("/") else 1
        elif tag == "a":
            links += 1
        elif tag == "br":
            add(" ")
        elif tag in BREAKING:
            skip = 0
            end()
            if tag == "hr":
                continue
            while len(stack) > 1 and (stack[-1].tag in CLOSES.get(tag, ()) or (stack[-1].tag in KIND and KIND[stack[-1].tag] != "listed" and stack[-1].tag != "blockquote" and tag not in CLOSES)):
                close(len(stack) - 1)
            number += 1
            links = 0
            top = stack[-1]
            new = _traits(tag, attrs, top.content)
            inside = top.content or tag in CONTENT or any(t[4:] in GOOD for t in new)
            stack.append(_Open(tag, number, inside, top.traits | new if new - top.traits else top.traits))
            opened[tag] += 1
    add(page[start:].removesuffix("<"))  # markup cut off at its first character
    end()
    return found


def traits(b: Block) -> dict[str, float]:
    """The classifier's inputs of a block."""
    words = min(b.text.count(" ") + 1, LONG)
    return {
        **dict.fromkeys(b.traits, 1.0), "base": 1.0, "words": math.log(words), "links": b.linked / len(b.text), "sentence": float(b.text[-1] in ".!?:;\"”»"), "tag " + KIND.get(b.tag, "other"): 1.0,
    }


@dataclass(frozen=True)
class Labeller:
    """Weights of a linear classifier of blocks, and the smoothness between neighbours and between siblings."""

    weights: dict[str, float] = field(default_factory=dict)
    adjacent: float = 1.2
    sibling: float = 0.5

    def log_odds(self, b: Block) -> float:
        """How much likelier, as a logarithm, the block is content; at most LARGEST either way, so that neighbours can overrule it."""
        s = sum(self.weights.get(k, 0.0) * x for k, x in traits(b).items())
        return max(-LARGEST, min(LARGEST, s))

    def edges(self, found: list[Block]) -> list[tuple[int, int, float]]:
        """Neighbours pull each other the more, the nearer they are in the document tree; so do the next blocks of one parent."""
        made = [(i, i + 1, self.adjacent / max(1, b.away)) for i, b in enumerate(found[1:])]
        last: dict[int, int] = {}
        for i, b in enumerate(found):
            j = last.get(b.parent)
            if j is not None:
                made.append((j, i, self.sibling))
            last[b.parent] = i
        return made

    def keep(self, found: list[Block]) -> list[bool]:
        return minimum_cut([self.log_odds(b) for b in found], self.edges(found))


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut: node i has capacity terminal[i] from the source if positive, else to the sink.

    A node whose capacity is at least that of all its edges is decided by it,
    and then counts as capacity of its neighbours; that takes one pass. What is
    left is cut by a maximum flow, in blocking flows over shortest paths.
    """
    left, n, tiny = list(terminal), len(terminal), 1e-9
    near: list[dict[int, float]] = [{} for _ in left]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    bound = [sum(d.values()) for d in near]
    side: list[bool | None] = [None] * n
    queue = [i for i in range(n) if abs(left[i]) >= bound[i] - tiny]
    while queue:
        i = queue.pop()
        if side[i] is None:
            side[i] = left[i] > 0
            for j, c in near[i].items():
                if side[j] is None:
                    left[j] += c if side[i] else -c
                    bound[j] -= c
                    if abs(left[j]) >= bound[j] - tiny:
                        queue.append(j)
    still = [i for i in range(n) if side[i] is None]
    arcs = {i: [j for j in near[i] if side[j] is None] for i in still}
    while still:
        level = {i: 0 for i in still if left[i] > tiny}
        reached, ahead = False, list(level)
        for a in ahead:
            if left[a] < -tiny:
                reached = True
                continue
            for b in arcs[a]:
                if b not in level and near[a][b] > tiny:
                    level[b] = level[a] + 1
                    ahead.append(b)
        if not reached:
            for i in still:
                side[i] = i in level
            break
        at = dict.fromkeys(level, 0)
        for s in [i for i in level if not level[i]]:
            path = [s]
            while path and left[s] > tiny:
                a = path[-1]
                if left[a] < -tiny:
                    flow = min(left[s], -left[a], *(near[x][y] for x, y in pairwise(path)))
                    left[s] -= flow
                    left[a] += flow
                    for x, y in pairwise(path):
                        near[x][y] -= flow
                        near[y][x] += flow
                    full = next((k for k, (x, y) in enumerate(pairwise(path)) if near[x][y] <= tiny), len(path) - 2)
                    del path[full + 1 :]
                    continue
                while at[a] < len(arcs[a]):
                    b = arcs[a][at[a]]
                    if near[a][b] > tiny and level.get(b) == level[a] + 1:
                        path.append(b)
                        break
                    at[a] += 1
                else:
                    path.pop()
                    if path:
                        at[path[-1]] += 1
    return [bool(x) for x in side]


def fit(pages: list[tuple[str, dict[str, bool]]], ridge: float = 0.3) -> Labeller:
    """Logistic regression on the blocks of labelled pages: html, and the label of each block's text (others teach nothing).

    Newton's method with a ridge penalty; traits seen in fewer than three
    blocks get no weight. Pages are few and held by the driver.
    """
    rows = [(traits(b), labels[b.text]) for page, labels in pages for b in blocks(page) if b.text in labels]
    seen = Counter(k for x, _ in rows for k in x)
    names = sorted(k for k, n in seen.items() if n >= 3)
    if not names:
        return Labeller()
    place = {k: i for i, k in enumerate(names)}
    x, y = np.zeros((len(rows), len(names))), np.array([label for _, label in rows], float)
    for r, (have, _) in enumerate(rows):
        for k, v in have.items():
            if k in place:
                x[r, place[k]] = v
    w = np.zeros(len(names))
    penalty = ridge * np.eye(len(names))
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Labeller(dict(zip(names, w.tolist(), strict=True)))


def labelled_pages(count: int = 1000, seed: int = 7) -> list[tuple[str, dict[str, bool]]]:
    """Pages of made-up words in many layouts, with the label of each block: what ``fit`` learns from where no labelled pages are given."""
    rng, made = Random(seed), []
    stock = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    for _ in range(count):
        labels: dict[str, bool] = {}

        def words(n: int) -> str:
            return " ".join(rng.choices(stock, k=n))

        def say(content: bool, low: int, high: int, stop: float = 0.9, links: float = 0.0, labels: dict = labels) -> str:
            n = rng.randint(low, high)
            parts = [words(n).capitalize() + (rng.choice("..!?") if rng.random() < stop else "")]
            if rng.random() < links:
                parts.append(words(rng.randint(1, max(1, n // 2))))
                plain = " ".join(parts)
                parts[1] = f'<a href="/x">{parts[1]}</a>'
            else:
                plain = parts[0]
            labels[plain] = content
            return " ".join(parts)

        def link(content: bool = False, low: int = 1, high: int = 4, labels: dict = labels) -> str:
            t = words(rng.randint(low, high)).capitalize()
            labels[t] = content
            return f'<a href="/y">{t}</a>'

        def list_of(make, low: int = 2, high: int = 6) -> str:  # noqa: ANN001
            return "<ul>" + "".join(f"<li>{make()}</li>" for _ in range(rng.randint(low, high))) + "</ul>"

        def named(word: str) -> str:
            return rng.choice(("class", "class", "id")) + '="' + rng.choice((word, f"site-{word}", f"{word}-1", f"{word} box", f"c-{word}")) + '"'

        def boilerplate(inside: bool) -> str:
            what = rng.random()
            text = lambda: "".join(f"<p>{say(False, 2, rng.choice((12, 40, 160)), 0.9, 0.2)}</p>" for _ in range(rng.randint(1, 4)))
            if what < 0.2:
                return f"<section {named(rng.choice(('comments', 'comment', 'replies', 'disqus', 'respond', 'reply')))}><h3>{say(False, 1, 3, 0)}</h3>{text()}</section>"
            if what < 0.35:
                return f"<aside>{rng.choice((text, lambda: list_of(link)))()}</aside>"
            if what < 0.45:
                return f"<nav>{list_of(link)}</nav>"
            if what < 0.55:
                return f"<form action=x><p>{say(False, 3, 25)}</p><label>{say(False, 1, 3, 0)}</label><button>{say(False, 1, 2, 0)}</button></form>"
            if what < 0.62:
                return f"<footer><p>{say(False, 4, 30, 0.7, 0.3)}</p></footer>"
            if what < 0.67:
                return f"<div {rng.choice(('hidden', 'style=display:none'))}>{text()}</div>"
            if what < 0.72 and not inside:
                return f"<header><h1>{say(False, 1, 4, 0)}</h1><p>{say(False, 3, 15)}</p>{list_of(link) if rng.random() < 0.5 else ''}</header>"
            word = rng.choice(sorted(w for w in WORDS - MILD if not (inside and w in ("header", "search", "form", "related"))))
            return f"<div {named(word)}>{rng.choice((text, lambda: list_of(link), lambda: say(False, 2, 30, 0.8, 0.3)))()}</div>"

        def content() -> str:
            out = [f"<h1>{say(True, 2, 10, 0)}</h1>"]
            if rng.random() < 0.3:
                out = [f"<header {named(rng.choice(('post-header', 'entry-header', 'title')))}>{out[0]}</header>"]
            for _ in range(rng.randint(2, 9)):
                kind = rng.random()
                if kind < 0.55:
                    out.append(f"<p>{say(True, 1, rng.choice((6, 25, 90)), 0.9, 0.3)}</p>")
                elif kind < 0.65:
                    out.append(f"<h2>{say(True, 1, 6, 0)}</h2><p>{say(True, 5, 60)}</p>")
                elif kind < 0.73:
                    out.append(list_of(lambda: say(True, 1, 15, 0.5, 0.2)))
                elif kind < 0.78:
                    out.append(rng.choice(("<blockquote>{}</blockquote>", "<pre>{}</pre>", "<div>{}</div>")).format(say(True, 3, 40)))
                elif kind < 0.82:
                    out.append(f"<figure><img src=x><figcaption>{say(True, 2, 12, 0.6)}</figcaption></figure>")
                elif kind < 0.86:
                    out.append(f"<table><tr><th>{say(True, 1, 3, 0)}<th>{say(True, 1, 3, 0)}<tr><td>{say(True, 1, 5, 0)}<td>{say(True, 1, 5, 0)}</table>")
                elif kind < 0.9:  # a listed word that means nothing here
                    word = rng.choice(("related-work", "share-price", "search-results", "social-impact", "header-files", "form-factor", "post-header", "text-widget", "trending-topics", "menu-card", "alert-levels"))
                    out.append(f"<section {rng.choice(('class', 'id'))}={word}><h2>{say(True, 1, 5, 0)}</h2><p>{say(True, 6, 60)}</p><p>{say(True, 3, 60)}</p></section>")
                else:
                    out.append(boilerplate(True))
            return "".join(out)

        body = content()
        around = rng.choice(("<article>{}</article>", "<main>{}</main>", "<main><article class=post>{}</article></main>", "<div class='post-content'>{}</div>", "<div id=content>{}</div>", "<div class=entry>{}</div>", "<div>{}</div>", "<article class='story body'>{}</article>", "<section class='article-body'>{}</section>"))
        before = "".join(boilerplate(False) for _ in range(rng.randint(0, 3)))
        after = "".join(boilerplate(False) for _ in range(rng.randint(0, 3)))
        made.append((f"<html><body>{before}{around.format(body)}{after}</body></html>", labels))
    return made


@lru_cache(maxsize=1)
def trained() -> Labeller:
    """The classifier of ``labelled_pages``; the same at every run."""
    return fit(labelled_pages())


def main_text(page: str, labeller: Labeller | None = None) -> str:
    """The blocks that the cut leaves on the content side, one a line."""
    found = blocks(page)
    keep = (labeller or trained()).keep(found)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(df: DataFrame, labeller: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page's whole html. No shuffle.

    Null and empty pages give an empty text. Repeated rows come back as often;
    extra columns are never read. ``labeller`` (a few hundred weights) is
    trained on ``labelled_pages`` unless one of ``fit`` is given.
    """
    small_batches(df.sparkSession)
    model = labeller or trained()
    d = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h, model) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return d.mapInArrow(run, f"page_id {d.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
