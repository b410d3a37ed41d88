"""Main text of HTML pages by boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of elements and text runs. Every node is described by its subtree (text, links,
signs, tags, text per tag), its attribute tokens and those above it, its depth, its place and its
siblings, and gradient-boosted trees say how likely it is all main text. Decoding walks the tree from its
leaves: a node is taken whole if its characters, weighed by its odds, are worth more than what its
children are worth by themselves. The result is a set of subtrees none of which holds another, so no node is
in while its ancestor is out by contradiction.

No table labels pages, so the trees are trained on pages drawn from a seeded grammar of layouts, whose
articles are known; ``PAGES`` bounds them. Extraction is one map over all whole pages.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .shared import table

PAGES, SEED = 700, 5
MARK = re.compile(r"[>\"']")
TAG = re.compile(r"/?[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"\s+")

#: Fixed values of HTML: elements without content, elements of raw text, which is none of the page's, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "li", "dd", "dt", "legend"}
#: Elements whose start ends an open one of the same list, up to the fence.
SIBLINGS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
GROUPS = [("article", "main"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "section"), ("ul", "ol", "li", "dl", "dt", "dd"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button", "label", "input", "select", "option"), ("a",), ("table", "tr", "td", "th", "tbody"), ("figure", "figcaption", "blockquote", "pre"), ("noscript", "iframe", "template", "object", "canvas", "audio", "video"), ("svg", "math"), ("#text",)]
GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}
#: Attribute tokens with a feature each, for the node itself and for what stands above it.
GOOD = "article content post entry main body story text page".split()
BAD = "nav menu header footer sidebar side widget ad ads advert advertisement banner promo sponsor sponsored cookie consent notice alert popup modal overlay comment comments reply respond discussion related recommended share social breadcrumb breadcrumbs pagination form subscribe newsletter login signup search meta tags toolbar copyright skip".split()
KINDS = {t: i for i, t in enumerate(GOOD + BAD)}
GOOD_SET, BAD_SET = frozenset(GOOD), frozenset(BAD)
BAD_TAGS = frozenset("nav header footer aside form button menu fieldset select noscript iframe template".split())
#: Nodes that are described and judged at a time.
NODES = 50_000


class Page:
    """The tree as parallel lists; node 0 is the root and a parent comes before its children."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.text, self.tokens = ["#root"], [-1], [""], [()]
        self.open: dict[str, int] = {}
        stack, at, n, self.last = [0], 0, len(source), {}
        while at < n:
            begin = source.find("<", at)
            if begin < 0:
                self._text(stack[-1], source[at:])
                return
            tag = TAG.match(source, begin + 1)
            if not tag and source[begin + 1 : begin + 2] not in ("!", "?"):  # a sign of the text
                begin = source.find("<", begin + 1)
                self._text(stack[-1], source[at : begin if begin >= 0 else n])
                at = begin if begin >= 0 else n
                continue
            self._text(stack[-1], source[at:begin])
            if not tag:
                at = self._declaration(source, begin, stack[-1])
                continue
            end = self._end(source, tag.end())
            at = end + 1
            if end >= n and source[begin + 1] != "/" and tag.end() < n:  # no tag's end: what follows is text
                self._text(stack[-1], source[tag.end() :])
                return
            name = tag[0].lower()
            if name[0] == "/":
                self._close(stack, name[1:])
                continue
            self._implied(stack, name)
            attributes = source[tag.end() : end]
            if name in RAW:
                at = self._raw_end(source, at, name)
                continue
            node = self._add(stack[-1], name, "", attributes)
            if name not in VOID and not (attributes.rstrip().endswith("/") and name not in BLOCK):
                stack.append(node)
                self.open[name] = self.open.get(name, 0) + 1

    def _find(self, source: str, what: str, at: int) -> int:
        """source.find(what, at), or its length; once nothing was found, nothing is looked for again."""
        if self.last.get(what, at + 1) <= at:
            return len(source)
        found = source.find(what, at)
        if found < 0:
            self.last[what] = at
            return len(source)
        return found

    def _end(self, source: str, at: int) -> int:
        """Place of the > that ends a tag: signs in quotes do not, unless a quote is left open."""
        first = self._find(source, ">", at)
        if first == len(source):
            return first
        k = at
        while mark := MARK.search(source, k):
            if mark[0] == ">":
                return mark.start()
            close = self._find(source, mark[0], mark.end())
            if close == len(source):
                return first
            k = close + 1
        return first

    def _declaration(self, source: str, begin: int, parent: int) -> int:
        """Skip a comment, a doctype or the like; a CDATA section is text. One that is left open ends at
        the next > or else with its first sign."""
        if source.startswith("<![CDATA[", begin):
            end = self._find(source, "]]>", begin)
            self._text(parent, html.escape(source[begin + 9 : end]))
            return end + 3
        if source.startswith("<!--", begin):
            if source.startswith(("<!-->", "<!--->"), begin):
                return source.index(">", begin) + 1
            end = self._find(source, "-->", begin + 4)
            if end < len(source):
                return end + 3
        return self._find(source, ">", begin) + 1

    def _raw_end(self, source: str, at: int, name: str) -> int:
        """Behind the end tag of an element of raw text. A script or style without one has the rest of the page,
        as HTML has it; an open title or textarea has nothing."""
        k = at if self.last.get(f"</{name}", at + 1) > at else len(source)
        while (k := self._find(source, "</", k)) < len(source):
            if source[k + 2 : k + 2 + len(name)].lower() == name and not source[k + 2 + len(name) : k + 3 + len(name)].isalnum():
                return self._find(source, ">", k) + 1
            k += 2
        self.last.setdefault(f"</{name}", at)
        return len(source) if name in ("script", "style") else at

    def _add(self, parent: int, tag: str, text: str, attributes: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append(text)
        self.tokens.append(tuple(t.lower() for m in ATTRIBUTE.finditer(attributes) for t in NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or ""))) if attributes.strip() else ())
        return len(self.tag) - 1

    def _text(self, parent: int, raw: str) -> None:
        if raw and not raw.isspace():
            self._add(parent, "#text", html.unescape(raw), "")
        elif raw:
            self._add(parent, "#space", " ", "")

    def _cut(self, stack: list[int], k: int) -> None:
        for node in stack[k:]:
            self.open[self.tag[node]] -= 1
        del stack[k:]

    def _close(self, stack: list[int], tag: str) -> None:
        if self.open.get(tag):
            k = len(stack) - 1
            while self.tag[stack[k]] != tag:
                k -= 1
            self._cut(stack, k)

    def _implied(self, stack: list[int], tag: str) -> None:
        if tag in CLOSES_P and self.open.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] == "p":
                    self._cut(stack, k)
                    break
                if self.tag[stack[k]] in BLOCK:
                    break
        if tag in SIBLINGS and any(self.open.get(t) for t in SIBLINGS[tag][0]):
            ends, fence = SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in fence:
                    break
                if self.tag[stack[k]] in ends:
                    self._cut(stack, k)
                    break


def sums(parent: np.ndarray, own: np.ndarray) -> np.ndarray:
    out = own.astype(np.float64).tolist()
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] += out[i]
    return np.array(out)


def features(page: Page) -> tuple[list[np.ndarray], np.ndarray]:
    """(parts of the features, each [node, feature] and as narrow as its values are, characters under each node)."""
    n = len(page.tag)
    parent = page.parent
    own = np.array([len(t.strip()) if tag == "#text" else 0 for tag, t in zip(page.tag, page.text, strict=True)], dtype=np.float64)
    signs = np.array([sum(map(t.count, ".,;!?")) if o else 0 for t, o in zip(page.text, own, strict=True)], dtype=np.float64)
    words = np.array([t.count(" ") + 1 if o else 0 for t, o in zip(page.text, own, strict=True)], dtype=np.float64)
    chars = sums(parent, own)
    tags = sums(parent, np.array([tag[0] != "#" for tag in page.tag]))
    depth, linked, poor, good = [0] * n, [False] * n, [False] * n, [False] * n
    kinds, count, place = np.zeros((n, len(KINDS)), dtype=np.uint8), [0] * n, [0] * n
    above = np.zeros((n, len(KINDS)), dtype=np.uint8)
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p, tag = parent[i], page.tag[i]
        depth[i] = depth[p] + 1
        linked[i] = linked[p] or tag == "a"
        bad_here = tag in BAD_TAGS or not BAD_SET.isdisjoint(page.tokens[i])
        poor[i] = poor[p] or bad_here
        good[i] = good[p] or tag in ("article", "main") or not GOOD_SET.isdisjoint(page.tokens[i])
        for t in page.tokens[i]:
            k = KINDS.get(t)
            if k is not None:
                kinds[i, k] = 1
        if page.tokens[p] or above[p].any():
            above[i] = np.maximum(above[p], kinds[p])
        if tag != "#space":
            place[i] = count[p]
            count[p] += 1
            same[p, tag] = same.get((p, tag), 0) + 1
    under_link = sums(parent, own * np.array(linked))
    under_poor = sums(parent, own * np.array(poor))
    total = max(chars[0], 1)
    before = np.concatenate([[0], np.cumsum(own)[:-1]])
    up = np.maximum(np.array(parent), 0)
    siblings = np.array(count)[up]
    group = np.zeros((n, len(GROUPS)), dtype=np.uint8)
    for i, tag in enumerate(page.tag):
        if tag in GROUP:
            group[i, GROUP[tag]] = 1
    above_group = np.zeros((n, len(GROUPS)), dtype=np.uint8)
    for i in range(1, n):
        above_group[i] = above_group[parent[i]]
        if page.tag[parent[i]] in GROUP:
            above_group[i, GROUP[page.tag[parent[i]]]] = 1
    all_words, all_signs = sums(parent, words), sums(parent, signs)
    alike = np.array([0] + [same.get((parent[i], page.tag[i]), 1) for i in range(1, n)])
    basic = np.column_stack(
        [
            np.log1p(chars), under_link / np.maximum(chars, 1), np.log1p(chars / (tags + 1)), all_signs / np.maximum(all_words, 1), np.log1p(all_words),
            depth, siblings, np.array(place) / np.maximum(siblings, 1), alike / np.maximum(siblings, 1), chars / total, before / total,
            under_poor / np.maximum(chars, 1), poor, good, chars / np.maximum(chars[up], 1), np.log1p(chars[up]), under_link[up] / np.maximum(chars[up], 1),
        ]
    )
    return [basic.astype(np.float32), group, above_group, kinds, above], chars


def dense(parts: list[np.ndarray], a: int = 0, b: int | None = None) -> np.ndarray:
    """The features of the nodes from a to b as one table."""
    return np.hstack([p[a:b].astype(np.float32) for p in parts])


def odds_of(trees: Trees, described: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Each page's odds per node: small pages are judged together, a large one by parts."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(described):
        to, nodes = at, 0
        while to < len(described) and (to == at or nodes + len(described[to][0]) <= NODES):
            nodes += len(described[to][0])
            to += 1
        if to == at + 1:
            out.append(np.concatenate([trees.probability(dense(described[at], a, a + NODES)) for a in range(0, nodes, NODES)]))
        else:
            odds = trees.probability(np.vstack([dense(d) for d in described[at:to]]))
            out += np.split(odds, np.cumsum([len(d[0]) for d in described[at:to]])[:-1])
        at = to
    return out


def chosen(page: Page, odds: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """True for the nodes taken whole: the subtrees of most worth, none inside another."""
    n, parent = len(page.tag), page.parent
    worth = chars * (2 * odds - 1)
    below = np.zeros(n)
    best = np.zeros(n)
    whole = np.zeros(n, dtype=bool)
    for i in range(n - 1, 0, -1):
        # a node and its children say much the same; a tie goes to the node
        whole[i] = worth[i] > 0 and worth[i] >= 0.97 * below[i]
        best[i] = max(worth[i] if whole[i] else 0, below[i])
        below[parent[i]] += best[i]
    taken = np.zeros(n, dtype=bool)
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[parent[i]] or taken[parent[i]]
        taken[i] = whole[i] and not inside[i]
    return taken


def render(page: Page, taken: np.ndarray) -> str:
    """The text of the taken subtrees: white space in a block is one space, blocks are lines."""
    n, blocks, run = len(page.tag), [], []
    inside = [False] * n
    open_blocks: list[int] = []

    def flush() -> None:
        line = SPACE.sub(" ", "".join(run)).strip()
        if line:
            blocks.append(line)
        run.clear()

    ends = list(range(n))
    for i in range(n - 1, 0, -1):
        ends[page.parent[i]] = max(ends[page.parent[i]], ends[i])
    for i in range(1, n):
        while open_blocks and ends[open_blocks[-1]] < i:
            open_blocks.pop()
            flush()
        inside[i] = inside[page.parent[i]] or bool(taken[i])
        tag = page.tag[i]
        if tag in BLOCK:
            flush()
            open_blocks.append(i)
        elif tag == "br":
            run.append(" ")
        if inside[i] and tag[0] == "#":
            run.append(page.text[i])
    flush()
    return "\n".join(blocks)


class Grammar:
    """Pages with known articles: words are drawn, and layouts mix what real ones have."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        syllables = "ba ce di fo gu la me ni or pu ra se ti un ve as en ill ost th".split()
        out = ["".join(syllables[k] for k in r.integers(0, len(syllables), r.integers(1, 4))) for _ in range(r.integers(low, high))]
        return " ".join(out)

    def sentence(self) -> str:
        s = self.words(4, 18)
        return s[:1].upper() + s[1:] + "."

    def prose(self) -> str:
        out = [self.sentence() for _ in range(self.rng.integers(1, 7))]
        if self.rng.random() < 0.15:
            out.insert(0, f'<a href="/{self.words(1, 2)}">{self.words(1, 4)}</a>')
        return " ".join(out)

    def maybe(self, share: float, *texts: str) -> str:
        return texts[int(self.rng.integers(len(texts)))] if self.rng.random() < share else ""

    def links(self, low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{self.words(1, 2)}">{self.words(1, 4)}</a></li>' for _ in range(self.rng.integers(low, high))) + "</ul>"

    def box(self, tags: str, names: str, inner: str) -> str:
        r = self.rng
        tag, name = (x[int(r.integers(len(x)))] for x in (tags.split(), names.split()))
        attribute = ("", f' class="{name}"', f' id="{name}"', f' class="box {name}-{self.words(1, 2)}"')[int(r.choice(4, p=[0.1, 0.5, 0.2, 0.2]))]
        if tag == "div" and not attribute:
            attribute = f' class="{name}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def article(self) -> str:
        r = self.rng
        title = self.words(3, 10)
        out = [f"<h1>{title}</h1>"] if r.random() < 0.8 else []
        for _ in range(int(r.integers(0, 12)) if r.random() < 0.9 else 0):
            kind = r.random()
            if kind < 0.62:
                out.append(f"<p>{self.prose()}</p>")
            elif kind < 0.72:
                out.append(f"<p><b>{self.prose()}<br>")
            elif kind < 0.79:
                out.append(f"<h2>{self.words(2, 7)}</h2><p>{self.prose()}</p>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.integers(2, 6))) + "</ul>")
            elif kind < 0.89:
                out.append(f"<blockquote><p>{self.prose()}</p></blockquote>")
            elif kind < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(r.integers(2, 5))) + "</table>")
            elif kind < 0.95:
                out.append(f"<div>{self.prose()}</div>")
            else:
                out.append("\x01" + self.box("div aside", "ad advert promo related share newsletter", self.maybe(0.5, self.links(2, 5)) + self.words(2, 12)) + "\x02")
        if not out or (len(out) == 1 and r.random() < 0.7):
            out.append(f"<p>{self.prose()}</p>")
        for inner in ("<p>{0} <math><mi>{1}</mi><mo>=</mo><mn>2</mn></math> {0}</p>", "<figure><svg><text>{1}</text></svg><figcaption>{0}</figcaption></figure>", "<video><p>{0}</p></video>", "<object><p>{0}</p></object>", "<p>{0} <audio>{1}</audio></p>"):
            if r.random() < 0.02:
                out.insert(int(r.integers(len(out) + 1)), inner.format(self.prose(), self.words(1, 3)))
        return "".join(out)

    def page(self) -> str:
        """A page whose article stands between \\x02 and \\x01; the same signs fence off what is not in it."""
        r = self.rng
        script = self.maybe(0.1, f"<noscript>{self.sentence()}</noscript>", f"<noscript><p>{self.prose()}</p></noscript>", f"<iframe>{self.words(1, 6)}</iframe>", f"<template><p>{self.prose()}</p></template>", f"<svg><title>{self.words(1, 3)}</title><text>{self.words(1, 3)}</text></svg>")
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        nav = self.maybe(0.85, f"<nav>{self.links(3, 8)}</nav>", self.box("div nav", "nav menu navigation", self.links(3, 9)), f"<nav>{' '.join(f'<a href=/>{self.words(1, 3)}</a>' for _ in range(5))}</nav>")
        top = self.maybe(0.4, f"<header><h1>{self.words(1, 4)}</h1>{nav}</header>", self.box("header div", "header site-header masthead", f"<p>{self.words(1, 8)}</p>") + nav) or nav
        notice = self.maybe(0.35, self.box("div section", "cookie consent notice alert banner", f"<p>{self.prose()}</p><button>{self.words(1, 3)}</button>"))
        ad = self.maybe(0.6, self.box("div", "ad ads advert banner sponsored promo", self.prose()), self.box("div aside", "ad sponsor", f"<p>{self.prose()}</p>"))
        crumbs = self.maybe(0.2, self.box("div nav", "breadcrumb breadcrumbs", " &gt; ".join(f"<a href=/>{self.words(1, 3)}</a>" for _ in range(3))))
        side = self.maybe(0.4, self.box("aside div", "sidebar widget side", f"<h3>{self.words(1, 4)}</h3>" + self.links(2, 7) + self.maybe(0.5, f"<p>{self.prose()}</p>")))
        form = self.maybe(0.3, f"<form><label>{self.words(1, 4)}</label><input name=q>{self.maybe(0.3, f"<select><option>{self.words(1, 3)}<option>{self.words(1, 3)}</select>")}<p>{self.sentence()}</p><button>{self.words(1, 3)}</button></form>", self.box("div", "newsletter subscribe login search", f"<form><p>{self.sentence()}</p><input></form>"))
        comments = self.maybe(0.4, self.box("section div", "comments comment-list discussion respond", f"<h3>{self.words(1, 3)}</h3>" + "".join(f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.prose()}</p></div>' for _ in range(r.integers(1, 6)))))
        related = self.maybe(0.25, self.box("div section", "related recommended more", f"<h3>{self.words(1, 4)}</h3>{self.links(2, 6)}"))
        foot = self.maybe(0.85, f"<footer>&copy; {self.words(1, 3)} &middot; {self.prose()}</footer>", self.box("footer div", "footer copyright site-footer", f"<p>{self.words(2, 12)}</p>" + self.maybe(0.5, self.links(2, 5))))
        article = "\x02" + self.article() + "\x01"
        wrap = r.random()
        if wrap < 0.55:
            article = f"<article>{article}</article>"
        elif wrap < 0.7:
            article = f"<main>{article}</main>"
        elif wrap < 0.95:
            article = self.box("div section", "content post entry-content article-body story main page-content text", article)
        around = [x for x in (comments, related) if x]
        if around and r.random() < 0.3:
            article = article.replace("</article>", "".join(around) + "</article>") if "</article>" in article else article + "".join(around)
            around = []
        middle = [crumbs, notice, ad] if r.random() < 0.7 else [ad, notice, crumbs]
        tail = [*around, side, form] if r.random() < 0.6 else [side, form, *around]
        body = script + top + "".join(middle) + article + "".join(tail) + foot
        if r.random() < 0.3:
            body = f'<div class="{("wrapper", "page", "container")[int(r.integers(3))]}">{body}</div>'
        return head + body + "</body></html>"


def train(pages: int = PAGES, seed: int = SEED) -> Trees:
    """Trees from pages of the grammar; a node is main text if nine tenths of its characters are."""
    grammar, xs, ys, weights = Grammar(seed), [], [], []
    for _ in range(pages):
        page = Page(grammar.page())
        own, inside, state = np.zeros(len(page.tag)), np.zeros(len(page.tag)), False
        for i, (tag, text) in enumerate(zip(page.tag, page.text, strict=True)):
            if tag[0] != "#":
                continue
            kept = []
            for part in re.split("([\x01\x02])", text):
                if part in ("\x01", "\x02"):
                    state = part == "\x02"
                else:
                    kept.append(part)
                    own[i] += len(part.strip())
                    inside[i] += len(part.strip()) * state
            page.text[i] = "".join(kept)
            if tag == "#text" and not page.text[i].strip():
                page.tag[i], page.text[i] = "#space", " "
        parts, chars = features(page)
        share = sums(page.parent, inside) / np.maximum(sums(page.parent, own), 1)
        used = np.flatnonzero(chars > 0)
        used = used[used > 0]
        xs.append(dense(parts)[used])
        ys.append(share[used] >= 0.9)
        weights.append(0.3 + np.log1p(chars[used]) / 6)
    return fit(np.vstack(xs), np.concatenate(ys).astype(float), np.concatenate(weights))


def _extract(shared):
    def run(batches):
        trees = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                pages = [Page(h or "") for h in batch.column("html").to_pylist()]
                described = [features(p) for p in pages]
                odds = odds_of(trees, [d for d, _ in described])
                texts = [render(p, chosen(p, o, chars)) for p, o, (_, chars) in zip(pages, odds, described, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages.

    A null or empty page, or one without main text, has an empty text. A page of any length is read whole,
    in a time that grows with it. Only scripts, styles, titles and textareas are laid aside unseen; whatever
    an element left open holds stays in the page. Repeated rows, null ids and urls pass through; other
    columns are not read. No rows: no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract(shared), "page_id long, url string, text string")
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), train())
