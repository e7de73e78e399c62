"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every block element is a node with a hidden label, content or boilerplate. Parent-child potentials
tie a node to its parent; features of the node (tag, words of its class and id, text length, links,
punctuation) are its evidence. Sum-product messages up and down the tree give each node's exact
marginal; text of nodes that are more likely content than not is the main text. The tables of the
model are counts over all pages that label themselves by one article or main element.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import append_columns, over_slices, table, values

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video title select option textarea button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag of the key closes an open one of these, unless a boundary stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
BOUNDARY = frozenset("html body div article section main aside nav header footer form td th table ul ol dl blockquote fieldset figure".split())

AWAY = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|disqus|footer|gdpr|header|login|masthead|menu|modal|nav\w*|newsletter|notice|popup|promo\w*|related|reply|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscri\w*|toolbar|widget)(?:$|[\s_-])", re.I)
TOWARD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[\s_-])", re.I)
AWAY_TAGS = frozenset("nav footer aside header form menu dialog".split())
TOWARD_TAGS = frozenset(("article", "main"))

TAGS = ("html", "body", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "section", "article", "main", "nav", "footer", "aside", "header", "form", "blockquote", "pre", "figure", "figcaption")
TAG_INDEX = {t: i for i, t in enumerate(TAGS)}
LENGTHS = (1, 20, 80, 200)
SIZES = (len(TAGS) + 1, 3, len(LENGTHS) + 1, 4, 3, 3)
# Pseudo-counts as shares of all counts: of a feature's values together, of the values of the lexicon
# feature, which has a say beyond the pages seen, and of a child that differs from its parent.
SMOOTHING = 0.02
LEXICON_SMOOTHING = 1e-4
CHANGE = 0.01
# Exponents of the features' potentials: length, links and punctuation say much the same.
WEIGHTS = (0.6, 1.5, 0.3, 0.3, 0.3, 0.3)


class Dom(HTMLParser):
    """Block elements in page order with parent, tag and names, and the text segments they own."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.names = [-1], ["html"], [""]
        self.stack: list[tuple[str, int]] = [("html", 0)]  # tag and node
        self.open: dict[str, int] = {"html": 1}
        self.links = self.hidden = 0
        self.segments: list[list] = []  # owner, pieces, characters in links
        self.current: list | None = None
        last = html.rfind("<")
        if last > html.rfind(">") and re.match(r"<[A-Za-z/!?]", html[last : last + 2] or ""):
            html = html[:last]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag in INLINE:
            if tag not in VOID:
                self._push(tag, self.stack[-1][1])
            return
        if tag in ENDS_P:
            self._close_open({"p"})
        if tag in CLOSES:
            self._close_open(CLOSES[tag])
        self.current = None
        if tag in VOID:
            return
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        self.parent.append(self.stack[-1][1])
        self.tag.append(tag)
        self.names.append(names)
        self._push(tag, len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _push(self, tag: str, node: int) -> None:
        self.stack.append((tag, node))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"
        self.hidden += tag in HIDDEN

    def _pop(self) -> str:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        self.links -= tag == "a"
        self.hidden -= tag in HIDDEN
        if tag not in INLINE:
            self.current = None
        return tag

    def _close_open(self, tags: set[str]) -> None:
        if any(self.open.get(t) for t in tags):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in tags:
                    while len(self.stack) > i:
                        self._pop()
                    return
                if self.stack[i][0] in BOUNDARY:
                    return

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._text(" ")
        elif tag not in VOID and tag != "html" and self.open.get(tag):
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self._text(data)

    def _text(self, data: str) -> None:
        node = self.stack[-1][1]
        if self.current is None or self.current[0] != node:
            self.current = [node, [], 0]
            self.segments.append(self.current)
        self.current[1].append(data)
        if self.links:
            self.current[2] += len(data.strip())


def read_page(html: str) -> tuple[Dom, list[tuple[int, str]], np.ndarray]:
    """The tree, its text segments with one space for white space, and each node's features."""
    dom = Dom(html)
    segments, n = [], len(dom.tag)
    chars, linked, marks, below, below_links = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, pieces, links in dom.segments:
        text = " ".join("".join(pieces).split())
        if text:
            segments.append((node, text))
            chars[node] += len(text)
            linked[node] += links
            marks[node] += sum(text.count(c) for c in ".,!?;")
    for i in range(n - 1, -1, -1):
        below[i] += chars[i]
        below_links[i] += linked[i]
        if i:
            below[dom.parent[i]] += below[i]
            below_links[dom.parent[i]] += below_links[i]
    rows = []
    gone = [False] * n
    for i in range(n):
        # Words that lead away hold for everything inside as well.
        gone[i] = (i > 0 and gone[dom.parent[i]]) or away(dom, i)
        lexicon = 1 if gone[i] else 2 if dom.tag[i] in TOWARD_TAGS or TOWARD.search(dom.names[i]) else 0
        density = 0 if not chars[i] else 1 if linked[i] * 10 <= chars[i] else 2 if linked[i] * 2 <= chars[i] else 3
        whole = 0 if not below[i] else 1 if below_links[i] * 3 <= below[i] else 2
        length = sum(chars[i] >= e for e in LENGTHS)
        rows.append((TAG_INDEX.get(dom.tag[i], len(TAGS)), lexicon, length, density, 0 if not marks[i] else 1 if marks[i] < 3 else 2, whole))
    return dom, segments, np.array(rows, np.int64)


def away(dom: Dom, i: int) -> bool:
    return dom.tag[i] in AWAY_TAGS or bool(dom.names[i] and AWAY.search(dom.names[i]))


def own_labels(dom: Dom) -> list[int] | None:
    """Labels of a page that marks its content itself by one article or main; None for other pages."""
    if sum(t in TOWARD_TAGS for t in dom.tag) != 1:
        return None
    out = []
    for i, tag in enumerate(dom.tag):
        inside = out[dom.parent[i]] if i else 0
        out.append(int((tag in TOWARD_TAGS or inside) and not away(dom, i)))
    return out


def _codes() -> list[tuple[str, int]]:
    return [("pair", 4), ("root", 2), *((f"f{k}", 2 * n) for k, n in enumerate(SIZES))]


def train(pages: DataFrame, html: str = "html") -> dict:
    """Log potentials from the pages that label themselves; a few hundred counts come to the driver.

    Without such pages the counts are the pseudo-counts alone: lexicon words decide.
    """

    def count(batch) -> dict:
        sums = {name: np.zeros(n, np.int64) for name, n in _codes()}
        for page in values(batch, "html"):
            if not page:
                continue
            dom, _, features = read_page(page)
            labels = own_labels(dom)
            if labels is None:
                continue
            y = np.array(labels)
            sums["root"][y[0]] += 1
            sums["pair"] += np.bincount(2 * y[np.array(dom.parent[1:], int)] + y[1:], minlength=4)
            for k, n in enumerate(SIZES):
                sums[f"f{k}"] += np.bincount(n * y + features[:, k], minlength=2 * n)
        lines = [(name, i, int(v)) for name, s in sums.items() for i, v in enumerate(s) if v]
        return {"name": [x[0] for x in lines], "i": [x[1] for x in lines], "n": [x[2] for x in lines]}

    counted = over_slices(pages.select(F.col(html).alias("html")), count, "name string, i int, n long", rows=128)
    sums = {name: np.zeros(n) for name, n in _codes()}
    for r in counted.groupBy("name", "i").agg(F.sum("n").alias("n")).collect():
        sums[r.name][r.i] = r.n
    pair = sums["pair"].reshape(2, 2)
    pair += 1 + CHANGE * pair.sum(axis=1, keepdims=True) * (1 - np.eye(2))
    features = []
    for k, n in enumerate(SIZES):
        c = sums[f"f{k}"].reshape(2, n) + 0.0
        c += np.maximum(50, c.sum(axis=1, keepdims=True)) * (LEXICON_SMOOTHING if k == 1 else SMOOTHING) / n
        if k == 1:
            c += np.array([[0, 4, 0], [0, 0, 4]])  # the lexicon's own direction
        features.append(WEIGHTS[k] * np.log(c / c.sum(axis=1, keepdims=True)))
    root = sums["root"] + np.array([2.0, 1.0])
    return {"pair": np.log(pair / pair.sum(axis=1, keepdims=True)), "root": np.log(root / root.sum()), "features": features}


def marginals(parent: list[int], features: np.ndarray, model: dict) -> list[float]:
    """P(content) of every node by sum-product: messages to the root, then back down.

    Parents stand before their children, so both sweeps are loops over the nodes.
    """
    evidence = sum(model["features"][k][:, features[:, k]] for k in range(features.shape[1]))
    b0, b1 = evidence[0].tolist(), evidence[1].tolist()
    (p00, p01), (p10, p11) = model["pair"].tolist()
    n = len(parent)

    def add(x: float, y: float) -> float:
        return max(x, y) + math.log1p(math.exp(-abs(x - y)))

    up0, up1 = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        up0[i], up1[i] = add(p00 + b0[i], p01 + b1[i]), add(p10 + b0[i], p11 + b1[i])
        b0[parent[i]] += up0[i]
        b1[parent[i]] += up1[i]
    root = model["root"]
    full0, full1, out = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n):
        if i:
            q = parent[i]
            a0, a1 = full0[q] - up0[i], full1[q] - up1[i]
            full0[i], full1[i] = b0[i] + add(a0 + p00, a1 + p10), b1[i] + add(a0 + p01, a1 + p11)
        else:
            full0[0], full1[0] = b0[0] + root[0], b1[0] + root[1]
        d = full0[i] - full1[i]
        out[i] = 1 / (1 + math.exp(min(d, 700.0)))
        top = max(full0[i], full1[i])
        full0[i], full1[i] = full0[i] - top, full1[i] - top
    return out


def extract_text(html: str | None, model: dict) -> str:
    if not html:
        return ""
    dom, segments, features = read_page(html)
    if not segments:
        return ""
    p = marginals(dom.parent, features, model)
    return "\n".join(text for node, text in segments if p[node] >= 0.5)


def extract(pages: DataFrame, model: dict, html: str = "html", text: str = "text", length: str = "n_chars") -> DataFrame:
    """`pages` with the main text and its code points.

    Null, empty and textless pages give the empty text. Repeated pages are read each. Cut-off tags
    at the end of a page are dropped, cut-off character references stay as they are.
    """

    def make(batch) -> dict:
        texts = [extract_text(page, model) for page in values(batch, html)]
        return {text: texts, length: [len(t) for t in texts]}

    return append_columns(pages, make, f"`{text}` string, `{length}` long", rows=128)


def op5_tree_marginals(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).drop("html")


QUERIES = {"op5_tree_marginals": op5_tree_marginals}
