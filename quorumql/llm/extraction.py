"""Main text of web pages by a tree-structured graphical model over the nodes of a page.

Every node, element or text, is content or not. A node's own potential is a weighted sum of its features (element name,
words of its class, id and role, share of linked text, length of its text; plain blocks, inline elements and texts have names alone); parent and child are tied by a table of
potentials, one each for texts, inline elements, plain blocks and containers as children. The tables' rows are
normalised, so a child without features of its own tells nothing about its parent, however many there are. Elements
around the article count as content too. The tree has no loops, so one pass of sum-product messages
upward and one downward give exact marginals. Texts whose marginal probability of being content reaches one half are
kept. Weights maximise the likelihood of labelled pages: the slope is observed minus expected features, and the
expectations come from the same message passing. Labelled pages are made by ``labelled_pages`` from the layouts listed
there, since tables of pages carry no labels.

Messages are log-odds and are passed level by level for all pages of a slice at once. A null or empty page has an empty
text; a page without content has one too.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quorumql.llm.common import add_columns, free_name, map_texts
from quorumql.llm.dom import INLINE, Page, joined, read_page

TAGS, NAMES, LENGTHS, LINKS = 256, 2048, 8, 4
SIZE = TAGS + NAMES + LENGTHS + LINKS
#: Blocks that mostly share the state of what holds them; other block elements are containers.
PLAIN_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre xmp table thead tbody tfoot tr td th figure figcaption img br hr caption".split())
NAME_WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Forest:
    """Nodes of many pages in one numbering: parents (-1 at the top), levels, kind of tie, and features as (node, number)."""

    parent: np.ndarray
    levels: list[np.ndarray]
    tie: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    first: np.ndarray  # number of each page's first node


def name_features(names: str) -> list[int]:
    """The words of the names, and each name as a whole."""
    words = NAME_WORDS.findall(CAMEL.sub(" ", names).lower()) + [f"={name}" for name in names.lower().split()]
    return [TAGS + zlib.crc32(word.encode("utf-8", "surrogatepass")) % NAMES for word in dict.fromkeys(words)]


def forest(pages: list[Page]) -> Forest:
    first = np.cumsum([0] + [len(p.tag) for p in pages])
    total = int(first[-1])
    parent = np.fromiter((q + start if q >= 0 else -1 for p, start in zip(pages, first) for q in p.parent), np.int64, total)
    depth = np.fromiter((d for p in pages for d in p.depth), np.int64, total)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1))
    levels = np.split(order, cuts)
    chars = np.fromiter((len(t) for p in pages for t in p.text), np.float64, total)
    linked = np.zeros(total)
    tags = [t for p in pages for t in p.tag]
    tie = np.fromiter((0 if t == "#text" else 1 if t in INLINE else 2 if t in PLAIN_BLOCKS else 3 for t in tags), np.int64, total)
    in_link = np.fromiter((t == "a" for t in tags), bool, total)
    for level in levels[1:]:
        in_link[level] |= in_link[parent[level]]
    linked[in_link] = chars[in_link]
    for level in reversed(levels[1:]):
        chars += np.bincount(parent[level], chars[level], total)
        linked += np.bincount(parent[level], linked[level], total)
    seen: dict[str, int] = {}
    numbers = np.arange(total)
    features = [np.fromiter((seen.get(t) or seen.setdefault(t, zlib.crc32(t.encode("utf-8", "surrogatepass")) % TAGS) for t in tags), np.int64, total),
                TAGS + NAMES + np.minimum(LENGTHS - 1, np.log2(1 + chars) / 2).astype(np.int64),
                TAGS + NAMES + LENGTHS + np.minimum(LINKS - 1, LINKS * linked / np.maximum(chars, 1)).astype(np.int64)]
    wide = tie == 3
    node, feature = [numbers[wide]] * 3, [f[wide] for f in features]
    named = [(start + i, f) for p, start in zip(pages, first) for i, names in enumerate(p.names) if names for f in name_features(names)]
    if named:
        pairs = np.array(named)
        node, feature = [*node, pairs[:, 0]], [*feature, pairs[:, 1]]
    return Forest(parent, levels, tie, np.concatenate(node), np.concatenate(feature), first)


@dataclass
class TreeModel:
    weights: np.ndarray  # by feature
    ties: np.ndarray  # by kind of child, state of the parent, state of the child

    def marginals(self, trees: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of being content for each node; probability of each pair of states of node and parent."""
        total = len(trees.parent)
        own = np.bincount(trees.node, self.weights[trees.feature], total)
        t = self.ties[trees.tie]
        up, message = own.copy(), np.zeros(total)
        for level in reversed(trees.levels[1:]):
            u = up[level]
            message[level] = np.logaddexp(t[level, 1, 1] + u, t[level, 1, 0]) - np.logaddexp(t[level, 0, 1] + u, t[level, 0, 0])
            up += np.bincount(trees.parent[level], message[level], total)
        both, above = up.copy(), np.zeros(total)
        for level in trees.levels[1:]:
            v = above[level] = both[trees.parent[level]] - message[level]
            both[level] = up[level] + np.logaddexp(t[level, 1, 1] + v, t[level, 0, 1]) - np.logaddexp(t[level, 1, 0] + v, t[level, 0, 0])
        joint = t + above[:, None, None] * np.array([0, 1])[:, None] + up[:, None, None] * np.array([0, 1])
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        return both, joint / joint.sum(axis=(1, 2), keepdims=True)

    def texts(self, pages: list[str | None]) -> list[str]:
        read = [read_page(html) for html in pages]
        trees = forest(read)
        content = self.marginals(trees)[0] >= 0
        return [joined(p, content[start : start + len(p.tag)].tolist()) for p, start in zip(read, trees.first)]


def fit(pages: list[Page], labels: list[list[bool]], rounds: int = 300, rate: float = 0.1, prior: float = 1e-4) -> TreeModel:
    """Maximum likelihood with a weak normal prior, by gradient steps with momentum and scaling (Adam)."""
    trees = forest(pages)
    y = np.array([flag for page in labels for flag in page], dtype=np.int64)
    below = np.flatnonzero(trees.parent >= 0)
    model = TreeModel(np.zeros(SIZE), np.full((4, 2, 2), -np.log(2)))
    seen = np.zeros((4, 2, 2))
    np.add.at(seen, (trees.tie[below], y[trees.parent[below]], y[below]), 1)
    raw = np.zeros((4, 2, 2))
    values, moments = (model.weights, raw), [[np.zeros_like(v), np.zeros_like(v)] for v in (model.weights, model.ties)]
    for step in range(1, rounds + 1):
        odds, joint = model.marginals(trees)
        miss = y - 0.5 * (1 + np.tanh(odds / 2))
        expected = np.zeros((4, 2, 2))
        np.add.at(expected, trees.tie[below], joint[below])
        pull = (seen - expected) / len(pages)
        pull -= np.exp(model.ties) * pull.sum(axis=2, keepdims=True)
        slopes = (np.bincount(trees.feature, miss[trees.node], SIZE) / len(pages) - prior * model.weights, pull - prior * raw)
        for value, (m, v), slope in zip(values, moments, slopes):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model.ties[:] = raw - np.logaddexp(raw[:, :, :1], raw[:, :, 1:])
    return model


# Layouts of the labelled pages: parts that are not content, by element and names; and wrappers of the article.
APART = {
    "menu": ("nav", "nav class=menu", "ul class=nav", "div class=navigation", "div id=menu", "div class=breadcrumb", "div class=navbar", "ul id=main-menu", "div class=pagination", "div role=navigation"),
    "header": ("header", "div class=header", "div id=header", "header class=site-header", "div class=masthead", "div class=topbar", "div role=banner"),
    "footer": ("footer", "div class=footer", "div id=footer", "footer class=site-footer", "div class=copyright", "div class=bottom", "div role=contentinfo"),
    "side": ("aside", "div class=sidebar", "div id=sidebar", "aside class=related", "div class=widget", "div class=related-posts", "section class=recommended", "div class=share", "div class=social", "div class=tags", "div role=complementary"),
    "advert": ("div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div id=ad-top", "div class=sponsored", "div class=promo", "div class=banner", "ins class=adsbygoogle", "section class=promoted", "aside class=ad"),
    "notice": ("div class=notice", "div class=cookie-notice", "div id=cookie-banner", "div class=consent", "div class=gdpr", "div class=alert", "div class=newsletter", "div class=subscribe", "div class=paywall", "div class=popup", "div class=modal"),
    "form": ("form", "form class=search", "div class=login", "form id=subscribe", "form class=contact"),
    "comments": ("div class=comments", "section id=comments", "ol class=comment-list", "div id=disqus", "div class=responses", "div class=comment", "article class=comment", "section class=reader-comments", "div class=discussion", "div id=respond"),
}
ARTICLE = ("article", "article", "article", "main", "main", "div class=article", "div id=content", "div class=content", "div class=post", "div class=entry-content", "div class=story", "div class=article-body", "section class=article", "div role=main", "div class=main", "article class=post", "td class=text", "div class=page", "div id=main")
BLOCKS = ("p", "p", "p", "p", "h1", "h2", "h3", "blockquote", "pre", "ul", "ol", "table", "figure", "div", "dl", "section")
PLAIN = ("div", "section", "div class=row", "div class=container", "div class=wrapper", "div id=page", "div class=inner")


class PageMaker:
    """Builds a page node by node, so that each node's label is known."""

    def __init__(self, seed: int) -> None:
        self.random, self.page, self.labels = random.Random(seed), Page(), []
        self.block = 0

    def node(self, spec: str, parent: int, label: bool) -> int:
        tag, _, names = spec.partition(" ")
        self.block += tag not in INLINE
        self.labels.append(label)
        return self.page.add(tag, names.partition("=")[2], parent)

    def words(self, parent: int, label: bool, most: int = 60) -> None:
        count = self.random.choice((1, 2, 4, 8, 16, 40, most))
        text = " ".join("x" * self.random.randint(1, 9) for _ in range(count))
        self.labels.append(label)
        self.page.add("#text", "", parent, text, self.block)

    def inline(self, parent: int, label: bool) -> None:
        self.words(parent, label)
        while self.random.random() < 0.3:
            inner = self.node(self.random.choice(("b", "i", "a", "em", "strong", "span", "code", "u", "small", "br")), parent, label)
            if self.page.tag[inner] != "br":
                self.words(inner, label, 8)
            self.words(parent, label)

    def body(self, parent: int, label: bool, blocks: int) -> None:
        for _ in range(blocks):
            kind = self.random.choice(BLOCKS)
            node = self.node(kind, parent, label)
            for inner in {"ul": ("li",), "ol": ("li",), "dl": ("dt", "dd"), "figure": ("img", "figcaption"), "blockquote": ("p",), "section": ("h2", "p")}.get(kind, ()) * self.random.randint(1, 3):
                child = self.node(inner, node, label)
                if inner != "img":
                    self.inline(child, label)
            if kind == "table":
                for _ in range(self.random.randint(1, 3)):
                    row = self.node("tr", node, label)
                    for _ in range(2):
                        self.inline(self.node(self.random.choice(("td", "th")), row, label), label)
            if kind in ("p", "h1", "h2", "h3", "pre", "div"):
                self.inline(node, label)

    def apart(self, kind: str, parent: int) -> None:
        node = self.node(self.random.choice(APART[kind]), parent, False)
        if kind == "menu" or kind == "side" and self.random.random() < 0.5:
            inner = node if self.page.tag[node] == "ul" else self.node("ul", node, False)
            for _ in range(self.random.randint(1, 7)):
                self.words(self.node("a", self.node("li", inner, False), False), False, 4)
        elif kind == "form":
            for tag in self.random.choices(("label", "button", "p", "select", "fieldset", "div"), k=self.random.randint(1, 4)):
                self.words(self.node(tag, node, False), False, 6)
                self.node("input", node, False)
        elif kind == "comments":
            for _ in range(self.random.randint(1, 4)):
                own = self.node(self.random.choice(("div class=comment", "li class=comment", "div", "p", "article class=comment")), node, False)
                self.inline(own, False)
        elif self.random.random() < 0.5:
            self.inline(node, False)
        else:
            self.body(node, False, self.random.randint(1, 3))
        if kind in ("header", "footer") and self.random.random() < 0.4:
            self.apart("menu", node)

    def make(self) -> tuple[Page, list[bool]]:
        pick = self.random
        html = self.node("html", self.node("#page", -1, True), True)
        self.node("meta", self.node("head", html, True), True)
        place = self.node("body", html, True)
        while pick.random() < 0.4:
            place = self.node(pick.choice(PLAIN), place, True)
        kinds = list(APART)
        for kind in pick.sample(("menu", "header", "advert", "notice", "side", "form"), pick.randint(0, 4)):
            self.apart(kind, place)
        if pick.random() < 0.95:
            inner = self.node(pick.choice(ARTICLE), place, True) if pick.random() < 0.85 else place
            while pick.random() < 0.25:
                inner = self.node(pick.choice(PLAIN[:2]), inner, True)
            if pick.random() < 0.7:
                self.words(self.node("h1", inner, True), True, 8)
            for _ in range(pick.randint(1, 6)):
                self.body(inner, True, pick.randint(1, 3))
                if pick.random() < 0.15:
                    self.apart(pick.choice(("advert", "side", "form", "notice", "comments")), inner)
        for kind in pick.sample(("comments", "side", "advert", "footer", "footer", "notice", "form", kinds[0]), pick.randint(0, 4)):
            self.apart(kind, place)
        return self.page, self.labels


def labelled_pages(count: int = 400, seed: int = 1) -> tuple[list[Page], list[list[bool]]]:
    made = [PageMaker(seed * 100_003 + i).make() for i in range(count)]
    return [page for page, _ in made], [labels for _, labels in made]


def train_tree_model(count: int = 400, seed: int = 1) -> TreeModel:
    return fit(*labelled_pages(count, seed))


def extract_text(pages: DataFrame, model: TreeModel, html: str = "html") -> tuple[DataFrame, dict[str, str]]:
    """``pages`` with main text and its length in code points, and the names those columns got."""
    names = {k: free_name(pages, k) for k in ("text", "n_chars")}
    schema = T.StructType([*pages.schema.fields, T.StructField(names["text"], T.StringType()), T.StructField(names["n_chars"], T.LongType())])

    def step(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = model.texts(rows.column(html).to_pylist())
        return add_columns(rows, {names["text"]: pa.array(texts, pa.string()), names["n_chars"]: pa.array([len(t) for t in texts], pa.int64())})

    return map_texts(pages, html, step, schema), names
