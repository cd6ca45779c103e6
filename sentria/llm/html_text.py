"""HTML extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

Every node is described by its tag and attribute tokens and those of its
ancestors, the text and link density of its subtree, its depth and its siblings.
The trees give its chance to hold main text. Decoding picks the most likely set of
nodes in which no node is kept under a dropped one.

The trees are trained here on generated pages of many layouts (``TRAINING_PAGES``,
a fixed number with a fixed seed), whose main blocks are known by construction.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.dom import Node, described, parse

TRAINING_PAGES = 400
TREES = 60
DEPTH = 4
RATE = 0.2
BINS = 24

TAGS = (
    ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "li", "dt", "dd"), ("div",), ("section",),
    ("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button", "label"),
    ("table", "tbody", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("body", "html", "#page"),
)
#: Attribute tokens by what they usually stand for; a token is a whole word of class, id or role.
TOKENS = (
    ("content", "article", "post", "entry", "story", "main", "body", "text", "page", "prose", "articlebody"),
    ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "topbar", "toc", "pagination", "pager", "tabs"),
    ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "adsense"),
    ("sidebar", "side", "aside", "widget", "related", "recommended", "complementary", "trending", "rail", "teaser"),
    ("footer", "foot", "copyright", "contentinfo", "legal", "colophon", "bottom"),
    ("header", "head", "masthead", "logo", "branding", "site", "top", "hero"),
    ("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "gdpr", "overlay", "message", "warning"),
    ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "reader", "responses", "feedback"),
    ("form", "search", "login", "signup", "newsletter", "subscribe", "contact", "register", "subscription"),
    ("share", "social", "author", "byline", "meta", "tags", "date", "rating", "follow"),
)
_TAG = {t: k for k, group in enumerate(TAGS) for t in group}
_TOKEN = {t: k for k, group in enumerate(TOKENS) for t in group}
_SPLIT = re.compile(r"[a-z]+")


@lru_cache(maxsize=20_000)
def _marks(attributes: str) -> int:
    """Bit set of the token groups in a tag's attributes."""
    out = 0
    for word in _SPLIT.findall(described(attributes)):
        k = _TOKEN.get(word)
        if k is not None:
            out |= 1 << k
    return out


def features(pages: list[list[Node]]) -> np.ndarray:
    """A row per node of all pages."""
    nodes = [x for page in pages for x in page]
    n = len(nodes)
    sizes = np.array([len(page) for page in pages])
    root = np.repeat(np.cumsum(sizes) - sizes, sizes)
    tag = np.array([_TAG.get(x.tag, len(TAGS)) for x in nodes])
    parent = np.array([x.parent for x in nodes])
    parent = np.where(parent < 0, -1, parent + root)
    inner = np.flatnonzero(parent >= 0).tolist()
    up = parent.tolist()
    marks = np.array([_marks(x.attributes) for x in nodes])
    chars, links, blocks, commas = [0] * n, [0] * n, [1] * n, [0] * n
    for k, x in enumerate(nodes):
        if x.run:
            own = "".join(x.parts)
            chars[k], links[k] = len(own), x.links
            commas[k] = own.count(",") + own.count(".")
    above_tags, above_marks, index, seen = [0] * n, [0] * n, [0] * n, [0] * n
    own_tags, own_marks = (1 << tag).tolist(), marks.tolist()
    for k in inner:
        p = up[k]
        above_tags[k] = above_tags[p] | own_tags[p]
        above_marks[k] = above_marks[p] | own_marks[p]
        index[k] = seen[p]
        seen[p] += 1
    for k in reversed(inner):
        p = up[k]
        chars[p] += chars[k]
        links[p] += links[k]
        blocks[p] += blocks[k]
        commas[p] += commas[k]
    chars, links, blocks, commas = (np.array(x, float) for x in (chars, links, blocks, commas))
    above_tags, above_marks, index, children = (np.array(x) for x in (above_tags, above_marks, index, seen))
    _, kind, times = np.unique(np.maximum(parent, -1) * (len(TAGS) + 1) + tag, return_inverse=True, return_counts=True)
    alike = np.where(parent < 0, 1, times[kind])
    safe = np.where(parent < 0, np.arange(n), parent)
    # Text next to a node: what its neighbours in the tree hold on average.
    beside = (chars[safe] - chars) / np.maximum(children[safe] - 1, 1)
    bit = lambda x, k: (x >> k) & 1
    columns = [tag == k for k in range(len(TAGS))]
    columns += [bit(above_tags, k) for k in range(4, 13)]
    columns += [bit(marks, k) for k in range(len(TOKENS))] + [bit(above_marks, k) for k in range(len(TOKENS))]
    columns += [
        np.log1p(chars), links / np.maximum(chars, 1), np.log1p(blocks), np.log1p(chars / blocks),
        np.array([x.depth for x in nodes]), np.log1p(children), np.log1p(children[safe]), np.log1p(alike),
        index / np.maximum(children[safe], 1), chars / np.maximum(chars[safe], 1), chars / np.maximum(chars[root], 1),
        np.log1p(beside), np.log1p(commas), commas / np.maximum(chars, 1), np.array([x.run for x in nodes]),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


class BoostedTrees:
    """Gradient-boosted regression trees for logistic loss, of fixed depth."""

    def __init__(self):
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature and threshold per inner node, leaf values

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        total = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            grad, curve = y - p, p * (1 - p)
            feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
            place = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                best = np.zeros(width)
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    key = (place - first) * (BINS + 1) + binned[:, f]
                    g = np.bincount(key, grad, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                    h = np.bincount(key, curve, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                    gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    gain[(h < 2) | (h[:, -1:] - h < 2)] = 0
                    gain = gain[:, : len(edges[f])]
                    cut = gain.argmax(axis=1)
                    value = gain[np.arange(width), cut]
                    for k in np.flatnonzero(value > best + 1e-9):
                        best[k], feature[first + k], threshold[first + k] = value[k], f, edges[f][cut[k]]
                place = 2 * place + 1 + (x[np.arange(len(y)), feature[place]] > threshold[place])
            leaf = place - (2**DEPTH - 1)
            values = RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, curve, 2**DEPTH) + 1)
            self.trees.append((feature, threshold, values))
            total += values[leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, values in self.trees:
            place = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                place = 2 * place + 1 + (x[rows, feature[place]] > threshold[place])
            out += values[place - (2**DEPTH - 1)]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the most likely choice in which kept nodes have kept parents.

    A node's gain of keeping is its log-odds and what its children gain, if that is more than nothing.
    """
    gain = odds.copy()
    for k in range(len(nodes) - 1, 0, -1):
        if gain[k] > 0:
            gain[nodes[k].parent] += gain[k]
    kept = np.zeros(len(nodes), bool)
    kept[0] = gain[0] > 0
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and gain[k] > 0
    return kept


def joined(nodes: list[Node], kept: np.ndarray) -> str:
    """Text of the kept runs: references decoded, white space to one space, blocks joined by one space."""
    blocks = (" ".join(entities.unescape("".join(x.parts)).split()) for x, k in zip(nodes, kept) if k and x.run)
    return " ".join(b for b in blocks if b)


class Layouts:
    """Generated pages whose main blocks carry the attribute data-main."""

    def __init__(self, seed: int = 11):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))]
        for k in range(len(out)):
            if r.random() < 0.12:
                out[k] += r.choice(",,.")
        return " ".join(out).capitalize() + r.choice(["", ".", "."])

    def box(self, inside: str, tags: str, tokens: str, plain: float = 0.25) -> str:
        """An element with a typical tag or a typical class, sometimes both."""
        r = self.r
        named = tags.split() if tags else []
        tag = r.choice(named) if named and r.random() < 0.6 else "div"
        name = ""
        if tag == "div" or r.random() > plain:
            word = r.choice(tokens.split())
            name = f' {r.choice(["class", "class", "id"])}="{r.choice(["", "", "x-", "box "])}{word}{r.choice(["", "", "-1", " clear"])}"'
        return f"<{tag}{name}>{inside}</{tag}>"

    def links(self, low: int, high: int) -> str:
        r = self.r
        each = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(r.randint(low, high))]
        return r.choice([lambda: "<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>", lambda: " | ".join(each)])()

    def paragraphs(self, low: int, high: int, most: int = 90) -> str:
        return "".join(f"<p>{self.words(3, most)}</p>" for _ in range(self.r.randint(low, high)))

    def noise(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.box(self.links(3, 9), "nav", "nav menu navbar navigation breadcrumb topbar tabs")
        if kind == "header":
            return self.box(f"<h1>{self.words(1, 4)}</h1><p>{self.words(2, 10)}</p>" + r.choice(["", self.links(2, 5)]), "header", "header masthead branding site-header logo")
        if kind == "footer":
            return self.box(f"{r.choice(['&copy; ', 'x ', '<p>'])}{self.words(3, 25)}" + r.choice(["", self.links(2, 6)]), "footer", "footer copyright legal site-footer")
        if kind == "aside":
            inside = f"<h3>{self.words(1, 4)}</h3>" + r.choice([self.links(3, 8), self.paragraphs(1, 3, 30)])
            return self.box(inside, "aside", "sidebar widget related recommended trending rail")
        if kind == "ad":
            return self.box(r.choice([self.words(4, 40), self.paragraphs(1, 2, 30), self.links(1, 2)]), "", "ad ads advert sponsored promo banner advertisement")
        if kind == "notice":
            return self.box(r.choice([self.words(5, 40), f"<p>{self.words(5, 40)}</p><button>{self.words(1, 2)}</button>"]), "", "cookie-notice consent notice alert popup modal gdpr cookies")
        if kind == "form":
            return f"<form{r.choice(['', ' class=search', ' id=newsletter', ' class=subscribe'])}><label>{self.words(1, 4)}</label><p>{self.words(2, 20)}</p><input name=q><button>{self.words(1, 2)}</button></form>"
        if kind == "share":
            return self.box(self.links(2, 5), "", "share social follow tags meta")
        each = "".join(self.box(f"<b>{self.words(1, 2)}</b><p>{self.words(3, 60)}</p>", "li div", "comment reply response", 0.5) for _ in range(r.randint(1, 6)))
        return self.box(f"<h3>{self.words(1, 3)}</h3>{each}", "section ol", "comments discussion reader-comments responses respond comment-list")

    def article(self) -> str:
        r = self.r
        out = [f"<h1 data-main>{self.words(3, 14)}</h1>"] if r.random() < 0.85 else []
        short = r.random() < 0.3
        for _ in range(r.randint(1, 2 if short else 14)):
            roll = r.random()
            if roll < 0.78:
                out.append(r.choice(["<p data-main>%s</p>", "<p data-main><b>%s<br>", "<p data-main>%s"]) % self.words(1, 8 if short else 120))
            elif roll < 0.84:
                out.append(f"<h2 data-main>{self.words(1, 8)}</h2>")
            elif roll < 0.9:
                items = "".join(f"<li data-main>{self.words(2, 25)}</li>" for _ in range(r.randint(2, 6)))
                out.append(f"<ul data-main>{items}</ul>")
            elif roll < 0.95:
                out.append(f"<blockquote data-main>{self.words(5, 50)}</blockquote>")
            else:
                cells = "".join(f"<td data-main>{self.words(1, 6)}</td>" for _ in range(r.randint(2, 4)))
                out.append(f"<table data-main><tr data-main>{cells}</tr></table>")
            if r.random() < 0.05:
                out.append(self.noise(r.choice(["ad", "share", "aside", "notice"])))
        if r.random() < 0.15:
            out.append(self.noise(r.choice(["comment", "share", "form"])))
        body = "".join(out)
        roll = r.random()
        if roll < 0.5:
            return f"<article data-main>{body}</article>"
        if roll < 0.65:
            return f"<main data-main>{body}</main>"
        name = r.choice(["content", "article", "post", "entry-content", "story", "main", "body-text", "prose"])
        return f'<div data-main {r.choice(["class", "id"])}="{name}">{body}</div>'

    def page(self) -> str:
        r = self.r
        kinds = ["nav", "header", "ad", "notice", "form", "aside", "share"]
        before = [self.noise(k) for k in kinds if r.random() < 0.35]
        after = [self.noise(k) for k in ["comment", "aside", "form", "ad", "share", "nav", "footer"] if r.random() < 0.4]
        r.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.3:
            body = f'<div data-main class="{r.choice(["wrapper", "page", "container", "site", "layout"])}">{body}</div>'
        return f"<html data-main><head><title>x</title></head><body data-main>{body}</body></html>"


@lru_cache(maxsize=1)
def trained() -> BoostedTrees:
    """The trees, from ``TRAINING_PAGES`` generated pages."""
    layouts = Layouts()
    rows, marks = [], []
    for _ in range(TRAINING_PAGES):
        nodes = parse(layouts.page())
        nodes[0].marked = True
        rows.append(features([nodes]))
        marks.append(np.array([x.marked for x in nodes], float))
    return BoostedTrees().fit(np.concatenate(rows), np.concatenate(marks))


def texts_of(pages: list[str | None], model: BoostedTrees) -> list[str]:
    """Main text of each page."""
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    odds = model.log_odds(features(parsed))
    out, at = [], 0
    for nodes in parsed:
        own = odds[at : at + len(nodes)]
        at += len(nodes)
        # The page itself is no choice.
        own[0] = math.inf
        out.append(joined(nodes, decode(nodes, own)))
    return out


def extract(pages: DataFrame, model: BoostedTrees | None = None, step: int = 64) -> DataFrame:
    """All columns of ``pages``, text and n_chars (its code points). Existing columns of these names are replaced.

    Null or empty html, or a page without main text, gives an empty text.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    @F.pandas_udf("string")
    def main_text(html: pd.Series) -> pd.Series:
        out = []
        pages = html.tolist()
        for at in range(0, len(pages), step):
            out += texts_of([p if isinstance(p, str) else None for p in pages[at : at + step]], shared.value)
        return pd.Series(out, dtype=object)

    own = pages.drop("text", "n_chars")
    return own.withColumn("text", main_text("html")).withColumn("n_chars", F.length("text").cast("long"))


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
