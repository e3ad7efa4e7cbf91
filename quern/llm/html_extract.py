"""Operator 2: the main text of web pages by classifying flat text blocks.

A page is read as a flat run of text blocks: block-level tags part them, inline tags and line breaks don't. Each block has its
word count and link density, those of the block before and after it, and what kind of element it and they lie in. A decision tree
trained on the labelled blocks of TRAINING_PAGES says which blocks are the article. Class names that sound like an advert or a
comment are one feature among the others, and don't count for an element that holds the page's title or article.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.html_training import TRAINING_PAGES

# Fixed lists of HTML element names.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas video audio textarea head title select datalist noframes".split())
#: Those whose content is markup, so that one may hold another of its name.
NESTED = frozenset("svg math template object canvas video audio".split())
ASIDE = frozenset("nav footer aside menu button dialog search".split())
CLOSES_P = BLOCK - {"body", "html", "button"}
TITLED = tuple("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote figcaption caption summary legend address".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ARTICLES = ("article", "main")
NEUTRAL = ("html", "body", "article", "main")
#: Words in class, id or role that often name what isn't the article.
HINT = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments commentlist reply replies respond discussion disqus share sharing social related recommended trending widget toolbar footer masthead popup modal overlay copyright disclaimer complementary contentinfo".split()
)
#: In attributes only what follows = may open a quote.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LABEL = re.compile(r"\bdata-main=\"?([01])")
FEATURES = ("words", "link_density", "plain", "words_before", "link_density_before", "plain_before", "words_after", "link_density_after", "plain_after", "in_aside", "in_article", "heading", "in_list", "hinted")


@dataclass
class _Hint:
    """An element whose name or kind says that it isn't the article, unless it holds the article."""

    void: bool = False


@dataclass
class Block:
    text: str
    words: int
    linked: int
    aside: bool
    article: bool
    heading: bool
    listed: bool
    plain: bool
    hint: _Hint | None
    label: int | None


@dataclass(slots=True)
class _Open:
    name: str
    aside: bool
    hint: _Hint | None
    label: int | None


@dataclass
class _Reader:
    """Flat blocks of one page; elements left open are closed by whatever closes around them. What is open is known by counts and places, so no tag walks the stack but for what it closes."""

    blocks: list[Block] = field(default_factory=list)
    open: list[_Open] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    hints: list[_Hint] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    asides: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def last(self, names: tuple[str, ...]) -> int:
        """The place of the innermost open element of these names, -1 if there is none."""
        return max([x[-1] for x in map(self.places.get, names) if x], default=-1)

    def end_block(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.places
            plain = self.last(TITLED) <= self.last(("div", "section", "body"))
            hint, label = (x[-1] if x else None for x in (self.hints, self.labels))
            self.blocks.append(Block(text, len(text.split()), self.linked, self.asides > 0, any(at[k] for k in ARTICLES), any(at[k] for k in HEADINGS), bool(at["li"]), plain, hint, label))
        self.parts, self.linked = [], 0

    def add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.places["a"]:
            self.linked += len(text.split())

    def start(self, name: str, attributes: str) -> None:
        if self.places["p"] and name in CLOSES_P and self.last(("p",)) > self.last(("button", "td", "th")):
            self.close("p")
        if name == "li" and self.last(("li",)) > self.last(("ul", "ol", "menu")):
            self.close("li")
        inside = any(self.places[k] for k in ARTICLES)
        if name == "h1" or name in ARTICLES:
            for x in reversed(self.hints):  # what is around a void one is void already
                if x.void:
                    break
                x.void = True
        hinted = name == "form" or bool(attributes) and name not in NEUTRAL and any(w in HINT for m in NAMES.finditer(attributes) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()))
        label = LABEL.search(attributes)
        opened = _Open(name, name in ASIDE or name == "header" and not inside, _Hint() if hinted else None, int(label[1]) if label else None)
        self.places[name].append(len(self.open))
        self.open.append(opened)
        self.asides += opened.aside
        if opened.hint:
            self.hints.append(opened.hint)
        if opened.label is not None:
            self.labels.append(opened.label)

    def close(self, name: str) -> None:
        """Closes the last open element of that name with all in it."""
        if not self.places[name]:
            return
        end = self.places[name][-1]
        while len(self.open) > end:
            x = self.open.pop()
            self.places[x.name].pop()
            self.asides -= x.aside
            if x.hint:
                self.hints.pop()
            if x.label is not None:
                self.labels.pop()


def closing(page: str, at: int, name: str) -> re.Match | None:
    """The tag that closes the element of that name which began before at."""
    if name not in NESTED:
        return re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
    depth = 1
    for m in re.compile(rf"<(/?){name}\b(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+(?:>|\Z)", re.I).finditer(page, at):
        depth += -1 if m[1] else not m[0].endswith("/>")
        if not depth:
            return m
    return None


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, references decoded and white space collapsed."""
    reader, at, n = _Reader(), 0, len(page)
    for m in iter(lambda: TAG.search(page, at), None):
        if m.start() > at:
            reader.add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in RAW and not m[1]:
            if not m[3].endswith("/"):
                end = closing(page, at, name)
                # A head that is never closed ends where the body begins.
                end = end or (re.compile(r"(?=<body\b)", re.I).search(page, at) if name == "head" else None)
                at = end.end() if end else n
            continue
        if name == "br":
            reader.parts.append(" ")
            continue
        if name in BLOCK:
            reader.end_block()
        if m[1]:
            reader.close(name)
        elif name not in VOID:
            reader.start(name, m[3] or "")
    if at < n:
        reader.add(page[at:])
    reader.end_block()
    return reader.blocks


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block. in_article is -1 outside the article of a page that has one."""
    own = np.array([(b.words, b.linked / max(1, b.words), b.plain) for b in found], float).reshape(-1, 3)
    edge = np.zeros((1, 3))
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    outside = -1 if any(b.article for b in found) else 0
    kind = np.array([(b.aside, 1 if b.article else outside, b.heading, b.listed, b.hint is not None and not b.hint.void) for b in found], float).reshape(-1, 5)
    return np.concatenate([own, before[: len(own)], after[: len(own)], kind], 1)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2):
    """A classification tree by Gini impurity: nested (feature, limit, at most, above), or a share of positives."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= limit
            n = low.sum()
            if least <= n <= len(y) - least:
                impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, float(limit)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-9:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], train_tree(x[low], y[low], depth - 1, least), train_tree(x[~low], y[~low], depth - 1, least)


def predict(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def trained():
    """The tree of the labelled pages."""
    x, y = [], []
    for page in TRAINING_PAGES:
        found = blocks(page)
        rows = features(found)
        for row, b in zip(rows, found, strict=True):
            if b.label is not None:
                x.append(row)
                y.append(b.label)
    return train_tree(np.array(x), np.array(y, float))


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if predict(tree, row) >= 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the article's blocks joined by line feeds, empty if none) and n_chars of every page row.

    pages: page_id, url, html, others ignored. Null or empty html gives an empty text; repeated rows and null ids are kept.
    """
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    return own.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
