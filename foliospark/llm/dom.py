"""The main body of pages that come as HTML, by boosted trees over the nodes of the document tree.

Each node is measured by its tag, the tokens of its id and class, its depth, the density of text and of links
in its subtree, and how it compares with its siblings. Trees give each node its odds of being furniture.
Decoding goes over the document tree from the leaves up: a node that is dropped takes its whole subtree
along, so no kept node has a dropped ancestor, and a node is dropped only if that is the cheapest for all
below it. ``boilerplate`` does the same for pages of which only the visible text is left.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pages import BLOCKS, HIDDEN, VOID, events
from .boost import Trees

#: Pages from which the trees are fitted, about so many.
SAMPLE_PAGES = 400
#: Buckets of the tags and of the tokens of attributes.
TAGS, TOKENS = 16, 48
#: Features that measure the structure; those after it are of names.
STRUCTURE = 16
#: A node's log-odds are bounded, and weigh by the root of its own text.
SURE = 4.0

# Tags and tokens of attributes whose kind is plain, by which the trees are fitted unless there are labels.
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "header", "button"}
FURNITURE_TOKENS = {"nav", "menu", "footer", "sidebar", "cookie", "banner", "breadcrumb", "related", "share", "social", "advert", "ads", "comments", "newsletter", "toolbar", "pagination", "widget"}
MAIN_TAGS = {"article", "main", "p", "h1", "figcaption", "blockquote"}
MAIN_TOKENS = {"article", "abstract", "content", "body", "entry", "fulltext", "paper", "post", "section", "text"}
SKIPPED = {"script", "style", "noscript", "svg", "head", "title", "iframe", "canvas"}

_TOKEN = re.compile(r"[a-z]+")
_STOP = re.compile(r"[.!?。！？](?:\s|$)")


class Page:
    """The nodes of a page in document order; a node's own text is what stands in it outside its children."""

    def __init__(self, html: str | None):
        self.tag: list[str] = ["#root"]
        self.tokens: list[set[str]] = [set()]
        self.parent: list[int] = [-1]
        self.texts: list[list[str]] = [[]]
        self.order: list[tuple[int, str]] = []
        self.readable = False
        found = events(html) if html else None
        if found is None:
            return
        self.readable = True
        open_ = [0]
        for kind, name, attributes in found:
            if kind == "text":
                at = open_[-1]
                if name.strip() and not any(self.tag[k] in SKIPPED for k in open_):
                    self.texts[at].append(name)
                    self.order.append((at, name))
            elif kind in ("open", "single"):
                if name in VOID:
                    if name == "br":
                        self.order.append((open_[-1], "\n"))
                    continue
                self.tag.append(name)
                self.tokens.append({t for a in ("id", "class", "role") for t in _TOKEN.findall(attributes.get(a, "").lower())})
                self.parent.append(open_[-1])
                self.texts.append([])
                if kind == "open":
                    open_.append(len(self.tag) - 1)
            elif kind == "close" and name in (self.tag[k] for k in open_[1:]):
                while self.tag[open_.pop()] != name:
                    pass

    def measure(self) -> np.ndarray:
        """The features of every node."""
        n = len(self.tag)
        parent = np.array(self.parent)
        own = np.array([sum(len(" ".join(t.split())) for t in ts) for ts in self.texts], float)
        stops = np.array([sum(len(_STOP.findall(t)) for t in ts) for ts in self.texts], float)
        linked = own * np.array([t == "a" for t in self.tag])
        text, nodes, links, dots = own.copy(), np.ones(n), linked, stops.copy()
        depth, height = np.zeros(n), np.zeros(n)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        for k in range(n - 1, 0, -1):  # children stand after their parents
            p = parent[k]
            for a in (text, nodes, links, dots):
                a[p] += a[k]
            height[p] = max(height[p], height[k] + 1)
        order = np.argsort(parent, kind="stable")
        sorted_parents = parent[order]
        first = np.searchsorted(sorted_parents, parent)
        count = np.searchsorted(sorted_parents, parent, side="right") - first
        place = np.empty(n)
        place[order] = np.arange(n) - first[order]
        total = np.bincount(parent + 1, text, minlength=n + 1)[parent + 1]
        alike = np.zeros(n)
        kinds: dict[tuple[int, str], int] = {}
        for p, t in zip(self.parent, self.tag):
            kinds[p, t] = kinds.get((p, t), 0) + 1
        for k, (p, t) in enumerate(zip(self.parent, self.tag)):
            alike[k] = kinds[p, t] / count[k]
        up = np.maximum(parent, 0)
        hashed = np.zeros((n, TAGS + TOKENS))
        for k, (t, ts) in enumerate(zip(self.tag, self.tokens)):
            hashed[k, zlib.crc32(t.encode()) % TAGS] = 1
            for token in ts:
                hashed[k, TAGS + zlib.crc32(token.encode()) % TOKENS] = 1
        above = np.zeros((n, 4))  # what the node stands in
        for k in range(n):
            p = parent[k]
            mine = (self.tag[k] in FURNITURE_TAGS, bool(self.tokens[k] & FURNITURE_TOKENS), self.tag[k] in MAIN_TAGS, bool(self.tokens[k] & MAIN_TOKENS))
            above[k] = np.maximum(mine, above[p] if p >= 0 else 0)
        density = text / nodes
        return np.column_stack(
            [
                np.log1p(text), np.log1p(own), np.log1p(nodes), density, links / np.maximum(text, 1), dots / np.maximum(text, 1) * 100, depth, height,
                np.log1p(count), place / np.maximum(count - 1, 1), text / np.maximum(total, 1), alike, density[up], (links / np.maximum(text, 1))[up],
                (dots / np.maximum(text, 1) * 100)[up], text[up] / max(text[0], 1), above, hashed,
            ]
        )

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """Nodes whose kind is plain by tag or attributes, their own or those they stand in, and whether they are furniture."""
        kind = np.zeros(len(self.tag), int)
        for k, (t, ts, p) in enumerate(zip(self.tag, self.tokens, self.parent)):
            bad, good = t in FURNITURE_TAGS or bool(ts & FURNITURE_TOKENS), t in MAIN_TAGS or bool(ts & MAIN_TOKENS)
            kind[k] = 1 if p >= 0 and kind[p] == 1 else 1 if bad and not good else -1 if good and not bad else 0
        return kind != 0, (kind == 1).astype(float)

    def decode(self, score: np.ndarray) -> np.ndarray:
        """Whether each node is kept: of all choices in which no kept node stands in a dropped one, the cheapest."""
        n = len(self.tag)
        weight = np.sqrt([sum(map(len, ts)) for ts in self.texts]) + 0.1
        own = np.clip(score, -SURE, SURE) * weight  # the cost of keeping a node; dropping it costs the opposite
        keep, drop = own.copy(), -own
        better = np.minimum
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            keep[p] += better(keep[k], drop[k])
            drop[p] += drop[k]
        kept = np.zeros(n, bool)
        kept[0] = True
        for k in range(1, n):
            kept[k] = kept[self.parent[k]] and keep[k] <= drop[k]
        return kept

    def text(self, kept: np.ndarray) -> str:
        """The text of the kept nodes in order, blocks on lines of their own."""
        parts: list[str] = []
        last = None
        for at, piece in self.order:
            if not kept[at] or self.tag[at] in HIDDEN:
                continue
            block = at
            while block > 0 and self.tag[block] not in BLOCKS:
                block = self.parent[block]
            if last is not None and block != last:
                parts.append("\n")
            parts.append(piece)
            last = block
        return "\n".join(" ".join(x.split()) for x in "".join(parts).split("\n") if x.strip())


class Model:
    """Trees over nodes, fitted on nodes of plain kind, or on labelled ones: for each page, whether each node is furniture."""

    def __init__(self, pages: list[Page], labels: list[np.ndarray] | None = None):
        x, y = [], []
        for i, page in enumerate(pages):
            known, kind = (np.ones(len(page.tag), bool), labels[i].astype(float)) if labels is not None else page.plain()
            if page.readable and known.any():
                features = page.measure()
                # once more without names, so that pages without telling tags and attributes are judged by their structure
                bare = features[known].copy()
                bare[:, STRUCTURE:] = 0
                x += [features[known], bare]
                y += [kind[known], kind[known]]
        self.trees = None
        if x and 0 < (target := np.concatenate(y)).mean() < 1:
            share = target.mean()
            self.trees = Trees(rounds=60).fit(np.concatenate(x), target, np.where(target > 0, 0.5 / share, 0.5 / (1 - share)))

    def kept(self, page: Page) -> np.ndarray:
        if self.trees is None or not page.readable:
            return np.ones(len(page.tag), bool)
        return page.decode(self.trees.score(page.measure()))


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", model: Model | None = None) -> DataFrame:
    """key and the text of each page's main body.

    The trees are fitted on about ``SAMPLE_PAGES`` pages, picked by the hash of their key, unless a model is given.
    A null page and markup that can't be read give a null text, an empty page an empty one. Repeated rows
    are read each; other columns are ignored. Nothing is shuffled.
    """
    if model is None:
        of_all = 1 << 30
        share = of_all * SAMPLE_PAGES // max(1, pages.count())
        sample = pages.where(F.expr(f"pmod(xxhash64(`{key}`), {of_all}) < {min(of_all, share)}")).select(F.col(html).alias("html")).where("html is not null")
        model = Model([Page(r[0]) for r in sorted(sample.distinct().collect())])
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x in batch.column("__html").to_pylist():
                page = Page(x)
                texts.append("" if x == "" else page.text(shared.value.kept(page)) if page.readable else None)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(texts, pa.string())], ["__key", "text"])

    return pages.select(F.col(key).alias("__key"), F.col(html).alias("__html")).mapInArrow(run, f"__key {kind}, text string").withColumnRenamed("__key", key)
