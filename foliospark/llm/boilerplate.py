"""The main body of pages whose text mixes a paper with navigation, notices, side bars and footers.

The pages come as visible text, so the tree that is left of a page is page, region, block and line; its
lines are the nodes. The odds of a line's n-grams in web pages against those in texts from other media
(which have papers, but no page furniture) are counted over the whole corpus. Gradient-boosted trees
over these odds, shape, density, neighbours and place give each line its odds of being furniture. They
are fitted on a bounded sample of lines whose kind is plain. Decoding goes down the tree: a page's best
sequence of regions (head, paper, insert, tail) is found first, so a line can't be the paper's own
inside a list of other articles, nor a furniture block interrupt a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import residue
from .boost import Trees
from .grams import fold, hashes, line_starts, slices, span, sums, totals

ORDER, BITS = 4, 18
#: Pages from which the trees are fitted, about so many.
SAMPLE_PAGES = 400
#: A paper with more than one in so many reads is hot.
HOT = 1000
#: An n-gram's odds are bounded by this.
BOUND = 3.0

_CAPTION = re.compile(r"\s*(?:figure|fig\.|table|box|scheme|chart|listing|algorithm|appendix|supplementary \w+)\s*[\dA-Z]+\s*[.:]", re.I)
_HEADING = re.compile(r"\s*(?:\d+(?:\.\d+)*\.?\s+)?[A-Z][a-z]+(?: (?:and|of|the|in|[a-z]+)){0,4}\s*$")
_BULLET = re.compile(r"\s*[•·*\-–▪◦]\s+")
_SEPARATOR = re.compile(r" [|·›/>–] |  ")
_NAMES = re.compile(r"\s*[A-ZÀ-Þ][\w'’-]+(?:,? [A-Z]\.)*(?:(?:,| and| &) [A-ZÀ-Þ][\w'’-]+(?:,? [A-Z]\.)*)*\s*$")
_STOP = re.compile(r"[.!?。！？:;][\"')\]’”]*\s*$")


def gram_odds(reads: DataFrame, web: Column, text: str = "text") -> np.ndarray:
    """Log-odds of each n-gram bucket in web pages against other texts, from all rows.

    Every task counts its rows into one table of buckets, so what is shuffled and what comes to the
    driver is bounded by the number of buckets, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for part in slices(batches, "__text"):
            data, offsets = span(part.column("__text"))
            kind = np.repeat(part.column("__web").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets))
            counts += np.bincount(kind << BITS | hashes(fold(data), ORDER, BITS), minlength=2 << BITS).reshape(2, -1)
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0, seen]), pa.array(counts[1, seen])], ["bucket", "other", "web"])

    rows = reads.select(F.col(text).alias("__text"), F.coalesce(web, F.lit(False)).alias("__web"))
    return odds_table(totals(rows.mapInArrow(run, "bucket bigint, other bigint, web bigint"), BITS))


def odds_table(counts: np.ndarray) -> np.ndarray:
    smooth = 0.5
    share = (counts + smooth) / (counts.sum(axis=1, keepdims=True) + 1)
    odds = np.clip(np.log(share[1] / share[0]), -BOUND, BOUND)
    odds[~counts.any(axis=0)] = 0
    return odds.astype(np.float32)


class Lines:
    """The non-blank lines of a slice of pages, and what is measured on them."""

    def __init__(self, texts: pa.Array, titles: pa.Array, odds: np.ndarray):
        data, offsets = span(texts)
        starts, ends, rows = line_starts(data, offsets)
        number = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
        lines = [x for t in texts.to_pylist() for x in (t or "").split("\n")]
        keep = np.fromiter((bool(x.strip()) for x in lines), bool, len(lines))
        self.text = [x for x, k in zip(lines, keep.tolist()) if k]
        self.row, self.number = rows[keep], number[keep]
        starts, ends = starts[keep], ends[keep]
        size = ends - starts
        value = odds[hashes(fold(data), ORDER, BITS)] if len(data) else np.empty(0, np.float32)
        span_ends = np.maximum(starts, ends - ORDER + 1)
        self.odds = sums(value, starts, span_ends) / np.maximum(1, span_ends - starts)
        title = [(t or "").strip() for t in titles.to_pylist()]
        checks = [
            (
                x.strip() == title[r] if title[r] else False,
                bool(_CAPTION.match(x)),
                bool(_BULLET.match(x)),
                len(_SEPARATOR.findall(x)),
                bool(_STOP.search(x)),
                len(x) < 60 and bool(_HEADING.match(x)),
                1 + x.count(",") if _NAMES.match(x) else 0,
                x.count(" ") + 1,
                sum(map(str.isdigit, x)) / len(x) if len(x) < 200 else 0.0,
            )
            for x, r in zip(self.text, self.row.tolist())
        ]
        m = np.array(checks, np.float64).reshape(len(checks), 9)
        self.title, self.caption, self.bullet, self.stop, self.heading, self.names = (m[:, j] for j in (0, 1, 2, 4, 5, 6))
        self.title, self.caption, self.bullet, self.stop, self.heading = (
            x > 0 for x in (self.title, self.caption, self.bullet, self.stop, self.heading)
        )
        words = m[:, 7]
        #: An article's name that isn't this page's: several words, no stop, no caption.
        self.other_title = ~self.title & ~self.caption & ~self.bullet & (words >= 4) & (words <= 24) & (size < 160) & (
            ~self.stop | np.fromiter((x.rstrip().endswith("?") for x in self.text), bool, len(self.text))
        ) & (m[:, 3] == 0)
        n = len(self.text)
        first = np.searchsorted(self.row, self.row)
        last = np.searchsorted(self.row, self.row, side="right") - 1
        index = np.arange(n)
        padded = np.concatenate([[0.0], np.cumsum(self.odds)])

        def around(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Mean odds of the lines of the page from a to b, 0 if there is none."""
            low, high = np.maximum(a, first), np.minimum(b, last) + 1
            return np.where(high > low, padded[np.maximum(high, low)] - padded[low], 0.0) / np.maximum(1, high - low)

        prose = (size >= 60) & self.stop & (self.odds < 0.3)
        before = np.maximum.accumulate(np.where(prose, index, -1)) if n else index
        after = (np.minimum.accumulate(np.where(prose, index, n)[::-1])[::-1]) if n else index
        at_title = np.maximum.accumulate(np.where(self.title, index, -1)) if n else index
        since = np.where((at_title >= first) & (at_title >= 0), index - at_title, 99)
        self.features = np.column_stack(
            [
                self.odds,
                np.log1p(size),
                words,
                self.stop,
                m[:, 3],
                self.bullet,
                m[:, 8],
                self.caption,
                self.heading,
                self.names,
                self.title,
                self.other_title,
                around(index - 1, index - 1),
                around(index + 1, index + 1),
                around(index - 3, index + 3),
                np.where(before >= first, np.minimum(index - before, 30), 31),
                np.where(after <= last, np.minimum(after - index, 30), 31),
                np.minimum(since, 60),
                (index - first) / np.maximum(1, last - first),
            ]
        )
        self.first, self.last = first, last
        titles_before = np.concatenate([[0], np.cumsum(self.title)])
        self.first_title = self.title & (titles_before[index] == titles_before[first]) if n else self.title

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines whose kind is plain, and whether they are furniture."""
        by = (self.names > 1) & (self.features[:, 17] == 1)  # the line after the title names the authors
        strange = (self.odds > 0.8) & ~self.caption & ~self.title & ~by
        foreign = self.other_title & (self.odds < 0.8) & ~self.heading & (self.features[:, 17] > 3)
        own = self.title | self.caption | by | ((self.odds < 0.25) & (self.stop | self.heading | self.bullet | (self.features[:, 2] <= 3)) & ~self.other_title)
        return strange | foreign | own, (strange | foreign).astype(np.float64)


#: Bound of a line's log-odds.
SURE = 6.0
#: Regions of a page, and the cost of going from one to the next (None: impossible). Inserts lie within the paper.
REGIONS = ("head", "paper", "insert", "tail")
_STEP = np.array(
    [
        [0.0, 1.0, np.inf, 3.0],
        [np.inf, 0.0, 1.2, 1.2],
        [np.inf, 0.5, 0.0, np.inf],
        [np.inf, np.inf, np.inf, 0.0],
    ]
)
_ENTER = np.array([0.0, 0.5, np.inf, np.inf])


def decode(score: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each line is furniture: the cheapest sequence of regions of each page. ``score`` has the
    lines' log-odds of furniture, ``first`` the index of each line's page's first line."""
    furniture = np.zeros(len(score), bool)
    pages = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(score) else np.empty(0, int)
    bound = np.clip(score, -SURE, SURE)
    for a, b in zip(pages.tolist(), [*pages[1:].tolist(), len(score)]):
        best, back = None, []
        for s in bound[a:b].tolist():
            cost = (-s if s < 0 else 0.0, s if s > 0 else 0.0)  # of calling the line furniture, or the paper's
            if best is None:
                best = [_ENTER[0] + cost[0], _ENTER[1] + cost[1], np.inf, np.inf]
                continue
            h, p, i, t = best
            from_paper = min((h + _STEP[0][1], 0), (p, 1), (i + _STEP[2][1], 2))
            from_insert = min((p + _STEP[1][2], 1), (i, 2))
            from_tail = min((h + _STEP[0][3], 0), (p + _STEP[1][3], 1), (t, 3))
            back.append((0, from_paper[1], from_insert[1], from_tail[1]))
            best = [h + cost[0], from_paper[0] + cost[1], from_insert[0] + cost[0], from_tail[0] + cost[0]]
        state = min(range(4), key=best.__getitem__)
        for k in range(b - a - 1, -1, -1):
            furniture[a + k] = state != 1
            if k:
                state = back[k - 1][state]
    return furniture


class Model:
    def __init__(self, odds: np.ndarray, texts: pa.Array, titles: pa.Array):
        self.odds = odds
        lines = Lines(texts, titles, odds)
        plain, kind = lines.plain()
        if not plain.any():
            self.trees = None
            return
        x, y = lines.features[plain], kind[plain]
        share = np.clip(y.mean(), 0.05, 0.95)
        self.trees = Trees(rounds=60).fit(x, y, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)))

    def furniture(self, texts: pa.Array, titles: pa.Array) -> tuple[Lines, np.ndarray]:
        lines = Lines(texts, titles, self.odds)
        if self.trees is None or not len(lines.text):
            return lines, np.zeros(len(lines.text), bool)
        score = self.trees.score(lines.features)
        score[lines.first_title] = -SURE  # the paper is where its title is
        return lines, decode(score, lines.first)


def pages(reads: DataFrame, papers: DataFrame) -> DataFrame:
    """The web pages with their papers' titles; a paper that stands twice counts with its greatest title.

    Papers that hold more than one in ``HOT`` of all reads, of which there are at most ``HOT``, send their
    titles to the pages; only the pages of the others are shuffled.
    """
    titles = papers.groupBy("doc_id").agg(F.max("title").alias("__title"))
    html = reads.where((F.col("format") == "html") & F.col("text").isNotNull()).select("read_id", "doc_id", F.col("text").alias("__text"))
    hot = reads.where("doc_id is not null").groupBy("doc_id").count().where(F.col("count") > reads.count() / HOT).select("doc_id")
    of_hot = html.join(F.broadcast(hot.join(titles, "doc_id", "left")), "doc_id")
    others = html.join(F.broadcast(hot), "doc_id", "left_anti").join(titles, "doc_id", "left")
    return of_hot.unionByName(others).select("read_id", "__text", "__title")


def fit(reads: DataFrame, papers: DataFrame) -> Model:
    """The n-grams' odds from all reads, and the trees from about ``SAMPLE_PAGES`` pages, picked by the hash of their
    key, so that the sample's size doesn't depend on the number of pages or tasks; equal pages count once."""
    html = reads.where((F.col("format") == "html"))
    of_all = 1 << 30
    share = of_all * SAMPLE_PAGES // max(1, html.count())
    picked = html.where(F.expr(f"pmod(xxhash64(read_id), {of_all}) < {min(of_all, share)}"))
    titles = papers.groupBy("doc_id").agg(F.max("title").alias("__title"))
    sample = picked.where("text is not null").select("doc_id", F.col("text").alias("__text")).join(titles, "doc_id", "left").toArrow()
    once = sorted(dict(zip(sample.column("__text").to_pylist(), sample.column("__title").to_pylist())).items(), key=lambda x: x[0])
    texts, names = (pa.array([x[k] for x in once], pa.string()) for k in (0, 1))
    return Model(gram_odds(reads, F.col("format") == "html"), texts, names)


def _run(model, of_residue, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            part = part.filter(pa.array(~of_residue.value.residue(part.column("__text"))))
            lines, furniture = model.value.furniture(part.column("__text"), part.column("__title"))
            if whole:
                kept: list[list[str]] = [[] for _ in range(part.num_rows)]
                for x, r, f in zip(lines.text, lines.row.tolist(), furniture.tolist()):
                    if not f:
                        kept[r].append(x)
                yield pa.RecordBatch.from_arrays([part.column("read_id"), pa.array(["\n".join(k) for k in kept], pa.string())], ["read_id", "text"])
            else:
                rows = lines.row[furniture]
                yield pa.RecordBatch.from_arrays(
                    [part.column("read_id").take(pa.array(rows)), pa.array(lines.number[furniture], pa.int32())], ["read_id", "line_no"]
                )

    return run


def _apply(reads: DataFrame, papers: DataFrame, whole: bool, schema: str) -> DataFrame:
    context = reads.sparkSession.sparkContext
    model = context.broadcast(fit(reads, papers))
    of_residue = context.broadcast(residue.fit(reads))
    return pages(reads, papers).mapInArrow(_run(model, of_residue, whole), schema)


def furniture_lines(reads: DataFrame, papers: DataFrame) -> DataFrame:
    """read_id and line_no (from 1, blank lines counted) of the non-blank lines of web pages that aren't
    part of the paper. Null texts and pages that are residue as a whole have none; a page whose paper
    is unknown is judged without a title. Repeated reads give repeated rows."""
    return _apply(reads, papers, False, "read_id bigint, line_no int")


def main_text(reads: DataFrame, papers: DataFrame) -> DataFrame:
    """read_id and the text of each web page that is the paper's own, its lines in order."""
    return _apply(reads, papers, True, "read_id bigint, text string")
