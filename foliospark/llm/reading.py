"""Reading level of each document's prose, by a familiar-word formula.

The level is a function of two numbers: the share of words outside a list of familiar words, and the
average sentence length. The list has the words that a share of the corpus's English documents use, counted
over the prose of all documents. The weights of both numbers, and the share, are fitted on
passages of known level; the share is chosen by leaving passages out. A post may mix prose of several
levels, so the fitted formula is applied to each of its sentences; the post's level is the highest that
enough of its words reach.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import slices
from .language import language

#: Words in at least one in so many documents are kept with their document frequencies. A word is familiar from one
#: of these shares of the English documents on; both are shares, so they mean the same in a corpus of any size.
LEAST_SHARE = 20_000
SHARES = (0.1, 0.07, 0.05, 0.03, 0.02, 0.015, 0.01, 0.007, 0.005, 0.003, 0.002, 0.001)
#: Passages of known level that are used at most.
MAX_PASSAGES = 5_000
MIN_WORDS = 40
#: Sentences longer than this count as this long.
LONGEST = 60
#: Without a stop at its end, a longer stretch isn't taken for one sentence, but for several of usual length.
UNSTOPPED, USUAL = 30, 15
#: Share of a post's words that must be in sentences of a level, or a higher one, for it to be the post's.
ENOUGH = 0.375

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_BLOCKS = re.compile(
    r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)|\[code\b.*?(?:\[/code\]|\Z)|\{\{\{.*?(?:\}\}\}|\Z)|\\begin\{(?:verbatim|lstlisting)\}.*?(?:\\end\{\w+\}|\Z)"
)
_INLINE = re.compile(r"`[^`\n]+`|<a\b[^>]*>.*?</a>|\[[^\]\n]{0,80}\]\([^)\n]*\)|</?[a-zA-Z][^>\n]*>")
_URL = re.compile(r"\b(?:https?|ftp)://\S+|\bwww\.\S+")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[ T]|\d\d:\d\d:\d\d\b|(?:INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\b)")
_STARTS_CODE = re.compile(
    r"    |\t|\s*(?:[$>#%]\s|//|/\*|@\w+|import \w|from \w+ import|def \w+\(|class \w+[:({]|SELECT\b.*\bFROM\b|#include|\}|\{)"
)
_MARKS_CODE = re.compile(r"[;{}]\s*$|::|=>|->|\(\)|\((?<=\w\()\w*[,)]|\[(?<=\w\[)\w+\]|[+\-*/]?=\s*\S|_(?<=\w_)\w+")
_CAMEL, _CAMEL_INSIDE = re.compile(r"\b[a-z]+[A-Z]\w*"), re.compile(r"[a-z][A-Z]")
_SENTENCE = re.compile(r"[.!?。！？]+[\"'”’)\]]*(?=\s|$)|\n+")
_DUMP = re.compile(r"\S{30,}")


def _code_marks(line: str) -> int:
    """How many signs of code a line has."""
    count = len(_MARKS_CODE.findall(line)) + (_STARTS_CODE.match(line) is not None)
    return count + len(_CAMEL.findall(line)) if _CAMEL_INSIDE.search(line) else count


def prose(text: str | None) -> str:
    """The prose of a post: without code, logs, dumps, markup and links. Null gives an empty text."""
    if not text:
        return ""
    if "```" in text or "~~~" in text or "<" in text or "[code" in text or "{{{" in text or "\\begin" in text:
        text = _BLOCKS.sub("\n", text)
    kept = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        if _LOG.match(line):
            continue
        plain = _INLINE.sub(" ", line) if "`" in line or "<" in line or "](" in line else line
        if "://" in plain or "www." in plain:
            plain = _URL.sub(" ", plain)
            if len(_WORD.findall(plain)) <= 6:  # a link with a word or two about it
                continue
        if len(plain) > 30 and max(map(len, plain.split()), default=0) >= 30:
            plain = _DUMP.sub(" ", plain)
        marks = _code_marks(plain)
        if marks and (len(plain) < 120 or marks * 60 > len(plain)):
            continue
        kept.append(plain)
    return "\n".join(kept)


def sentences(text: str) -> Iterator[tuple[list[str], float]]:
    """The words of each sentence of a prose text, and the sentence's length in words. Lines end sentences."""
    at = 0
    for match in [*_SENTENCE.finditer(text), None]:
        part = text[at : match.start() if match else len(text)]
        at = match.end() if match else at
        words = [w.lower() for w in _WORD.findall(part)]
        if words:
            stopped = match is not None and not match.group().startswith("\n")
            yield words, len(words) if stopped or len(words) <= UNSTOPPED else USUAL


def measure(text: str) -> tuple[list[str], float]:
    """The words of a prose text, and its average sentence length in words."""
    parts = [*sentences(text)]
    words = [w for p, _ in parts for w in p]
    return words, len(words) / max(1.0, sum(len(p) / n for p, n in parts))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    weight = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(x.shape[1]), x.T @ (y - p) - penalty @ weight)
        weight = weight + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return weight


class Formula:
    """Odds of being at least of each level, from the share of unfamiliar words and the sentence length."""

    def __init__(self, x: np.ndarray, levels: np.ndarray):
        self.steps = [(k, _logistic(self._design(x), (levels >= k).astype(float))) for k in sorted(set(levels.tolist()))[1:]]
        self.least = int(levels.min()) if len(levels) else 1

    @staticmethod
    def _design(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), 10 * x[:, 0], np.minimum(x[:, 1], LONGEST) / 10])

    def score(self, x: np.ndarray) -> np.ndarray:
        """A level on the passages' scale, with parts."""
        return self.least + sum((p for _, p in self.reach(x)), np.zeros(len(x)))

    def reach(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Each level but the least, with the probability of being at least of it."""
        design = self._design(x)
        return [(k, 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))) for k, w in self.steps]


class Model:
    """Familiar words, the weight of words for English, and the formula."""

    def __init__(self, words: list[tuple[str, int, int]], documents: int, passages: list[tuple[int, str]]):
        """``words`` with their numbers of English and of other documents, of ``documents`` English ones in all."""
        share = {w: a / max(1, documents) for w, a, _ in words if a}
        english, other = (sum(w[j] for w in words) + 0.5 * len(words) for j in (1, 2))
        self.english = {w: float(np.clip(np.log((a + 0.5) / english) - np.log((b + 0.5) / other), -4, 4)) for w, a, b in words}
        measured = [measure(prose(t)) for _, t in passages]
        levels = np.array([level for level, _ in passages])
        self.share, self.formula = SHARES[0], Formula(np.zeros((0, 2)), np.zeros(0, int)) if not len(levels) else None
        best = None
        for least in SHARES if len(levels) else ():
            x = np.array([[sum(share.get(w, 0.0) < least for w in words_) / max(1, len(words_)), mean] for words_, mean in measured])
            wrong = 0.0
            for fold in range(5):
                held = np.arange(len(levels)) % 5 == fold
                if held.all() or len(set(levels[~held].tolist())) < 2:
                    continue
                wrong += np.abs(Formula(x[~held], levels[~held]).score(x[held]) - levels[held]).sum()
            if best is None or wrong < best[0] - 1e-9:
                best, self.share, self.formula = (wrong,), least, Formula(x, levels)
        self.familiar = {w for w, s in share.items() if s >= self.share}

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Words, sentence length, share of unfamiliar words, mean level, whole level, and whether the text is English."""
        n = len(texts)
        row, size, length, strange, odds = [], [], [], [], np.zeros(n)
        for i, text in enumerate(texts):
            seen: set[str] = set()
            for words, long in sentences(prose(text)):
                row.append(i)
                size.append(len(words))
                length.append(long)
                strange.append(sum(w not in self.familiar for w in words))
                seen.update(words)
            odds[i] = sum(self.english.get(w, 0.0) for w in seen)
        row_, size_ = np.array(row, np.int64), np.array(size, float)
        total = lambda x: np.bincount(row_, x, minlength=n) if len(row_) else np.zeros(n)
        count = total(size_)
        some = np.maximum(count, 1)
        x = np.column_stack([np.array(strange) / np.maximum(size_, 1), np.array(length, float)]) if row else np.zeros((0, 2))
        mean, whole = self.formula.least * np.ones(n), self.formula.least * np.ones(n, np.int32)
        for k, reach in self.formula.reach(x):
            share = total(size_ * reach) / some
            mean += share
            whole[share >= ENOUGH] = k
        sentence = some / np.maximum(total(size_ / np.maximum(x[:, 1], 1)), 1e-9)
        return count.astype(np.int32), np.where(count > 0, sentence, 0.0), total(np.array(strange, float)) / some, np.where(count > 0, mean, np.nan), whole, odds > 0


def document_frequencies(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[tuple[str, int, int]], int]:
    """The words of all documents' prose with how many documents of either language use them, English ones
    and others, and the number of English documents. A label, though it may be wrong, says which a document is;
    without one its function words do. Words in less than one in ``LEAST_SHARE`` documents are left out, which
    bounds what comes to the driver by the words of that many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for part in slices(batches, "__text"):
            for x, name in zip(part.column("__text").to_pylist(), part.column("__lang").to_pylist()):
                plain = prose(x)
                if plain:
                    own = counts[(name.lower() if name else language(plain)) != "en"]
                    own.update({w.lower() for w in _WORD.findall(plain)})
                    own[""] += 1
        words = [*counts[0].keys() | counts[1].keys()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([counts[0][w] for w in words], pa.int64()), pa.array([counts[1][w] for w in words], pa.int64())],
            ["word", "english", "other"],
        )

    filled = docs.where(F.length(text) > 0)
    rows = (
        filled.select(F.col(text).alias("__text"), F.col(lang).alias("__lang"))
        .mapInArrow(run, "word string, english bigint, other bigint")
        .groupBy("word").agg(F.sum("english").alias("english"), F.sum("other").alias("other"))
        .where((F.col("english") + F.col("other") >= filled.count() / LEAST_SHARE) | (F.col("word") == "")).toArrow()
    )
    words = sorted(zip(*(rows.column(c).to_pylist() for c in ("word", "english", "other"))))
    return [w for w in words if w[0]], sum(a for w, a, _ in words if not w)


def fit(docs: DataFrame, passages: DataFrame) -> Model:
    known = passages.where("text is not null and level is not null").orderBy("ref_id").limit(MAX_PASSAGES).collect()
    return Model(*document_frequencies(docs), [(r["level"], r["text"]) for r in known])


def reading_levels(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_words, sentence_length, unfamiliar_share, level, whole_level and english of every row.

    The numbers are those of the prose. Without prose (null, empty, blank texts, code only) n_words is 0
    and both levels are null. ``level`` is the mean over the words on the passages' scale, with parts;
    ``whole_level`` the highest that a share of ``ENOUGH`` of the words reaches.
    Repeated rows are judged each; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, passages))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            count, length, share, level, whole, english = model.value.judge(part.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("__key"), pa.array(count), pa.array(length), pa.array(share), pa.array(level, from_pandas=True),
                 pa.array(whole, mask=count == 0), pa.array(english)],
                ["__key", "n_words", "sentence_length", "unfamiliar_share", "level", "whole_level", "english"],
            )

    return (
        docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
        .mapInArrow(run, f"__key {kind}, n_words int, sentence_length double, unfamiliar_share double, level double, whole_level int, english boolean")
        .withColumnRenamed("__key", key)
    )
