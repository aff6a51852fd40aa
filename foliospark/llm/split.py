"""Cutting oversized texts into overlapping pieces at natural boundaries.

Within each size window the cut is the candidate with the deepest valley of lexical cohesion: the
similarity of the blocks of words before and after each boundary, against the peaks on both sides.
Candidates are, in this order, paragraph ends, sentence ends, line ends and word ends; a text without
any is cut at the limit.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4000
OVERLAP = 350
BLOCK_WORDS = 60
SLICE_ROWS = 64

_WORD = re.compile(r"[^\W_]+|[぀-ヿ㐀-鿿]")
_PARAGRAPH_END = re.compile(r"(?<=\S)(?=[ \t]*\n[ \t]*\n)")
_SENTENCE_END = re.compile(r"(?<=[.!?])[\"')\]’”]*(?=\s)|(?<=[。！？])")
_LINE_END = re.compile(r"(?<=\S)(?=[ \t]*\n)")
_WORD_END = re.compile(r"(?<=\S)(?=\s)")


_HEADING = re.compile(r"(?:\n[ \t]*\n|^)[ \t]*[^\n.!?;:。]{1,60}\Z")


class Cohesion:
    """Similarity of the blocks of words around a position of a text."""

    def __init__(self, text: str, block: int):
        found = [(m.start(), m.group().lower()) for m in _WORD.finditer(text)]
        self.at = [p for p, _ in found]
        self.words = [w for _, w in found]
        self.block = block

    def __call__(self, position: int) -> float:
        k = bisect_left(self.at, position)
        before = Counter(self.words[max(0, k - self.block) : k])
        after = Counter(self.words[k : k + self.block])
        if not before or not after:
            return 0.0
        dot = sum(n * after[w] for w, n in before.items() if w in after)
        return dot / math.sqrt(sum(n * n for n in before.values()) * sum(n * n for n in after.values()))


def deepest(candidates: list[int], cohesion: Cohesion) -> int:
    """The candidate with the deepest valley; ties go to the last, which makes the longer piece."""
    if len(candidates) == 1:
        return candidates[0]
    value = [cohesion(c) for c in candidates]
    peak_left, peak_right = [], []
    for side, order in ((peak_left, value), (peak_right, value[::-1])):
        top = 0.0
        for v in order:
            top = max(top, v)
            side.append(top)
    peak_right.reverse()
    depth = [a + b - 2 * v for a, b, v in zip(peak_left, peak_right, value)]
    return candidates[max(range(len(depth)), key=lambda i: (round(depth[i], 9), i))]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """Start and end of each piece of a text, in code points; one piece if the text is within the limit.

    Each piece after the first starts ``overlap`` characters before the end of the one before; a piece
    ends at a boundary of its second half if there is one, else at an earlier boundary that still moves
    on, else at a word end, else at the limit.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of limit")
    if len(text) <= limit:
        return [(0, len(text))]
    levels = [[m.end() for m in p.finditer(text)] for p in (_PARAGRAPH_END, _SENTENCE_END, _LINE_END)]
    levels[0] = [c for c in levels[0] if not _HEADING.search(text, max(0, c - 80), c)]  # a heading stays with what it heads
    words: list[int] | None = None
    cohesion = Cohesion(text, block)
    out, start = [], 0
    while len(text) - start > limit:
        middle, end, least = start + limit // 2, start + limit, start + overlap + 1
        cut = None
        for low, high in ((middle, end), (least, middle - 1)):
            for level in levels:
                inside = level[bisect_left(level, low) : bisect_right(level, high)]
                if inside:
                    cut = deepest(inside, cohesion)
                    break
            if cut is not None:
                break
        if cut is None:
            if words is None:
                words = [m.end() for m in _WORD_END.finditer(text)]
            k = bisect_right(words, end)
            cut = words[k - 1] if k and words[k - 1] >= least else end
        out.append((start, cut))
        start = cut - overlap
    out.append((start, len(text)))
    return out


def locate(chunk: str, source: str | None, start: int | None) -> int | None:
    """Place of a chunk in its source; the occurrence at or after the stored start, else the first."""
    if not source:
        return None
    found = source.find(chunk, start) if start is not None and start >= 0 else -1
    if found < 0:
        found = source.find(chunk)
    return found if found >= 0 else None


_OUT = "read_id bigint, id string, piece int, text string, start_char int, end_char int, located boolean"


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                out: dict[str, list] = {c.split()[0]: [] for c in _OUT.split(", ")}
                columns = batch.slice(begin, SLICE_ROWS).to_pydict()
                for read_id, id_, text, start, source in zip(*(columns[c] for c in ("__read", "__id", "__text", "__start", "__source"))):
                    base = locate(text, source, start)
                    for k, (a, b) in enumerate(pieces(text, limit, overlap)):
                        row = (read_id, id_, k, text[a:b], (base or 0) + a, (base or 0) + b, base is not None)
                        for column, x in zip(out.values(), row):
                            column.append(x)
                yield pa.RecordBatch.from_pydict(
                    out,
                    schema=pa.schema(
                        [("read_id", pa.int64()), ("id", pa.string()), ("piece", pa.int32()), ("text", pa.string()),
                         ("start_char", pa.int32()), ("end_char", pa.int32()), ("located", pa.bool_())]
                    ),
                )

    return run


#: Words of 64 bits of the set of keys by which rows are picked out before they are shuffled; 4 MB, whatever the corpus.
SET_WORDS = 1 << 18


def likely_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is likely one of those in the only column of ``keys``, without a shuffle of ``rows``.

    The keys are hashed into a set of bits of a fixed size, which is broadcast; no row whose key is among
    them is lost, others may stay (about one in ``64 * SET_WORDS`` for each key).
    """
    word = lambda c: F.expr(f"pmod(shiftright({c}, 6), {SET_WORDS})")
    bit = lambda c: F.expr(f"shiftleft(1L, int({c} & 63))")
    hashed = keys.select(F.xxhash64(keys.columns[0]).alias("__h"))
    bits = hashed.groupBy(word("__h").alias("__word")).agg(F.bit_or(bit("__h")).alias("__bits"))
    at = rows.withColumn("__h", F.xxhash64(key)).withColumn("__word", word("__h"))
    inside = at.join(F.broadcast(bits), "__word").where(F.col("__bits").bitwiseAND(bit("__h")) != 0)
    return inside.select(*rows.columns)


def split_chunks(chunks: DataFrame, reads: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the chunks whose text is longer than ``limit``: read_id, id, piece, text, start_char,
    end_char, located.

    Offsets are those in the read's text where the chunk is found there (``located``), whatever the
    stored offsets say; else in the chunk's own text. A key that occurs twice counts once, with its
    greatest text. Null texts aren't oversized. Only the texts of the reads of oversized chunks are
    shuffled, which are picked out by a set of their ids; other columns of either table are ignored.
    """
    big = (
        chunks.select(F.col("read_id").alias("__read"), F.col("id").alias("__id"), F.col("text").alias("__text"), F.col("start_char").alias("__start"))
        .where(F.length("__text") > limit)
        .groupBy("__read", "__id")
        .agg(F.max(F.struct("__text", "__start")).alias("__c"))
        .select("__read", "__id", "__c.__text", "__c.__start")
    )
    source = (
        likely_in(reads.select(F.col("read_id").alias("__read"), F.col("text").alias("__source")), "__read", big.select("__read"))
        .groupBy("__read")
        .agg(F.max("__source").alias("__source"))
    )
    return big.join(source, "__read", "left").mapInArrow(_split(limit, overlap), _OUT)
