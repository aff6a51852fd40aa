"""Texts of an Arrow batch as one byte buffer, and hashed byte n-grams over it, without a loop per character."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text taken at once; bounds the memory of the arrays derived from them.
SLICE_BYTES = 2_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # ASCII letters to lower case
_FOLD[48:58] = 48  # digits alike
_FOLD[[9, 13]] = 32


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the texts of each part have about ``SLICE_BYTES``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(span(batch.column(text))[1])
        part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def span(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and the offsets of each; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def fold(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


def hashes(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram of up to four bytes that starts at each byte; the last ``order`` - 1 are padded."""
    n = len(data)
    wide = np.full(n + 8, 10, np.uint8)
    wide[:n] = data
    code = np.empty(n + 4, np.uint32)
    for k in range(4):  # every fourth place at once
        part = wide[k : k + (n + 7 - k) // 4 * 4].view("<u4")
        code[k::4] = part[: len(code[k::4])]
    code = code[:n] & np.uint32((1 << 8 * order) - 1) if order < 4 else code[:n]
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
    code = (code ^ (code >> np.uint32(13))) * np.uint32(0x85EBCA6B)
    return (code >> np.uint32(32 - bits)).astype(np.int32)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the spans' hashes and of its inverse, from 0 to n; kept from call to call."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            _powers[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]).astype(np.uint64))
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Spans:
    """64-bit hashes of any part of a buffer."""

    def __init__(self, data: np.ndarray):
        power, self.back = powers(len(data))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.total[ends] - self.total[starts]) * self.back[starts]


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive, without the newline) and row of every line of every text.

    A text has one line more than it has newlines; lines may be empty."""
    breaks = np.flatnonzero(data == 10)
    # a break at the end of a text opens an empty last line, which starts where the next text starts
    order = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    sort = np.lexsort((order, owner))
    starts, rows = order[sort], owner[sort]
    last = np.concatenate([rows[1:] != rows[:-1], [True]]) if len(rows) else np.zeros(0, bool)
    ends = np.where(last, offsets[rows + 1] if len(rows) else 0, np.concatenate([starts[1:] - 1, [0]]) if len(starts) else 0)
    return starts, ends, rows


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each half-open range."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[starts]


def totals(counted: DataFrame, bits: int) -> np.ndarray:
    """The sums of all columns after ``bucket`` for every bucket, as one array a column.

    ``counted`` has rows of a task's own counts. They are summed by bucket; one task packs the sums, so that
    the driver gets one short row, whose size depends on the number of buckets alone.
    """
    names = counted.columns[1:]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(names), 1 << bits), np.float32)
        for batch in batches:
            at = batch.column(0).to_numpy()
            for row, name in zip(table, names):
                row[at] = batch.column(name).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())], ["packed"])

    summed = counted.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names))
    packed = summed.repartition(1).mapInArrow(pack, "packed binary").collect()
    out = np.zeros((len(names), 1 << bits), np.float32)
    for row in packed:  # without any rows there may be no task
        out = np.frombuffer(zlib.decompress(row[0]), np.float32).reshape(len(names), 1 << bits)
    return out
