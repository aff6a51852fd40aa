"""Filling containers of a fixed number of tokens with documents, by lexical retrieval.

A document larger than a container is cut into full containers and a rest; every rest and every
smaller document is an item that is never split. Items are encoded once and spread over shards of at
most about ``shard_items`` rows by their words: centroids of weighted tokens, fitted on a bounded sample,
give each item its cluster; clusters that are alike share a shard, and one that is too large for a shard is
split by a salted hash, so copies and hot sources spread evenly and each shard is a task of bounded size.
Each shard holds a BM25 inverted index of its items: the largest unused item seeds a container,
its best-scored unused neighbours that still fit follow, and what room is left is filled with the
largest unused items that fit, whatever their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .encode import encode_corpus

CAPACITY = 2048
SHARD_ITEMS = 16_384
#: Items from which the clusters are fitted, about so many; clusters at most, and for each shard; rounds of fitting.
SAMPLE_ITEMS, MOST_CLUSTERS, CLUSTERS_PER_SHARD, ROUNDS = 16_384, 1024, 8, 8
#: Numbers that a document's tokens are hashed to for clustering.
WIDTH = 1024
#: A token of more than one in so many items is frequent; seeds whose scores are prepared at once.
OFTEN, SEEDS = 16, 64
#: Neighbours that are put in order at once.
AT_ONCE = 128
#: Usual constants of BM25.
K1, B = 1.2, 0.75


def _items(capacity: int):
    """Pieces of each document; full ones are a container by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            sizes = np.diff(batch.column("ids").offsets.to_numpy())
            ids = batch.column("ids").flatten().to_numpy()
            begins = np.concatenate([[0], np.cumsum(sizes)])
            take, piece, start, terms, salt = [], [], [], [], []
            for i, size in enumerate(sizes.tolist()):
                for k in range(max(1, -(-size // capacity))):
                    a, b = k * capacity, min(size, (k + 1) * capacity)
                    take.append(i)
                    piece.append(k)
                    start.append(a)
                    terms.append((begins[i] + a, b - a))
                    salt.append(row + i)
            row += batch.num_rows
            counts = np.array([n for _, n in terms], np.int32)
            full = counts == capacity
            lengths = np.where(full, 0, counts)  # the words of a full piece are needed no more
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            flat = np.concatenate([ids[a : a + n] for (a, n), f in zip(terms, full) if not f] or [ids[:0]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__key").take(pa.array(take)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int32()),
                    pa.array(counts),
                    pa.array(full),
                    pa.array(salt, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                ],
                ["__key", "piece", "start_token", "n_tokens", "full", "salt", "terms"],
            )

    return run


class Index:
    """BM25 over the items of one shard."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, offsets: np.ndarray):
        owner = np.repeat(np.arange(len(sizes)), np.diff(offsets))
        pairs, tf = np.unique(owner * (1 << 32) + terms, return_counts=True)
        self.item, term = pairs >> 32, pairs & 0xFFFFFFFF
        names, self.term = np.unique(term, return_inverse=True)
        df = np.bincount(self.term, minlength=len(names))
        idf = np.log1p((len(sizes) - df + 0.5) / (df + 0.5))
        mean = max(1.0, float(sizes.mean()))
        weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.item] / mean))
        self.size = len(sizes)
        # tokens of many items are columns of a matrix, by which the scores of many seeds are had at once; the others are lists
        often = df * OFTEN > len(sizes)
        column = np.cumsum(often) - 1
        mine = often[self.term]
        self.dense = np.zeros((len(sizes), int(often.sum())), np.float32)
        self.dense[self.item[mine], column[self.term[mine]]] = weight[mine]
        self.item, self.term, weight = self.item[~mine], self.term[~mine], weight[~mine]
        self.begin = np.searchsorted(self.item, np.arange(len(sizes) + 1))
        self.df = np.where(often, 0, df)
        order = np.argsort(self.term, kind="stable")
        self.posting_item, self.posting_weight = self.item[order], weight[order]
        self.posting_begin = np.concatenate([[0], np.cumsum(self.df)])
        self.ready: dict[int, np.ndarray] = {}

    def prepare(self, seeds: np.ndarray) -> None:
        """The part of some seeds' scores that their frequent tokens give."""
        self.ready = dict(zip(seeds.tolist(), (self.dense[seeds] > 0).astype(np.float32) @ self.dense.T))

    def neighbours(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Items that share any of the seed's terms, with their scores."""
        if seed not in self.ready:
            self.prepare(np.array([seed]))
        own = self.term[self.begin[seed] : self.begin[seed + 1]]
        count = self.df[own]
        at = np.repeat(self.posting_begin[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        scores = self.ready[seed] + np.bincount(self.posting_item[at], self.posting_weight[at], minlength=self.size)
        items = np.flatnonzero(scores)
        return items, scores[items]


def fill(sizes: np.ndarray, terms: np.ndarray, offsets: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and place of each item; items come in their order of preference. Empty items are
    dealt round the containers."""
    n = len(sizes)
    container, place = np.full(n, -1, np.int64), np.zeros(n, np.int32)
    index = Index(sizes, terms, offsets)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(n - 1, -1, -1):
        stacks[sizes[i]].append(i)
    left = np.bincount(sizes, minlength=capacity + 1)
    left[0] = 0
    free = sizes > 0
    opened = 0

    def put(i: int, at: int) -> None:
        container[i], place[i] = opened, at
        free[i] = False
        left[sizes[i]] -= 1

    def largest(room: int) -> int | None:
        """The first unused item of the largest size that fits."""
        while room > 0:
            fits = np.flatnonzero(left[: room + 1])
            if not len(fits):
                return None
            stack = stacks[fits[-1]]
            while stack and not free[stack[-1]]:
                stack.pop()
            return stack[-1]
        return None

    while (seed := largest(capacity)) is not None:
        put(seed, 0)
        room, at = capacity - int(sizes[seed]), 1
        if room:
            if seed not in index.ready:  # items come by size, so the next seeds are among those that follow
                index.prepare(np.concatenate([[seed], np.flatnonzero(free[seed : seed + 8 * SEEDS])[: SEEDS - 1] + seed]))
            items, scores = index.neighbours(seed)
            while room and left[: room + 1].any():  # the best that fit, then the best of those that still do
                fits = free[items] & (sizes[items] <= room)
                items, scores = items[fits], scores[fits]
                if not len(items):
                    break
                best = np.argpartition(-scores, AT_ONCE)[:AT_ONCE] if len(items) > AT_ONCE else np.arange(len(items))
                for i in items[best[np.lexsort((items[best], -scores[best]))]].tolist():
                    if sizes[i] <= room:
                        put(i, at)
                        room, at = room - int(sizes[i]), at + 1
            while (i := largest(room)) is not None:
                put(i, at)
                room, at = room - int(sizes[i]), at + 1
        opened += 1
    empty = np.flatnonzero(sizes == 0)
    container[empty] = np.arange(len(empty)) % max(1, opened)
    taken = np.bincount(container[sizes > 0], minlength=max(1, opened))
    place[empty] = taken[container[empty]] + np.arange(len(empty)) // max(1, opened)
    return container, place


class Clusters:
    """Centroids of items' tokens, weighted by how rare the tokens are in the sample."""

    def __init__(self, items: list[np.ndarray], count: int):
        df = np.zeros(1 << 20)
        for x in items:
            df[np.unique(x) % len(df)] += 1
        self.idf = np.log1p(len(items) / (1 + df)).astype(np.float32)
        self.idf[df > 0.2 * len(items)] = 0  # tokens of every subject
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in items])])
        rows = self.vectors(np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64), offsets)
        centres = rows[np.linspace(0, len(rows) - 1, count).astype(int)]
        for _ in range(ROUNDS):
            own = (rows @ centres.T).argmax(axis=1)
            order = np.argsort(own, kind="stable")
            found, start = np.unique(own[order], return_index=True)
            sums = np.add.reduceat(rows[order], start, axis=0)
            centres = centres.copy()
            centres[found] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        self.centres = centres

    def vectors(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of unit length for each item; tokens count by the root of their number."""
        n = len(offsets) - 1
        owner = np.repeat(np.arange(n), np.diff(offsets))
        pairs, times = np.unique(owner << 32 | terms, return_counts=True)
        owner, term = pairs >> 32, pairs & 0xFFFFFFFF
        code = term * 0x9E3779B1 & 0xFFFFFFFF
        value = np.sqrt(times) * self.idf[term % len(self.idf)] * np.where(code & 1, 1, -1)
        rows = np.bincount(owner * WIDTH + (code >> 8) % WIDTH, value, minlength=n * WIDTH).reshape(n, WIDTH).astype(np.float32)
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    def __call__(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return (self.vectors(terms, offsets) @ self.centres.T).argmax(axis=1).astype(np.int32)

    def shards(self, counts: np.ndarray, shard_items: int) -> list[tuple[int, int]]:
        """The first shard of each cluster and how many it is split over. Clusters follow one another by
        likeness, the next is the one most like the last, and share a shard while there is room."""
        left = set(np.flatnonzero(counts).tolist())
        out = [(0, 1)] * len(counts)
        shard, used, last = 0, 0, None
        while left:
            names = np.array(sorted(left))
            k = int(names[0] if last is None else names[(self.centres[names] @ self.centres[last]).argmax()])
            left.remove(k)
            last, n = k, int(counts[k])
            if used and used + n > shard_items:
                shard, used = shard + 1, 0
            parts = max(1, -(-n // shard_items))
            out[k] = (shard, parts)
            if parts > 1:
                shard, used = shard + parts, 0
            else:
                used += n
        return out


def _assign(clusters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                lists = part.column("terms")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                own = clusters.value(lists.flatten().to_numpy().astype(np.int64), offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own)], [*part.schema.names, "cluster"])

    return run


#: Rows whose vectors are made at once.
SLICE_ROWS = 1024


def shard_items_by_words(items: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The items with their ``shard``, by clusters fitted on about ``SAMPLE_ITEMS`` of them. What the driver gets is the
    sample and a count for each cluster."""
    total = items.count()
    shards = -(-total // shard_items)
    if shards <= 1:
        return items.withColumn("shard", F.lit(0))
    of_all = 1 << 30
    share = min(of_all, of_all * SAMPLE_ITEMS // total)
    sample = items.where(F.expr(f"pmod(xxhash64(__key, piece, salt), {of_all}) < {share}")).select("terms").toArrow()
    lists = sorted(sample.column("terms").to_pylist())
    count = min(MOST_CLUSTERS, CLUSTERS_PER_SHARD * shards, max(1, len(lists)))
    if not lists:
        return items.withColumn("shard", F.expr(f"int(pmod(xxhash64(__key, piece, salt), {shards}))"))
    clusters = Clusters([np.array(x, np.int64) for x in lists], count)
    shared = items.sparkSession.sparkContext.broadcast(clusters)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    own = items.mapInArrow(_assign(shared), f"{schema}, cluster int")
    counts = np.zeros(count, np.int64)
    for row in own.groupBy("cluster").count().collect():
        counts[row["cluster"]] = row["count"]
    places = clusters.shards(counts, shard_items)
    firsts, parts = (F.array(*(F.lit(p[k]) for p in places)) for k in (0, 1))
    salt = F.expr("xxhash64(__key, piece, salt)")
    return own.withColumn("shard", (firsts[F.col("cluster")] + F.pmod(salt, parts[F.col("cluster")])).cast("int")).drop("cluster")


def _pack(capacity: int, fields: list[str]):
    def run(key: tuple[pa.Scalar, ...], shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks().sort_by([("n_tokens", "descending"), ("__key", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        sizes = shard.column("n_tokens").to_numpy().astype(np.int64)
        lists = shard.column("terms").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        container, place = fill(sizes, lists.flatten().to_numpy().astype(np.int64), offsets, capacity)
        order = np.lexsort((place, container))
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.concatenate([[True], np.diff(container[order]) > 0]) if len(order) else np.zeros(0, bool)
        offset = np.empty(len(order), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        name = key[0].as_py()
        return pa.table(
            {
                "__key": shard.column("__key"),
                "piece": shard.column("piece"),
                "start_token": shard.column("start_token"),
                "n_tokens": shard.column("n_tokens"),
                "container": pa.array([f"shard-{name}-{c}" for c in container.tolist()], pa.string()),
                "place": pa.array(place),
                "offset": pa.array(offset.astype(np.int32)),
            }
        ).select(fields)

    return run


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    shard_items: int = SHARD_ITEMS,
    path: str | None = None,
) -> DataFrame:
    """A container for every document: ``key``, piece, start_token, n_tokens, container, place, offset.

    Every row of ``docs`` is placed, one row a piece: a document of at most ``capacity`` tokens has
    piece 0 only, a larger one has pieces of ``capacity`` tokens and a rest. Null and empty texts have
    size 0 and take a place without room. The items are encoded once and kept in the checkpoint folder, so the
    work that follows sees the same rows in the same shards whatever executors are lost. No container holds more than ``capacity`` tokens; places of a
    container count from 0 without gaps. Ties in size go by key and piece. Repeated rows are placed each
    time. An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    encoded = encode_corpus(docs.select(F.col(key).alias("__key"), F.col(text).alias("text")), "__key", "text", "ids", path)
    items = durable(encoded.mapInArrow(
        _items(capacity),
        f"__key {kind}, piece int, start_token int, n_tokens int, full boolean, salt bigint, terms array<int>",
    ).withColumn("salt", F.expr("shiftleft(bigint(spark_partition_id()), 40) + salt")))
    fields = ["__key", "piece", "start_token", "n_tokens", "container", "place", "offset"]
    whole = items.where("full").selectExpr(
        "__key", "piece", "start_token", "n_tokens",
        "concat('full-', coalesce(cast(__key as string), ''), '-', salt, '-', piece) as container", "0 as place", "0 as offset",
    )
    packed = shard_items_by_words(items.where("not full"), shard_items).groupBy("shard").applyInArrow(
        _pack(capacity, fields),
        f"__key {kind}, piece int, start_token int, n_tokens int, container string, place int, offset int",
    )
    return whole.unionByName(packed).withColumnRenamed("__key", key)
