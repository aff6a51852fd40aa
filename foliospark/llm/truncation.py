"""Texts that stop before their end.

A backward character n-gram model, counted over every text of the corpus, gives for the last characters
of a text how often they are followed by an end (a stop, the end of a block, the end of a value) and how
often the text goes on. Contexts of several lengths are interpolated, the longest last. A text is cut if
the log-odds of going on pass a threshold set for its language and column, which parts the corpus's own
ends from the same texts cut on purpose. Counts are keyed by the contexts' 64-bit hashes, so none is lost to
another however large the corpus; only contexts at which some text ends are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import residue
from .grams import Spans, fold, slices, span
from .language import language

ORDERS = (5, 10, 16, 24)
#: Characters by which the beginning of a sentence or line is known, the longest last, and what marks such contexts.
HEADS, HEAD_MARK = (8, 12), 100
#: The contexts of a value, in order.
SLOTS = (*(f"c{n}" for n in ORDERS), *(f"h{n}" for n in HEADS))
#: A whole line that stands so often elsewhere is complete.
OFTEN = 10
#: The set of wanted contexts has so many bits for each, and 2 to these powers in all; a fuller set only lets more through.
BITS_EACH, LEAST_BITS, MOST_BITS = 12, 16, 28
#: Weight of the shorter contexts' estimate, in sightings.
SHRINK = 2.0
#: Before any sighting: the share of ends without and with a stop before them, and of beginnings without a stop at their end.
PRIOR_END, PRIOR_STOPPED, PRIOR_OPEN = 0.05, 0.9, 0.2
#: Bound of the log-odds that a beginning gives.
HEAD_WEIGHT = 4.0
#: Characters that a cut made on purpose leaves at least; every longer value is cut so once.
LEAST_CUT = 20
#: Weight of a column's ends in the threshold of one of its languages, and of all columns' in a column's, in values.
POOLED = 300
#: Steps of the odds for thresholds, their width and their first.
STEPS, STEP, FIRST = 601, 0.1, -20.0

# Marks put after a cut, longest first.
MARKS = ("[truncated]", "(truncated)", "[continued]", "(continued)", "[...]", "(...)", "[…]", "(…)", "....", "...", "…", "[cut]", "(more)", "read more", "-->", "->", ">>")


def strip_mark(text: str) -> tuple[str, bool]:
    """The text without trailing white space and marks of a cut, and whether there was such a mark."""
    text, marked = text.rstrip(), False
    again = True
    while again:
        again = False
        end = text[-16:].lower()
        for mark in MARKS:
            if end.endswith(mark):
                text, marked, again = text[: -len(mark)].rstrip(), True, True
                break
    return text, marked


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each number and each run of white space as one character: "0", and a blank, or a newline
    where a line ends that isn't followed by a small letter."""
    n = len(data)
    if not n:
        return data, offsets
    plain = fold(data)
    white = (plain == 32) | (data == 10)
    digit = plain == 48
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    keep = np.ones(n, bool)
    keep[1:] = ~((white[1:] & white[:-1]) | (digit[1:] & digit[:-1]))
    keep |= first
    solid = np.append(~white | first, True)
    following = np.minimum.accumulate(np.where(solid, np.arange(n + 1), n)[::-1])[::-1]  # at or after
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    run = np.flatnonzero(keep & white)
    end = following[run + 1]
    lines = breaks[end] - breaks[run]
    next_byte = np.append(data, 10)[end]
    small = (next_byte >= 97) & (next_byte <= 122)
    plain[run] = np.where((lines > 1) | ((lines == 1) & ~small), 10, 32)
    return plain[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_CLOSERS = np.zeros(256, bool)
_CLOSERS[list(b"\"')]")] = True


class Contexts:
    """Normalised texts, where they may end, and hashes of the contexts that end before each byte."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = data, offsets = normalise(*span(texts))
        n = len(data)
        self.spans = Spans(data)
        self.row_start = np.repeat(offsets[:-1], np.diff(offsets))
        follow = np.append(data[1:], np.uint8(10)) if n else data
        follow[offsets[1:][np.diff(offsets) > 0] - 1] = 10  # the next text doesn't follow
        stop = ((data == 46) | (data == 33) | (data == 63)) & ~_ALNUM[follow]
        wide = np.zeros(n, bool)
        if n > 2:  # the ideographic full stop, question and exclamation marks
            a, b, c = data[:-2], data[1:-1], data[2:]
            wide[:-2] = ((a == 0xE3) & (b == 0x80) & (c == 0x82)) | ((a == 0xEF) & (b == 0xBC) & ((c == 0x9F) | (c == 0x81)))
        #: Positions just after a stop, perhaps with closing brackets and quotes.
        self.after = np.zeros(n + 1, bool)
        self.after[1:] = stop
        if n > 2:
            self.after[3:] |= wide[:-2]
            self.after[2:] |= self.after[1:-1] & _CLOSERS[data[1:]]
        #: Whether a text may end before each byte.
        self.end = stop | wide | self.after[:-1] | (data == 10)

    def hash(self, ends: np.ndarray, order: int, starts: np.ndarray) -> np.ndarray:
        """Hash of the context of ``order`` bytes before each of ``ends``, cut at the text's start; even, and never 0."""
        low = np.maximum(ends - order, starts)
        code = self.spans(low, ends)
        code = (code ^ (code >> np.uint64(29)) ^ np.uint64(order * 0x51ED27)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((code ^ (code >> np.uint64(32))) << np.uint64(1)) | (np.uint64(1) << np.uint64(63))

    def tails(self, order: int) -> np.ndarray:
        return self.hash(self.offsets[1:], order, self.offsets[:-1])

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each sentence or line."""
        n = len(self.data)
        begin = np.zeros(n + 1, bool)
        begin[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        if n:
            begin[1:] |= (self.data == 10) | ((self.data == 32) & self.after[:-1])
        starts = np.flatnonzero(begin[:n])
        rows = np.searchsorted(self.offsets, starts, side="right") - 1
        ends = np.minimum(np.append(starts[1:], n), self.offsets[rows + 1])
        white = (self.data[np.maximum(ends - 1, 0)] == 32) | (self.data[np.maximum(ends - 1, 0)] == 10) if n else np.zeros(0, bool)
        return starts, np.where(white & (ends - 1 > starts), ends - 1, ends), rows

    def heads(self, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
        """Hash of the beginning of each segment."""
        return self.hash(np.minimum(starts + size, ends), HEAD_MARK + size, starts)

    def last_heads(self, whole: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for each text's last segment, and whether that is a whole line; hash 0 where the text
        isn't whole and the segment's beginning is out of sight."""
        code = np.zeros(len(self.offsets) - 1, np.uint64)
        short = np.zeros(len(self.offsets) - 1, bool)
        starts, ends, rows = self.segments()
        if len(starts):
            last = np.append(rows[1:] != rows[:-1], True)
            seen = last & ((starts > self.offsets[rows]) | whole[rows])
            code[rows[seen]] = self.heads(starts[seen], ends[seen], size)
            line = (starts == self.offsets[rows]) | (self.data[np.maximum(starts - 1, 0)] == 10)
            short[rows[seen]] = (line & (ends - starts < size))[seen]
        return code, short


#: Characters of a text by which its end is judged.
TAIL = 256


class Tails:
    """The ends of texts without marks of a cut."""

    def __init__(self, texts: list[str | None]):
        pairs = [strip_mark((t or "")[-2 * TAIL :]) for t in texts]
        self.texts = [t[-TAIL:] for t, _ in pairs]
        self.marked = np.array([m for _, m in pairs], bool)
        self.whole = np.array([len(t or "") < TAIL for t in texts], bool)
        self.contexts = Contexts(pa.array(self.texts, pa.string()))
        self.filled = np.diff(self.contexts.offsets) > 0
        self.stopped = self.contexts.after[self.contexts.offsets[1:]]

    def slots(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The hashes of the contexts of each value, one array a slot, and whether its last segment is a short whole line."""
        heads = [self.contexts.last_heads(self.whole, size) for size in HEADS]
        return [*(self.contexts.tails(order) for order in ORDERS), *(code for code, _ in heads)], heads[-1][1]


class Wanted:
    """A set of hashes as bits; the order of a context is part of its hash, so one set serves all."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        at = (code >> np.uint64(7)) & self.mask
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def wanted_set(codes: DataFrame) -> np.ndarray:
    """The words of the set of the distinct ``code``; the driver gets its pages, at most 2 ** ``MOST_BITS`` bits."""
    count = codes.agg(F.approx_count_distinct("code")).first()[0]
    bits = int(np.clip(np.ceil(np.log2(max(1, BITS_EACH * count))), LEAST_BITS, MOST_BITS))
    page = 1 << 14
    at = F.expr(f"shiftrightunsigned(code, 7) & {(1 << bits) - 1}L").alias("at")
    words = codes.select(at).groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            word, value = batch.column("word").to_numpy(), batch.column("bits").to_numpy()
            for number in np.unique(word // page).tolist():
                inside = word // page == number
                np.bitwise_or.at(pages.setdefault(number, np.zeros(page, np.int64)), word[inside] % page, value[inside])
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int32()), pa.array([x.tobytes() for x in pages.values()], pa.binary())], ["page", "words"])

    spread = words.repartition(max(1, (1 << bits) // (64 * page) // 64), F.expr(f"word div {page}"))
    table = np.zeros(max(page, (1 << bits) // 64), np.uint64)
    for number, data in spread.mapInArrow(pack, "page int, words binary").collect():
        table[number * page : (number + 1) * page] = np.frombuffer(data, np.uint64)
    return table[: (1 << bits) // 64]


class Counter:
    """Sightings of hashes, each with a flag in its lowest bit, summed within a task."""

    MOST = 4_000_000

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, code: np.ndarray, flag: np.ndarray) -> None:
        key, n = np.unique(code | flag.astype(np.uint64), return_counts=True)
        self.parts.append((key, n))
        self.size += len(key)
        if self.size > self.MOST:
            self._merge()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            key, back = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            self.parts = [(key, np.bincount(back, np.concatenate([n for _, n in self.parts])).astype(np.int64))]
            self.size = len(key)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The sums as rows if there are too many to keep."""
        if self.size > self.MOST:
            yield self.batch()
            self.parts, self.size = [], 0

    def batch(self) -> pa.RecordBatch:
        key, n = self.rows()
        plain = (key & ~np.uint64(1)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(plain), pa.array(n.astype(np.int64)), pa.array(np.where(key & np.uint64(1), n, 0).astype(np.int64))], ["code", "every", "ends"])


def count_ends(values: DataFrame, words: np.ndarray) -> DataFrame:
    """Over all texts, of each context whose hash is in the set, how often it occurs and how often an end
    follows (``every``, ``ends``); of each beginning, how often it occurs and how often what begins so has no
    stop at its end. Tasks sum their own, so a frequent context is a row a task."""
    shared = values.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counter = Wanted(shared.value), Counter()
        for part in slices(batches, "__text"):
            contexts = Contexts(part.column("__text"))
            offsets = contexts.offsets
            at = np.arange(len(contexts.data))
            started = at > contexts.row_start  # a text's first character has no context
            at, end, start = at[started], contexts.end[started], contexts.row_start[started]
            filled = np.flatnonzero(np.diff(offsets) > 0)
            at = np.concatenate([at, offsets[1:][filled]])
            start = np.concatenate([start, offsets[:-1][filled]])
            end = np.concatenate([end, np.ones(len(filled), bool)])
            for order in ORDERS:
                code = contexts.hash(at, order, start)
                hit = np.flatnonzero(wanted(code))
                at, end, start = at[hit], end[hit], start[hit]  # a longer context ends in a shorter one that is wanted too
                counter.add(code[hit], end)
            starts, ends, _ = contexts.segments()
            for size in HEADS:
                code = contexts.heads(starts, ends, size)
                hit = wanted(code)
                counter.add(code[hit], ~contexts.after[ends[hit]])
            yield from counter.flush()
        yield counter.batch()

    counted = values.select("__text").where("__text is not null").mapInArrow(run, "code bigint, every bigint, ends bigint")
    return counted.groupBy("code").agg(F.sum("every").alias("every"), F.sum("ends").alias("ends"))


def end_odds() -> Column:
    """Log-odds that a text goes on, from its slots' counts (``e_`` and ``n_``); its own end isn't counted as one."""
    stopped, own = F.col("stopped"), F.when(F.col("synthetic"), 0).otherwise(1)
    p = F.when(stopped, PRIOR_STOPPED).otherwise(PRIOR_END)
    q = F.lit(PRIOR_OPEN)
    for slot in SLOTS:
        head = slot.startswith("h")
        every = F.greatest(F.coalesce(F.col(f"e_{slot}"), F.lit(0)) - 1, F.lit(0))
        mine = F.when(stopped, 0).otherwise(own) if head else own
        ends = F.least(F.greatest(F.coalesce(F.col(f"n_{slot}"), F.lit(0)) - mine, F.lit(0)), every)
        if head:
            q = (ends + SHRINK * q) / (every + SHRINK)
        else:
            p = (ends + SHRINK * p) / (every + SHRINK)
    bounded = F.greatest(F.least(F.ln((1 - q) / q), F.lit(HEAD_WEIGHT)), F.lit(-HEAD_WEIGHT))
    odds = F.ln((1 - p) / p) + F.when(stopped, 0.0).otherwise(bounded)
    often = F.col("short") & (F.coalesce(F.col(f"e_{SLOTS[-1]}"), F.lit(0)) > OFTEN) & (q > 0.8)
    return F.when(often, F.least(odds, F.lit(-1.0))).otherwise(odds)


def threshold(ends: np.ndarray, cuts: np.ndarray) -> float:
    """The odds from which on a text is cut, from histograms of the odds at the values' ends and at cuts made on purpose.

    The ends are a mixture of cuts and of complete texts. Few complete ones lie above the median of the
    cuts, so the ends there tell the share of cuts; with it, the threshold makes the fewest errors of both
    kinds: with shares E and C below it and a share s of cuts, it minimises 2 s C - E.
    """
    if not ends.sum() or not cuts.sum():
        return float("inf")
    e, c = np.cumsum(ends) / ends.sum(), np.cumsum(cuts) / cuts.sum()
    middle = int(np.searchsorted(c, 0.5))
    share = min(1.0, (1 - e[middle]) / max(1 - c[middle], 1e-9))
    return FIRST + STEP * (int((2 * share * c - e).argmin()) + 0.5)


def _limits(judged: DataFrame) -> dict[tuple[str, str], float]:
    """A threshold for each column and language, from histograms of the odds. The cuts made on purpose are those of
    the whole column; small groups lean on their column, small columns on all."""
    step = F.expr(f"int(round((greatest(least(log_odds, {FIRST + STEP * (STEPS - 1)}), {FIRST}) - {FIRST}) / {STEP}))")
    rows = judged.where("eligible and not marked").groupBy("origin", "language", "synthetic", step.alias("step")).count().collect()
    groups: dict[tuple[str, str], np.ndarray] = {}
    columns: dict[str, np.ndarray] = {}
    every = np.zeros((2, STEPS))
    for r in rows:
        own = groups.setdefault((r["origin"], r["language"]), np.zeros((2, STEPS)))
        for table in (own, columns.setdefault(r["origin"], np.zeros((2, STEPS))), every):
            table[int(r["synthetic"]), r["step"]] += r["count"]
    share = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1)
    pools = {name: share(own + POOLED * share(every)) for name, own in columns.items()}
    return {(origin, name): threshold(own[0] + POOLED * pools[origin][0], pools[origin][1]) for (origin, name), own in groups.items()}


def judge_ends(evidence: DataFrame, reads: DataFrame) -> DataFrame:
    """Every excerpt and read text with the odds that it was cut: origin, doc_id, item_id, feed_id,
    log_odds, cut.

    Null, empty and blank texts aren't cut; nor are reads that are residue as a whole. Repeated rows are
    judged each time and alike. A mark of a cut decides where the odds are in doubt. Each value is also cut
    on purpose, at a place given by its key's hash, so the thresholds are of all values.
    """
    context = evidence.sparkSession.sparkContext
    of_residue = context.broadcast(residue.fit(reads))
    keys = ["origin", "doc_id", "item_id", "feed_id"]
    left = evidence.select(F.lit("evidence").alias("origin"), "doc_id", F.col("id").alias("item_id"), "feed_id", F.col("excerpt").alias("__text"))
    right = reads.select(F.lit("reads").alias("origin"), "doc_id", F.col("read_id").cast("string").alias("item_id"), "feed_id", F.col("text").alias("__text"))

    def run(column: str):
        def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "__text"):
                texts = part.column("__text").to_pylist()
                bad = of_residue.value.residue(part.column("__text")) if column == "reads" else np.zeros(len(texts), bool)
                pick = part.column("__pick").to_pylist()
                cut = [i for i, t in enumerate(texts) if len(t or "") > LEAST_CUT and not bad[i]]
                shorter = [texts[i][: LEAST_CUT + (pick[i] >> 20) % (len(texts[i]) - LEAST_CUT)] for i in cut]
                tails = Tails(texts + shorter)
                codes, short = tails.slots()
                at = pa.array([*range(len(texts)), *cut], pa.int32())
                synthetic = np.arange(len(at)) >= len(texts)
                own = pa.array([*range(len(texts)), *[None] * len(cut)], pa.int32())  # cuts have no key
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("origin").take(at), *(part.column(k).take(own) for k in keys[1:]), *(pa.array(c.view(np.int64)) for c in codes), pa.array(short), pa.array(tails.stopped),
                        pa.array([language(t) for t in tails.texts]), pa.array(tails.marked & ~synthetic),
                        pa.array(tails.filled & ~bad[at.to_numpy()]), pa.array(synthetic),
                    ],
                    [*keys, *SLOTS, "short", "stopped", "language", "marked", "eligible", "synthetic"],
                )

        return inner

    schema = "origin string, doc_id string, item_id string, feed_id string, " + "".join(f"{x} bigint, " for x in SLOTS) + (
        "short boolean, stopped boolean, language string, marked boolean, eligible boolean, synthetic boolean"
    )
    picked = lambda t: t.withColumn("__pick", F.expr("xxhash64(doc_id, item_id) & 9223372036854775807"))
    ends = durable(picked(left).mapInArrow(run("evidence"), schema).unionByName(picked(right).mapInArrow(run("reads"), schema)))
    ends = ends.withColumn("profile", F.xxhash64(*SLOTS))
    # equal ends meet the counts once
    profiles = ends.where("eligible").select("profile", F.explode(F.array(*(F.struct(F.lit(x).alias("slot"), F.col(x).alias("code")) for x in SLOTS))).alias("s")).select("profile", "s.*").where("code <> 0").distinct()
    counts = count_ends(left.select("__text").unionByName(right.select("__text")), wanted_set(profiles.select("code")))
    met = profiles.join(counts, "code").groupBy("profile").agg(
        *(F.max(F.when(F.col("slot") == x, F.col(c))).alias(f"{c[0] if c == 'every' else 'n'}_{x}") for x in SLOTS for c in ("every", "ends"))
    )
    judged = durable(ends.join(met, "profile", "left").select(*keys, "language", "marked", "eligible", "synthetic", end_odds().alias("log_odds")))
    limit = F.lit(float("inf"))
    for (origin, name), value in _limits(judged).items():
        limit = F.when((F.col("origin") == origin) & (F.col("language") == name), value).otherwise(limit)
    cut = F.col("eligible") & (F.col("log_odds") > F.when(F.col("marked"), F.least(limit, F.lit(0.0))).otherwise(limit))
    return judged.where("not synthetic").select(*keys, "log_odds", cut.alias("cut"))


def cut_by_feed(judged: DataFrame) -> DataFrame:
    """For each feed and origin, how many values there are, how many are cut, and the share. Keys that
    were delivered again count once."""
    once = judged.groupBy("feed_id", "origin", "doc_id", "item_id").agg(F.max("cut").alias("cut"))
    return once.groupBy("feed_id", "origin").agg(
        F.count("*").alias("n"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share_cut")
    )
