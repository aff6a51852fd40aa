"""Texts that are template residue, filler, error or access pages in place of a paper.

Character n-gram models of residue, of page furniture and of natural text give each window of a text the
likelihood of each kind. Windows of residue and of natural text are weighed by their coverage: a text is
residue if it has residue and hardly any natural text; furniture counts for neither, so a page that
carries a notice next to a paper stays.

All three models are learned from the corpus. Natural text is the prose of texts, furniture their short
lines, and those of texts with a body tell most. Residue is what stands where no body is: lines that occur, but for their numbers, in
several unrelated papers and mostly in reads without natural text, and then what else the texts hold that
these lines give away. A few wordings of a general kind start it off in small corpora.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .grams import Spans, fold, hashes, line_starts, slices, span, totals

ORDER = 4
BITS = 18
#: Bits of each kind's weight in a sum; a window's weights stay below.
FIELD = 21
WINDOW_BYTES = 160
#: Share of residue among residue and natural text from which on a text is residue.
COVERAGE = 0.5
#: Lines of so many bytes are prose, shorter ones may be headings and furniture.
PROSE_BYTES = 45
#: Texts with so many bytes of prose have a body, from which natural text and furniture are learned; others count so much.
BODY_BYTES, BODILESS = 1_600, 0.05
#: Texts that a task remembers to have counted.
MOST_SEEN = 1_000_000
#: Texts with less natural text than this may be residue, and are looked through for wordings that repeat.
BARE_BYTES = 300
#: A line of residue occurs in so many papers, and so many times as often in reads without natural text as in others.
PAPERS, EXCESS = 3, 2
#: Rounds in which what the texts found hold is learned as well.
ROUNDS = 2
#: Longest word of a window that is one word again and again, with what parts it from the next.
LONGEST_PERIOD = 16

# Residue of a general kind, known without any corpus: the usual filler, placeholders of common template
# languages, editors and forms, status codes and messages of common software, and requests for scripts or a login.
SEEDS = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae. Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
Integer tellus urna, porta semper quam sagittis. Nulla porttitor massa, arcus nunc tellus semper.
{{ name }} {{name}} {{ user.name }} ${name} #{name} %NAME% [NAME] [YOUR NAME] <name> [[name]] @@NAME@@ {name} <%= name %> {% if name %} {% endif %} {% block name %} {% include name %}
Dear {name}, Dear [Name], Sincerely, {{name}}, the [COMPANY] team. Thank you for your order {{ order.id }}.
Title: [Insert title here] Author: [Insert author here] Abstract: {{ abstract }} Date: [DATE] Name: ________ Date: ........ Address: (to be filled in) Signature: N/A Notes: TBD TODO
Click here to add a subtitle. Enter text here. Placeholder text. Replace this text with your own text. Type your abstract here. Insert figure here. Figure caption here. Delete these instructions. Sample text. Untitled. Your title here. Paragraph 1. Heading 1. Item 1.
400 Bad Request
401 Unauthorized
403 Forbidden
404 Not Found
410 Gone
429 Too Many Requests
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
This page could not be found. The requested page does not exist or was moved. The server encountered an error and could not complete your request. The server did not respond in time. Something went wrong. Contact the administrator. Go back to the home page.
Access denied. You do not have permission to access this page. Please log in to continue. Your session timed out. Please sign in again. Please try again later. No results found. Coming soon. Under construction. This content is not available. This item was withdrawn. This domain is for sale. Inquire about this domain.
Please enable JavaScript to view this page. JavaScript is disabled in your browser. This site requires scripts and cookies. Please turn on JavaScript and reload the page. Checking your browser before you go on to the site. This may take some seconds. Please verify that you are a human. Loading, please wait.
Seite nicht gefunden. JavaScript muss im Browser aktiviert sein. Page introuvable. Vous devez activer JavaScript dans votre navigateur. No encontrada. Debe habilitar JavaScript en su navegador. Pagina non trovata. Attivare JavaScript nel browser.
Traceback (most recent call last):
File "/usr/lib/app/main.py", line 10, in run
RuntimeError: unexpected error. KeyError: 'id'. ValueError: invalid value. TypeError: object is not callable. TimeoutError: timed out. TemplateSyntaxError: unexpected tag. Exception in thread "main" java.lang.NullPointerException
SQLSTATE[42000]: Syntax error in query. ERROR: relation "users" does not exist. Warning: include(header.php): failed to open stream: No such file. Fatal error: Allowed memory size of 1024 bytes exhausted. Uncaught exception.
{"error": {"code": 500, "message": "internal error"}} {"status": "error", "detail": "timed out"} <Error><Code>NoSuchKey</Code><Message>The specified key does not exist.</Message><RequestId>1</RequestId></Error>
"""
KINDS = ("natural", "residue", "furniture")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def seed_counts(seeds: str = SEEDS) -> np.ndarray:
    data = fold(np.frombuffer("\n".join(x.strip() for x in seeds.strip().splitlines()).encode(), np.uint8))
    return np.bincount(hashes(data, ORDER, BITS), minlength=1 << BITS).astype(np.float64)


class Model:
    """Log-probability of each n-gram bucket under each kind, from the counts of the buckets in texts of each kind."""

    def __init__(self, natural: np.ndarray, residue: np.ndarray, furniture: np.ndarray):
        counts = np.stack([natural, residue, furniture], axis=1) + 0.02
        seen = (counts >= 1).any(axis=1, keepdims=True)
        table = np.log(counts / counts.sum(axis=0))
        table[:, np.array([natural.sum(), residue.sum(), furniture.sum()]) < 1] = -50.0  # a kind of which nothing is known
        # one n-gram alone decides nothing: its weight is bounded, and one never seen has none
        table = np.where(seen, np.maximum(table - table.max(axis=1, keepdims=True), -4.0), 0.0)
        # the three weights in 1/256 as parts of one integer, so that a window's are summed at once
        steps = np.round(-256 * table).astype(np.uint64)
        self.table = steps[:, 0] | steps[:, 1] << np.uint64(FIELD) | steps[:, 2] << np.uint64(2 * FIELD)

    def weights(self, total: np.ndarray) -> np.ndarray:
        """The log-likelihoods that are parts of sums of the table."""
        part = np.uint64((1 << FIELD) - 1)
        return np.stack([(total >> np.uint64(k * FIELD)) & part for k in range(3)], axis=-1).astype(np.int64) / -256

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, size, row and kind (index of KINDS, or -1 if nothing is known) of each window of the texts."""
        starts, ends, rows = line_starts(data, offsets)
        filled = ends > starts
        starts, ends, rows = starts[filled], ends[filled], rows[filled]
        parts = -(-(ends - starts) // WINDOW_BYTES)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(starts, parts) + nth * WINDOW_BYTES
        end = np.minimum(begin + WINDOW_BYTES, np.repeat(ends, parts))
        plain = fold(data)
        code = hashes(plain, ORDER, BITS)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[code], out=total[1:])
        scores = self.weights(total[np.maximum(begin, end - 1)] - total[begin])
        kind = scores.argmax(axis=1)
        kind[scores.max(axis=1) - scores.min(axis=1) < 2.0] = -1
        kind[repeated(data, code, begin, end)] = 1
        return begin, end - begin, np.repeat(rows, parts), kind

    def weigh(self, data: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
        """The windows, and the bytes of residue and of natural text of each text."""
        found = self.windows(data, offsets)
        _, size, row, kind = found
        count = len(offsets) - 1
        return found, np.bincount(row[kind == 1], size[kind == 1], minlength=count), np.bincount(row[kind == 0], size[kind == 0], minlength=count)

    def residue(self, texts: pa.Array) -> np.ndarray:
        """Whether each text is residue; never for nulls and empty texts."""
        _, bad, good = self.weigh(*span(texts))
        return (bad > 0) & (bad >= COVERAGE * (bad + good))


def repeated(data: np.ndarray, code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each window is one short word again and again: it equals itself some bytes further on.
    ``code`` has the buckets of the n-grams; windows whose first comes again soon are looked at byte by byte."""
    out = np.zeros(len(begin), bool)
    for period in range(3, LONGEST_PERIOD + 1):
        long = np.flatnonzero(end - begin >= 4 * period)
        again = long[code[begin[long]] == code[begin[long] + period]]
        for i in again.tolist():
            window = data[begin[i] : end[i]]
            window = np.where((window >= 65) & (window <= 90), window + np.uint8(32), window)
            if (window[period:] == window[:-period]).mean() >= 0.95 and _LETTER[window].mean() >= 0.5:
                out[i] = True
    return out


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of the prose and of the short lines of a task's texts, those without a body at a lower weight.
    Equal texts count once a task."""
    counts = np.zeros((2, 1 << BITS))
    done: set[int] = set()
    for part in slices(batches, "__text"):
        codes = part.column("__code").to_pylist()
        fresh = [i for i, c in enumerate(codes) if c not in done and not done.add(c)]
        if len(done) > MOST_SEEN:
            done.clear()
        data, offsets = span(part.column("__text").take(pa.array(fresh, pa.int32())))
        starts, ends, rows = line_starts(data, offsets)
        size = ends - starts
        prose = size >= PROSE_BYTES
        body = np.bincount(rows[prose], size[prose], minlength=len(offsets) - 1) >= BODY_BYTES
        kind = np.where(prose, 1, 2) + np.where(body[rows], 0, 2)
        # each byte has its line's kind; line breaks between them have none
        step = np.zeros(len(data) + 1, np.int8)
        np.add.at(step, starts, kind.astype(np.int8))
        np.subtract.at(step, ends, kind.astype(np.int8))
        of = np.cumsum(step[:-1], dtype=np.int8)
        code = hashes(fold(data), ORDER, BITS)
        for k in (1, 2, 3, 4):
            counts[(k - 1) % 2] += np.bincount(code[of == k], minlength=1 << BITS) * (1.0 if k < 3 else BODILESS)
    seen = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0, seen]), pa.array(counts[1, seen])], ["bucket", "natural", "furniture"])


def _line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line but for its numbers and outer blanks."""
    plain = fold(data)
    keep = np.ones(len(data), bool)
    keep[1:] = ~((plain[1:] == 48) & (plain[:-1] == 48)) & ~((plain[1:] == 32) & (plain[:-1] == 32))
    place = np.concatenate([[0], np.cumsum(keep)])
    code = Spans(plain[keep])(place[starts], place[ends])
    return ((code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _bare(model):
    """The texts of a task without natural text, whole; and of its other texts, how often they hold each line that isn't natural."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["line", "n", "of", "text"]
        for part in slices(batches, "__text"):
            data, offsets = span(part.column("__text"))
            (begin, _, row, kind), _, good = model.value.weigh(data, offsets)
            bare = np.flatnonzero((good < BARE_BYTES) & (np.diff(offsets) > 0))
            starts, ends, rows = line_starts(data, offsets)
            other = (ends > starts) & (good[rows] >= BARE_BYTES)
            starts, ends = starts[other], ends[other]
            first = kind[np.searchsorted(begin, starts)] != 0 if len(starts) else np.zeros(0, bool)
            line, n = np.unique(_line_keys(data, starts[first], ends[first]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(len(bare), np.int64), line])), pa.array(np.concatenate([np.zeros(len(bare), np.int64), n])),
                    pa.concat_arrays([part.column("__of").take(pa.array(bare)), pa.nulls(len(line), pa.int64())]),
                    pa.concat_arrays([part.column("__text").take(pa.array(bare)).cast(pa.string()), pa.nulls(len(line), pa.string())]),
                ],
                names,
            )

    return run


def _bare_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of the texts without natural text."""
    for part in slices(batches, "text"):
        data, offsets = span(part.column("text"))
        starts, ends, rows = line_starts(data, offsets)
        filled = ends > starts
        starts, ends, rows = starts[filled], ends[filled], rows[filled]
        whole = data.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(_line_keys(data, starts, ends)), part.column("of").take(pa.array(rows)),
             pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())], pa.string())],
            ["line", "of", "text"],
        )


def _residue_grams(model):
    """Bucket counts of a task's texts of residue, less their furniture and natural text; without a model, of all it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int64)
        for part in slices(batches, "text"):
            data, offsets = span(part.column("text"))
            code = hashes(fold(data), ORDER, BITS)
            if model is None:
                counts += np.bincount(code, minlength=1 << BITS)
                continue
            (begin, size, row, kind), bad, good = model.value.weigh(data, offsets)
            flags = (bad > 0) & (bad >= COVERAGE * (bad + good))
            learned = flags[row] & ((kind == 1) | (kind == -1))
            step = np.zeros(len(data) + 1, np.int8)
            step[begin[learned]] += 1
            np.subtract.at(step, begin[learned] + size[learned], 1)
            counts += np.bincount(code[np.cumsum(step[:-1], dtype=np.int8) > 0], minlength=1 << BITS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["bucket", "n"])

    return run


def fit(reads: DataFrame, text: str = "text", doc: str = "doc_id", seeds: str = SEEDS) -> Model:
    """The model for a corpus, counted over all its texts. Lines count once a paper (``doc``; without such a
    column, a text), so attempts and deliveries of one paper don't make a wording common.

    Tasks count into tables of buckets; shuffled are buckets, hashes of lines, and the few texts without
    natural text, which are kept in the checkpoint folder. What comes to the driver and is broadcast is
    bounded by the number of buckets. Without any text nothing is residue.
    """
    context = reads.sparkSession.sparkContext
    of = F.xxhash64(F.coalesce(F.col(doc).cast("string"), F.col(text)) if doc in reads.columns else F.col(text))
    texts = reads.select(of.alias("__of"), F.col(text).alias("__text")).where(F.length("__text") > 0)
    natural, furniture = totals(texts.select("__text", F.xxhash64("__text").alias("__code")).mapInArrow(_bodies, "bucket bigint, natural double, furniture double"), BITS)
    start = 3 * seed_counts(seeds)
    model = Model(natural, start, furniture)
    seen = durable(texts.mapInArrow(_bare(context.broadcast(model)), "line bigint, n bigint, of bigint, text string"))
    bare = seen.where("text is not null").select("of", "text")
    once = bare.mapInArrow(_bare_lines, "line bigint, of bigint, text string").groupBy("line", "of").agg(F.min("text").alias("text"))
    lines = once.select("line", F.lit(1).alias("bare"), F.lit(0).alias("n"), "text").unionByName(
        seen.where("text is null").select("line", F.lit(0).alias("bare"), "n", F.lit(None).cast("string").alias("text"))
    )
    common = lines.groupBy("line").agg(F.sum("bare").alias("bare"), F.sum("n").alias("n"), F.min("text").alias("text")).where(f"bare >= {PAPERS} and bare > {EXCESS} * n")
    learned = 3 * totals(common.select("text").mapInArrow(_residue_grams(None), "bucket bigint, n bigint"), BITS)[0]
    model = Model(natural, start + learned, furniture)
    for _ in range(ROUNDS):
        more = totals(bare.select("text").mapInArrow(_residue_grams(context.broadcast(model)), "bucket bigint, n bigint"), BITS)[0]
        model = Model(natural, start + learned + more, furniture)
    return model


def flag_residue(reads: DataFrame, key: str = "read_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``key`` and ``residue`` BOOLEAN of every row, read once and without a shuffle.

    Null, empty and blank texts aren't residue. Repeated rows are flagged alike; other columns are ignored.
    """
    shared = reads.sparkSession.sparkContext.broadcast(model or fit(reads, text))
    kind = reads.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            flags = shared.value.residue(part.column("__text"))
            yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(flags)], ["__key", "residue"])

    return (
        reads.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
        .mapInArrow(run, f"__key {kind}, residue boolean")
        .withColumnRenamed("__key", key)
    )
