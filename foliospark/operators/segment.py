"""Documents into lines, paragraphs, chunks and sentences with their sections."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def body_lines(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """The lines of each document that belong to its body: doc, page, pos, line, in reading order by page and pos.

    Lines are squeezed and empty ones dropped. The first heading of the back matter ends the document.
    Publisher's notices are dropped anywhere, page numbers among the first and last two lines of a page,
    and lines among the first and last four whose key is at the edges of two or more pages. A null text
    has no lines. Positions come from windows within a page, repeats from one aggregate by document and key.
    """
    lines = (
        pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.posexplode(T.lines(F.replace(F.col(text), F.lit("\0"), F.lit(" ")))).alias("raw", "line"))
        .withColumn("line", T.squeeze(F.col("line")))
        .where(F.length("line") > 0)
    )
    each = Window.partitionBy("doc", "page")
    lines = (
        lines.withColumn("pos", F.row_number().over(each.orderBy("raw")) - 1)
        .withColumn("left", F.count("*").over(each) - 1 - F.col("pos"))
        .withColumn("key", T.edge_key(F.col("line")))
    )
    at_edge = (F.col("pos") < 4) | (F.col("left") < 4)
    repeated = (
        lines.where(at_edge & (F.length("key") >= 3)).groupBy("doc", "key").agg(F.count_distinct("page").alias("n")).where("n >= 2").select("doc", "key")
    )
    stops = lines.where(F.col("line").rlike(T.STOP_HEADING)).groupBy("doc").agg(F.min(F.struct("page", "pos")).alias("stop"))
    marked = lines.join(repeated.withColumn("again", F.lit(True)), ["doc", "key"], "left").join(stops, "doc", "left")
    keep = (
        (F.col("stop").isNull() | (F.struct("page", "pos") < F.col("stop")))
        & ~F.col("line").rlike(T.BOILERPLATE)
        & ~(F.col("line").rlike(T.PAGE_NUMBER) & ((F.col("pos") < 2) | (F.col("left") < 2)))
        & ~(F.coalesce("again", F.lit(False)) & at_edge)
    )
    return marked.where(keep).select(F.col("doc").alias(doc), F.col("page").alias(page), "pos", "line")


def body_text(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """doc and text: the body's lines, those broken at a hyphen before a small letter joined, one a line."""
    kept = body_lines(pages, doc, page, text)
    order = Window.partitionBy(doc).orderBy(page, "pos")
    goes_on = F.lag("line").over(order).endswith("-") & F.col("line").rlike("^[a-z]")
    parts = kept.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn(
        "next_goes_on", F.coalesce(F.lead("line").over(order).rlike("^[a-z]") & F.col("line").endswith("-"), F.lit(False))
    )
    piece = F.concat(F.when(F.col("next_goes_on"), F.regexp_replace("line", "-$", "")).otherwise(F.col("line")), F.when(F.col("next_goes_on"), "").otherwise("\n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "pos", piece.alias("piece")))), lambda p: p["piece"]), "")
    return parts.groupBy(doc).agg(F.trim(F.regexp_replace(whole, r"\n+$", "")).alias("text"))


# What parts paragraphs, what joins a broken word, what becomes a blank.
PARAGRAPH_BREAK = re.compile(r"\n[ \t]*\n+")
BROKEN_WORD = re.compile(r"(?<=\w)-[ \t]*\n[ \t]*(?=\w)")
WRAP = re.compile(r"[ \t\n]+")


def paragraph_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Text, start and end of each paragraph of a text, in the text with its line breaks made alike."""
    source = text.replace("\r\n", "\n").replace("\r", "\n")
    start = 0
    for gap in [*PARAGRAPH_BREAK.finditer(source), None]:
        end = gap.start() if gap else len(source)
        clean = WRAP.sub(" ", BROKEN_WORD.sub("", source[start:end])).strip()
        if clean:
            yield clean, start, end
        start = gap.end() if gap else end


def chunk_spans(text: str, limit: int, overlap: int) -> Iterator[tuple[str, int, int]]:
    """Text, start and end of each chunk of a text."""
    start, size, overlap = 0, len(text), min(overlap, limit // 3)
    while start < size:
        end = min(start + limit, size)
        if end < size and size > limit:
            low = start + limit // 2
            cut = max(text.rfind("\n\n", low, end), text.rfind(". ", low, end))
            if cut > start:
                end = cut + (2 if text.startswith(". ", cut) else 0)
        whole = text if size <= limit else text[start:end].strip()
        if whole.strip():
            yield whole, start, end
        if end >= size:
            return
        start = max(end - overlap, start + 1)


def _spans(docs: DataFrame, doc: str, text: str, cut: Callable[[str], Iterator[tuple[str, int, int]]]) -> DataFrame:
    """doc, index, text, start_char, end_char of the spans of each text, in Arrow batches where the texts lie: a text
    is walked once, whatever its length, and nothing is shuffled."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                rows, nth, found = [], [], ([], [], [])
                for i, value in enumerate(part.column("__text").to_pylist()):
                    for k, span in enumerate(cut(value)):
                        rows.append(i)
                        nth.append(k)
                        for column, x in zip(found, span):
                            column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__doc").take(pa.array(rows, pa.int32())), pa.array(nth, pa.int32()), pa.array(found[0], pa.string()),
                     pa.array(found[1], pa.int32()), pa.array(found[2], pa.int32())],
                    ["__doc", "index", "text", "start_char", "end_char"],
                )

    rows = docs.select(F.col(doc).alias("__doc"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    return rows.mapInArrow(run, f"__doc {kind}, index int, text string, start_char int, end_char int").withColumnRenamed("__doc", doc)


#: Texts whose spans are made into one batch.
SLICE_ROWS = 256


def paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, id, index, text, start_char, end_char: the parts between blank lines, squeezed, words broken at
    a line's end joined. Offsets are those of the whole part in the source; parts without text are dropped.
    Null, empty and blank texts have none; a repeated row has its paragraphs again."""
    return _spans(docs, doc, text, paragraph_spans).select(doc, F.format_string("paragraph-%04d", "index").alias("id"), "index", "text", "start_char", "end_char")


def page_paragraphs(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text", ocr: str | None = None) -> DataFrame:
    """As ``paragraphs``, of the pages of documents, with ``page_number``; numbered across a document's pages.

    A page without text takes that of the column ``ocr`` if it is given. Offsets are those in the page's
    stripped text. A document none of whose pages has text has no rows.
    """
    strip = lambda c: F.regexp_replace(c, f"^{T.BLANKS}+|{T.BLANKS}+$", "")
    own = F.nullif(strip(F.col(text)), F.lit(""))
    shown = F.coalesce(own, strip(F.col(ocr))) if ocr else own
    spans = _spans(pages.select(F.struct(F.col(doc).alias("doc"), F.col(page).alias("page")).alias("__page"), shown.alias("__shown")), "__page", "__shown", paragraph_spans)
    index = F.row_number().over(Window.partitionBy("__page.doc").orderBy("__page.page", "index")) - 1
    return spans.withColumn("index", index).select(
        F.col("__page.doc").alias(doc), F.format_string("paragraph-%04d", "index").alias("id"), "index", F.col("__page.page").alias("page_number"), "text", "start_char", "end_char"
    )


def scan_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, text (the paragraphs, joined by blank lines), n_paragraphs, source_text, error: one row a document. A
    text without a paragraph has an error in place of the text."""
    kind = docs.select(F.col(doc).alias("__doc"), F.col(text).alias("source_text"))
    joined = _spans(docs, doc, text, lambda x: ((y, 0, 0) for y in ["\n\n".join(p for p, _, _ in paragraph_spans(x))] if y)).select(
        F.col(doc).alias("__doc"), "text"
    )
    count = _spans(docs, doc, text, paragraph_spans).groupBy(F.col(doc).alias("__doc")).agg(F.count("*").cast("int").alias("n_paragraphs"))
    return kind.join(joined, "__doc", "left").join(count, "__doc", "left").select(
        F.col("__doc").alias(doc), "text", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), "source_text",
        F.when(F.col("text").isNull(), "The text has no paragraphs").alias("error"),
    )


def chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", limit: int = 4000, overlap: int = 350) -> DataFrame:
    """doc, id, index, text, start_char, end_char: windows of at most ``limit`` characters, each cut at the
    last blank line or sentence end of its second half, the next starting the overlap before. The text is
    stripped, the offsets aren't; a text within the limit is one chunk as it is. Null and blank texts have none."""
    return _spans(docs, doc, text, lambda x: chunk_spans(x, limit, overlap)).select(
        doc, F.format_string("chunk-%03d", "index").alias("id"), "index", "text", "start_char", "end_char"
    )


def tagged_sentences(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, idx, sentence, section: sentences of at least five words with the last section heading before
    them, "opening" before the first; if a document has none, all its sentences, as "opening".

    Headings carry forward by a window within the document. Null and blank texts have no sentences.
    """
    lines = docs.select(doc, F.posexplode(T.lines(F.col(text))).alias("pos", "line")).withColumn(
        "line", F.regexp_replace(T.squeeze(F.col("line")), r"^[ \-]+|[ \-]+$", "")
    )
    heading = F.nullif(F.lower(F.regexp_extract("line", T.SECTION, 1)), F.lit(""))
    order = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tagged = (
        lines.where(F.length("line") > 0)
        .withColumn("heading", heading)
        .withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(order), F.lit("opening")))
        .where("heading is null")
        .select(doc, "section", "pos", F.posexplode(T.sentences(F.col("line"))).alias("k", "sentence"))
        .where(F.regexp_count("sentence", F.lit("[A-Za-z0-9]+")) >= 5)
    )
    alone = docs.join(tagged.select(doc).distinct(), doc, "left_anti").select(
        doc, F.lit("opening").alias("section"), F.lit(0).alias("pos"), F.posexplode(T.sentences(T.squeeze(F.col(text)))).alias("k", "sentence")
    )
    idx = F.row_number().over(Window.partitionBy(doc).orderBy("pos", "k")) - 1
    return tagged.unionByName(alone).select(doc, idx.alias("idx"), "sentence", "section")
