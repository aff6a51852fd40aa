"""Where documents come from: texts, uploads, pages of PDF files, landed fetches, and a fetching reader."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from ..operators.segment import body_text

#: Answers after which a fetch is tried again, and the waits before it.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
WAITS = (0.75, 1.5)
MOST_BYTES = 50 * 1024 * 1024
MOST_CHARS = 120_000


def from_texts(texts: DataFrame, doc: str = "doc_id", text: str = "text", most: int = MOST_CHARS) -> DataFrame:
    """doc, text, source_url, format, status: pasted texts, their body only, at most ``most`` characters.
    An empty body has the status "empty"."""
    body = body_text(texts.select(doc, F.lit(1).alias("page_no"), F.col(text).alias("text")), doc)
    joined = texts.select(doc).distinct().join(body, doc, "left")
    clean = F.substring(F.coalesce("text", F.lit("")), 1, most)
    return joined.select(
        doc, clean.alias("text"), F.lit(None).cast("string").alias("source_url"), F.lit("text").alias("format"),
        F.when(F.length(clean) > 0, "read").otherwise("empty").alias("status"),
    )


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def uploads(files: DataFrame) -> DataFrame:
    """Rows of binary files (path, content) with their route: pdf by suffix or magic, text by suffix, else
    rejected; and the decoded text of the latter."""
    pdf = F.lower("path").endswith(".pdf") | (F.substring("content", 1, 4) == F.lit(b"%PDF"))
    text = F.lower("path").rlike(r"\.(txt|md|markdown)$")
    route = F.when(pdf, "pdf").when(text, "text").otherwise("rejected")
    return files.select("path", route.alias("route"), F.when(route == "text", F.decode("content", "UTF-8")).alias("text"), F.when(pdf, F.col("content")).alias("content"))


def pdf_pages(files: DataFrame, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """path, page_no, text of the pages of PDF files, by ``extract`` (pypdf if it is installed)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        read = extract
        if read is None:
            from io import BytesIO

            from pypdf import PdfReader  # optional

            def read(content: bytes) -> list[str]:
                return [p.extract_text() or "" for p in PdfReader(BytesIO(content)).pages]

        for batch in batches:
            rows = [(p, k + 1, t) for p, c in zip(batch["path"], batch["content"]) for k, t in enumerate(read(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, text string")


def read_pdf(pages: DataFrame, ocr: DataFrame | None = None, doc: str = "doc_id", most: int = MOST_CHARS) -> DataFrame:
    """doc, text, format, ocr_used, status from page texts (doc, page_no, text): the text layer if it is
    meaningful, else the pages of ``ocr``, else what there is with a warning's status."""
    layer = body_text(pages, doc).withColumnRenamed("text", "layer")
    other = body_text(ocr, doc).withColumnRenamed("text", "scan") if ocr is not None else pages.select(doc).distinct().withColumn("scan", F.lit(None).cast("string"))
    both = pages.select(doc).distinct().join(layer, doc, "left").join(other, doc, "left")
    good = F.coalesce(T.is_meaningful(F.col("layer")), F.lit(False))
    scanned = ~good & (F.length("scan") > 0)
    return both.select(
        doc, F.substring(F.when(good, F.col("layer")).when(F.length("scan") > 0, F.col("scan")).otherwise(F.coalesce("layer", F.lit(""))), 1, most).alias("text"),
        F.lit("pdf").alias("format"), F.coalesce(scanned, F.lit(False)).alias("ocr_used"),
        F.when(good | F.coalesce(scanned, F.lit(False)), "read").when(F.length("layer") > 0, "poor").otherwise("empty").alias("status"),
    )


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str, bytes]], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """url, status, content_type, body, tries: each address fetched with bounded retries by ``get``, which
    gives status, content type and either the bytes or their parts in order, or raises. Of parts no more is read
    than ``MOST_BYTES``: longer bodies are refused (status 413). Pages that are a browser's error page are fetched
    again too; if all are, the last one stands."""

    def within(body: bytes | Iterator[bytes] | None) -> tuple[bytes | None, bool]:
        if body is None or isinstance(body, (bytes, bytearray, memoryview)):
            return (None, True) if body is not None and len(body) > MOST_BYTES else (body, False)
        parts, size = [], 0
        for one in body:
            size += len(one)
            if size > MOST_BYTES:
                return None, True
            parts.append(one)
        return b"".join(parts), False

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for url in batch["url"]:
                status, kind, body, tries = 0, None, None, 0
                for k in range(attempts):
                    tries = k + 1
                    try:
                        status, kind, body = get(url)
                        body, refused = within(body)
                        status = 413 if refused else status
                    except Exception:  # noqa: BLE001
                        status, kind, body = 0, None, None
                    page = body is not None and "pdf" not in (kind or "").lower() and any(m in bytes(body).decode("utf-8", "replace").casefold() for m in T.BROWSER_ERRORS)
                    if status and status not in RETRYABLE and not (page and status < 400):
                        break
                    if k + 1 < attempts:
                        wait(WAITS[min(k, len(WAITS) - 1)])
                rows.append((url, status, kind, body, tries))
            yield pd.DataFrame(rows, columns=["url", "status", "content_type", "body", "tries"])

    return urls.select("url").mapInPandas(run, "url string, status int, content_type string, body binary, tries int")


def route_fetches(landed: DataFrame) -> DataFrame:
    """Landed fetches (url, status, content_type, body) with their route: pdf, html, text or error."""
    head = F.substring("body", 1, 4)
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    pdf = F.contains(kind, F.lit("application/pdf")) | (head == F.lit(b"%PDF")) | F.lower("url").rlike(r"\.pdf(?:$|[?#])") & (head == F.lit(b"%PDF"))
    html = F.contains(kind, F.lit("html")) | (F.length(kind) == 0)
    text = F.decode("body", "UTF-8")
    bad = (F.col("status") >= 400) | (F.col("status") == 0) | ~T.is_web_address(F.col("url")) | (html & ~pdf & T.is_browser_error(text))
    return landed.select("url", F.when(F.coalesce(bad, F.lit(True)), "error").when(pdf, "pdf").when(html, "html").otherwise("text").alias("route"), F.when(~pdf, text).alias("text"))


#: What is told of a page that was read in place of a PDF file.
NO_PDF = "No readable linked PDF was found; the page's own text was used."


def read_urls(requests: DataFrame, landed: DataFrame, pdf_texts: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """url, text, source_url, format, ocr_used, warnings and error of each requested address.

    ``landed`` (url, status, content_type, body) has what was fetched, pages and linked files alike, ``pdf_texts`` (url,
    page_no, text, and ocr_text if there is any) the page texts of the PDF files among it. A PDF file is read as one;
    of a page, the best linked file that landed as a PDF and has a readable text is read, else the page's own
    text unless it is a browser's error page; anything else is text. An address that is none, or didn't land, or has
    no text, has an error and a null text.
    """
    asked = requests.select("url").distinct()
    got = landed.dropDuplicates(["url"])
    routes = route_fetches(got)
    layers = pdf_texts.select(F.col("url").alias("doc_id"), "page_no", "text")
    scans = pdf_texts.select(F.col("url").alias("doc_id"), "page_no", F.col("ocr_text").alias("text")) if "ocr_text" in pdf_texts.columns else None
    files = read_pdf(layers, scans, most=most).where(F.length("text") > 0).join(routes.where("route = 'pdf'").select(F.col("url").alias("doc_id")), "doc_id", "left_semi")
    files = files.select(F.col("doc_id").alias("file"), F.col("text").alias("file_text"), "ocr_used", F.col("status").alias("read_as"))
    own = asked.join(routes, "url", "left").withColumn("route", F.when(~T.is_web_address(F.col("url")), "invalid").otherwise(F.coalesce("route", F.lit("error"))))
    pages_ = own.join(got.select("url", F.decode("body", "UTF-8").alias("html")), "url").where("route = 'html'").select("url", "html")
    linked = P.pdf_candidates(pages_, "url", "url", "html").select("url", "rank", F.col("pdf_url").alias("file"))
    best = linked.join(files.select("file"), "file", "left_semi").groupBy("url").agg(F.min_by("file", "rank").alias("file"))
    read = own.join(best, "url", "left").withColumn("file", F.when(F.col("route") == "pdf", F.col("url")).otherwise(F.col("file"))).join(files, "file", "left")
    plain = own.where("route in ('html', 'text')").select(F.col("url").alias("doc_id"), F.lit(1).alias("page_no"), F.when(F.col("route") == "html", P.visible_text_udf("text")).otherwise(F.col("text")).alias("text"))
    shown = body_text(plain).select(F.col("doc_id").alias("url"), F.nullif(F.substring("text", 1, most), F.lit("")).alias("page_text"))
    both = read.drop("text").join(shown, "url", "left")
    from_file = F.col("file_text").isNotNull()
    text = F.when(from_file, F.col("file_text")).when(F.col("route").isin("html", "text"), F.col("page_text"))
    none = F.array().cast("array<string>")
    warning = F.when(from_file & (F.col("read_as") == "poor"), F.array(F.lit("The text layer is poor and no other reading was available."))).when(
        ~from_file & (F.col("route") == "html"), F.array(F.lit(NO_PDF))).otherwise(none)
    return both.select(
        "url", text.alias("text"), F.when(text.isNotNull(), F.coalesce("file", "url")).alias("source_url"), F.when(from_file, "pdf").when(text.isNotNull(), F.col("route")).alias("format"),
        F.coalesce("ocr_used", F.lit(False)).alias("ocr_used"), F.when(text.isNotNull(), warning).otherwise(none).alias("warnings"),
        F.when(F.col("route") == "invalid", "The address is no http(s) address").when(F.col("route") == "error", "The address gave no readable page")
        .when(text.isNull(), "The document has no text of a paper").alias("error"),
    )
