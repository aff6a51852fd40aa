"""Named queries over the test tables, with the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, concepts, graph, pages, segment, shred, store
from ..sources import documents
from ..streaming import progress
from .oracle_more import SQL

FLAGSHIP = "ox1_concepts"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """Each read once, as doc_id and text; a redelivered read has the same text."""
    return _table(spark, folder, "reads").where("text is not null").groupBy(F.col("read_id").alias("doc_id")).agg(F.max("text").alias("text"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of pdf reads as pages of a document: doc_id, page_no, text, blocks of a page in order."""
    once = _table(spark, folder, "paragraphs").groupBy("read_id", "id").agg(F.max(F.struct(F.coalesce("page_number", F.lit(0)).alias("page_no"), "index", "text")).alias("p"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p.index", "id", "p.text"))), lambda x: x["text"]), "\n")
    return once.groupBy(F.col("read_id").alias("doc_id"), F.col("p.page_no").alias("page_no")).agg(text.alias("text"))


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Each piece of evidence once."""
    rows = _table(spark, folder, "evidence")
    columns = ["claim", "kind", "excerpt", "source_location", "confidence", "extracted_at", "feed_id"]
    return rows.groupBy("doc_id", "id").agg(F.max(F.struct("extracted_at", *[c for c in columns if c != "extracted_at"])).alias("e")).select("doc_id", "id", "e.*")


def _papers(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "papers")
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), "added_at").alias("p")).select("doc_id", "p.*")


def _read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and text of every attempt to read a paper, distinct."""
    return _table(spark, folder, "reads").where("text is not null").groupBy("doc_id", "read_id").agg(F.max("text").alias("text")).select("doc_id", "text")


def _run_papers(spark: SparkSession, folder: str) -> DataFrame:
    """run_id and paper, a doc_id, of the papers a stored run names: those with its title and its address,
    else its title, else its address. A run that names no paper has no row."""
    runs = shred.run_tables(_table(spark, folder, "analysis_runs"))["runs"].select("run_id", "title", "source_url")
    papers = _papers(spark, folder).select(F.col("doc_id").alias("paper"), "title", "source_url")
    named = lambda t: t.withColumn("__title", F.nullif(T.for_match(F.col("title")), F.lit("")))
    by_title = named(runs).join(named(papers).select("paper", "__title"), "__title").select("run_id", "paper", F.lit(2).alias("points"))
    by_address = runs.join(papers.select("paper", "source_url"), "source_url").select("run_id", "paper", F.lit(1).alias("points"))
    scored = by_title.unionByName(by_address).groupBy("run_id", "paper").agg(F.sum("points").alias("points"))
    return scored.withColumn("most", F.max("points").over(Window.partitionBy("run_id"))).where("points = most").select("run_id", "paper")


def _run_concepts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and evidence of stored runs, by run."""
    tables = shred.run_tables(_table(spark, folder, "analysis_runs"))
    ids = tables["concept_evidence"].withColumn("at", F.slice("ordinals", 1, 1)).groupBy("run_id", "at").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinals", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids")
    )
    found = tables["concepts"].join(ids.withColumnRenamed("at", "ordinals"), ["run_id", "ordinals"], "left").select(
        F.col("run_id").alias("doc_id"), "id", "label", "kind", "description", "concept_type", F.col("confidence").cast("double").alias("confidence"),
        F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), "ordinals",
    )
    pieces = tables["evidence"].select(F.col("run_id").alias("doc_id"), "id", "claim", "kind", "excerpt", "source_location", F.col("confidence").cast("double").alias("confidence"))
    return found, pieces


def t1_body_lines(spark: SparkSession, folder: str) -> DataFrame:
    return segment.body_lines(_pages(spark, folder)).select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.col("pos").cast("int").alias("pos"), "line")


def t1_body_text(spark: SparkSession, folder: str) -> DataFrame:
    return segment.body_text(_pages(spark, folder)).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def t3_edge_keys(spark: SparkSession, folder: str) -> DataFrame:
    lines = _docs(spark, folder).select(F.explode(F.split("text", "\n")).alias("line")).select(T.squeeze(F.col("line")).alias("line")).where("length(line) > 0")
    return lines.groupBy(T.edge_key(F.col("line")).alias("key")).agg(F.count("*").alias("n"))


def t4_t8_flags(spark: SparkSession, folder: str) -> DataFrame:
    d = _docs(spark, folder)
    line = F.split("text", "\n")
    return d.select(
        "doc_id", T.is_meaningful(F.col("text")).alias("meaningful"), T.is_browser_error(F.col("text")).alias("browser_error"),
        F.size(F.filter(line, lambda x: x.rlike(T.STOP_HEADING))).alias("stop_headings"), F.size(F.filter(line, lambda x: x.rlike(T.PAGE_NUMBER))).alias("page_numbers"),
        F.size(F.filter(line, lambda x: x.rlike(T.BOILERPLATE))).alias("notices"),
    )


def t9_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return segment.paragraphs(_docs(spark, folder)).select("doc_id", "id", F.col("index").cast("int").alias("index"), "text", F.col("start_char").cast("int").alias("start_char"), F.col("end_char").cast("int").alias("end_char"))


def t10_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return segment.chunks(_docs(spark, folder)).select("doc_id", "id", F.col("index").cast("int").alias("index"), "start_char", "end_char", F.length("text").alias("n_chars"))


def t11_compact(spark: SparkSession, folder: str) -> DataFrame:
    return _evidence(spark, folder).where("excerpt is not null").select("doc_id", "id", T.compact(F.col("excerpt"), 60).alias("short"))


def t13_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return segment.tagged_sentences(_docs(spark, folder)).select("doc_id", F.col("idx").cast("int").alias("idx"), "sentence", "section")


def t14_t15_titles(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", T.title(F.col("text")).alias("title"), T.year(F.col("text")).alias("year"))


def t16_search(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.posexplode(T.search(F.col("text"), "mixed-effects model")).alias("n", "excerpt"))


def t17_t20_labels(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("excerpt")
    return _evidence(spark, folder).where("excerpt is not null").select(
        "doc_id", "id", T.phrase_after(s, analysis.METHOD_CUES).alias("phrase"), T.metric_label(s).alias("metric"), T.experiment_label(s).alias("experiment"),
    )


def t23_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = T.comparison_terms(F.col("abstract"))
    return _papers(spark, folder).select("doc_id", F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n_docs"))


def t24_relationship(spark: SparkSession, folder: str) -> DataFrame:
    """What the text of each read says of its relation to earlier work."""
    return _docs(spark, folder).select("doc_id", T.relationship(F.col("text")).alias("relationship_type"))


def t26_anchored(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence anchored in its paper's abstract or title; see ``t26_read_anchored`` for the papers' texts."""
    e, p = _evidence(spark, folder), _papers(spark, folder)
    source = F.concat_ws("\n", "title", "abstract")
    return e.join(p.select("doc_id", source.alias("source")), "doc_id").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(T.is_anchored(F.col("excerpt"), F.col("source"))).alias("n_anchored")
    )


def t26_read_anchored(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence anchored in the text of any read of its paper."""
    e = _evidence(spark, folder)
    found = analysis.anchored(e, _read_texts(spark, folder)).withColumn("found", F.lit(True))
    return e.select("doc_id", "excerpt").join(found, ["doc_id", "excerpt"], "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count("found").alias("n_anchored"))


def t27_t33_addresses(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("source_url")
    return _papers(spark, folder).select("doc_id", T.is_web_address(u).alias("web"), T.source_type(F.coalesce(u, F.lit(""))).alias("source_type"), T.is_authority(u).alias("authority"))


def t29_terms(spark: SparkSession, folder: str) -> DataFrame:
    words = F.explode(F.split("title", ",")).alias("part")
    return _papers(spark, folder).where("title is not null").select("doc_id", words).select("doc_id", T.clean_term(F.col("part")).alias("term")).distinct()


def c3_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of every read of a paper, and of its title and abstract, which have no read_id."""
    reads = _table(spark, folder, "reads").where("text is not null").groupBy("doc_id", "read_id").agg(F.max("text").alias("text"))
    front = _papers(spark, folder).select("doc_id", F.lit(None).cast("bigint").alias("read_id"), F.concat_ws(". ", "title", "abstract").alias("text"))
    docs = reads.unionByName(front).select(F.struct("doc_id", "read_id").alias("of"), "text")
    return concepts.candidates(concepts.pattern_mentions(docs, "of"), "of").select(
        "of.doc_id", "of.read_id", F.col("rank").cast("int").alias("rank"), "term", F.col("mentions").cast("int").alias("mentions"), F.col("start_char").cast("int").alias("start_char")
    )


def w1_best(spark: SparkSession, folder: str) -> DataFrame:
    best = analysis.best_sentences(segment.tagged_sentences(_docs(spark, folder)))
    return best.select("doc_id", *(F.col(r)["sentence"].alias(r) for r in ("thesis", "method", "finding", "experiment", "metric", "opening")))


def ox1_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.concept_rows(analysis.structure(_docs(spark, folder))).select("doc_id", F.col("pos").cast("int").alias("pos"), "id", "label", "description", "confidence")


def ox1_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.evidence_rows(analysis.structure(_docs(spark, folder), query="factorial layout")).select("doc_id", F.col("pos").cast("int").alias("pos"), "id", "claim", "excerpt", "source_location")


def os1_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.summaries(analysis.structure(_docs(spark, folder)))


def j1_links(spark: SparkSession, folder: str) -> DataFrame:
    c, e = _run_concepts(spark, folder)
    return analysis.links(c, e).where("evidence_id is not null").select("doc_id", "concept_id", "evidence_id", F.coalesce("there", F.lit(False)).alias("there"), "evidence_kind")


def j2_dangling(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.dangling(*_run_concepts(spark, folder))


def oe1_explanations(spark: SparkSession, folder: str) -> DataFrame:
    c, e = _run_concepts(spark, folder)
    return analysis.explanations(c, e).select("doc_id", "concept_id", "support_status", "score", "reliability", "rationale")


def ov2_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The rules over the runs' own concepts and evidence, with the run's claims as the text that must hold its excerpts."""
    c, e = _run_concepts(spark, folder)
    return analysis.violations(c, e, e.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("claim")), " ").alias("text")))


def _spoiled(c: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts and evidence with a fault put in by kind: concepts of findings name evidence that isn't there, those of
    metrics none; excerpts of contexts are invented, statistics stand twice, methods' ids are their experiments'."""
    ids = F.when(F.col("kind") == "finding", F.concat("evidence_ids", F.array(F.lit("evidence-none")))).when(F.col("kind") == "metric", F.array().cast("array<string>")).otherwise(F.col("evidence_ids"))
    concepts_ = c.withColumn("evidence_ids", ids).withColumn("id", F.when(F.col("kind") == "method", "experiment").otherwise(F.col("id")))
    pieces = e.withColumn("excerpt", F.when(F.col("kind") == "context", "Nobody wrote this sentence.").otherwise(F.col("excerpt")))
    return concepts_, pieces.unionByName(pieces.where("kind = 'statistic'"))


def j2_injected(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.dangling(*_spoiled(*_run_concepts(spark, folder)))


def ov2_injected(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule that some run breaks once faults are put in, each by itself."""
    c, e = _run_concepts(spark, folder)
    bad, pieces = _spoiled(c, e)
    texts = e.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("excerpt")), " ").alias("text"))
    one = lambda c_, e_: analysis.violations(c_, e_, texts)
    held = c.where(F.size("evidence_ids") > 0)
    return one(bad, pieces).unionByName(one(bad, e)).unionByName(one(c, e)).unionByName(one(held, pieces.dropDuplicates(["doc_id", "id"]))).distinct()


def ov2_paper_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The rules with each run's excerpts looked for in the reads of the paper it names. Without such a
    paper there is no text that holds them."""
    c, e = _run_concepts(spark, folder)
    of = _run_papers(spark, folder)
    pieces = e.select(F.col("doc_id").alias("run_id"), "excerpt").join(of, "run_id")
    found = analysis.anchored(pieces.withColumnRenamed("paper", "doc_id"), _read_texts(spark, folder)).withColumnRenamed("doc_id", "paper")
    return analysis.broken_rules(c, e, pieces.join(found, ["paper", "excerpt"]).select(F.col("run_id").alias("doc_id"), "excerpt").distinct())


def a5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.quality(*_run_concepts(spark, folder))


def oc1_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds' newest papers against the reading passages as library."""
    current = _papers(spark, folder).where("abstract is not null").select("doc_id", F.concat_ws(" ", "title", "abstract").alias("text"))
    library = _table(spark, folder, "reading_refs").select(F.col("ref_id").alias("paper_id"), "text")
    return analysis.compare(current, library).select("doc_id", "paper_id", "relationship_type", F.col("n_shared").cast("int").alias("n_shared"), F.round("confidence", 6).alias("confidence"), "shared")


def g1_nodes(spark: SparkSession, folder: str) -> DataFrame:
    c, _ = _run_concepts(spark, folder)
    return graph.map_nodes(c.dropDuplicates(["doc_id", "id"])).select("doc_id", "node_id", "kind", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def g2_edges(spark: SparkSession, folder: str) -> DataFrame:
    c, _ = _run_concepts(spark, folder)
    nodes = graph.map_nodes(c.dropDuplicates(["doc_id", "id"]))
    return graph.keep_known(graph.map_edges(nodes), nodes)


def g3_cards(spark: SparkSession, folder: str) -> DataFrame:
    return graph.cards(_papers(spark, folder))


def k1_current(spark: SparkSession, folder: str) -> DataFrame:
    return store.current_runs(_table(spark, folder, "analysis_runs")).select("run_id", F.unix_micros("created_at").alias("created_us"), F.md5(F.coalesce("response_json", F.lit(""))).alias("digest"))


def k3_recent(spark: SparkSession, folder: str) -> DataFrame:
    return store.recent(_table(spark, folder, "analysis_runs"), 20).select("run_id", F.unix_micros("created_at").alias("created_us"))


def k5_events(spark: SparkSession, folder: str) -> DataFrame:
    e = progress.stage_events(_table(spark, folder, "analysis_runs").select("run_id").distinct())
    return store.event_lines(e.select("run_id", "node", "status"))


def st1_stages(spark: SparkSession, folder: str) -> DataFrame:
    return progress.stage_events(_table(spark, folder, "analysis_runs").select("run_id").distinct()).select("run_id", F.col("seq").cast("int").alias("seq"), "node", "status")


def st2_states(spark: SparkSession, folder: str) -> DataFrame:
    return store.fold_states(progress.stage_events(_table(spark, folder, "analysis_runs").select("run_id").distinct())).select("run_id", "node", "status", F.size("trace").alias("n_trace"))


def st_windows(spark: SparkSession, folder: str) -> DataFrame:
    return progress.tumbling(_table(spark, folder, "events")).select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def s1_texts(spark: SparkSession, folder: str) -> DataFrame:
    return documents.from_texts(_docs(spark, folder)).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "format", "status")


def s4_pdf_reads(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of pdf reads as text layers; the first paragraph of a page stands in for its OCR text."""
    pages_ = _pages(spark, folder)
    ocr = pages_.select("doc_id", "page_no", F.split("text", "\n")[0].alias("text"))
    return documents.read_pdf(pages_, ocr).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "ocr_used", "status")


def s6_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """The reads as uploaded files."""
    suffix = F.when(F.col("format") == "pdf", ".PDF").when(F.col("format") == "text", ".md").otherwise(".html")
    once = _table(spark, folder, "reads").where("text is not null").groupBy("read_id", "format").agg(F.max("text").alias("text"))
    files = once.select(F.concat(F.col("read_id").cast("string"), suffix).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return documents.uploads(files).select("path", "route", F.md5("text").alias("digest"))


def s7_page_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    rows = segment.page_paragraphs(_pages(spark, folder))
    return rows.select("doc_id", "id", F.col("page_number").cast("int").alias("page_number"), "text", "start_char", "end_char")


def s8_scans(spark: SparkSession, folder: str) -> DataFrame:
    every = _table(spark, folder, "reads").groupBy(F.col("read_id").alias("doc_id")).agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))
    return segment.scan_texts(every).select("doc_id", "n_paragraphs", F.md5("text").alias("digest"), F.col("error").isNotNull().alias("failed"))


def s9_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The papers' addresses against reads as what landed: pages link to the file of the same paper, pdf reads are the files."""
    reads = _table(spark, folder, "reads").where("text is not null and doc_id is not null").groupBy("doc_id", "format").agg(F.max("text").alias("text"))
    page = F.concat(F.lit("https://papers.example.org/"), "doc_id")
    link = F.concat(F.lit('<html><body><a href="/'), "doc_id", F.lit('.pdf">PDF</a><main><p>'), F.regexp_replace("text", "[<>&]", " "), F.lit("</p></main></body></html>"))
    html = reads.where("format = 'html'").select(page.alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.encode(link, "UTF-8").alias("body"))
    files = reads.where("format = 'pdf'").select(F.concat(page, F.lit(".pdf")).alias("url"), F.lit(200).alias("status"), F.lit("application/pdf").alias("content_type"), F.encode(F.lit("%PDF-1"), "UTF-8").alias("body"))
    texts = reads.where("format = 'pdf'").select(F.concat(page, F.lit(".pdf")).alias("url"), F.lit(1).alias("page_no"), "text")
    asked = _papers(spark, folder).select(page.alias("url")).unionByName(spark.createDataFrame([("not-a-url",)], "url string"))
    return documents.read_urls(asked, html.unionByName(files), texts).select("url", "source_url", "format", F.length("text").alias("n_chars"), F.size("warnings").alias("n_warnings"), F.col("error").isNotNull().alias("failed"))


def t7_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """The visible text of posts, whose markup is that of web pages."""
    posts = _table(spark, folder, "documents").where("text is not null")
    return posts.select("doc_id", pages.visible_text_udf("text").alias("text")).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def l1_pdf_links(spark: SparkSession, folder: str) -> DataFrame:
    posts = _table(spark, folder, "documents").select("doc_id", F.lit("https://posts.example.org/").alias("url"), F.col("text").alias("html"))
    return pages.pdf_candidates(posts, "doc_id")


def t21_locations(spark: SparkSession, folder: str) -> DataFrame:
    """Where each excerpt stands in its paper's title and abstract."""
    source = F.concat_ws("\n", "title", F.regexp_replace("abstract", r"(?<=[.]) ", "\n"))
    rows = _evidence(spark, folder).where("excerpt is not null").join(_papers(spark, folder).select("doc_id", source.alias("source")), "doc_id")
    return rows.select("doc_id", "id", T.location(F.col("source"), F.col("excerpt"), F.col("kind")).alias("location"))


def t22_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and characters where the chunks begin, and the text around them."""
    chunks = _table(spark, folder, "chunks").where("start_char is not null").select("read_id", "id", "start_char", "end_char").distinct()
    rows = chunks.join(_docs(spark, folder).withColumnRenamed("doc_id", "read_id"), "read_id")
    start = F.col("start_char").cast("int")
    return rows.select("read_id", "id", start.alias("start_char"), T.offset_location(F.col("text"), start).alias("location"), T.around(F.col("text"), start, start + 40).alias("excerpt"))


def t34_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of posts to authorities, and the addresses of papers as such links."""
    posts = _table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    papers = _papers(spark, folder).where("source_url is not null").select("doc_id", F.concat(F.lit('<a href="'), F.replace("source_url", F.lit("&"), F.lit("&amp;")), F.lit('">x</a><a href="https://dl.acm.org/?a=1&amp;b=2">')).alias("text"))
    return posts.unionByName(papers).where("text is not null").select("doc_id", F.posexplode(T.hrefs(F.col("text"))).alias("n", "url"))


def _title_words(spark: SparkSession, folder: str) -> DataFrame:
    """The words of titles as mentions: term, place, and a kind of signal by the word's length."""
    signal = F.element_at(F.array(F.lit("ner"), F.lit("noun_phrase"), F.lit("pattern")), F.length("term") % 3 + 1)
    words = _papers(spark, folder).where("title is not null").select("doc_id", F.posexplode(F.split("title", " ")).alias("start_char", "term"))
    return words.select("doc_id", "term", "start_char", (F.col("start_char") + F.length("term")).alias("end_char"), signal.alias("signal"), F.upper(signal).alias("entity_type"))


def c4_ranked(spark: SparkSession, folder: str) -> DataFrame:
    ranked = concepts.candidates(_title_words(spark, folder), top=5)
    return ranked.select("doc_id", F.col("rank").cast("int").alias("rank"), "term", "entity_type", F.col("mentions").cast("int").alias("mentions"), "start_char", F.array_join("signals", ",").alias("signals"))


def c2_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of titles between colons and commas as noun phrases of title and abstract."""
    papers = _papers(spark, folder).where("title is not null")
    docs = papers.select("doc_id", F.concat_ws(". ", "title", "abstract").alias("text"))
    parts = papers.select("doc_id", F.posexplode(F.split("title", "[:,]")).alias("start_char", "term")).withColumn("end_char", F.col("start_char") + F.length("term"))
    return concepts.noun_phrases(parts, docs).select("doc_id", "term", "start_char", "end_char", "signal")


def _knowledge(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A knowledge base made by rule from the words of titles: pages, items and links."""
    words = _title_words(spark, folder).select(T.clean_term(F.col("term")).alias("term")).where("length(term) >= 4").select(F.lower("term").alias("term")).distinct()
    size = F.length("term")
    pages_ = words.select(
        "term", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"),
    ).select(
        "term", "rank", F.when(F.col("rank") == 1, F.concat(F.lit("The "), "term")).otherwise(F.col("term")).alias("title"),
        F.concat(F.lit("https://en.wikipedia.org/wiki/"), "term").alias("url"), F.concat(F.lit("Q"), F.length("term") * 10 + F.ascii("term") % 7).alias("wikidata_id"),
        F.lit("a word").alias("description"), ((size % 5 == 0) & (F.col("rank") == 2)).alias("is_disambiguation"),
    )
    items = pages_.select("wikidata_id").distinct().select(
        "wikidata_id", F.lit(None).cast("string").alias("description"),
        F.when(F.col("wikidata_id").endswith("1"), F.array(F.concat(F.lit("https://doi.org/10/"), "wikidata_id"))).otherwise(F.array().cast("array<string>")).alias("reference_urls"),
    )
    refs = pages_.where("rank = 2").select("title", F.explode(F.array(F.struct(F.lit(2).alias("n"), F.lit("https://arxiv.org/a").alias("url")), F.struct(F.lit(1).alias("n"), F.lit("https://www.nature.com/b").alias("url")), F.struct(F.lit(0).alias("n"), F.lit("https://example.com/c").alias("url")))).alias("r")).select("title", "r.*").where("length(title) % 2 = 0")
    return pages_, items, refs


def j6_types(spark: SparkSession, folder: str) -> DataFrame:
    """The items of the knowledge base made by rule that are of an allowed class, by id or by label."""
    _, items, _ = _knowledge(spark, folder)
    classes = spark.createDataFrame([("1", "Q8366"), ("1", "Q999"), ("2", "Q5"), ("3", "Q777"), ("4", "Q65943"), ("5", "Q778")], "last string, item_id string")
    labels = spark.createDataFrame([("Q777", "physical effect"), ("Q778", "town"), ("Q5", "human"), ("Q999", "a theorem of sorts")], "item_id string, label string")
    types = items.select("wikidata_id", F.substring("wikidata_id", -1, 1).alias("last")).join(F.broadcast(classes), "last").select("wikidata_id", "item_id")
    return concepts.typed_items(items, types, labels).select("wikidata_id", "concept_type")


def j5_named(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates from titles linked to the knowledge base made by rule."""
    pages_, items, refs = _knowledge(spark, folder)
    typed = items.withColumn("concept_type", F.lit("algorithm"))
    linked = concepts.link(concepts.candidates(_title_words(spark, folder)), pages_, typed, refs)
    return linked.select("doc_id", F.col("n").cast("int").alias("n"), "term", "wikidata_id", "description", F.array_join("source_urls", " ").alias("sources"), "recognition_status", F.round("confidence", 6).alias("confidence"))


def c5_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The named concepts of every read by patterns and the knowledge base made by rule, as concept and evidence rows."""
    pages_, items, refs = _knowledge(spark, folder)
    docs = _docs(spark, folder)
    mined = concepts.candidates(concepts.pattern_mentions(docs)).select(F.lower("term").alias("term")).distinct()
    last = F.element_at(F.split("term", " "), -1)
    own = mined.withColumn("word", last).join(pages_.withColumnRenamed("term", "word"), "word").drop("word")
    named = concepts.named_concepts(docs, own, items.withColumn("concept_type", F.lit("algorithm")), refs)
    return analysis.entity_rows(analysis.structure(docs), named).select("doc_id", "id", "label", "description", "evidence_id", "source_location", "wikidata_id", "confidence", F.length("excerpt").alias("n_excerpt"))


def ov1_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The papers' addresses as requests."""
    asked = _papers(spark, folder).select("doc_id", F.col("source_url").alias("source"), F.when(F.length("doc_id") % 2 == 0, "url").otherwise("text").alias("source_type"))
    return analysis.validate_input(asked).select("doc_id", "status", F.col("error").isNotNull().alias("failed"))


def od1_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The reads of each paper as its scanned documents, in the order of their keys."""
    once = _table(spark, folder, "reads").where("doc_id is not null").groupBy("doc_id", F.col("read_id").alias("n")).agg(F.max("text").alias("source_text"), F.max("source_url").alias("u"))
    scans = once.select("doc_id", "n", "source_text", F.when(F.col("u").isNotNull(), F.array("u", F.lit("second"))).alias("paragraphs"))
    return analysis.documents_text(scans).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def a8_evidence_count(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.evidence_count(_run_concepts(spark, folder)[0])


def k4_responses(spark: SparkSession, folder: str) -> DataFrame:
    """The responses of stored runs made again from their parts."""
    t = shred.run_tables(_table(spark, folder, "analysis_runs"))
    listed = lambda name, field: t[name].groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinals", field))), lambda x: x[field]).alias(name))
    c, e = _run_concepts(spark, folder)
    state = t["runs"].join(listed("warnings", "warning"), "run_id", "left").join(listed("trace", "step"), "run_id", "left").select(
        "run_id", "status", "document_format", F.col("ocr_used").cast("boolean").alias("ocr_used"), "warnings", F.array(F.lit("stored")).alias("errors"), "trace", F.col("thesis").alias("text"),
        F.lit(1).alias("n_chunks"), F.col("rest")["usage.retries"].cast("int").alias("retry_count"), F.col("thesis").isNotNull().alias("has_analysis"),
    )
    out = store.responses(state, c.withColumnRenamed("doc_id", "run_id"), e.withColumnRenamed("doc_id", "run_id"))
    return out.select("run_id", "status", "ocr_used", F.size("warnings").alias("n_warnings"), F.size("trace").alias("n_trace"), "usage.input_characters", F.round("quality.citation_coverage", 6).alias("coverage"))


def js1_objects(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON objects in stored responses put into model outputs of several shapes."""
    runs = store.current_runs(_table(spark, folder, "analysis_runs")).where("response_json is not null")
    shape = F.length("run_id") + F.length("response_json")
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "response_json", F.lit("\n```"))
    raw = F.when(shape % 3 == 0, F.to_json(F.struct(F.array(F.struct(F.col("response_json").alias("text"))).alias("content")))).when(shape % 3 == 1, F.to_json(F.struct(fenced.alias("completion")))).otherwise(
        F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("Sure. "), "response_json").alias("text"))).alias("content")).alias("message")).alias("output"))))
    out = runs.select("run_id", raw.alias("raw")).select("run_id", store.provider_text(F.col("raw")).alias("said"))
    return out.select("run_id", F.md5("said").alias("said"), F.md5(store.json_object(F.col("said"))).alias("object"))


def js2_text(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of evidence in the shapes of several providers."""
    e = _evidence(spark, folder).where("excerpt is not null")
    made = [F.to_json(F.struct(F.col("excerpt").alias(n))) for n in ("completion", "generation", "outputText")]
    made.append(F.to_json(F.struct(F.array(F.struct(F.col("excerpt").alias("outputText"))).alias("results"))))
    shape = F.length("id") % 4
    raw = F.coalesce(*(F.when(shape == k, m) for k, m in enumerate(made)))
    return e.select("doc_id", "id", store.provider_text(raw).alias("text"))


def js5_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The papers of each feed as a form's list of existing papers; feeds that began early send no list."""
    papers = _papers(spark, folder).where("feed_id is not null")
    listed = F.to_json(F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("id"), "title", "abstract"))))
    forms = papers.groupBy(F.col("feed_id").alias("request_id")).agg(listed.alias("existing_papers"))
    odd = _table(spark, folder, "feeds").where("since_year < 2000").select(F.concat(F.lit("odd-"), "feed_id").alias("request_id"), F.lit('{"id": 1}').alias("existing_papers"))
    return store.existing_papers(forms.unionByName(odd)).select("request_id", "n", "id", "title", F.length("abstract").alias("n_chars"), F.col("error").isNotNull().alias("failed"))


def s10_run(spark: SparkSession, folder: str) -> DataFrame:
    """The run with the least id."""
    runs = _table(spark, folder, "analysis_runs")
    return store.get_run(runs, runs.agg(F.min("run_id")).first()[0]).select("run_id", F.md5(F.coalesce("response_json", F.lit(""))).alias("digest"))


def k2_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The stored runs with those of the newest tenth of days put in once more without text."""
    runs = store.current_runs(_table(spark, folder, "analysis_runs"))
    new = runs.where(F.length("response_json") > 5000).select("run_id", "created_at", F.lit("{}").alias("response_json"))
    return store.upsert(runs, new).select("run_id", F.md5(F.coalesce("response_json", F.lit(""))).alias("digest"))


def g4_references(spark: SparkSession, folder: str) -> DataFrame:
    t = shred.run_tables(_table(spark, folder, "analysis_runs"))
    urls = t["concept_urls"].groupBy("run_id", F.slice("ordinals", 1, 1).alias("ordinals")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ordinals").alias("o"), "url"))), lambda x: x["url"]).alias("source_urls"))
    rows = t["concepts"].join(urls, ["run_id", "ordinals"]).select("run_id", "ordinals", "id", F.col("rest")["wikipedia_url"].alias("wikipedia_url"), "source_urls")
    return graph.reference_links(rows.withColumn("id", F.concat_ws("#", "id", F.col("ordinals")[0].cast("string"))), "run_id").select("run_id", "id", F.array_join("references", " ").alias("links"))


def g5_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The explanations of runs that have evidence for a finding, and those made for the others, under the interface's names."""
    c, e = _run_concepts(spark, folder)
    told = analysis.explanations(c, e)
    some = e.where("kind = 'statistic' and confidence > 0.8").select("doc_id").distinct()
    shown = graph.for_interface(graph.with_fallback(c, told.join(some, "doc_id", "left_semi")))
    return shown.select("doc_id", "conceptId", "supportStatus", "paperContext", F.array_join("limitations", " ").alias("limits"))


def w12_shown(spark: SparkSession, folder: str) -> DataFrame:
    t = shred.run_tables(_table(spark, folder, "analysis_runs"))
    at = F.col("ordinals")[0].alias("pos")
    c, e = _run_concepts(spark, folder)
    first = graph.first_shown(c.withColumn("pos", F.col("ordinals")[0]), t["relationships"].select(F.col("run_id").alias("doc_id"), at, "explanation"), analysis.explanations(c, e))
    return first.select("doc_id", "selected", "relationship", "limitation")


def st2_traces(spark: SparkSession, folder: str) -> DataFrame:
    """The stored traces as events, folded again."""
    t = shred.run_tables(_table(spark, folder, "analysis_runs"))["trace"]
    events = t.select("run_id", F.col("ordinals")[0].alias("seq"), F.concat(F.lit("step "), F.col("ordinals")[0].cast("string")).alias("node"), F.lit("running").alias("status"), F.array("step").alias("trace"))
    return store.fold_states(events).select("run_id", "node", F.size("trace").alias("n_trace"), F.md5(F.array_join("trace", "|")).alias("digest"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return shred.run_elements(_table(spark, folder, "analysis_runs"))


def p5_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all flat tables as one: run_id, entity (the path of the list), ordinals, whose first members
    are the parent's, and every field with its value."""
    flat = shred.shred_latest(_table(spark, folder, "analysis_runs"), "run_id", "created_at", "response_json")
    return shred.grouped(flat, "run_id").select("run_id", F.col("group").alias("entity"), "ordinals", F.map_entries("fields").alias("fields"))


_QUERIES = (
    s1_texts, s4_pdf_reads, s6_uploads, s7_page_paragraphs, s8_scans, s9_urls, s10_run, k2_upsert, k4_responses, t7_page_text, l1_pdf_links, t21_locations, t22_offsets, t34_links,
    c2_phrases, c4_ranked, c5_entities, j2_injected, j5_named, j6_types, ov1_requests, ov2_injected, od1_texts, a8_evidence_count, js1_objects, js2_text, js5_forms, g4_references, g5_fallback, w12_shown, st2_traces,
    t1_body_lines, t1_body_text, t3_edge_keys, t4_t8_flags, t9_paragraphs, t10_chunks, t11_compact, t13_sentences, t14_t15_titles, t16_search,
    t17_t20_labels, t23_terms, t24_relationship, t26_anchored, t26_read_anchored, t27_t33_addresses, t29_terms, c3_candidates, w1_best, ox1_concepts, ox1_evidence,
    os1_summaries, j1_links, j2_dangling, oe1_explanations, ov2_violations, ov2_paper_violations, a5_quality, oc1_compare, g1_nodes, g2_edges, g3_cards, k1_current,
    k3_recent, k5_events, st1_stages, st2_states, st_windows, p5_found, p5_tables,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
