"""Concept maps: nodes, edges, cards and layout of documents' concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .analysis import USAGE

# The edges between kinds of node, the places of the main ones as shares of the canvas.
TEMPLATE = (("thesis", "method", "uses"), ("thesis", "finding", "leads to"), ("thesis", "experiment", "tested by"), ("thesis", "metric", "measured by"), ("thesis", "concept", "mentions"))

PLACES = {"thesis": (0.5, 0.5), "method": (0.2, 0.23), "finding": (0.8, 0.23), "experiment": (0.25, 0.77), "metric": (0.75, 0.77)}


def map_nodes(concepts: DataFrame, doc: str = "doc_id", width: float = 1000.0, height: float = 600.0, order: str = "pos") -> DataFrame:
    """doc, node_id, label, kind, confidence, x, y: a node for each concept, laid out on a canvas.

    The five main nodes, by id, have fixed places; those of kind concept go along the upper and the lower edge in
    turn, four to a row; any other has a place in a grid around the middle by its number. ``order`` is the column of a
    concept's place in its document (the id if there is none)."""
    by = Window.partitionBy(doc).orderBy(order if order in concepts.columns else "id", "id")
    nth = F.row_number().over(by) - 1
    entity = F.row_number().over(Window.partitionBy(doc, F.col("kind") == "concept").orderBy(order if order in concepts.columns else "id", "id")) - 1
    fixed = lambda axis, size: F.coalesce(*(F.when(F.col("id") == k, F.lit(p[axis] * size)) for k, p in PLACES.items()))
    along = F.when(F.col("kind") == "concept", width * (0.12 + (entity % 4) * 0.25))
    across = F.when(F.col("kind") == "concept", height * F.when(entity % 2 == 0, 0.08).otherwise(0.92))
    return concepts.select(
        doc, F.col("id").alias("node_id"), "label", "kind", "confidence",
        F.coalesce(fixed(0, width), along, width * 0.5 + ((nth % 3) - 1) * 100).alias("x"),
        F.coalesce(fixed(1, height), across, height * 0.5 + (F.floor(nth / 3) - 1) * 90).alias("y"),
    )


def map_edges(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, source_id, target_id, relation: edges from the thesis to other nodes, where both are there."""
    template = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(r).alias("relation")) for a, b, r in TEMPLATE))
    wanted = nodes.select(doc, F.col("node_id").alias("source_id"), "kind", F.explode(template).alias("t")).where("kind = t.a")
    ends = nodes.select(doc, F.col("node_id").alias("target_id"), F.col("kind").alias("target_kind"))
    return wanted.join(ends, (wanted[doc] == ends[doc]) & (F.col("t.b") == F.col("target_kind"))).select(wanted[doc], "source_id", "target_id", "t.relation")


def keep_known(edges: DataFrame, nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Edges both of whose ends are nodes."""
    known = nodes.select(doc, "node_id").distinct()
    out = edges
    for end in ("source_id", "target_id"):
        out = out.join(known.withColumnRenamed("node_id", end), [doc, end], "left_semi")
    return out


def cards(papers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, title, authors (joined, or "Imported document"), year (or a dash)."""
    return papers.select(
        doc, "title", F.when(F.size("authors") > 0, F.array_join("authors", ", ")).otherwise("Imported document").alias("authors"),
        F.coalesce(F.col("year").cast("string"), F.lit("—")).alias("year"),
    )


def reference_links(concepts: DataFrame, doc: str = "doc_id", urls: str = "source_urls", own: str = "wikipedia_url") -> DataFrame:
    """doc, id and up to three of its addresses other than its own page and its item in the knowledge base."""
    outside = F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: ~u.eqNullSafe(F.col(own)) & ~F.contains(u, F.lit("wikidata.org/wiki/")))
    return concepts.select(doc, "id", F.slice(outside, 1, 3).alias("references"))


# What is told of a concept that the service didn't explain.
NO_RATIONALE = "No evidence-grounded explanation was returned by the analysis service."
NO_CONTEXT = "No supporting evidence was extracted for this concept."
VERIFY = "Verify this concept against the paper or cited literature."
#: Names of an explanation's fields in the user interface.
RENAMED = {
    "concept_id": "conceptId", "use_in_paper": "useInPaper", "support_status": "supportStatus", "simple_explanation": "simpleExplanation",
    "paper_context": "paperContext", "supporting_evidence": "supportingEvidence", "evidence_ids": "evidenceIds", "concept_type": "conceptType",
    "wikipedia_url": "wikipediaUrl", "wikidata_id": "wikidataId", "source_urls": "sourceUrls", "recognition_status": "recognitionStatus",
}


def fallback(concepts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """An explanation made from each concept itself: the columns of ``analysis.explanations``."""
    usage = F.element_at(F.create_map(*[F.lit(x) for kv in USAGE.items() for x in kv]), F.col("kind"))
    return concepts.select(
        doc, F.col("id").alias("concept_id"), F.col("label").alias("term"), "kind", F.col("description").alias("definition"), usage.alias("use_in_paper"),
        F.col("description").alias("simple_explanation"), F.lit(NO_CONTEXT).alias("paper_context"), F.lit("unsupported").alias("support_status"), F.lit(0.0).alias("score"),
        F.lit("low").alias("reliability"), F.lit(NO_RATIONALE).alias("rationale"), F.array(F.lit(VERIFY)).alias("limitations"),
    )


def with_fallback(concepts: DataFrame, explanations: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The explanations of each document; of documents without any, one made from each of their concepts."""
    made = fallback(concepts, doc).join(explanations.select(doc).distinct(), doc, "left_anti")
    return explanations.select(*made.columns).unionByName(made)


def for_interface(explanations: DataFrame) -> DataFrame:
    """The explanations under the user interface's names; other columns keep theirs."""
    return explanations.withColumnsRenamed(RENAMED)


def first_shown(concepts: DataFrame, relationships: DataFrame, explanations: DataFrame, doc: str = "doc_id", order: str = "pos") -> DataFrame:
    """doc, selected (the first concept's id), relationship (the first relationship's explanation) and limitation (the first
    one of the first concept's explanation), with what stands where there is none."""
    first = concepts.groupBy(doc).agg(F.min_by("id", order).alias("selected"))
    told = relationships.groupBy(doc).agg(F.min_by("explanation", order).alias("relationship"))
    limits = explanations.select(doc, F.col("concept_id").alias("selected"), F.try_element_at("limitations", F.lit(1)).alias("limitation")).dropDuplicates([doc, "selected"])
    return first.join(told, doc, "left").join(limits, [doc, "selected"], "left").select(
        doc, F.coalesce("selected", F.lit("thesis")).alias("selected"),
        F.coalesce(F.nullif("relationship", F.lit("")), F.lit("No strong overlap found yet. Add another paper to discover a connection.")).alias("relationship"), "limitation",
    )
