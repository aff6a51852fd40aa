import json

from pyspark.sql import functions as F

from foliospark.operators import analysis, concepts, graph, store
from foliospark.plans import registry


def test_references_keep_their_order(spark):
    claims = {
        "P31": [{"mainsnak": {"property": "P31", "datavalue": {"value": {"id": "Q408891"}}}, "references": [{"snaks": {"P854": [{"datavalue": {"value": "http://b.org/2"}}, {"datavalue": {"value": "ftp://no"}}]}}]}],
        "P356": [{"mainsnak": {"property": "P356", "datavalue": {"value": "10.1/x"}}, "references": [{"snaks": {"P854": [{"datavalue": {"value": "http://a.org/1"}}]}}]}],
        "P279": [{"mainsnak": {"property": "P279", "datavalue": {"value": {"id": "Q1"}}}}],
        "P1": [{"mainsnak": {"property": "P1"}}],
    }
    items = spark.createDataFrame([("Q9", json.dumps(claims)), ("Q8", "{}"), ("Q7", None), ("Q6", "no json")], "wikidata_id string, claims string")
    found = {r["wikidata_id"]: r["reference_urls"] for r in concepts.claim_references(items).collect()}
    assert found == {"Q9": ["http://b.org/2", "http://a.org/1", "https://doi.org/10.1/x"]}
    assert {(r[0], r[1]) for r in concepts.claim_items(items).collect()} == {("Q9", "Q408891"), ("Q9", "Q1")}


def test_typed_items(spark):
    items = spark.createDataFrame([("a", None, "x"), ("b", None, "x"), ("c", None, "x"), ("d", None, "x")], "wikidata_id string, concept_type string, label string")
    types = spark.createDataFrame([("a", "Q8366"), ("b", "Q2"), ("c", "Q3"), ("b", "Q2")], "wikidata_id string, item_id string")
    labels = spark.createDataFrame([("Q2", "Software architecture"), ("Q3", "town")], "item_id string, label string")
    assert {r["wikidata_id"]: r["concept_type"] for r in concepts.typed_items(items, types, labels).collect()} == {"a": "algorithm", "b": "Software architecture"}
    assert {r["wikidata_id"]: r["concept_type"] for r in concepts.typed_items(items, types).collect()} == {"a": "algorithm"}
    assert concepts.typed_items(items.limit(0), types, labels).count() == 0


def test_linked_concept_with_sources_and_rows(spark):
    text = "(Abstract)\nNewton's law of gravitation states that masses attract. We introduce a plain survey of the law of gravitation for readers."
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", "  ")], "doc_id string, text string")
    mined = concepts.candidates(concepts.pattern_mentions(docs.where("text is not null"))).collect()
    terms = [r["term"] for r in mined]
    assert any(t.lower().endswith("law of gravitation") for t in terms) and not any("states" in t for t in terms)
    pages = spark.createDataFrame([(t, k, "Law of gravitation", "https://en.wikipedia.org/wiki/Law", "Q11412", "page", False) for t in terms for k in (1, 2)] + [(terms[0], 0, terms[0], "u", "Q0", "", True)],
                                  "term string, rank int, title string, url string, wikidata_id string, description string, is_disambiguation boolean")
    items = spark.createDataFrame([("Q11412", "gravitation", "how masses attract", "scientific law", ["https://doi.org/10/g"])], "wikidata_id string, label string, description string, concept_type string, reference_urls array<string>")
    refs = spark.createDataFrame([("Law of gravitation", "https://www.nature.com/z", 0), ("Law of gravitation", "https://arxiv.org/a", 1), ("Law of gravitation", "https://x.com", 2)], "title string, url string, n int")
    named = concepts.named_concepts(docs, pages, items, refs).collect()
    assert len(named) == 1 and named[0]["recognition_status"] == "source_supported"
    assert named[0]["source_urls"] == ["https://en.wikipedia.org/wiki/Law", "https://www.wikidata.org/wiki/Q11412", "https://doi.org/10/g", "https://www.nature.com/z", "https://arxiv.org/a"]
    assert named[0]["excerpt"].startswith("(Abstract) Newton's law")
    structure = analysis.structure(docs)
    rows = analysis.entity_rows(structure, concepts.named_concepts(docs, pages, items, refs))
    row = rows.first()
    assert row["id"] == "entity-1" and row["evidence_ids"] == ["evidence-entity-1"] and row["source_location"].startswith("line 2 (character ") and row["description"].startswith("Scientific Law documented as ")
    assert analysis.all_concepts(structure, rows).where("doc_id = 'd'").count() == 6 and analysis.all_evidence(structure, rows).where("doc_id = 'd'").count() == 6
    own = concepts.named_concepts(docs, pages, items, refs).withColumn("term", F.lit(structure.first()["concepts"][0]["label"].upper()))
    assert analysis.entity_rows(structure, own).count() == 0
    assert concepts.named_concepts(docs.limit(0), pages, items, refs).count() == 0


def test_input_rules(spark):
    rows = spark.createDataFrame([("a", "url", "https://x.org/p"), ("b", "url", "not-a-url"), ("c", "text", " "), ("d", "text", "words"), ("e", None, None)], "id string, source_type string, source string")
    assert {r["id"]: r["status"] for r in analysis.validate_input(rows).collect()} == {"a": "validated", "b": "failed", "c": "failed", "d": "validated", "e": "failed"}


def test_output_rules_find_each_fault(spark):
    def concept(doc, id_="thesis", kind="thesis", label="l", evidence=("e1",), confidence=0.5):
        return (doc, id_, label, kind, list(evidence), confidence)

    def piece(doc, id_="e1", kind="quote", excerpt="We measured the rain.", claim="c", confidence=0.5):
        return (doc, id_, claim, kind, excerpt, confidence)

    c = [concept("ok"), concept("shape", confidence=1.5), concept("twice"), concept("same"), concept("same"), concept("lost", evidence=("e1", "e9")), concept("bare", evidence=()), concept("loose")]
    e = [piece(d) for d in ("ok", "shape", "twice", "same", "lost", "bare")] + [piece("twice"), piece("loose", excerpt="Invented words that nobody wrote."), piece("kind", kind="rumour")]
    cs = spark.createDataFrame(c, "doc_id string, id string, label string, kind string, evidence_ids array<string>, confidence double")
    es = spark.createDataFrame(e, "doc_id string, id string, claim string, kind string, excerpt string, confidence double")
    texts = spark.createDataFrame([(d, "On that day we  measured THE rain. Then more.") for d in ("ok", "shape", "twice", "same", "lost", "bare", "loose", "kind")], "doc_id string, text string")
    assert {r["doc_id"]: (r["rule"], r["detail"]) for r in analysis.violations(cs, es, texts).collect()} == {
        "shape": (0, "thesis"), "kind": (0, "e1"), "twice": (1, "e1"), "same": (2, "thesis"), "lost": (3, "e9"), "bare": (4, "thesis"), "loose": (5, "e1"),
    }
    told = spark.createDataFrame([("ok", "thesis"), ("ok", "thesis"), ("lost", "ghost")], "doc_id string, concept_id string")
    wrong = {(r["doc_id"], r["concept_id"]): r["error"] for r in analysis.invalid_explanations(told, cs.where("doc_id in ('ok', 'lost')")).collect()}
    assert wrong == {("ok", "thesis"): "twice", ("lost", "ghost"): "unknown", ("lost", "thesis"): "missing"}


def test_injected_faults_break_every_rule(spark):
    found = {r["rule"] for r in registry.ov2_injected(spark, "/root/testdata/sf0.01").collect()}
    assert {1, 2, 3, 4, 5} == found


def test_relationships_of_every_kind(spark):
    from foliospark.functions import text as T

    rows = [("We extend prior work", "extends"), ("These results contradict it", "contradicts"), ("This fails to hold", "contradicts"), ("Our data support the claim", "supports"), ("A plain sentence", "similar"), ("It builds on and confirms", "extends"), (None, None)]
    out = spark.createDataFrame(rows, "t string, want string").where("t is not null").select("want", T.relationship(F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in out)


def test_documents_text(spark):
    rows = [("d", 2, "  second \n", None), ("d", 1, " ", ["a", "b"]), ("d", 3, None, None), ("e", 1, None, [])]
    scans = spark.createDataFrame(rows, "doc_id string, n int, source_text string, paragraphs array<string>")
    assert [tuple(r) for r in analysis.documents_text(scans).collect()] == [("d", "a\n\nb\n\nsecond")]


def test_responses_and_forms(spark):
    states = spark.createDataFrame(
        [("a", "completed", "pdf", True, ["w"], ["e"], ["t1", "t2"], "text", 2, 1, True), ("b", "completed", None, None, None, None, None, None, None, None, False), ("c", "retrying", "text", False, [], [], [], "", 0, 0, True)],
        "run_id string, status string, document_format string, ocr_used boolean, warnings array<string>, errors array<string>, trace array<string>, text string, n_chunks int, retry_count int, has_analysis boolean",
    )
    cs = spark.createDataFrame([("a", ["e1"]), ("a", [])], "run_id string, evidence_ids array<string>")
    es = spark.createDataFrame([("a", "line 1"), ("a", None)], "run_id string, source_location string")
    out = {r["run_id"]: r for r in store.responses(states, cs, es).collect()}
    assert out["a"]["status"] == "completed" and out["a"]["warnings"] == ["w", "e"] and out["a"]["usage"].asDict() == {"input_characters": 4, "chunk_count": 2, "retries": 1}
    assert out["a"]["quality"].asDict() == {"schema_valid": 1.0, "citation_coverage": 0.5, "evidence_location_coverage": 0.5, "retry_count": 1.0}
    assert out["b"]["status"] == "failed" and out["b"]["quality"] is None and out["b"]["trace"] == [] and out["c"]["status"] == "failed"
    forms = spark.createDataFrame([("x", '[{"id":"1","title":"t","concepts":["c"]},{"id":"2","title":"u"}]'), ("y", "[]"), ("z", '{"id":"1"}'), ("v", "nonsense"), ("u", '[{"title":"t"}]'), ("w", None)], "request_id string, existing_papers string")
    rows = {(r["request_id"], r["n"]): (r["id"], r["error"] is not None) for r in store.existing_papers(forms).collect()}
    assert rows == {("x", 0): ("1", False), ("x", 1): ("2", False), ("z", 0): (None, True), ("v", 0): (None, True), ("u", 0): (None, True)}


def test_map_and_fallback(spark):
    cs = spark.createDataFrame(
        [("d", 0, "thesis", "L", "thesis", "D", ["e1"], 0.9), ("d", 1, "entity-1", "M", "concept", "E", ["e1", "e2"], 0.9), ("d", 2, "entity-2", "N", "concept", "E", [], 0.9), ("d", 3, "other", "O", "metric", "E", [], 0.9), ("f", 0, "thesis", "L", "thesis", "D", [], 0.9)],
        "doc_id string, pos int, id string, label string, kind string, description string, evidence_ids array<string>, confidence double",
    )
    at = {r["node_id"]: (round(r["x"], 6), round(r["y"], 6)) for r in graph.map_nodes(cs.where("doc_id = 'd'"), width=100, height=100).collect()}
    assert at == {"thesis": (50, 50), "entity-1": (12, 8), "entity-2": (37, 92), "other": (50 - 100, 50)}
    assert {r["doc_id"]: r["n_evidence_named"] for r in analysis.evidence_count(cs).collect()} == {"d": 2, "f": 0}
    es = spark.createDataFrame([("d", "e1", "claim", "quote", "x", "line 1", 0.7)], "doc_id string, id string, claim string, kind string, excerpt string, source_location string, confidence double")
    told = analysis.explanations(cs, es).where("doc_id = 'd'")
    shown = {(r["doc_id"], r["conceptId"]): r for r in graph.for_interface(graph.with_fallback(cs, told)).collect()}
    assert shown["f", "thesis"]["paperContext"] == "No supporting evidence was extracted for this concept." and shown["f", "thesis"]["rationale"].startswith("No evidence-grounded")
    assert shown["d", "thesis"]["supportStatus"] == "contextual" and len(shown) == 5
    links = spark.createDataFrame([("d", 1, "later"), ("d", 0, "")], "doc_id string, pos int, explanation string")
    first = {r["doc_id"]: (r["selected"], r["relationship"][:9], r["limitation"] is not None) for r in graph.first_shown(cs, links, told).collect()}
    assert first == {"d": ("thesis", "No strong", True), "f": ("thesis", "No strong", False)}
    refs = spark.createDataFrame([("d", "a", ["https://w.org/own", "https://www.wikidata.org/wiki/Q1", "u1", "u2", "u3", "u4"], "https://w.org/own"), ("d", "b", None, None)], "doc_id string, id string, source_urls array<string>, wikipedia_url string")
    assert {r["id"]: r["references"] for r in graph.reference_links(refs).collect()} == {"a": ["u1", "u2", "u3"], "b": []}
