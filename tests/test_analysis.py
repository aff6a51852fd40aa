from foliospark.operators import analysis, concepts, graph

PAPER = """A careful study of rain
Abstract
We propose a gauge network for measuring rain in valleys.
Methods
We use a calibrated network of forty gauges across the valley.
Results
Our results show that accuracy improved by 12.5 percent overall.
The benchmark was evaluated on the valley corpus twice."""


def test_structure(spark):
    docs = spark.createDataFrame([(1, PAPER, "x"), (2, "", "x"), (3, None, "x")], "doc_id int, text string, thesis string")
    rows = {r["doc_id"]: r for r in analysis.structure(docs, query="gauge network").collect()}
    assert set(rows) == {1, 2}
    one = rows[1]
    assert [c["id"] for c in one["concepts"]] == ["thesis", "method", "finding", "experiment", "metric"]
    assert one["thesis"].startswith("We propose a gauge network")
    assert one["concepts"][4]["label"] == "accuracy (12.5 percent)"
    assert len(one["evidence"]) == 6 and one["relevance"] == 80
    assert all("line" in e["source_location"] for e in one["evidence"])
    assert rows[2]["relevance"] == 70 and len(rows[2]["evidence"]) == 5
    assert analysis.structure(docs.limit(0)).count() == 0


def fixture(spark):
    c = spark.createDataFrame(
        [("d", "a", "A", "method", "Does a.", ["e1", "e2"], 0.9), ("d", "b", "B", "finding", "Does b.", [], 0.7), ("d", "c", "C", "concept", "Does c.", ["gone"], 0.7)],
        "doc_id string, id string, label string, kind string, description string, evidence_ids array<string>, confidence double",
    )
    e = spark.createDataFrame(
        [("d", "e1", "Claim one.", "experiment", "text one", "line 1", 0.85), ("d", "e2", "Claim two.", "quote", "text two", None, 0.845)],
        "doc_id string, id string, claim string, kind string, excerpt string, source_location string, confidence double",
    )
    return c, e


def test_explanations_and_checks(spark):
    c, e = fixture(spark)
    rows = {r["concept_id"]: r for r in analysis.explanations(c, e).collect()}
    assert (rows["a"]["support_status"], rows["a"]["reliability"], rows["a"]["score"]) == ("partial", "high", 0.845)
    assert rows["a"]["paper_context"] == "Claim one. Claim two." and "84%" in rows["a"]["rationale"]
    assert rows["b"]["support_status"] == rows["c"]["support_status"] == "unsupported" and rows["b"]["score"] == 0.0
    assert [tuple(r) for r in analysis.dangling(c, e).collect()] == [("d", "c", "gone")]
    docs = spark.createDataFrame([("d", "text one and text two")], "doc_id string, text string")
    assert [tuple(r) for r in analysis.violations(c, e, docs).collect()] == [("d", 3, "gone")]
    q = analysis.quality(c, e).first()
    assert (round(q["citation_coverage"], 4), q["location_coverage"]) == (0.6667, 0.5)


def test_comparison(spark):
    current = spark.createDataFrame([("d", "Rain gauges extend valley networks"), ("n", None)], "doc_id string, text string")
    library = spark.createDataFrame([("p", "Valley rain gauges again"), ("q", "Nothing common")], "paper_id string, text string")
    rows = analysis.compare(current, library).collect()
    assert [(r["paper_id"], r["relationship_type"], r["n_shared"], r["shared"]) for r in rows] == [("p", "extends", 3, "gauges, rain, valley")]


def test_maps(spark):
    c, _ = fixture(spark)
    c = c.unionByName(c.limit(1).selectExpr("doc_id", "'t' as id", "'T' as label", "'thesis' as kind", "description", "evidence_ids", "confidence"))
    nodes = graph.map_nodes(c)
    edges = {(r["target_id"], r["relation"]) for r in graph.map_edges(nodes).collect()}
    assert edges == {("a", "uses"), ("b", "leads to"), ("c", "mentions")}
    assert graph.keep_known(graph.map_edges(nodes), nodes.where("node_id <> 'b'")).count() == 2


def test_concept_mining(spark):
    docs = spark.createDataFrame([("d", "Newton's third law of motion states it. The Bayesian attention model helps; the Bayesian attention model wins."), ("n", None)], "doc_id string, text string")
    mentions = concepts.pattern_mentions(docs)
    text = docs.first()["text"]
    for r in mentions.collect():
        assert text[r["start_char"] : r["end_char"]].split()[0] == r["term"].split()[0]
    ranked = [(r["term"], r["mentions"]) for r in concepts.candidates(mentions).orderBy("rank").collect()]
    assert ranked == [("Newton's third law of motion", 1), ("attention model", 1), ("Bayesian attention model", 1)]
    pages = spark.createDataFrame([("bayesian attention model", 1, "Attention model", "https://en.wikipedia.org/wiki/A", "Q1", "d", False)], "term string, rank int, title string, url string, wikidata_id string, description string, is_disambiguation boolean")
    items = spark.createDataFrame([("Q1", "l", "d", "algorithm", ["https://doi.org/10.1/x"])], "wikidata_id string, label string, description string, concept_type string, reference_urls array<string>")
    linked = concepts.link(concepts.candidates(mentions), pages, items).collect()
    assert [(r["wikidata_id"], r["recognition_status"]) for r in linked] == [("Q1", "source_supported")]
    claims = spark.createDataFrame([("Q1", '{"P31":[{"mainsnak":{"datavalue":{"value":{"id":"Q9"}}}}]}'), ("Q2", "bad")], "wikidata_id string, claims string")
    assert [tuple(r) for r in concepts.claim_items(claims).collect()] == [("Q1", "Q9")]
