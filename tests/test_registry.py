import datetime
import json

from foliospark.functions import text as T
from foliospark.plans import registry

ABSTRACT = "We study rain."
TEXT = "Gauges and rain\nThe valley  gauges were\nread every ninety minutes. We use the kriging model for the maps."
AT = datetime.datetime(2024, 1, 1)


def run(evidence, title="Gauges and rain", url=None):
    concepts = [{"id": "thesis", "label": "l", "kind": "thesis", "confidence": 0.5, "evidence_ids": [e for e, _ in evidence]}]
    return json.dumps({"paper": {"title": title, "source_url": url}, "concepts": concepts, "evidence": [{"id": e, "claim": "c", "kind": "quote", "confidence": 0.5, "excerpt": x} for e, x in evidence]})


def folder(spark, tmp_path):
    tables = {
        "papers": (
            [("p", "Gauges and rain", "https://a.org/p", ABSTRACT, AT), ("q", "Gauges and rain", "https://a.org/q", None, AT), ("r", "Unread", None, "The diffusion equation holds.", AT)],
            "doc_id string, title string, source_url string, abstract string, added_at timestamp",
        ),
        "reads": (
            [("p", 1, "Nothing of use."), ("p", 2, TEXT), ("p", 2, TEXT), ("p", 3, None), ("q", 4, "Another paper, on snow.")],
            "doc_id string, read_id long, text string",
        ),
        "evidence": (
            [("p", "e1", "the valley gauges were read…"), ("p", "e2", "An invented excerpt."), ("p", "e3", None), ("q", "e1", "The valley gauges were read"), ("r", "e1", "x")],
            "doc_id string, id string, excerpt string",
        ),
        "analysis_runs": (
            [
                ("good", run([("a", "valley gauges were read")])), ("bad", run([("a", "valley gauges were read"), ("b", "An invented excerpt.")])),
                ("other", run([("a", "valley gauges were read")], url="https://a.org/q")), ("address", run([("a", "valley gauges")], None, "https://a.org/p")),
                ("nameless", run([("a", "valley gauges")], None)),
            ],
            "run_id string, response_json string",
        ),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "evidence":
            df = df.selectExpr("*", "'c' as claim", "'quote' as kind", "'' as source_location", "0.5D as confidence", "timestamp'2024-01-01' as extracted_at", "'f' as feed_id")
        if name == "analysis_runs":
            df = df.selectExpr("*", "timestamp'2024-01-01' as created_at")
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_evidence_and_concepts_are_looked_for_in_the_reads(spark, tmp_path):
    at = folder(spark, tmp_path)
    known = registry.queries()
    anchored = {tuple(r) for r in known["t26_read_anchored"](spark, at).collect()}
    assert anchored == {("p", 3, 1), ("q", 1, 0), ("r", 1, 0)}
    broken = {tuple(r) for r in known["ov2_paper_violations"](spark, at).collect()}
    assert broken == {("bad", 5, "b"), ("other", 5, "a"), ("nameless", 5, "a")}
    found = {(r["doc_id"], r["read_id"], r["term"], r["start_char"]) for r in known["c3_candidates"](spark, at).collect()}
    kriging = next(x for x in found if x[:2] == ("p", 2))
    assert "kriging model" in kriging[2] and TEXT[kriging[3] :].startswith(kriging[2].split()[0])
    assert any(x[:2] == ("r", None) for x in found)


def test_anchored_as_by_plain_search(spark, tmp_path):
    at = folder(spark, tmp_path)
    plain = lambda t: " ".join(t.casefold().replace("…", "").split())
    texts = spark.read.parquet(f"{at}/reads.parquet").where("text is not null").collect()
    want = {}
    for e in spark.read.parquet(f"{at}/evidence.parquet").collect():
        hit = bool(e["excerpt"]) and any(plain(e["excerpt"]) in plain(t["text"]) for t in texts if t["doc_id"] == e["doc_id"])
        n, k = want.get(e["doc_id"], (0, 0))
        want[e["doc_id"]] = (n + 1, k + hit)
    assert {r["doc_id"]: (r["n"], r["n_anchored"]) for r in registry.t26_read_anchored(spark, at).collect()} == want
    assert spark.createDataFrame([("A b…", " a\n B c")], "e string, s string").select(T.is_anchored("e", "s")).first()[0]
