import json

import pytest

from foliospark.operators import shred, store
from foliospark.operators.records import Unreadable, read

RUN = {
    "run_id": "r",
    "concepts": [{"id": "a", "evidence_ids": ["e1", None, "e2"]}, None, {"id": "b", "evidence_ids": "e3", "source_urls": ["u", "v"]}],
    "evidence": {"id": "e1"},
    "concept_explanations": [{"concept_id": "a", "supporting_evidence": {"evidence_id": "e1"}, "reliability": {"limitations": ["x", "y"]}}],
    "relationships": [{"paper_ids": ["p1"]}],
    "warnings": "only one",
    "trace": None,
}
EXPECTED = {
    ("concepts", "r", "a"), ("concepts", "r", "b"), ("concept_evidence", "a", "e1"), ("concept_evidence", "a", "e2"), ("concept_evidence", "b", "e3"),
    ("concept_urls", "b", "0"), ("concept_urls", "b", "1"), ("evidence", "r", "e1"), ("explanations", "r", "a"), ("explanation_evidence", "a", "e1"),
    ("explanation_limitations", "a", "0"), ("explanation_limitations", "a", "1"), ("relationships", "r", "0"), ("relationship_papers", "0", "p1"), ("warnings", "r", "0"),
}


def runs(spark, rows):
    return spark.createDataFrame(rows, "run_id string, created_at timestamp, response_json string, path string")


def test_elements_in_any_envelope(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    for text in (json.dumps(RUN), "﻿" + json.dumps(RUN), json.dumps(json.dumps(RUN)), json.dumps({"event": "x", "response": RUN})):
        found = {(r["entity"], r["parent_id"], r["item_id"]) for r in shred.run_elements(runs(spark, [("r", t, text, "p")])).collect()}
        assert found == EXPECTED


def test_latest_row_and_unreadable_texts(spark):
    from datetime import datetime

    old, new = datetime(2024, 1, 1), datetime(2024, 2, 1)
    rows = [("r", old, json.dumps(RUN), "p"), ("r", new, json.dumps({"warnings": ["w"]}), "p"), ("r", new, json.dumps({"warnings": ["w"]}), "p"),
            ("s", old, "{broken", "p"), ("t", old, None, "p"), ("u", old, "", "p"), ("v", None, "[1, 2]", "p"), (None, old, json.dumps(RUN), "p")]
    assert [tuple(r) for r in shred.run_elements(runs(spark, rows)).collect()] == [("r", "warnings", "r", "0")]
    assert shred.run_elements(runs(spark, rows).limit(0)).count() == 0
    assert store.recent(runs(spark, rows), 1).first()["run_id"] == "r"
    assert store.get_run(runs(spark, rows), "s").count() == 1


def test_tables_lead_to_parents(spark):
    from datetime import datetime

    tables = shred.run_tables(runs(spark, [("r", datetime(2024, 1, 1), json.dumps(RUN), "p")]))
    assert {tuple(r["ordinals"]): r["id"] for r in tables["concepts"].collect()} == {(0,): "a", (2,): "b"}
    assert {tuple(r["ordinals"]): r["evidence_id"] for r in tables["concept_evidence"].collect()} == {(0, 0): "e1", (0, 2): "e2", (2, 0): "e3"}


def test_deep_nesting_and_long_texts(spark):
    from datetime import datetime

    levels = 10_000
    deep = '{"a":' * levels + '"end"' + "}" * levels
    assert len(read(deep)) == levels + 1 and read(deep)[-1][3] == "end"
    assert read('{"a":' + "[" * levels + "7" + "]" * levels + "}")[-1][1] == [0] * levels
    assert read(json.dumps({"a": "x" * 100_000}))[1][3] == "x" * 100_000
    text = '{"warnings":["w"],"extra":' + deep + "}"
    assert [r["item_id"] for r in shred.run_elements(runs(spark, [("r", datetime(2024, 1, 1), text, "p")])).collect()] == ["0"]


def test_reader_agrees_with_the_plain_one():
    values = [1, -2.5e3, "a", 'q"\\\n\u00e9', "", True, False, None, [], {}, [1, [2, {"x": None}]], {"k": [{"z": 1}, "s"]}]
    for v in values:
        for text in (json.dumps({"v": v, "w": v}), json.dumps({"v": v, "w": v}, indent=2)):
            want = []

            def walk(path, ordinals, x):
                if isinstance(x, dict):
                    want.append((path, ordinals, "object", None))
                    [walk(f"{path}.{k}" if path else k, ordinals, y) for k, y in x.items()]
                elif isinstance(x, list):
                    [walk(path + "[]", [*ordinals, i], y) for i, y in enumerate(x)]
                elif x is not None:
                    kind = "boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "number"
                    want.append((path, ordinals, kind, x if kind == "string" else json.dumps(x)))

            walk("", [], json.loads(text))
            assert read(text) == want


def test_reader_edges():
    assert [t[0] for t in read('{"a.b":1,"a":{"b":2},"c[]":3}')] == ["", "a\\.b", "a", "a.b", "c\\[\\]"]
    assert read('{"a":{"x":1},"a":2}') == [("", [], "object", None), ("a", [], "number", "2")]
    assert read('{"response":{"a":1},"b":2}', wrappers=("response",)) == read('{"a":1}') == read(json.dumps('{"a":1}'))
    assert read('{"l":"x"}', frozenset({"l"}))[-1] == ("l[]", [0], "string", "x")
    for bad in ('{"a":1,}', '{"a" 1}', "[1]", '{"a":1} x', '{"a":[1,]}', "{", '{"a":[}', '{"a":01}', '{"a":tru}', '""', "", "7", '{"a":"\n"}'):
        with pytest.raises(Unreadable):
            read(bad)


def test_unknown_fields_and_unreadable_texts_are_kept(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    tables = shred.run_tables(runs(spark, [("r", t, json.dumps({**RUN, "usage": {"retries": 2}, "concepts": [{"id": "a", "odd": "o"}]}), "p"), ("s", t, "{", "p")]))
    assert tables["concepts"].first()["rest"] == {"odd": "o"}
    assert tables["runs"].where("run_id = 'r'").first()["rest"]["usage.retries"] == "2"
    assert [r["run_id"] for r in tables["unreadable"].collect()] == ["s"]


def test_model_output(spark):
    from pyspark.sql import functions as F

    rows = [('{"content":[{"text":"a"},{"text":"b"}]}', "ab"), ('{"output":{"message":{"content":[{"text":"c"}]}}}', "c"), ('{"completion":"d"}', "d"), ("{}", None)]
    out = spark.createDataFrame(rows, "raw string, want string").select("want", store.provider_text(F.col("raw")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in out)
    texts = [('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {bad} {"b": 2} end', '{"b": 2}'), ("none", None), (None, None)]
    out = spark.createDataFrame(texts, "t string, want string").select("want", store.json_object(F.col("t")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in out)
