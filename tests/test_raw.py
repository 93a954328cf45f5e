"""Raw records of a graph's document, long adjacency lists, and envelopes."""

import json

import pytest

from plumbline import cli
from plumbline.operators import raw, view
from plumbline.sources import sinks


def told(spark, tmp_path, body):
    path = tmp_path / "graph.json"
    path.write_text(body if isinstance(body, str) else json.dumps(body, indent=1))
    return [(r["section"], r["place"], r["object"], r["problem"]) for r in raw.in_order(raw.problems(*raw.read(spark, str(path)))).collect()]


def test_all_problems_of_a_document_in_its_order(spark, tmp_path, capsys):
    nodes = [{"id": "a", "type": "Dataset", "label": "a"}, 7, {"id": 3, "type": 4}, {"id": "a", "type": None, "label": None}, {"label": "x"}, {"id": "s", "type": "Step", "label": "s"}, {"id": 3, "type": "Step", "label": "s"}]
    edges = [
        {"id": "e1", "type": "reads_dataset", "from": "a", "to": "s"},
        {"id": "e2", "type": "reads_dataset", "from": "s", "to": "a", "evidence": []},
        {"id": None, "type": "x", "from": 3, "to": "gone", "evidence": {"kind": "UNKNOWN", "resolution": None, "confidence": 1}},
        {"from": "a"},
        None,
    ]
    got = told(spark, tmp_path, {"schema_version": "0.3.0", "nodes": nodes, "edges": edges})
    assert got == [
        ("nodes", 1, "at 1", "is no object"), ("nodes", 2, "3", "missing key label"), ("nodes", 2, "3", "unknown type"), ("nodes", 2, "3", "id is no string"), ("nodes", 3, '"a"', "unknown type"), ("nodes", 3, '"a"', "duplicate id"),
        ("nodes", 4, "at 4", "missing key id"), ("nodes", 4, "at 4", "missing key type"), ("nodes", 6, "3", "id is no string"), ("nodes", 6, "3", "duplicate id"),
        ("edges", 1, '"e2"', "evidence is no object"), ("edges", 1, '"e2"', "illegal endpoints"), ("edges", 2, "null", "unknown evidence resolution"), ("edges", 2, "null", "unknown evidence with confidence"), ("edges", 2, "null", "unknown type"),
        ("edges", 2, "null", "from is no string"), ("edges", 2, "null", "dangling to"), ("edges", 3, "at 3", "missing key id"), ("edges", 3, "at 3", "missing key type"), ("edges", 3, "at 3", "missing key to"), ("edges", 4, "at 4", "is no object"),
    ]
    assert cli.main(["validate", str(tmp_path / "graph.json")], spark) == 1
    assert [p["problem"] for p in json.loads(capsys.readouterr().out)] == [p for *_, p in got]


def test_envelopes(spark, tmp_path):
    assert told(spark, tmp_path, [1]) == [("graph", 0, "graph", "graph is no object")] == told(spark, tmp_path, "not json")
    assert [p for *_, p in told(spark, tmp_path, {"nodes": 1, "edges": None})] == ["missing key schema_version", "nodes is no list", "edges is no list"]
    assert [p for *_, p in told(spark, tmp_path, {"schema_version": 3})] == ["unsupported schema version", "missing collection nodes", "missing collection edges"]
    assert told(spark, tmp_path, {"schema_version": "0.2.0", "nodes": [], "edges": []}) == []
    up = sinks.upgraded({"schema_version": "0.2.0", "schema": {"capabilities": ["x"]}, "run_id": "r"})
    assert up["schema_version"] == "0.3.0" and up["schema"]["capabilities"] == ["x", "evidence_v1"] and up["run_id"] == "r"
    assert sinks.upgraded({"schema_version": "0.2.0"})["schema"]["capabilities"][-1] == "evidence_v1"
    with pytest.raises(ValueError):
        sinks.upgraded({"schema_version": "0.3.0"})


def test_a_hub_makes_many_rows(spark):
    hub = [(f"e{k:05}", "reads_dataset", "hub", f"n{k}") for k in range(1000)] + [("x", "reads_dataset", "a", "hub"), ("y", "writes_dataset", "hub", "n1"), ("x", "reads_dataset", "a", "hub")]
    got = view.adjacency_chunks(spark.createDataFrame(hub, "id string, type string, src string, dst string").repartition(5), "out", 64).collect()
    rows = {(r["node"], r["type"], r["chunk"]): r["edges"] for r in got}
    assert len(rows) == len(got) == 16 + 2 and [len(rows["hub", "reads_dataset", k]) for k in range(16)] == [64] * 15 + [40]
    assert sum((rows["hub", "reads_dataset", k] for k in range(16)), []) == [f"e{k:05}" for k in range(1000)] and rows["a", "reads_dataset", 0] == ["x", "x"]
