import json

from plumbline import cli
from plumbline.streaming import events


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    q = events.activity(events.read_stream(spark, str(tmp_path / "in"), table.schema)).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (str(r["start"]), r["event_type"], r["n"])
    assert sorted(map(key, spark.table("seen").collect())) == sorted(map(key, events.activity(table).collect()))


def test_commands(spark, tmp_path, capsys):
    ev = {"kind": "OBSERVED", "resolution": "EXACT", "confidence": None}
    body = {
        "schema_version": "0.3.0",
        "nodes": [{"id": "dataset:work.a", "type": "Dataset", "label": "a"}, {"id": "step:001", "type": "Step", "label": "data"}],
        "edges": [{"id": "edge:001", "type": "reads_dataset", "from": "dataset:work.a", "to": "step:001", "evidence": ev}],
        "findings": [{"id": "finding:001:x", "type": "x", "status": "SUPPORTED", "object": "o", "message": "m", "affected_nodes": ["step:001"], "affected_edges": ["edge:001"]}],
    }
    path = tmp_path / "g.json"
    path.write_text(json.dumps(body))
    assert cli.main(["validate", str(path)], spark) == 0
    capsys.readouterr()
    assert cli.main(["query-lineage", str(path), "dataset:work.a"], spark) == 0
    assert json.loads(capsys.readouterr().out)["nodes"][0]["id"] == "step:001"
    assert cli.main(["explain-edge", str(path), "edge:001"], spark) == 0
    assert "finding:001:x" in capsys.readouterr().out
    assert cli.main(["query-lineage", str(path), "nobody"], spark) == 2
    assert cli.main(["nonsense"], spark) == 2
