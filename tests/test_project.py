"""Projects by configuration, and what a viewer shows."""

import json

import pytest

from plumbline import cli
from plumbline.operators import view
from plumbline.sources import config, contracts, programs, sinks


def project(tmp_path, **more):
    texts = {
        "main.sas": "%include 'inc.sas'; %let who = me; %go(data=&lib..x); %gm_doc(a=1);",
        "inc.sas": "data &who; set raw.a; run;",
        "setup.sas": "%macro s; %let lib = raw; %let who = you; %mend; %s;",
        "macros/go.sas": "%macro go(data=); proc sort data=&data; by k; run; %mend;",
        "docs/gm_doc.md": "# gm_doc\n## Purpose\nText.\n\n| Parameter | Default Value |\n|---|---|\n| a | REQUIRED |\n",
        "logs/x.sas": "data never; run;",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    body = {"main_program": "main.sas", "setup_file": "setup.sas", "allowed_roots": ".", "macro_roots": ["macros"], "macro_contracts": "docs", "output_dir": "out"} | more
    (tmp_path / "project.yaml").write_text(json.dumps(body))  # JSON is YAML
    return str(tmp_path / "project.yaml")


def test_config_tells_all_problems(tmp_path):
    path = project(tmp_path, main_program=["gone.sas", "../out.sas", "logs/x.sas"], setup_file=["a", "b"], macro_roots=["nowhere"], output_dir=None)
    found = config.read(path)
    assert {p.type for p in found.problems} == {"config_file_missing", "config_outside_allowed_roots", "config_prohibited_artifact", "config_multiple_setup_files", "config_declared_root_missing", "config_missing_key"} and found.blocked
    assert not config.read(project(tmp_path)).problems
    (tmp_path / "bad.yaml").write_text("a: [")
    assert config.read(str(tmp_path / "bad.yaml")).problems[0].type == "config_malformed_yaml"


def test_run_by_config(spark, tmp_path, capsys):
    assert cli.main(["run", "--config", project(tmp_path)], spark) == 0
    run = json.loads(capsys.readouterr().out)
    edges = spark.read.parquet(str(tmp_path / "out" / run["run_id"] / "edges"))
    wrote = {(r["src"], r["dst"]) for r in edges.where("type = 'writes_dataset'").collect()}
    assert wrote == {("step:001", "dataset:work.you"), ("step:002", "dataset:raw.x"), ("macrocall:001", "dataset:raw.x")}
    refs = {tuple(r["derivation_refs"]) for r in edges.where("derivation_refs IS NOT NULL").collect()}
    assert refs == {("macrocall:001", "macrodefinition:go")}
    findings = {r["type"] for r in spark.read.parquet(str(tmp_path / "out" / run["run_id"] / "findings")).collect()}
    assert {"main_program_rebinds_setup_macro_variable", "macro_contract_matched"} <= findings and "include_file_missing" not in findings
    assert cli.main(["run", "--config", project(tmp_path, setup_file=None)], spark) == 1
    assert cli.main(["run"], spark) == 2


def test_a_run_has_its_setup_and_all_findings(spark, tmp_path, capsys):
    path = project(tmp_path, main_program=["main.sas", "two.sas"], macro_roots=["macros", "nowhere"])
    (tmp_path / "setup.sas").write_text("%let lib = raw; libname t work; proc sort data=raw.base out=sorted; by k v; run; %include 'inc/deep.inc';")
    (tmp_path / "inc").mkdir()
    (tmp_path / "inc" / "deep.inc").write_text("%let deep = 1; %let more = 2; %macro late(d=); data &d; set t.q; run; %mend;")
    (tmp_path / "two.sas").write_text("%include 'inc/deep.inc'; %late(d=z); data m; merge sorted x; by v; run; %include 'logs/x.sas'; %include 'inc'; %include '/etc/none.sas'; %include 'inc/gone.sas';")
    assert cli.main(["run", "--config", path], spark) == 0
    run = json.loads(capsys.readouterr().out)
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / run["run_id"] / name))
    assert run["status"] == "PARTIAL" and [r["run_id"] for r in sinks.runs(spark, str(tmp_path / "out")).collect()] == [run["run_id"]]
    nodes = {r["id"]: r for r in read("nodes").collect()}
    setup = str(tmp_path / "setup.sas")
    assert nodes[f"setup:{setup}"]["type"] == "SetupFile" and {"macrovar:lib@0", "macrovar:deep@5"} <= set(nodes)
    assert f"macrovar:{tmp_path / 'two.sas'}:deep@0" in nodes and nodes["macrodefinition:late"]["type"] == "MacroDefinition"
    edges = read("edges").collect()
    assert (f"setup:{setup}", "step:001") in {(e["src"], e["dst"]) for e in edges if e["type"] == "contains_step"}
    assert ("dataset:t.q", "macrocall") in {(e["src"], e["dst"].split(":")[0]) for e in edges if e["type"] == "reads_dataset"}
    found = [(r["id"].split(":")[1], r["type"], r["object"]) for r in read("findings").collect()]
    kinds = {t for _, t, _ in found}
    assert {"config_declared_root_missing", "include_prohibited_artifact", "include_file_unreadable", "include_outside_allowed_roots", "include_file_missing", "merge_by_not_prefix_of_sort_by"} <= kinds
    assert min(found)[1] == "config_declared_root_missing"  # the configuration's own come first
    assert {o for _, t, o in found if t == "dataset_read_never_written"} == {"raw.base", "raw.a"}  # t.q is in WORK, raw.x is sorted in place
    manifest = read("manifest")
    body = json.loads(manifest.where("configuration <> '{}'").first()["configuration"])
    assert body["programs"] == [str(tmp_path / "main.sas"), str(tmp_path / "two.sas")] and str(tmp_path / "inc" / "deep.inc") in {r["path"] for r in manifest.collect()}


def test_a_file_that_changes_during_a_run_stops_it(spark, tmp_path, monkeypatch):
    path = project(tmp_path)
    whole = programs.graph

    def late(found):
        out = whole(found)
        (tmp_path / "inc.sas").write_text("data other; run;")
        return out

    monkeypatch.setattr(programs, "graph", late)
    with pytest.raises(programs.SourceChanged):
        cli.main(["run", "--config", path], spark)
    assert sinks.runs(spark, str(tmp_path / "out")).count() == 0 and not [x for x in (tmp_path / "out").iterdir() if x.is_dir()]


def test_a_crash_between_tables_leaves_no_run(spark, tmp_path):
    name = sinks.reserve(spark, str(tmp_path))
    good = spark.range(3)
    with pytest.raises(Exception, match="boom"):
        sinks.write_tables(str(tmp_path), name, nodes=good, edges=good.selectExpr("raise_error('boom') AS x"))
    assert (tmp_path / f"_unfinished-{name}" / "nodes").exists() and sinks.runs(spark, str(tmp_path)).count() == 0
    other = sinks.reserve(spark, str(tmp_path))
    sinks.write_tables(str(tmp_path), other, nodes=good)
    assert sinks.latest_run(sinks.runs(spark, str(tmp_path))).first()["run_id"] == other and not (tmp_path / other / "_reserved").exists()
    with pytest.raises(RuntimeError):
        sinks.write_tables(str(tmp_path), other, nodes=good)
    sinks.remove_run(spark, str(tmp_path), name)
    assert not (tmp_path / f"_unfinished-{name}").exists()


def test_wanted_contracts(spark):
    docs = spark.createDataFrame([("/d/GM_a.md", ""), ("/d/sub/gm_b.md", ""), ("/d/gm_c.md", "")], "path string, text string")
    names = lambda called: {r["path"] for r in contracts.wanted(docs, ["/d"], spark.createDataFrame([(c,) for c in called], "name string")).collect()}
    assert names(["gm_a", "GM_B"]) == {"/d/GM_a.md"} and len(names([])) == 3


def test_views(spark):
    nodes = spark.createDataFrame([("dataset:lib.a", "Dataset", "lib.a"), ("step:1", "Step", None), ("dataset:lib.b", "Dataset", "lib.b"), ("macrocall:1", "MacroCall", "m"), ("p1", "MacroParameter", "x"), ("p2", "MacroParameter", "a")], "id string, type string, label string").selectExpr("*", "id AS value", "CASE WHEN type = 'Step' THEN NULL ELSE 'f' END AS file")
    edges = spark.createDataFrame([("e2", "reads_dataset", "dataset:lib.a", "step:1"), ("e1", "writes_dataset", "step:1", "dataset:lib.b"), ("e3", "passes_parameter", "macrocall:1", "p1"), ("e4", "passes_parameter", "macrocall:1", "p2"), ("e5", "calls_macro", "step:1", "macrocall:1")], "id string, type string, src string, dst string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert view.hit_set(nodes) is None and rows(view.hit_set(nodes, click="step:1", kind="Dataset")) == {("step:1",)}
    some = nodes.where("id IN ('dataset:lib.a', 'step:1')")
    assert rows(view.hit_set(nodes, searched=some)) == {("dataset:lib.a",), ("step:1",)} and rows(view.hit_set(nodes, searched=some, library="other")) == {("step:1",)}
    near = spark.createDataFrame([("dataset:lib.a", 0), ("step:1", 1), ("dataset:lib.b", 4)], "node string, dist int")
    assert dict(rows(view.edge_opacity(edges, near))) == {"e2": 0.9, "e1": 0.15, "e3": 0.03, "e4": 0.03, "e5": 0.03}
    assert dict(rows(view.edge_opacity(edges, near, "macrocall:1")))["e3"] == 0.9 and set(dict(rows(view.edge_opacity(edges, None))).values()) == {0.5}
    hits = nodes.where("id = 'p1'")
    assert dict(rows(view.node_opacity(nodes, hits, near.limit(0), near, "p2"))) == {"dataset:lib.a": 1.0, "step:1": 1.0, "dataset:lib.b": 1.0, "macrocall:1": 0.1, "p1": 1.0, "p2": 1.0}
    pairs = spark.createDataFrame([("dataset:lib.a", "dataset:lib.b", "disconnected"), ("dataset:lib.a", "p1", "disconnected")], "a string, b string, status string")
    assert view.status_note(["p1", "p2", "macrocall:1"], None, edges, 3, {"p1": "x"}).endswith('for: "x", "p2", and 1 more.')
    assert view.status_note(["dataset:lib.a", "dataset:lib.b", "p1"], pairs, edges, 3, {}).startswith('"dataset:lib.a" and "dataset:lib.b" are not connected within 3 hops. No lineage')
    assert view.status_note(["step:1"], None, edges, 3, {}) is None
    shown, drawn = view.render_model(nodes, edges)
    assert ("step:1", "step:1", "Step", 3) in rows(shown) and {r["title"] for r in drawn.collect()} == {"reads lib.a", "writes lib.b", "calls_macro"}
    assert [(r["id"], [tuple(x) for x in r["parameters"]]) for r in view.macro_parameters(nodes, edges).collect()] == [("macrocall:1", [("a", "p2"), ("x", "p1")])]
    assert {(r["node"], tuple(r["edges"])) for r in view.adjacency(edges).where("type = 'passes_parameter'").collect()} == {("macrocall:1", ("e3", "e4"))}
    assert [len(r["ids"]) for r in view.source_index(nodes).collect()] == [5]
    assert view.inline_json({"a": "</script>"}) == '{"a":"\\u003c/script>"}' and view.inside_root("/a/", "/a/b") and not view.inside_root("/a", "/a/../b") and not view.inside_root("/a", "/ab")
    assert view.with_capability(None) == ["dataset_lineage", "variable_lineage", "evidence_v1"] == view.with_capability(view.with_capability(None))


def test_drawn_edges_travel_once_an_end(spark):
    nodes = spark.createDataFrame([("a", "Dataset", "A"), ("s", "Step", None), ("c", "CommentBlock", "C"), ("s", "Step", "again")], "id string, type string, label string")
    rows = [("e1", "reads_dataset", "a", "s"), ("e2", "writes_dataset", "s", "a"), ("e3", "documents", "c", "a"), ("e4", "reads_dataset", "gone", "s")]
    drawn = view.render_model(nodes, spark.createDataFrame(rows, "id string, type string, src string, dst string"))[1]
    assert sorted((r["id"], r["title"]) for r in drawn.collect()) == [("e1", "reads A"), ("e1", "reads A"), ("e2", "writes A"), ("e2", "writes A")]
    assert drawn._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
