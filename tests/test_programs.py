import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources import contracts, programs, sinks, sqltree
from plumbline.sources.facts import Program, macro_sites
from plumbline.sources.includes import place_of
from plumbline.sources.lexer import blocks, lex, split_top

SOURCE = """/* header; not a statement */
%let lib = raw;
libname raw "/data/raw";
* a starred comment;
data work.one(keep=a) two;
  set &lib..base;
  where age > 17;
  x = a + 1;
  flag = 'Y';
  output;
run;
proc sort data=work.one out=work.sorted nodupkey; by descending id visit; run;
data merged; merge work.sorted other; by visit; z = 'it''s; fine'; if sex = 'F' then group = 1; run;
proc sql;
  create table final as select a.id, b.name as who, 'K' as kind, count(*) as n
    from merged as a left join people as b on a.id = b.id
    where a.visit = 'V1' group by id order by b.name desc;
  create view v as select id from final;
quit;
proc import datafile="/in/x.csv" out=loaded dbms=csv; run;
proc export data=loaded outfile="/out/y.csv" dbms=csv; run;
%report(data=&nowhere, title=x);
data _null_; set final; call symputx('n', id); run;
data open; set &missing;
"""


def test_lexer():
    out = lex("a 'x;''y' b; /* c; */ * d;\n%* e;\nf /* g */ h")
    assert [(p.kind, p.text) for p in out.pieces] == [("statement", "a 'x;''y' b"), ("comment", "c;"), ("comment", "* d"), ("comment", "%* e"), ("comment", "g"), ("statement", "f h")]
    assert [p.terminated for p in out.pieces][-1] is False
    assert lex("x 'never").findings == [("unterminated_string", 1)]
    assert lex("ok;\n/* never").findings == [("unterminated_comment", 2)]
    assert lex("").pieces == [] and split_top("a, f(b, c), 'd, e'") == ["a", "f(b, c)", "'d, e'"]


def test_blocks():
    got = [(b.kind, len(b.pieces), b.closed) for b in blocks(lex("data a; set b; proc sort data=a; by x; run; quit; proc sql; select 1; quit; x;").pieces)]
    assert got == [("data", 2, False), ("sort", 3, True), ("", 1, True), ("sql", 3, True), ("", 1, True)]


@pytest.fixture(scope="module")
def facts():
    return Program("p.sas", SOURCE).facts


def kinds(facts, kind):
    return {(e["src"], e["dst"]) for e in facts.edges if e["type"] == kind}


def test_data_step_facts(facts):
    assert ("dataset:raw.base", "~step~1") in kinds(facts, "reads_dataset")
    assert {("~step~1", "dataset:work.one"), ("~step~1", "dataset:work.two")} <= kinds(facts, "writes_dataset")
    assert ("dataset:work.one", "dataset:raw.base") in kinds(facts, "depends_on")
    read = next(e for e in facts.edges if e["src"] == "dataset:raw.base" and e["type"] == "reads_dataset")
    assert (read["evidence_kind"], read["resolution"]) == ("RESOLVED", "EXACT")
    found = {f["type"] for f in facts.findings}
    assert {"row_filter", "AMBIGUOUS_OUTPUT_TARGET", "unqualified_variable_reference", "merge_by_not_prefix_of_sort_by", "runtime_macro_variable_creation"} <= found
    assert ("~step~3", "variable:work.merged.group") in kinds(facts, "derives")
    assert ("variable:work.merged.sex", "~step~3") in kinds(facts, "conditioned_by")
    sex = next(e for e in facts.edges if e["src"] == "variable:work.merged.sex" and e["type"] == "reads_variable")
    assert (sex["operator"], sex["value"]) == ("=", "F")


def test_sort_sql_and_file_facts(facts):
    assert facts.nodes["~step~2"]["pattern"] == "ROW_FILTERING_SORT" and facts.nodes["~step~2"]["by_vars"] == ["id", "visit"]
    assert {("variable:work.merged.id", "~sqlstatement~1"), ("variable:work.people.id", "~sqlstatement~1")} == kinds(facts, "joins_on")
    join = next(e for e in facts.edges if e["type"] == "joins_on")
    assert (join["join_kind"], join["operator"]) == ("LEFT", "=")
    assert ("variable:work.merged.visit", "~sqlstatement~1") in kinds(facts, "filters_dataset")
    assert ("variable:work.people.name", "~sqlstatement~1") in kinds(facts, "sorts_by")
    assert not kinds(facts, "groups_by")  # two sources: the bare column is ambiguous
    view = next(e for e in facts.edges if e["dst"] == "dataset:work.v" and e["type"] == "writes_dataset")
    assert (view["output_kind"], view["materialized"]) == ("view", False)
    assert kinds(facts, "reads_external_file") == {("externalfile:/in/x.csv", "dataset:work.loaded")}
    assert kinds(facts, "writes_external_file") == {("dataset:work.loaded", "externalfile:/out/y.csv")}


def test_macro_facts(facts):
    assert ("~macrocall~1", "unknownmacro:report") in kinds(facts, "implemented_by")
    assert any(d.startswith("unknowndataset:&nowhere") for _, d in kinds(facts, "resolves_to"))
    assert {"macro_source_not_found", "block_not_explicitly_closed", "unresolved_macro_variable_in_data_source"} <= {f["type"] for f in facts.findings}
    assert macro_sites("m", "%macro a; %macro inner; %mend; %mend; %macro b(x=1); %mend;") == [("a", "m"), ("b", "m")]
    two = Program("q", "%go(a=1);", macros={"go": ["x", "y"]}).facts
    assert any(n["type"] == "MacroConflict" for n in two.nodes.values())


def test_conditions_and_includes():
    p = Program("p", "")
    p.lets = {"a": "Yes"}
    assert p.condition("&a = yes") is True and p.condition("&a ne YES") is False and p.condition("&b = 1") is None
    assert p.condition("&b = 1 or &a = yes") is True and p.condition("&a = yes and &a = yes") is None
    assert p.condition("&a in (no yes)") is True and p.condition("%symexist(zz)") is False
    got = Program("main", "%include 'a'; %include 'gone'; %if &v = 1 %then %do; data t; set s; run; %end;", files={"a": "%let v = 2; %include 'a';"}).facts
    assert {f["type"] for f in got.findings} == {"include_cycle_detected", "include_file_missing", "macro_branch_not_taken"}
    assert not kinds(got, "writes_dataset")


def test_conditions_never_guess():
    p = Program("p", "%let n = 3; %let x = sequel; %let y = a or b;")
    assert [p.condition(c) for c in ("&n>=1", "&n >= 1", "&x", "&n=3", "&x = se quel", "&n = 3 or", "&y = a or b")] == [None, None, None, None, False, False, None]
    assert p.condition("&n = 3 OR &zz = 1") is True and p.condition("&n ne 3 or &x eq b") is False and p.condition("&n  ^=  4") is True


def test_includes_share_one_order():
    files = {"m.sas": "%let a = 1; %let b = 1; %let c = 1; %macro one(k=); data &k; run; %mend;", "twice.sas": "%let a = 2;"}
    f = Program("p.sas", "%include 'm.sas'; %one(k=z);", files=files).facts
    assert ("~step~1", "dataset:work.z") in kinds(f, "writes_dataset") and not f.findings
    assert [n["value"] for i, n in Program("p.sas", "%let a = 1; %include 'twice.sas'; %include 'twice.sas';", files=files).facts.nodes.items() if i.startswith("macrovar")] == ["1", "2", "2"]
    # a call before the definition stays open; a definition read twice is one
    f = Program("p.sas", "%one(k=y); %include 'm.sas'; %include 'm.sas'; %one(k=z);", files=files).facts
    assert [x["type"] for x in f.findings] == ["macro_source_not_found"] and kinds(f, "writes_dataset") == {("~step~1", "dataset:work.z"), ("~macrocall~2", "dataset:work.z")}
    # a rejected include within a definition or a branch not taken is not told; text that never ends is, behind what it had
    f = Program("p.sas", "%macro q; %include 'gone'; %mend; %include 'bad'; data t; run;", files={"bad": "data u; run; x = 'never"}).facts
    assert [(x["type"], x["object"]) for x in f.findings] == [("unterminated_string", "bad")] and len(kinds(f, "writes_dataset")) == 2
    assert [place_of(*x) for x in (("../b.sas", "/a/c/d.sas"), ("b.sas", "hdfs://h/a/c.sas"), ("/x.sas", "s3://k/a/c.sas"), ("b", "a"))] == ["/a/b.sas", "hdfs://h/a/b.sas", "s3://k/x.sas", "b"]


def test_sql_trees():
    assert sqltree.item("case when a > 1 then b else 'then' end as k length=8") == (sqltree.expression("case when a > 1 then b else 'then' end"), "k")
    kind = lambda t: sqltree.item(t)[0].kind
    assert [kind(t) for t in ("a.b", "q.*", "*", "'x'n as y", "-3 as n", "'01jan2020'd as d", "a + 1 as b", "calculated y as z")] == ["column", "star", "star", "name", "literal", "other", "other", "other"]
    for open_ in ("case when a = 1 then 1 when b = 2 then 3 end", "case x when 1 then 2 end", "case when then 1 end", "case when a = 1 then 2 else end"):
        assert sqltree.expression(open_).parts == ()
    assert sqltree.condition("a.x ge 3").names == ("a.x",) and sqltree.condition("a = 1 and b = 2").kind == "other" and sqltree.condition("1 < a").kind == "other"
    assert sqltree.expression("sum(x, y.z) + calculated q").names == ("x", "y.z")
    f = Program("p", "proc sql; create table t as select case when a + 1 > 2 then b end as c, sum(x) from s where a in (1, 2); insert into t (a, b) values (1); insert into t values (1); quit; proc sql; create table u as select a from s;").facts
    assert not kinds(f, "writes_variable") - {("~sqlstatement~4", "variable:work.u.a")}
    assert [x["type"] for x in f.findings] == ["proc_sql_unsupported_syntax", "proc_sql_select_expression_unaliased", *["proc_sql_unsupported_syntax"] * 3, "sql_block_not_explicitly_closed"] and f.findings[-1]["status"] == "SUPPORTED"


def test_included_over_many_files(spark):
    files = [(f"/r/f{k}.sas", f"%include 'f{(k + 1) % 5}.sas'; data d{k}; run;") for k in range(5)]
    library = spark.createDataFrame(files, "path string, text string")
    main = spark.createDataFrame([("/r/a.sas", "%include 'f0.sas';"), ("/r/b.sas", "data b; run; %include 'f3.sas'; %none;"), ("/r/c.sas", "x")], "path string, text string")
    got = {(r["program"], r["path"]) for r in programs.included(main, library).collect()}
    assert got == {(f"/r/{p}.sas", f"/r/f{k}.sas") for p in "ab" for k in range(5)}
    found = programs.facts(main, library=library)
    rows = found.where("kind = 'finding'").select("program", "body").collect()
    assert sorted((r["program"], json.loads(r["body"])["type"]) for r in rows) == [("/r/a.sas", "include_cycle_detected"), ("/r/b.sas", "include_cycle_detected"), ("/r/b.sas", "macro_source_not_found")]
    wrote = found.where("kind = 'node' AND body LIKE '%dataset:work%'").groupBy("program").count().collect()
    assert {r["program"]: r["count"] for r in wrote} == {"/r/a.sas": 5, "/r/b.sas": 6}


def test_run_graph(spark, tmp_path):
    for name, text in (("a.sas", SOURCE), ("b.sas", "﻿data x; set final; run;"), ("sub/c.sas", "%macro report(data=); %mend;")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    sources = programs.read_sources(spark, str(tmp_path))
    programs.check_unchanged(sources)
    assert sources.count() == 3 and programs.macro_index(sources).count() == 1
    assert programs.statements(sources).where("kind = 'comment'").count() == 2
    nodes, edges, findings = programs.graph(programs.facts(sources))
    ids = [r["id"] for r in nodes.collect()]
    assert len(ids) == len(set(ids)) and {"step:001", "sqlstatement:001", "macrocall:001"} <= set(ids) and not any("~" in i for i in ids)
    edge_ids = [r["id"] for r in edges.collect()]
    assert len(set(edge_ids)) == len(edge_ids) and "edge:001" in edge_ids
    known = set(ids)
    assert all(r["src"] in known and r["dst"] in known for r in edges.collect())
    from plumbline.operators import graph

    bad = graph.problems(nodes.withColumnRenamed("place", "p").selectExpr("*", "0 AS pos"), edges.selectExpr("*", "CAST(NULL AS DOUBLE) AS confidence", "0 AS pos"))
    assert not bad.collect()
    text = sinks.graph_json(nodes, edges, findings, "r1", "PARTIAL")
    (tmp_path / "graph.json").write_text(text)
    back = sinks.read_graph(spark, str(tmp_path / "graph.json"))
    assert back["nodes"].count() == len(ids) and "src" in back["edges"].columns
    (tmp_path / "old.json").write_text(json.dumps({"schema_version": "0.1.0", "nodes": [], "edges": [], "findings": []}))
    with pytest.raises(ValueError):
        sinks.read_graph(spark, str(tmp_path / "old.json"))
    assert sinks.diagram(nodes, edges).startswith("flowchart LR\n") and "reads_dataset" in sinks.diagram(nodes, edges)
    assert sinks.report(findings).index("## REQUIRES_DECISION") < sinks.report(findings).index("## NOT_EXECUTED")
    told = sinks.manifest(sources, findings, {"a": 1})
    assert told.count() == 4 and told.where("path IS NULL").select("findings", "configuration").first() == (findings.count(), '{"a": 1}')


def test_contracts(spark):
    doc = "# gm_x\n## Purpose\nMakes x.\n\n| Parameter | Default Value |\n|---|---|\n| data | REQUIRED |\n| out | work.x |\n\n%gm_x(data=a)\n"
    found = contracts.read_contracts(spark.createDataFrame([("p", doc), ("q", "no heading")], "path string, text string"))
    rows = {r["path"]: r for r in found.collect()}
    assert rows["p"]["macro"] == "gm_x" and rows["p"]["parameters"]["data"]["required"] and rows["p"]["examples"] == ["%gm_x(data=a)"] and rows["q"]["errors"]
    deep = contracts.parse("p", doc + "%gm_x(data=%str(a(b(c)))), out=')') and %gm_x(data='(') then %gm_x(open")
    assert deep["examples"] == ["%gm_x(data=a)", "%gm_x(data=%str(a(b(c))))", "%gm_x(data='(')"]
    calls = spark.createDataFrame([("c", "gm_x", "out"), ("c", "gm_x", "zz")], "call string, macro string, name string")
    assert {(r["name"], r["state"]) for r in contracts.match_parameters(calls, found).collect()} == {("data", "missing"), ("out", "matched"), ("zz", "unknown")}


def test_programs_with_includes_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(programs, "SHARE", 2)
    monkeypatch.setattr(programs, "BATCH", 3)
    own = spark.range(9).selectExpr("concat('/p/', id, '.sas') AS path", "concat('%include ''a.sas''; data o', id, '; set &b; run;') AS text")
    library = spark.createDataFrame([("/p/a.sas", "%let b = raw.x;")], "path string, text string")
    found = programs.facts(own, library=library, roots=["/p"])
    assert found.rdd.getNumPartitions() == 5 and "FlatMapGroupsInPandas" not in found._jdf.queryExecution().simpleString()
    edges = found.where("kind = 'edge'").select(F.from_json("body", "type string, src string, dst string").alias("b")).select("b.*")
    assert {r["dst"] for r in edges.where("type = 'writes_dataset'").collect()} == {f"dataset:work.o{k}" for k in range(9)}
    assert edges.where("src = 'dataset:raw.x'").count() == 9
