"""Queries of the viewer's operators and of the parser's facts, with SQL that knows the texts' pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, hops, raw, view
from ..sources import programs, star_graph
from ..sources.store import table
from . import oracle
from .registry import _HITS, _NEAR, _reach, lineage, query

_HIT = "SELECT id FROM nodes WHERE (contains(lower(label), 'step') OR contains(lower(type), 'step')) AND type = 'Step'"


@query("hit_set_search_and_filter", f"WITH {oracle.N} {_HIT}")
def _(spark, d):
    nodes, _ = lineage(spark, d)
    return view.hit_set(nodes, searched=graph.search_nodes(nodes, "step", None), kind="Step")


_OPACITY = "CASE WHEN a.dist IS NULL OR b.dist IS NULL THEN 0.03 WHEN greatest(a.dist, b.dist) = 0 THEN 1.0 WHEN greatest(a.dist, b.dist) = 1 THEN 0.9 WHEN greatest(a.dist, b.dist) = 2 THEN 0.6 WHEN greatest(a.dist, b.dist) = 3 THEN 0.35 ELSE 0.15 END"


@query(
    "edge_opacity",
    f"{_NEAR}, far AS (SELECT node, min(dist) AS dist FROM reached GROUP BY node) SELECT e.id, CAST({_OPACITY} AS DOUBLE) AS opacity FROM edges e LEFT JOIN far a ON a.node = e.src LEFT JOIN far b ON b.node = e.dst",
)
def _(spark, d):
    return view.edge_opacity(lineage(spark, d)[1], hops.distances(_reach(spark, d)))


@query("node_opacity", f"{_NEAR}, {oracle.N} SELECT id, CAST(CASE WHEN id IN (SELECT node FROM reached) THEN 1.0 ELSE 0.1 END AS DOUBLE) AS opacity FROM nodes")
def _(spark, d):
    reached = _reach(spark, d)
    hits = spark.createDataFrame([(h,) for h in _HITS], "id string")
    return view.node_opacity(lineage(spark, d)[0], hits, hops.bridges(reached, _HITS), hops.distances(reached))


@query(
    "render_edges",
    f"WITH {oracle.E}, {oracle.N} SELECT e.id, src, dst, e.type, CASE e.type WHEN 'reads_dataset' THEN 'vee' ELSE 'triangle' END AS arrow, CASE e.type WHEN 'reads_dataset' THEN 'reads ' || a.label ELSE 'writes ' || b.label END AS title FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst",
)
def _(spark, d):
    return view.render_model(*lineage(spark, d))[1]


@query("adjacency_lists", f"WITH {oracle.E} SELECT src AS node, type, count(*) AS n, string_agg(id, ',' ORDER BY id) AS edges FROM edges GROUP BY src, type")
def _(spark, d):
    return view.adjacency(lineage(spark, d)[1]).select("node", "type", F.size("edges").cast("long").alias("n"), F.concat_ws(",", "edges").alias("edges"))


# ---- facts of program texts made of the tables' rows


def _programs(spark, d, name: str, *columns: str):
    """One text a row: columns are concatenated."""
    return table(spark, d, name).select(F.concat(*[F.lit(c[1:]) if c.startswith("=") else F.col(c).cast("string") for c in columns]).alias("text"), F.monotonically_increasing_id().cast("string").alias("path"))


def _edges(found, *types: str):
    body = F.from_json("body", "type string, src string, dst string, operator string, value string")
    rows = found.where("kind = 'edge'").select(body.alias("b")).select("b.*")
    return rows.where(F.col("type").isin(*types)).withColumns({"src": _bare("src"), "dst": _bare("dst")})


def _bare(column: str):
    """An id without the number of a step, statement or call."""
    return F.regexp_replace(column, r"^~(\w+)~.*$", "$1")


@query(
    "facts_data_step",
    """WITH t AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier),
f AS (SELECT unnest([
  {'type': 'reads_dataset', 'src': 'dataset:raw.n' || n, 'dst': 'step', 'operator': NULL, 'value': NULL},
  {'type': 'writes_dataset', 'src': 'step', 'dst': 'dataset:work.o' || k, 'operator': NULL, 'value': NULL},
  {'type': 'reads_variable', 'src': 'variable:work.o' || k || '.grade', 'dst': 'step', 'operator': '>=', 'value': CAST(n AS VARCHAR)},
  {'type': 'writes_variable', 'src': 'step', 'dst': 'variable:work.o' || k || '.flag', 'operator': NULL, 'value': 'Y' || k},
  {'type': 'conditioned_by', 'src': 'variable:work.o' || k || '.grade', 'dst': 'step', 'operator': NULL, 'value': NULL},
  {'type': 'reads_variable', 'src': 'variable:work.o' || k || '.kind', 'dst': 'step', 'operator': NULL, 'value': NULL},
  {'type': 'writes_variable', 'src': 'step', 'dst': 'variable:work.o' || k || '.b', 'operator': NULL, 'value': '2'},
  {'type': 'writes_variable', 'src': 'step', 'dst': 'variable:work.o' || k || '.b', 'operator': NULL, 'value': '3'}]) AS e FROM t)
SELECT e.type AS type, e.src AS src, e.dst AS dst, e.operator AS operator, e.value AS value FROM f""",
)
def _(spark, d):
    text = ("=data o", "s_suppkey", "=; set raw.n", "s_nationkey", "=; if grade ge ", "s_nationkey", "= then flag = 'Y", "s_suppkey", "='; select(kind); when('a') b = 2; otherwise b = 3; end; run;")
    return _edges(programs.facts(_programs(spark, d, "supplier", *text)), "reads_dataset", "writes_dataset", "reads_variable", "writes_variable", "conditioned_by")


@query(
    "facts_proc_sql",
    """WITH t AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier),
f AS (SELECT unnest([
  {'type': 'reads_dataset', 'src': 'dataset:raw.a' || k, 'dst': 'sqlstatement', 'operator': NULL, 'value': NULL},
  {'type': 'reads_dataset', 'src': 'dataset:raw.b' || n, 'dst': 'sqlstatement', 'operator': NULL, 'value': NULL},
  {'type': 'writes_dataset', 'src': 'sqlstatement', 'dst': 'dataset:work.t' || k, 'operator': NULL, 'value': NULL},
  {'type': 'joins_on', 'src': 'variable:raw.a' || k || '.id', 'dst': 'sqlstatement', 'operator': '=', 'value': NULL},
  {'type': 'joins_on', 'src': 'variable:raw.b' || n || '.id', 'dst': 'sqlstatement', 'operator': '=', 'value': NULL},
  {'type': 'filters_dataset', 'src': 'variable:raw.a' || k || '.x', 'dst': 'sqlstatement', 'operator': '>', 'value': NULL},
  {'type': 'groups_by', 'src': 'variable:raw.b' || n || '.y', 'dst': 'sqlstatement', 'operator': NULL, 'value': NULL},
  {'type': 'sorts_by', 'src': 'variable:raw.b' || n || '.y', 'dst': 'sqlstatement', 'operator': NULL, 'value': NULL},
  {'type': 'writes_dataset', 'src': 'sqlstatement', 'dst': 'dataset:work.log', 'operator': NULL, 'value': NULL},
  {'type': 'writes_variable', 'src': 'sqlstatement', 'dst': 'variable:work.log.v', 'operator': NULL, 'value': 'q' || k},
  {'type': 'writes_variable', 'src': 'sqlstatement', 'dst': 'variable:work.t' || k || '.total', 'operator': NULL, 'value': NULL},
  {'type': 'writes_variable', 'src': 'sqlstatement', 'dst': 'variable:work.t' || k || '.y', 'operator': NULL, 'value': NULL}]) AS e FROM t)
SELECT e.type AS type, e.src AS src, e.dst AS dst, e.operator AS operator, e.value AS value FROM f""",
)
def _(spark, d):
    text = ("=proc sql; create table t", "s_suppkey", "= as select q.y, sum(p.x) as total from raw.a", "s_suppkey", "= as p left join raw.b", "s_nationkey", "= as q on p.id = q.id where p.x > 1 group by q.y order by q.y desc; insert into log set v = 'q", "s_suppkey", "='; quit;")
    return _edges(programs.facts(_programs(spark, d, "supplier", *text)), "reads_dataset", "writes_dataset", "joins_on", "filters_dataset", "groups_by", "sorts_by", "writes_variable")


@query(
    "facts_macros",
    """WITH t AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier),
f AS (SELECT unnest([
  {'type': 'writes_dataset', 'src': 'step', 'dst': 'dataset:work.' || CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END || k, 'operator': NULL, 'value': NULL},
  {'type': 'writes_dataset', 'src': 'macrocall', 'dst': 'dataset:work.' || CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END || k, 'operator': NULL, 'value': NULL},
  {'type': 'writes_dataset', 'src': 'step', 'dst': 'dataset:work.l1', 'operator': NULL, 'value': NULL},
  {'type': 'writes_dataset', 'src': 'macrocall', 'dst': 'dataset:work.l1', 'operator': NULL, 'value': NULL},
  {'type': 'writes_dataset', 'src': 'step', 'dst': 'dataset:work.l2', 'operator': NULL, 'value': NULL},
  {'type': 'writes_dataset', 'src': 'macrocall', 'dst': 'dataset:work.l2', 'operator': NULL, 'value': NULL},
  {'type': 'writes_dataset', 'src': 'step', 'dst': 'dataset:work.' || CASE WHEN k % 3 = 0 THEN 'yes' ELSE 'no' END, 'operator': NULL, 'value': NULL},
  {'type': 'implemented_by', 'src': 'macrocall', 'dst': 'macrodefinition:one', 'operator': NULL, 'value': NULL},
  {'type': 'implemented_by', 'src': 'macrocall', 'dst': 'macrodefinition:two', 'operator': NULL, 'value': NULL},
  {'type': 'implemented_by', 'src': 'macrocall', 'dst': 'unknownmacro:gone', 'operator': NULL, 'value': NULL}]) AS e FROM t)
SELECT e.type AS type, e.src AS src, e.dst AS dst, e.operator AS operator, e.value AS value FROM f""",
)
def _(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey") % 2, F.col("s_suppkey") % 3).toDF("k", "odd", "third")
    text = F.concat(
        F.lit("%macro one(kind=, n=1); %if &kind = 0 %then %do; data even&n; run; %end; %else %do; data odd&n; run; %end; %mend; "),
        F.lit("%macro two; %do i = 1 %to 2; data l&i; run; %end; %mend; %one(kind="), F.col("odd").cast("string"), F.lit(", n="), F.col("k").cast("string"), F.lit("); %two; %gone(a=%str(b)); %let t = "),
        F.col("third").cast("string"), F.lit("; %if &t = 0 %then %do; data yes; run; %end; %else %do; data no; run; %end;"),
    )
    return _edges(programs.facts(rows.select(text.alias("text"), F.col("k").cast("string").alias("path"))), "writes_dataset", "implemented_by")


@query(
    "facts_sorts_and_findings",
    """WITH t AS (SELECT s_suppkey AS k FROM supplier), f AS (SELECT unnest([
  {'type': 'row_filtering_sort', 'object': 'raw.a' || k, 'status': 'SUPPORTED'}, {'type': 'merge_by_not_prefix_of_sort_by', 'object': 'dataset:work.s' || k, 'status': 'REQUIRES_DECISION'},
  {'type': 'unknown_expression', 'object': 'a ** ' || k, 'status': 'NOT_EXECUTED'}, {'type': 'block_not_explicitly_closed', 'object': 'data z' || k, 'status': 'NOT_EXECUTED'},
  {'type': 'deferred_variable_construct', 'object': 'array q x1-x3', 'status': 'NOT_EXECUTED'}]) AS e FROM t) SELECT e.type AS type, e.object AS object, e.status AS status FROM f""",
)
def _(spark, d):
    text = ("=proc sort data=raw.a", "s_suppkey", "= out=s", "s_suppkey", "= nodupkey; by k v; run; data m; merge s", "s_suppkey", "= other; by v; array q x1-x3; w = a ** ", "s_suppkey", "=; run; data z", "s_suppkey", "=; set m;")
    found = programs.facts(_programs(spark, d, "supplier", *text)).where("kind = 'finding'")
    return found.select(F.from_json("body", "type string, object string, status string").alias("b")).select("b.*")


def _told(found, *types: str):
    """(type, object, status) of findings."""
    rows = found.where("kind = 'finding'").select(F.from_json("body", "type string, object string, status string").alias("b")).select("b.*")
    return rows.where(F.col("type").isin(*types)) if types else rows


@query(
    "facts_includes",
    """WITH t AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier),
f AS (SELECT unnest([
  {'type': 'reads_dataset', 'a': 'dataset:raw.n' || n, 'b': 'step'}, {'type': 'writes_dataset', 'a': 'step', 'b': 'dataset:work.deep'},
  {'type': 'reads_dataset', 'a': 'dataset:work.q' || n, 'b': 'step'}, {'type': 'writes_dataset', 'a': 'step', 'b': 'dataset:work.z' || k},
  {'type': 'reads_dataset', 'a': 'dataset:work.q' || n, 'b': 'macrocall'}, {'type': 'writes_dataset', 'a': 'macrocall', 'b': 'dataset:work.z' || k},
  {'type': 'implemented_by', 'a': 'macrocall', 'b': 'macrodefinition:one'},
  {'type': 'reads_dataset', 'a': 'dataset:raw.m' || n, 'b': 'step'}, {'type': 'writes_dataset', 'a': 'step', 'b': 'dataset:work.last'},
  {'type': 'include_cycle_detected', 'a': '/p/sub/deep.sas', 'b': 'NOT_EXECUTED'}, {'type': 'include_file_missing', 'a': '/p/inc' || n || '.sas', 'b': 'NOT_EXECUTED'},
  {'type': 'include_outside_allowed_roots', 'a': '/p/' || k || '.sas', 'b': 'NOT_EXECUTED'}, {'type': 'include_prohibited_artifact', 'a': '/p/' || k || '.sas', 'b': 'NOT_EXECUTED'},
  {'type': 'include_file_unreadable', 'a': '/p/' || k || '.sas', 'b': 'NOT_EXECUTED'}, {'type': 'include_path_unresolved', 'a': '/p/' || k || '.sas', 'b': 'UNRESOLVED_MACRO_VARIABLE'}]) AS e FROM t)
SELECT e.type AS type, e.a AS a, e.b AS b FROM f""",
)
def _(spark, d):
    """Programs that include a file of their nation, which defines a macro behind bindings and includes a further one, which names itself again."""
    k, n = F.col("s_suppkey").cast("string"), F.col("n_nationkey").cast("string")
    lit = lambda *some: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in some])
    own = table(spark, d, "supplier").withColumn("n_nationkey", F.col("s_nationkey"))
    main = own.select(
        lit("/p/", k, ".sas").alias("path"),
        lit("%include 'inc", n, ".sas'; %one(k=z", k, "); %include '/other/x.sas'; %include 'logs/x.sas'; %include 'sub'; %include '&b'; data last; set &b; run;").alias("text"),
    )
    between = table(spark, d, "nation").select(
        lit("/p/inc", n, ".sas").alias("path"),
        lit("%let b = raw.n", n, "; %let c = 1; %let e = 1; %macro one(k=); data &k; set q", n, "; run; %mend; %include 'sub/deep.sas'; %include 'gone.sas'; %let b = raw.m", n, ";").alias("text"),
    )
    deep = table(spark, d, "region").where("r_regionkey = 0").select(F.lit("/p/sub/deep.sas").alias("path"), F.lit("data deep; set &b; run; %include '../sub/deep.sas';").alias("text"))
    folder = deep.select(F.lit("/p/sub").alias("path"))
    found = programs.facts(main, library=between.unionByName(deep), folders=folder, roots=["/p"])
    edges = _edges(found, "reads_dataset", "writes_dataset", "implemented_by").select("type", F.col("src").alias("a"), F.col("dst").alias("b"))
    return edges.unionByName(_told(found).select("type", F.col("object").alias("a"), F.col("status").alias("b")))


@query(
    "facts_conditions",
    """WITH t AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), f AS (SELECT k, unnest(['a', 'b', 'e', 'f', 'i'] || CASE WHEN n = 3 THEN ['c'] ELSE ['c', 'd'] END || CASE WHEN n IN (1, 2, 3) THEN ['g'] ELSE ['h'] END || CASE WHEN n = 4 THEN ['l'] ELSE ['j'] END) AS x FROM t)
SELECT 'dataset:work.' || x || k AS dataset FROM f""",
)
def _(spark, d):
    """Which branches stay: those of a condition that is decided, or both."""
    pair = lambda condition, yes, no: (f"= %if {condition} %then %do; data {yes}", "s_suppkey", f"=; run; %end; %else %do; data {no}", "s_suppkey", "=; run; %end;")
    text = ("=%let n = ", "s_nationkey", "=; %let x = sequel;", *pair("&n>=1", "a", "b"), *pair("&n = 3 or &zz = 1", "c", "d"), *pair("&x", "e", "f"), *pair("&n in (1 2 3)", "g", "h"), *pair("%symexist(n)", "i", "k"), *pair("&n ne 4", "j", "l"))
    return _edges(programs.facts(_programs(spark, d, "supplier", *text)), "writes_dataset").select(F.col("dst").alias("dataset"))


@query(
    "facts_sql_limits",
    """WITH t AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier),
f AS (SELECT unnest([
  {'type': 'reads_variable', 'a': 'variable:raw.a.a', 'b': 'sqlstatement', 'c': NULL, 'v': NULL}, {'type': 'writes_variable', 'a': 'sqlstatement', 'b': 'variable:work.t' || k || '.a' || k, 'c': NULL, 'v': NULL},
  {'type': 'reads_variable', 'a': 'variable:raw.a.x', 'b': 'sqlstatement', 'c': '>', 'v': CAST(n AS VARCHAR)}, {'type': 'reads_variable', 'a': 'variable:raw.a.y', 'b': 'sqlstatement', 'c': NULL, 'v': NULL},
  {'type': 'writes_variable', 'a': 'sqlstatement', 'b': 'variable:work.t' || k || '.c', 'c': NULL, 'v': NULL},
  {'type': 'joins_on', 'a': 'variable:raw.b.id', 'b': 'sqlstatement', 'c': '=', 'v': NULL},
  {'type': 'reads_variable', 'a': 'unknownvariable:w@3', 'b': 'sqlstatement', 'c': NULL, 'v': NULL}, {'type': 'writes_variable', 'a': 'sqlstatement', 'b': 'variable:work.log.v', 'c': NULL, 'v': NULL},
  {'type': 'proc_sql_unsupported_syntax', 'a': 'case when p.x = 1 then 1 when p.x = 2 then 2 end as bad', 'b': 'NOT_EXECUTED', 'c': NULL, 'v': NULL},
  {'type': 'proc_sql_unsupported_syntax', 'a': '''my col''n', 'b': 'NOT_EXECUTED', 'c': NULL, 'v': NULL}, {'type': 'proc_sql_select_star_unsupported', 'a': 'p.*', 'b': 'NOT_EXECUTED', 'c': NULL, 'v': NULL},
  {'type': 'proc_sql_unsupported_syntax', 'a': '(1, 2, 3)', 'b': 'NOT_EXECUTED', 'c': NULL, 'v': NULL}, {'type': 'unqualified_variable_reference', 'a': 'w', 'b': 'UNQUALIFIED_VARIABLE', 'c': NULL, 'v': NULL},
  {'type': 'unresolved_macro_variable_in_sql_dataset', 'a': '&zz', 'b': 'UNRESOLVED_MACRO_VARIABLE', 'c': NULL, 'v': NULL}, {'type': 'sql_block_not_explicitly_closed', 'a': 'proc sql', 'b': 'NOT_EXECUTED', 'c': NULL, 'v': NULL}]) AS e FROM t)
SELECT e.type AS type, e.a AS a, e.b AS b, e.c AS operator, e.v AS value FROM f""",
)
def _(spark, d):
    """What SQL is analysed and what is left open, with a finding."""
    text = (
        "=proc sql; create table t", "s_suppkey", "= as select p.a as a", "s_suppkey", "=, case when p.x > ", "s_nationkey", "= then p.y else 'q' end as c, case when p.x = 1 then 1 when p.x = 2 then 2 end as bad, 'my col'n, p.* from raw.a as p left join raw.b as q on id = q.id; insert into log (u, v) values (1, 2, 3); insert into log set v = w + ",
        "s_suppkey", "=; create table &zz as select m from raw.a;",
    )
    found = programs.facts(_programs(spark, d, "supplier", *text))
    edges = _edges(found, "reads_variable", "writes_variable", "joins_on").select("type", F.col("src").alias("a"), F.col("dst").alias("b"), "operator", "value")
    none = F.lit(None).cast("string")
    return edges.unionByName(_told(found).select("type", F.col("object").alias("a"), F.col("status").alias("b"), none.alias("operator"), none.alias("value")))


@query(
    "facts_setup",
    """WITH t AS (SELECT s_suppkey AS k, s_nationkey AS n, (SELECT min(n_name) FROM nation) AS first FROM supplier),
f AS (SELECT unnest([{'type': 'reads_dataset', 'a': 'dataset:' || CASE WHEN n % 2 = 0 THEN lower(first) ELSE 'own' || n END || '.d', 'b': 'step'}, {'type': 'reads_dataset', 'a': 'dataset:work.sorted', 'b': 'step'}, {'type': 'reads_dataset', 'a': 'dataset:work.other', 'b': 'step'},
  {'type': 'merge_by_not_prefix_of_sort_by', 'a': 'dataset:work.sorted', 'b': 'REQUIRES_DECISION'}] || CASE WHEN n % 2 = 0 THEN [] ELSE [{'type': 'main_program_rebinds_setup_macro_variable', 'a': 'lib', 'b': 'SUPPORTED'}] END) AS e FROM t)
SELECT e.type AS type, e.a AS a, e.b AS b FROM f UNION ALL SELECT 'reads_dataset', 'dataset:raw.n', 'step'""",
)
def _(spark, d):
    """A setup whose bindings and sorts every program starts from, with its own facts."""
    name = table(spark, d, "nation").agg(F.min("n_name").alias("n"))
    setup = name.select(F.lit("setup.sas").alias("path"), F.concat(F.lit("%let lib = "), F.lower("n"), F.lit("; proc sort data=raw.n out=sorted; by id v; run;")).alias("text"))
    own = programs.facts(setup, role="SetupFile")
    rebind = F.when(F.col("s_nationkey") % 2 == 1, F.concat(F.lit("%let lib = own"), F.col("s_nationkey").cast("string"), F.lit("; "))).otherwise("")
    text = F.concat(rebind, F.lit("data c; set &lib..d; run; data m; merge sorted other; by v; run;"))
    main = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), text.alias("text"))
    found = own.unionByName(programs.facts(main, programs.carried(own)))
    return _edges(found, "reads_dataset").select("type", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(_told(found).select("type", F.col("object").alias("a"), F.col("status").alias("b")))


@query(
    "run_read_never_written",
    "SELECT 'raw.n' || n_nationkey AS object, 'SUPPORTED' AS status, CAST(count(*) AS BIGINT) AS programs FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 3 > 0 GROUP BY n_nationkey",
)
def _(spark, d):
    """Findings of a run over all programs: sources that none of them writes, with how many read each; `t` stands for WORK in the end."""
    key = F.col("s_nationkey").cast("string")
    writes = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit(" data raw.n"), key, F.lit("; run;"))).otherwise("")
    text = F.concat(F.lit("libname t '/x'; libname t work; data o; set raw.n"), key, F.lit(" t.x gone; run;"), writes)
    main = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), text.alias("text"))
    _, edges, findings = programs.graph(programs.facts(main))
    told = findings.where("type = 'dataset_read_never_written'").select("object", "status")
    reads = edges.where("type = 'reads_dataset'").groupBy(F.substring_index("src", ":", -1).alias("object")).agg(F.count("*").alias("programs"))
    return told.join(reads, "object").select("object", "status", "programs")


@query(
    "adjacency_chunks",
    f"WITH {oracle.E}, p AS (SELECT dst AS node, type, id, (row_number() OVER (PARTITION BY dst, type ORDER BY id) - 1) // 16 AS chunk FROM edges) SELECT node, type, CAST(chunk AS INTEGER) AS chunk, count(*) AS n, string_agg(id, ',' ORDER BY id) AS edges FROM p GROUP BY node, type, chunk",
)
def _(spark, d):
    """Incoming edges in rows of sixteen."""
    return view.adjacency_chunks(lineage(spark, d)[1], "in", 16, star_graph.lineage_parts(spark, d)).select("node", "type", "chunk", F.size("edges").cast("long").alias("n"), F.concat_ws(",", "edges").alias("edges"))


@query(
    "validate_raw_records",
    """WITH t AS (SELECT s_suppkey AS k FROM supplier),
n AS (SELECT k, k % 7 AS m FROM t), e AS (SELECT k, k % 11 AS m FROM t),
f AS (
  SELECT 'nodes' AS section, k AS place, 0 AS nth, 'at ' || k AS object, 'is no object' AS problem FROM n WHERE m = 2
  UNION ALL SELECT 'nodes', k, 1, 'at ' || k, 'missing key id' FROM n WHERE m = 6
  UNION ALL SELECT 'nodes', k, 3, '"n' || k || '"', 'missing key label' FROM n WHERE m = 1
  UNION ALL SELECT 'nodes', k, 4, '"n' || k || '"', 'unknown type' FROM n WHERE m = 3
  UNION ALL SELECT 'nodes', k, 5, CAST(k AS VARCHAR), 'id is no string' FROM n WHERE m = 0
  UNION ALL SELECT 'nodes', k, 6, '"n' || (k - 1) || '"', 'duplicate id' FROM n WHERE m = 4
  UNION ALL SELECT 'edges', k, 4, '"e' || k || '"', 'missing key to' FROM e WHERE m = 0
  UNION ALL SELECT 'edges', k, 5, '"e' || k || '"', 'evidence is no object' FROM e WHERE m = 1
  UNION ALL SELECT 'edges', k, 6, '"e' || k || '"', 'unknown evidence kind' FROM e WHERE m = 2
  UNION ALL SELECT 'edges', k, 7, '"e' || k || '"', 'unknown evidence resolution' FROM e WHERE m IN (2, 3)
  UNION ALL SELECT 'edges', k, 8, '"e' || k || '"', 'unknown evidence with confidence' FROM e WHERE m = 4
  UNION ALL SELECT 'edges', k, 9, '"e' || k || '"', 'unknown type' FROM e WHERE m = 5
  UNION ALL SELECT 'edges', k, 10, '"e' || k || '"', 'from is no string' FROM e WHERE m IN (6, 7)
  UNION ALL SELECT 'edges', k, 13, '"e' || k || '"', 'dangling to' FROM e WHERE m = 8
  UNION ALL SELECT 'edges', k, 14, '"e' || k || '"', 'illegal endpoints' FROM e WHERE m = 9
  UNION ALL SELECT 'graph', 0, 2, 'graph', 'unsupported schema version'
  UNION ALL SELECT 'graph', 0, 4, 'graph', 'nodes is no list' UNION ALL SELECT 'graph', 0, 5, 'graph', 'missing collection edges')
SELECT section, CAST(place AS BIGINT) AS place, nth, object, problem FROM f""",
)
def _(spark, d):
    """Records as they stand in a document, a supplier's number telling what is wrong with each."""
    k = F.col("s_suppkey").cast("string")
    say = lambda text: F.concat(*[x for part in text.split("#") for x in (k, F.lit(part))][1:])
    pick = lambda by, cases, other: F.coalesce(*[F.when(F.col("s_suppkey") % by == m, say(text)) for m, text in cases.items()], say(other))
    before = F.concat(F.lit('{"id": "n'), (F.col("s_suppkey") - 1).cast("string"), F.lit('", "type": "Dataset", "label": "again"}'))
    node = pick(7, {0: '{"id": #, "type": "Step", "label": "x"}', 1: '{"id": "n#", "type": "Dataset"}', 2: '"n#"', 3: '{"id": "n#", "type": "Mystery", "label": null}', 6: '{"type": "Step", "label": "x"}'}, '{"id": "n#", "type": "Dataset", "label": "x"}')
    node = F.when(F.col("s_suppkey") % 7 == 4, before).otherwise(node)
    edge = lambda rest: '{"id": "e#", ' + rest + "}"
    ends, good = '"from": "a", "to": "b"', '"type": "depends_on"'
    edges = {
        0: edge(f'{good}, "from": "a"'), 1: edge(f'{good}, {ends}, "evidence": "seen"'), 2: edge(f'{good}, {ends}, "evidence": {{"kind": null}}'), 3: edge(f'{good}, {ends}, "evidence": {{"kind": "OBSERVED", "resolution": 1}}'),
        4: edge(f'{good}, {ends}, "evidence": {{"kind": "UNKNOWN", "resolution": "EXACT", "confidence": 0.5}}'), 5: edge(f'"type": "guesses", {ends}'), 6: edge(f'{good}, "from": 1, "to": "b"'), 7: edge(f'{good}, "from": null, "to": "b"'),
        8: edge(f'{good}, "from": "a", "to": "gone"'), 9: edge(f'"type": "reads_dataset", {ends}'), 10: edge(f'{good}, {ends}, "evidence": {{"kind": "UNKNOWN", "resolution": "EXACT", "confidence": null}}'),
    }
    s = table(spark, d, "supplier")
    body = lambda text: F.parse_json(text).alias("body")
    more = table(spark, d, "region").where("r_regionkey < 2").select((-F.col("r_regionkey") - 1).cast("long").alias("place"), body(F.when(F.col("r_regionkey") == 0, '{"id": "a", "type": "Dataset", "label": "a"}').otherwise('{"id": "b", "type": "Dataset", "label": "b"}')))
    nodes = s.select(F.col("s_suppkey").cast("long").alias("place"), body(node)).unionByName(more)
    found = raw.problems(spark.range(1).select(body(F.lit('{"schema_version": "9", "nodes": {}}'))), nodes, s.select(F.col("s_suppkey").cast("long").alias("place"), body(pick(11, edges, ""))))
    return found
