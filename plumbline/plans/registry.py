"""The engine's own queries over the tables' graphs, each with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import steps, text
from ..operators import graph, hops, impact, index, trace, variables
from ..sources import star_graph
from ..sources.store import settled, table
from . import oracle

PART, REGION, USER = "dataset:part.1", "dataset:region.1", "variable:events.u1.click"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def lineage(spark, d) -> tuple[DataFrame, DataFrame]:
    return star_graph.lineage_nodes(spark, d), star_graph.lineage_edges(spark, d)


def with_evidence(edges: DataFrame) -> DataFrame:
    return edges.select("id", "type", "src", "dst", *star_graph.evidence(F.col("flag")))


def first_variable(spark, d) -> str:
    """The variable of the first event: every table has one."""
    r = table(spark, d, "events").orderBy("event_id").select("user_id", "event_type").first()
    return f"variable:events.u{r['user_id']}.{r['event_type']}"


FIRST_VARIABLE = "(SELECT 'variable:events.u' || user_id || '.' || event_type FROM events ORDER BY event_id LIMIT 1)"

# ---- the graph as tables


@query("graph_nodes_by_type", f"WITH {oracle.N} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def _(spark, d):
    return graph.by_type(lineage(spark, d)[0])


@query("graph_edges_by_type", f"WITH {oracle.E} SELECT type, count(*) AS n FROM edges GROUP BY type")
def _(spark, d):
    return graph.by_type(lineage(spark, d)[1])


@query(
    "node_degrees",
    f"WITH {oracle.E}, {oracle.N}, ends AS (SELECT src AS e FROM edges UNION ALL SELECT dst FROM edges), c AS (SELECT e, count(*) AS n FROM ends GROUP BY e) SELECT id, greatest(coalesce(n, 0), 1) AS degree FROM nodes LEFT JOIN c ON id = e",
)
def _(spark, d):
    return graph.degrees(*lineage(spark, d), star_graph.lineage_parts(spark, d))


@query("node_projection", f"WITH {oracle.N} SELECT id, type, label FROM nodes")
def _(spark, d):
    return graph.project_nodes(lineage(spark, d)[0])


@query(
    "edge_projection",
    f"WITH {oracle.E} SELECT id, type, src, dst, CASE flag WHEN 'N' THEN 'OBSERVED' WHEN 'A' THEN 'HEURISTIC' ELSE 'UNKNOWN' END AS evidence_kind, CASE flag WHEN 'N' THEN 'EXACT' WHEN 'A' THEN 'PARTIAL' ELSE 'UNRESOLVED' END AS resolution FROM edges",
)
def _(spark, d):
    return with_evidence(lineage(spark, d)[1])


@query(
    "search_nodes_ci",
    f"WITH {oracle.N}, f AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM nodes WHERE lower(label) LIKE '%an%' OR lower(type) LIKE '%an%') SELECT id, type, label, k > 200 AS omitted FROM f",
)
def _(spark, d):
    return graph.search_nodes(lineage(spark, d)[0], "AN", 200)


@query("search_all_matches", f"WITH {oracle.N} SELECT id, type, label, false AS omitted FROM nodes WHERE lower(label) LIKE '%step%' OR lower(type) LIKE '%step%'")
def _(spark, d):
    return graph.search_nodes(lineage(spark, d)[0], "step", None)


@query("filter_library", f"WITH {oracle.N} SELECT id, type, label FROM nodes WHERE type = 'Dataset' AND id LIKE 'dataset:nation.%'")
def _(spark, d):
    return graph.filter_nodes(lineage(spark, d)[0], "Dataset", "nation").where("id LIKE 'dataset:nation.%'")


@query("facet_types", f"WITH {oracle.N} SELECT DISTINCT type FROM nodes")
def _(spark, d):
    return graph.facets(lineage(spark, d)[0])


@query("facet_libraries", f"WITH {oracle.N} SELECT DISTINCT regexp_extract(id, '^dataset:([^.]*)', 1) AS library FROM nodes WHERE type = 'Dataset'")
def _(spark, d):
    return graph.library_facets(lineage(spark, d)[0])


# ---- lineage


def _traced(spark, d, start, direction, depth=20, limit=None):
    ways = ("upstream", "downstream") if direction == "both" else (direction,)
    stored = index.build(*lineage(spark, d), star_graph.lineage_parts(spark, d), ways=ways)
    return trace.trace_lineage(stored.nodes, None, start, direction, depth, limit, stored)


@query("trace_downstream", oracle.trace(PART, "downstream", 40))
def _(spark, d):
    return _traced(spark, d, PART, "downstream").nodes.select("id", "direction", "hop")


@query("trace_upstream", oracle.trace(REGION, "upstream", 40))
def _(spark, d):
    return _traced(spark, d, REGION, "upstream").nodes.select("id", "direction", "hop")


@query(
    "trace_both",
    f"WITH RECURSIVE {oracle.E}, up(node, hop) AS (SELECT 'dataset:nation.3', 0 UNION SELECT e.src, hop + 1 FROM up JOIN edges e ON e.dst = up.node), down(node, hop) AS (SELECT 'dataset:nation.3', 0 UNION SELECT e.dst, hop + 1 FROM down JOIN edges e ON e.src = down.node) "
    "SELECT node AS id, 'upstream' AS direction, min(hop) AS hop FROM up GROUP BY node HAVING min(hop) > 0 UNION ALL SELECT node, 'downstream', min(hop) FROM down GROUP BY node HAVING min(hop) > 0",
)
def _(spark, d):
    return _traced(spark, d, "dataset:nation.3", "both").nodes.select("id", "direction", "hop")


@query("trace_depth_bounded", oracle.trace(PART, "downstream", 3))
def _(spark, d):
    return _traced(spark, d, PART, "downstream", 1).nodes.select("id", "direction", "hop")


@query("trace_cycle_edges", oracle.trace_edges(PART, "downstream", 40))
def _(spark, d):
    return _traced(spark, d, PART, "downstream").edges.select("id", "src", "dst", "cycle")


_FIRST = "first AS (SELECT *, row_number() OVER (ORDER BY hop, path) - 1 AS place FROM (SELECT node, hop, path, row_number() OVER (PARTITION BY node ORDER BY hop, path) AS k FROM walk) WHERE k = 1)"


@query(
    "trace_limited",
    f"WITH RECURSIVE {oracle.E}, walk(node, hop, path) AS (SELECT '{REGION}', 0, CAST([] AS VARCHAR[]) UNION ALL SELECT e.src, hop + 1, list_append(path, e.id) FROM walk JOIN edges e ON e.dst = walk.node WHERE hop < 6), {_FIRST} "
    "SELECT node AS id, 'upstream' AS direction, hop, hop // 2 AS depth FROM first WHERE place BETWEEN 1 AND 200",
)
def _(spark, d):
    """The first 200 nodes of a queue: by level, then by the path of least edge ids."""
    return _traced(spark, d, REGION, "upstream", 5, 200).nodes


_UP = "up(node, hop) AS (SELECT '{0}', 0 UNION SELECT e.src, hop + 1 FROM up JOIN edges e ON e.dst = up.node), down(node, hop) AS (SELECT '{1}', 0 UNION SELECT e.dst, hop + 1 FROM down JOIN edges e ON e.src = down.node)".format(REGION, PART)


@query(
    "trace_over_index",
    f"WITH RECURSIVE {oracle.E}, {_UP} SELECT node AS id, 'upstream' AS direction, min(hop) AS hop FROM up GROUP BY node HAVING min(hop) > 0 UNION ALL SELECT node, 'downstream', min(hop) FROM down GROUP BY node HAVING min(hop) > 0",
)
def _(spark, d):
    """Two walks over one index; neither writes edges."""
    stored = index.build(*lineage(spark, d), star_graph.lineage_parts(spark, d))
    down, up = (trace.trace_lineage(stored.nodes, None, start, way, 20, None, stored).nodes for start, way in ((PART, "downstream"), (REGION, "upstream")))
    return down.unionByName(up).select("id", "direction", "hop")


# ---- variables


@query(
    "variable_impact",
    oracle.variables("START", 20).replace("'START'", FIRST_VARIABLE) + " SELECT v AS id, d AS depth FROM vars",
)
def _(spark, d):
    return variables.walk_variable_impact(settled(star_graph.variable_edges(spark, d)), first_variable(spark, d), 20).variables


@query(
    "variable_impact_operations",
    oracle.variables("START", 20).replace("'START'", FIRST_VARIABLE)
    + " SELECT r.dst AS id, min(vars.d) AS depth, count(*) AS n_reads FROM vars JOIN edges r ON r.src = vars.v AND r.type = 'reads_variable' GROUP BY r.dst",
)
def _(spark, d):
    found = variables.walk_variable_impact(settled(star_graph.variable_edges(spark, d)), first_variable(spark, d), 20)
    return found.operations.select("id", "depth", F.size("via_edges").cast("long").alias("n_reads"))


@query(
    "variable_impact_facts",
    oracle.variables("START", 20).replace("'START'", FIRST_VARIABLE)
    + ", ops AS (SELECT DISTINCT r.id AS rid, r.dst AS op, vars.d FROM vars JOIN edges r ON r.src = vars.v AND r.type = 'reads_variable'), lv AS (SELECT op, min(d) AS d FROM ops GROUP BY op), "
    "w AS (SELECT e.id, e.src, e.dst, e.value, lv.d, vars.d AS vd, min(e.id) OVER (PARTITION BY e.dst, lv.d) AS least FROM lv JOIN edges e ON e.src = lv.op AND e.type = 'writes_variable' JOIN vars ON vars.v = e.dst) "
    "SELECT rid AS edge, op AS \"on\", (SELECT value FROM edges x WHERE x.id = rid) AS value, false AS cycle FROM ops UNION ALL SELECT id, src, value, NOT (vd = d + 1 AND id = least) FROM w",
)
def _(spark, d):
    return variables.walk_variable_impact(settled(star_graph.variable_edges(spark, d)), first_variable(spark, d), 20).facts


@query("owning_program", "SELECT 'step:o' || o_orderkey AS id, 'program:' || min(o_orderpriority) AS program FROM orders GROUP BY o_orderkey")
def _(spark, d):
    orders = table(spark, d, "orders")
    ops = orders.select(F.concat(F.lit("step:o"), "o_orderkey").alias("id"), F.lit("Step").alias("type")).distinct()
    held = orders.select(F.concat(F.lit("c:"), "o_orderpriority", F.lit(":"), F.col("o_orderkey")).alias("id"), F.lit("contains_step").alias("type"), F.concat(F.lit("program:"), "o_orderpriority").alias("src"), F.concat(F.lit("step:o"), "o_orderkey").alias("dst"))
    return variables.owning_program(ops, held)


# ---- impact

_RANKED = f"""WITH RECURSIVE {oracle.E}, ranked AS (SELECT src, dst, CASE flag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS r FROM edges),
walk(node, hop, r) AS (SELECT '{PART}', 0, 0 UNION SELECT e.dst, hop + 1, greatest(w.r, e.r) FROM walk w JOIN ranked e ON e.src = w.node)
SELECT node AS id, max(r) AS rank, CASE max(r) WHEN 0 THEN 'known_impacted' WHEN 1 THEN 'possibly_impacted' ELSE 'unresolved_boundary' END AS classification FROM walk WHERE hop > 0 GROUP BY node"""


@query("impact_structural", _RANKED)
def _(spark, d):
    nodes, edges = lineage(spark, d)
    found = impact.impact(settled(nodes), settled(with_evidence(edges)), PART, ("structural",), 20)
    return found.nodes.select("id", "rank", "classification")


@query(
    "impact_limited",
    f"WITH RECURSIVE {oracle.E}, walk(node, hop, path) AS (SELECT '{PART}', 0, CAST([] AS VARCHAR[]) UNION ALL SELECT e.dst, hop + 1, list_append(path, e.id) FROM walk JOIN edges e ON e.src = walk.node WHERE hop < 20), {_FIRST} "
    "SELECT node AS id, place <= 70 AS kept FROM first WHERE place BETWEEN 1 AND 71",
)
def _(spark, d):
    """The nodes that a queue keeps under a limit of 70, and the one at which it stops."""
    nodes, edges = lineage(spark, d)
    found = impact.impact(settled(nodes), settled(with_evidence(edges)), PART, ("structural",), 20, 70)
    return found.nodes.select("id", F.lit(True).alias("kept")).unionByName(found.continuation.select("id", F.lit(False).alias("kept")))


@query(
    "impact_classification",
    f"SELECT classification, count(*) AS n FROM ({_RANKED}) GROUP BY classification",
)
def _(spark, d):
    nodes, edges = lineage(spark, d)
    return impact.impact(settled(nodes), settled(with_evidence(edges)), PART, ("structural",), 20).nodes.groupBy("classification").agg(F.count("*").alias("n"))


def _variable_graph(spark, d):
    edges = star_graph.variable_edges(spark, d).select("id", "type", "src", "dst", F.lit("OBSERVED").alias("evidence_kind"), F.lit("EXACT").alias("resolution"))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().select("id", F.when(F.col("id").startswith("variable:"), "Variable").otherwise("Step").alias("type"))
    return settled(nodes), settled(edges)


@query(
    "impact_value_flow",
    oracle.variables("START", 2).replace("'START'", FIRST_VARIABLE)
    + f" SELECT v AS id FROM vars WHERE v <> {FIRST_VARIABLE} UNION SELECT r.dst FROM vars JOIN edges r ON r.src = vars.v AND r.type = 'reads_variable'",
)
def _(spark, d):
    return impact.impact(*_variable_graph(spark, d), first_variable(spark, d), ("value_flow",), 2).nodes.select("id")


@query("impact_selection", "SELECT 'sqlstatement:c' || c_custkey AS id, 'selection' AS mode FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    """Selection edges point at the statement that filters, and end there."""
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    edges = c.select(F.concat(F.lit("e:f:"), "c_custkey").alias("id"), F.lit("filters_dataset").alias("type"), F.lit("variable:customer.segment").alias("src"), F.concat(F.lit("sqlstatement:c"), "c_custkey").alias("dst"), F.lit("OBSERVED").alias("evidence_kind"), F.lit("EXACT").alias("resolution"))
    nodes = edges.select(F.col("dst").alias("id"), F.lit("SqlStatement").alias("type")).union(spark.createDataFrame([("variable:customer.segment", "Variable")], "id string, type string"))
    found = impact.impact(settled(nodes), settled(edges), "variable:customer.segment", ("selection", "value_flow"), 5)
    return found.nodes.select("id", F.explode("modes").alias("mode"))


# ---- explanation and checks


def _findings(spark, d) -> DataFrame:
    """Orders in error as findings on their step and its write."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    key = F.col("o_orderkey").cast("string")
    return o.select(F.concat(F.lit("finding:"), key).alias("id"), F.lit("order_failed").alias("type"), F.lit("NOT_EXECUTED").alias("status"), F.array(F.concat(F.lit("step:o"), key)).alias("affected_nodes"), F.array(F.concat(F.lit("e:w:o"), key)).alias("affected_edges"))


@query(
    "explain_edge",
    f"WITH {oracle.E} SELECT id, type, src, dst, (SELECT 'finding:' || min(o_orderkey) FROM orders WHERE o_orderstatus = 'F') AS finding FROM edges WHERE id = (SELECT 'e:w:o' || min(o_orderkey) FROM orders WHERE o_orderstatus = 'F')",
)
def _(spark, d):
    key = table(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.min("o_orderkey")).first()[0]
    return graph.explain_edge(lineage(spark, d)[1], _findings(spark, d), f"e:w:o{key}").select("id", "type", "src", "dst", F.get("findings", F.lit(0)).alias("finding"))


@query("findings_of_objects", "SELECT 'step:o' || o_orderkey AS object_id, 1 AS n FROM orders WHERE o_orderstatus = 'F' UNION SELECT 'e:w:o' || o_orderkey, 1 FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return graph.findings_of(_findings(spark, d)).select("object_id", F.size("findings").alias("n"))


@query("run_status", "SELECT CASE max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) WHEN 1 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM orders")
def _(spark, d):
    return graph.run_status(_findings(spark, d))


@query("resolution_path", f"WITH {oracle.N} SELECT id, 'node' AS category, type FROM nodes WHERE type = 'SqlStatement'")
def _(spark, d):
    nodes, edges = lineage(spark, d)
    refs = table(spark, d, "customer").select(F.concat(F.lit("sqlstatement:c"), "c_custkey").alias("ref"))
    return graph.resolution_path(refs, nodes, edges, _findings(spark, d))


@query(
    "edge_explanation",
    "SELECT 'path' AS section, 'sqlstatement:c' || c_custkey AS id, 'node' AS category, 'SqlStatement' AS type, row_number() OVER (ORDER BY 'sqlstatement:c' || c_custkey) > 40 AS omitted FROM customer "
    "UNION ALL SELECT 'finding', 'finding:' || min(o_orderkey), 'finding', 'order_failed', false FROM orders WHERE o_orderstatus = 'F'",
)
def _(spark, d):
    """An edge that all customers' statements stand behind, out of a step with a finding; 40 records are shown."""
    nodes, edges = lineage(spark, d)
    key = table(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.min("o_orderkey")).first()[0]
    refs = table(spark, d, "customer").agg(F.collect_set(F.concat(F.lit("sqlstatement:c"), "c_custkey")).alias("derivation_refs"))
    derived = refs.select(F.lit("e:derived").alias("id"), F.lit("derives").alias("type"), F.lit(f"step:o{key}").alias("src"), F.lit(PART).alias("dst"), "derivation_refs")
    every = edges.select("id", "type", "src", "dst").unionByName(derived, allowMissingColumns=True)
    return graph.explanation(nodes, every, _findings(spark, d), "e:derived", 40)


def _faulty(spark, d):
    """The lineage graph with rows that break each rule, keyed by suppliers."""
    nodes, edges = lineage(spark, d)
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    more = s.select(F.concat(F.lit("x:"), key).alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "Mystery").otherwise("Dataset").alias("type"), F.col("s_name").alias("label"))
    more = more.unionByName(s.where("s_suppkey % 5 = 0").select(F.concat(F.lit("x:"), key).alias("id"), F.lit("Dataset").alias("type"), F.lit("again").alias("label")))
    nodes = nodes.withColumn("pos", F.lit(0)).unionByName(more.withColumn("pos", F.when(F.col("label") == "again", 1).otherwise(0)))
    bad = s.select(F.concat(F.lit("b:"), key).alias("id"), F.when(F.col("s_suppkey") % 4 == 0, "guesses").otherwise("reads_dataset").alias("type"), F.lit(PART).alias("src"), F.when(F.col("s_suppkey") % 2 == 0, "nowhere").otherwise("dataset:region.1").alias("dst"))
    bad = bad.select("*", F.when(F.substring("id", 3, 9).cast("long") % 7 == 0, "GUESS").otherwise("UNKNOWN").alias("evidence_kind"), F.lit("UNRESOLVED").alias("resolution"), F.lit(0.0).alias("confidence"))
    edges = with_evidence(edges).withColumn("confidence", F.lit(None).cast("double")).unionByName(bad)
    return graph.problems(nodes, edges.withColumn("pos", F.lit(0)), star_graph.lineage_parts(spark, d))


_FAULTS = {
    "validate_dangling": ("problem = 'dangling dst'", "SELECT 'edges' AS section, 'b:' || s_suppkey AS object, 'dangling dst' AS problem FROM supplier WHERE s_suppkey % 2 = 0"),
    "validate_duplicate_ids": ("problem = 'duplicate id'", "SELECT 'nodes' AS section, 'x:' || s_suppkey AS object, 'duplicate id' AS problem FROM supplier WHERE s_suppkey % 5 = 0"),
    "validate_endpoint_pairs": ("problem = 'illegal endpoints'", "SELECT 'edges' AS section, 'b:' || s_suppkey AS object, 'illegal endpoints' AS problem FROM supplier WHERE s_suppkey % 2 = 1"),
    "validate_unknown_types": (
        "problem = 'unknown type'",
        "SELECT 'nodes' AS section, 'x:' || s_suppkey AS object, 'unknown type' AS problem FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'edges', 'b:' || s_suppkey, 'unknown type' FROM supplier WHERE s_suppkey % 4 = 0",
    ),
    "validate_evidence": (
        "problem IN ('evidence kind', 'unknown evidence with confidence')",
        "SELECT 'edges' AS section, 'b:' || s_suppkey AS object, CASE WHEN s_suppkey % 7 = 0 THEN 'evidence kind' ELSE 'unknown evidence with confidence' END AS problem FROM supplier",
    ),
}
for _name, (_where, _sql) in _FAULTS.items():
    query(_name, _sql)(lambda spark, d, w=_where: _faulty(spark, d).where(w))


@query("validate_lineage_graph", "SELECT 'x' AS section, 'x' AS object, 'x' AS problem WHERE false")
def _(spark, d):
    nodes, edges = lineage(spark, d)
    return graph.problems(nodes.withColumn("pos", F.lit(0)), with_evidence(edges).withColumns({"confidence": F.lit(None).cast("double"), "pos": F.lit(0)}), star_graph.lineage_parts(spark, d))


@query("normalize_missing_evidence", "SELECT event_id AS id, CASE WHEN value > 50 THEN event_type ELSE 'UNKNOWN' END AS evidence_kind, CASE WHEN value > 50 THEN 'EXACT' ELSE 'NOT_ATTEMPTED' END AS resolution FROM events")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("value") > 50, F.col("event_type")).alias("evidence_kind"), F.lit("EXACT").alias("resolution"))
    return graph.normalize(e)


# ---- joins


@query("read_never_written", f"WITH {oracle.E} SELECT src AS dataset, min(id) AS edge FROM edges WHERE type = 'reads_dataset' AND src NOT IN (SELECT dst FROM edges WHERE type = 'writes_dataset') GROUP BY src")
def _(spark, d):
    return graph.read_never_written(*lineage(spark, d))


@query(
    "asof_binding",
    "SELECT e.event_id, s.value AS bound FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts > s.ts",
)
def _(spark, d):
    e = table(spark, d, "events")
    return graph.as_of(e.select("event_id", "user_id", "ts"), e.where("event_type = 'signup'").select("user_id", "ts", F.col("value").alias("bound")), ["user_id"], "ts", "ts", ["bound"]).select("event_id", "bound")


@query(
    "asof_sort_prefix",
    "WITH s AS (SELECT user_id, ts, event_type, event_id % 3 = 0 AS two FROM events WHERE event_type <> 'click') "
    "SELECT e.event_id, coalesce(s.event_type = e.event_type AND (e.event_id % 2 = 0 OR NOT s.two), false) AS is_prefix FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts > s.ts",
)
def _(spark, d):
    """Is what an event asks to be sorted by (its type, and for odd ones `none` behind it) a beginning of what the user's last sort was by?"""
    e = table(spark, d, "events")
    second = F.when(F.col("event_id") % 3 == 0, F.array("event_type")).otherwise(F.array(F.lit("none")))
    sorts = e.where("event_type <> 'click'").select("user_id", "ts", F.concat(F.array("event_type"), second).alias("sorted_by"))
    asked = F.when(F.col("event_id") % 2 == 0, F.array("event_type")).otherwise(F.array(F.col("event_type"), F.lit("none")))
    used = graph.as_of(e.select("event_id", "event_type", "user_id", "ts"), sorts, ["user_id"], "ts", "ts", ["sorted_by"])
    return used.select("event_id", F.coalesce(graph.is_prefix(asked, F.col("sorted_by")), F.lit(False)).alias("is_prefix"))


@query(
    "asof_fallback",
    "WITH a AS (SELECT user_id, ts, value FROM events WHERE event_type = 'signup' AND user_id % 2 = 0), b AS (SELECT user_id, ts, -value AS value FROM events WHERE event_type <> 'signup'), "
    "x AS (SELECT e.event_id, e.user_id, a.value AS av FROM events e ASOF LEFT JOIN a ON e.user_id = a.user_id AND e.ts > a.ts), y AS (SELECT e.event_id, b.value AS bv FROM events e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts > b.ts) "
    "SELECT x.event_id, CASE WHEN user_id IN (SELECT user_id FROM a) THEN av ELSE bv END AS bound FROM x JOIN y ON x.event_id = y.event_id",
)
def _(spark, d):
    """Users of an even number who signed up keep to their sign-ups; all others have the other events for it."""
    e = table(spark, d, "events")
    first = e.where("event_type = 'signup' AND user_id % 2 = 0").select("user_id", "ts", F.col("value").alias("bound"))
    second = e.where("event_type <> 'signup'").select("user_id", "ts", (-F.col("value")).alias("bound"))
    return graph.as_of(e.select("event_id", "user_id", "ts"), first, ["user_id"], "ts", "ts", ["bound"], second).select("event_id", "bound")


@query(
    "rebind_report",
    "WITH s AS (SELECT event_type AS k, max_by(value, event_id) AS setup_value FROM events WHERE user_id % 2 = 0 GROUP BY event_type) SELECT event_type AS name, setup_value, value FROM events JOIN s ON event_type = k WHERE user_id % 2 = 1 AND value <> setup_value",
)
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("name"), "value", F.col("event_id").alias("ord"), "user_id")
    return graph.rebinds(e.where("user_id % 2 = 0").drop("user_id"), e.where("user_id % 2 = 1").drop("user_id"))


@query(
    "stabbing_innermost",
    "WITH spans AS (SELECT o_orderpriority AS file, o_orderkey % 1000 AS a, o_orderkey % 1000 + o_custkey % 40 AS b, o_orderkey AS id FROM orders), p AS (SELECT DISTINCT o_orderpriority AS file, o_custkey % 1000 AS line FROM orders), "
    "h AS (SELECT p.file, line, id, row_number() OVER (PARTITION BY p.file, line ORDER BY b - a, id) AS k FROM p JOIN spans s ON p.file = s.file AND line BETWEEN a AND b) SELECT p.file, p.line, h.id FROM p LEFT JOIN h ON p.file = h.file AND p.line = h.line AND k = 1",
)
def _(spark, d):
    o = table(spark, d, "orders")
    a = F.col("o_orderkey") % 1000
    spans = o.select(F.col("o_orderpriority").alias("file"), a.alias("line_start"), (a + F.col("o_custkey") % 40).alias("line_end"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"))
    return graph.innermost(o.select(F.col("o_orderpriority").alias("file"), (F.col("o_custkey") % 1000).alias("line")).distinct(), spans)


# ---- hops

_HITS = ["dataset:nation.1", "dataset:nation.2", "dataset:region.0"]
_NEAR = f"""WITH RECURSIVE {oracle.E}, near AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), walk(hit, node, dist) AS (
  SELECT h, h, 0 FROM (VALUES {", ".join(f"('{h}')" for h in _HITS)}) t(h) UNION SELECT hit, b, dist + 1 FROM walk JOIN near ON node = a WHERE dist < 3),
reached AS (SELECT hit, node, min(dist) AS dist FROM walk GROUP BY hit, node)"""


def _reach(spark, d):
    return hops.reach(lineage(spark, d)[1], _HITS, 3)


@query("hop_distance", f"{_NEAR} SELECT node, min(dist) AS dist FROM reached GROUP BY node")
def _(spark, d):
    return hops.distances(_reach(spark, d))


@query(
    "hop_bridges",
    f"{_NEAR} SELECT DISTINCT l.node FROM reached p JOIN reached l ON l.hit = p.hit JOIN reached r ON r.hit = p.node AND r.node = l.node WHERE p.hit < p.node AND p.node IN (SELECT hit FROM reached) AND l.dist + r.dist = p.dist AND l.node NOT IN (SELECT hit FROM reached)",
)
def _(spark, d):
    return hops.bridges(_reach(spark, d), _HITS)


@query(
    "hop_pair_status",
    f"{_NEAR}, h AS (SELECT DISTINCT hit FROM reached) SELECT x.hit AS a, y.hit AS b, CASE WHEN r.node IS NULL THEN 'disconnected' ELSE 'reachable' END AS status FROM h x JOIN h y ON x.hit < y.hit LEFT JOIN reached r ON r.hit = x.hit AND r.node = y.hit",
)
def _(spark, d):
    return hops.pair_status(_reach(spark, d), _HITS)


# ---- text


@query("manifest_hashes", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS n_bytes FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("n_bytes"))


@query("macro_ref_extract", "SELECT doc_id, unnest(regexp_extract_all(text, '%([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(text.macro_references(F.col("text"))).alias("name"))


@query("identifier_extract", "SELECT event_id, unnest(list_distinct(regexp_extract_all(lower(props), '\\b([a-z_][a-z0-9_]*)\\b', 1))) AS name FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(text.identifiers(F.col("props"))).alias("name"))


@query("literal_value", "SELECT event_id, CAST(CAST(value AS INTEGER) AS VARCHAR) AS number, event_type AS string FROM events")
def _(spark, d):
    number = F.concat(F.lit(" "), F.rint("value").cast("int").cast("string"))
    return table(spark, d, "events").select("event_id", text.literal_value(number).alias("number"), text.literal_value(F.concat(F.lit("'"), "event_type", F.lit("'"))).alias("string"))


@query("normalise_space", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalise_space(F.col("text")).alias("text"))


@query("scalar_text", "SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low, replace(p_name, ' ', '') AS compressed, substring(p_name, 2, 3) AS sub, strpos(p_name, 'a') AS at, concat_ws('-', trim(p_name), trim(p_brand)) AS joined FROM part")
def _(spark, d):
    s = text.SCALARS
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", s["upcase"](n).alias("up"), s["lowcase"](n).alias("low"), s["compress"](n).alias("compressed"), s["substr"](n, 2, 3).alias("sub"), s["index"](n, "a").alias("at"), s["catx"]("-", n, F.col("p_brand")).alias("joined"))


@query("scalar_number", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + l_discount + l_tax AS total, greatest(l_quantity, l_discount) AS most, ceil(l_quantity * l_tax) AS up, abs(l_discount - l_tax) AS gap, l_partkey % 7 AS rest FROM lineitem")
def _(spark, d):
    s, c = text.SCALARS, F.col
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", s["sum"](c("l_quantity"), c("l_discount"), c("l_tax")).alias("total"), s["max"](c("l_quantity"), c("l_discount")).alias("most"),
        s["ceil"](c("l_quantity") * c("l_tax")).cast("double").alias("up"), s["abs"](c("l_discount") - c("l_tax")).alias("gap"), s["mod"](c("l_partkey"), F.lit(7)).alias("rest"),
    )


@query(
    "scalar_date",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS y, month(o_orderdate) AS m, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS n, date_diff('month', DATE '1992-01-15', CAST(o_orderdate AS DATE)) AS months, date_diff('quarter', DATE '1992-01-15', CAST(o_orderdate AS DATE)) AS quarters, "
    "CAST(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR AS DATE) AS next_year, CAST(date_trunc('month', o_orderdate) - INTERVAL 2 MONTH AS DATE) AS earlier FROM orders",
)
def _(spark, d):
    s, c = text.SCALARS, F.col("o_orderdate")
    day, start = s["datepart"](c), F.lit("1992-01-15").cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey", day.alias("day"), s["year"](c).alias("y"), s["month"](c).alias("m"), s["intck"]("day", F.lit("1992-01-01").cast("date"), day).cast("long").alias("n"), s["intck"]("month", start, day).cast("long").alias("months"),
        s["intck"]("qtr", start, day).cast("long").alias("quarters"), s["intnx"]("year", day, 1).alias("next_year"), s["intnx"]("month", day, -2).alias("earlier"),
    )


# ---- data steps


@query("set_concat", "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    a = table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_name AS name", "s_acctbal AS bal")
    return steps.set_(a, table(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS name", "c_acctbal AS bal"))


@query("merge_by_full", "SELECT coalesce(s_suppkey, c_custkey) AS k, coalesce(c_name, s_name) AS name, s_acctbal AS sbal, c_acctbal AS cbal FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def _(spark, d):
    a = table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_name AS name", "s_acctbal AS sbal")
    return steps.merge(a, table(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS name", "c_acctbal AS cbal"), ["k"])


_FIRST = "SELECT c_custkey, c_mktsegment, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k {} 1"


@query("sort_nodupkey", _FIRST.format("="))
def _(spark, d):
    return steps.sort_nodupkey(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"])


@query("sort_dupout", _FIRST.format(">"))
def _(spark, d):
    return steps.sort_dupout(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"])


@query("keep_drop_rename", "SELECT p_partkey AS part, p_brand AS brand FROM part")
def _(spark, d):
    return steps.shape(table(spark, d, "part"), ["p_partkey", "p_brand", "p_size"], ["p_size"], {"p_partkey": "part", "p_brand": "brand"})


@query("if_then_else", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.SCALARS["ifc"](F.col("p_size") > 25, F.lit("large"), F.lit("small")).alias("kind"))


@query("multi_output", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 0 WHEN p_size > 20 THEN 1 ELSE 2 END AS output FROM part")
def _(spark, d):
    out = steps.branch(table(spark, d, "part"), F.col("p_size") > 40, F.col("p_size") > 20)
    return steps.set_(*[o.select("p_partkey", F.lit(k).alias("output")) for k, o in enumerate(out)])


@query("sum_statement", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events")
def _(spark, d):
    return steps.running_sum(table(spark, d, "events"), F.lit(1), "running", ["user_id"], ["ts", "event_id"]).select("event_id", "running")


@query("sql_inner_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("sql_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def _(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'P'")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("sql_group_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
def _(spark, d):
    grouped = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return grouped.where("n > 10")


@query("sql_case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS state FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "debt").otherwise("fine").alias("state"))


@query("sql_order", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def _(spark, d):
    """A top-k report."""
    from pyspark.sql import Window

    top = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)
    return top.select("c_custkey", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("place"))


@query("insert_select", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def _(spark, d):
    return table(spark, d, "nation").selectExpr("n_nationkey AS k", "n_name AS name").union(table(spark, d, "region").selectExpr("r_regionkey + 100", "r_name"))


# ---- streams (an extension), run here over the whole table as a batch


@query("event_activity", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    from ..streaming import events

    return events.activity(table(spark, d, "events")).withColumn("total", F.round("total", 4))
