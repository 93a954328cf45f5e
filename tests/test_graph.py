import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from plumbline.operators import bounds, graph, hops, impact, trace, variables, vocabulary


def walk(nodes, edges, start, down, depth, limit):
    """A queue over lists: the order, limits and flags that the levels must give."""
    seen, front, reached, walked, more = {start}, deque([(start, 0)]), [], {}, []
    limit_hit = depth_hit = False
    while front and not limit_hit:
        now, d = front.popleft()
        for i, a, b in sorted(edges):
            if (a if down else b) != now or i in walked:
                continue
            nxt = b if down else a
            if nxt in seen:
                walked[i] = True
                continue
            if limit is not None and len(reached) >= limit:
                limit_hit = True
                more.append(nxt)
                break
            e = d + (nodes[nxt] == "Dataset")
            if e > depth:
                depth_hit = True
                more.append(now)
                continue
            seen.add(nxt)
            reached.append(nxt)
            walked[i] = False
            front.append((nxt, e))
    return reached, walked, set(more) | {n for n, _ in front}, limit_hit, depth_hit


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(1)
    nodes = {f"d{k}": "Dataset" for k in range(9)} | {f"s{k}": "Step" for k in range(9)}
    edges = []
    for k in range(26):
        d, s = f"d{rng.randrange(9)}", f"s{rng.randrange(9)}"
        edges.append((f"e{k:02}", d, s) if rng.random() < 0.5 else (f"e{k:02}", s, d))
    n = spark.createDataFrame([(i, t, i) for i, t in nodes.items()], "id string, type string, label string").cache()
    e = spark.createDataFrame([(i, "reads_dataset" if a[0] == "d" else "writes_dataset", a, b) for i, a, b in edges], "id string, type string, src string, dst string").cache()
    return nodes, edges, n, e


@pytest.mark.parametrize(("depth", "limit"), [(20, 5000), (2, 5000), (20, 4), (0, 3), (20, None)])
def test_trace_is_a_queue(some, depth, limit):
    nodes, edges, n, e = some
    got = trace.trace_lineage(n, e, "d0", "downstream", depth, limit)
    reached, walked, more, limit_hit, depth_hit = walk(nodes, edges, "d0", True, depth, limit)
    assert {r["id"] for r in got.nodes.collect()} == set(reached)
    if limit is not None:
        assert {r["id"]: r["cycle"] for r in got.edges.collect()} == walked
        assert {r["id"] for r in got.continuation.collect()} == more
    assert (got.limit_hit, got.depth_hit) == (limit_hit, depth_hit)


def test_trace_refuses(some, spark):
    _, _, n, e = some
    for wrong in ({"depth": 21}, {"depth": True}, {"limit": 0}, {"limit": 5001}, {"direction": "sideways"}):
        with pytest.raises(ValueError):
            trace.trace_lineage(n, e, "d0", **wrong)
    with pytest.raises(ValueError):
        trace.trace_lineage(n, e, "nobody")
    with pytest.raises(ValueError):
        trace.trace_lineage(n.where("id <> 's0'"), e.unionByName(spark.createDataFrame([("e99", "reads_dataset", "d0", "gone")], e.schema)), "d0", "downstream")
    with pytest.raises(ValueError):
        bounds.check(None, 5)


def test_impact_keeps_the_weakest_path(spark):
    n = spark.createDataFrame([("a", "Dataset"), ("s", "Step"), ("t", "Step"), ("b", "Dataset"), ("u", "UnknownDataset"), ("x", "ExternalFile")], "id string, type string")
    e = spark.createDataFrame(
        [("e1", "reads_dataset", "a", "s", "OBSERVED", "EXACT"), ("e2", "writes_dataset", "s", "b", "OBSERVED", "EXACT"), ("e3", "reads_dataset", "a", "t", "HEURISTIC", "PARTIAL"), ("e4", "writes_dataset", "t", "b", "OBSERVED", "EXACT"), ("e5", "depends_on", "b", "u", "OBSERVED", "EXACT"), ("e6", "writes_external_file", "b", "x", None, None), ("e7", "reads_dataset", "b", "s", "OBSERVED", "EXACT")],
        "id string, type string, src string, dst string, evidence_kind string, resolution string",
    )
    got = impact.impact(n, e, "a", ("structural",), 5)
    nodes = {r["id"]: (r["classification"], r["reasons"]) for r in got.nodes.collect()}
    assert nodes["b"][0] == "possibly_impacted" and nodes["u"] == ("unresolved_boundary", ["unknown_node"]) and nodes["x"] == ("unresolved_boundary", ["external_file"])
    assert {r["target"]: r["path_edges"] for r in got.paths.collect()}["b"] == ["e3", "e4"]
    assert impact.impact(n, e, "a", ("structural",), 0).depth_hit
    with pytest.raises(ValueError):
        impact.impact(n, e, "a", ("output",))


def test_variable_walk(spark):
    rows = [("r1", "reads_variable", "v1", "o1", None), ("w1", "writes_variable", "o1", "v2", "x"), ("r2", "reads_variable", "v2", "o2", None), ("w2", "writes_variable", "o2", "v1", None), ("w3", "writes_variable", "o2", "v3", None), ("r3", "reads_variable", "v3", "o1", None)]
    e = spark.createDataFrame(rows, "id string, type string, src string, dst string, value string")
    got = variables.walk_variable_impact(e, "v1", 5)
    assert {(r["id"], r["depth"]) for r in got.variables.collect()} == {("v1", 0), ("v2", 1), ("v3", 2)}
    assert {r["id"]: r["via_edges"] for r in got.operations.collect()} == {"o1": ["r1", "r3"], "o2": ["r2"]}
    assert {r["edge"] for r in got.facts.where("cycle").collect()} == {"w2"}
    short = variables.walk_variable_impact(e, "v1", 1)
    assert short.depth_hit and {r["id"] for r in short.continuation.collect()} == {"o2"}


def test_search_filter_and_hops(some, spark):
    _, _, n, e = some
    found = graph.search_nodes(n, "DATASET", 3)
    assert found.count() == 9 and found.where("omitted").count() == 6
    assert graph.search_nodes(n, "", 5000).count() == 18
    with pytest.raises(TypeError):
        graph.search_nodes(n, None)
    lib = spark.createDataFrame([("dataset:raw.a", "Dataset", "a"), ("dataset:work.b", "Dataset", "b"), ("step:1", "Step", "s")], n.schema)
    assert {r["id"] for r in graph.filter_nodes(lib, library="RAW").collect()} == {"dataset:raw.a", "step:1"}
    reached = hops.reach(e, ["d0", "d1"], 3)
    assert hops.distances(reached).where("node IN ('d0', 'd1') AND dist = 0").count() == 2
    assert hops.pair_status(reached, ["d0", "d1"]).count() == 1


def test_as_of_is_strict(spark):
    uses = spark.createDataFrame([("k", 5, "u1"), ("k", 2, "u2"), ("z", 9, "u3"), ("k", 7, "u4")], "name string, at int, use string")
    events = spark.createDataFrame([("k", 2, "old"), ("k", 5, "new"), ("k", 3, None)], "name string, at int, value string")
    got = {r["use"]: r["value"] for r in graph.as_of(uses, events, ["name"], "at", "at", ["value"]).collect()}
    assert got == {"u1": None, "u2": None, "u3": None, "u4": "new"}


def test_interval_join_takes_the_narrowest(spark):
    spans = spark.createDataFrame([("f", 1, 200, "wide", 0), ("f", 60, 70, "near", 1), ("f", 60, 70, "twin", 2)], "file string, line_start int, line_end int, id string, pos int")
    points = spark.createDataFrame([("f", 65), ("f", 199), ("f", 300), ("g", 1)], "file string, line int")
    assert {(r["file"], r["line"]): r["id"] for r in graph.innermost(points, spans).collect()} == {("f", 65): "near", ("f", 199): "wide", ("f", 300): None, ("g", 1): None}


def test_status_and_vocabulary(spark):
    f = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    assert [graph.run_status(f(*s)).first()[0] for s in ((), ("SUPPORTED",), ("NOT_EXECUTED",), ("NOT_EXECUTED", "BLOCKED"))] == ["COMPLETE", "COMPLETE", "PARTIAL", "FAILED"]
    assert len(vocabulary.NODE_TYPES) == 25 and len(vocabulary.EDGE_TYPES) == 28


def test_steps(spark):
    from plumbline.functions import steps, text

    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z", 5), (3, "w", 6)], "k int, v string, n int")
    assert {tuple(r) for r in steps.merge(a, b, ["k"]).collect()} == {(1, "x", None), (2, "z", 5), (3, "w", 6)}
    assert steps.set_(a, b).count() == 4
    one = spark.range(1)
    assert one.select(text.literal_value(F.lit(" 'a b' "))).first()[0] == "a b" and one.select(text.literal_value(F.lit("a+1"))).first()[0] is None
    assert one.select(text.numbered_range(F.lit("x"), F.lit(3), F.lit(1), F.lit(2))).first()[0] == ["x03", "x02", "x01"]
    assert one.select(text.condition(F.lit("A"), "eq", F.lit("a"))).first()[0] is True
    assert one.select(text.SCALARS["sum"](F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0))).first()[0] == 3.0


@pytest.mark.parametrize("limit", [1, 2, 3, 20])
def test_impact_under_a_limit_stops_at_the_first_node_left_out(spark, limit):
    nodes = spark.createDataFrame([(n, "Step" if n[0] == "s" else "Dataset") for n in ("a", "s1", "b", "c", "s2", "d")], "id string, type string")
    pairs = [("a", "s1"), ("s1", "b"), ("s1", "c"), ("b", "s2"), ("s2", "d"), ("s2", "a")]
    edges = spark.createDataFrame([(f"e{k}", "reads_dataset" if b[0] == "s" else "writes_dataset", a, b, "OBSERVED", "EXACT") for k, (a, b) in enumerate(pairs)], "id string, type string, src string, dst string, evidence_kind string, resolution string")
    got = impact.impact(nodes, edges, "a", ("structural",), 20, limit)
    found = {r["id"]: r["reasons"] for r in got.nodes.collect()}
    assert list(found) and sorted(found) == sorted(["s1", "b", "c", "s2", "d"][:limit]) and got.limit_hit == (limit < 5)
    assert all(set(r["path_nodes"]) <= {"a", *found} for r in got.paths.collect())
    left = {r["id"] for r in got.continuation.collect()}
    assert left == {1: {"b"}, 2: {"c"}, 3: {"s2"}, 20: set()}[limit]
    assert {n for n, why in found.items() if "limit" in why} == {1: {"s1"}, 2: {"s1"}, 3: {"b"}, 20: set()}[limit]


def queue_of_variables(edges, start, depth, limit):
    """(variables, operations, facts, rest) of a plain queue."""
    by = lambda node, kind: sorted((i, d) for i, t, s, d in edges if s == node and t == kind)
    found, ops, facts, deep, queue = {start: 0}, {}, [], set(), [start]
    full = lambda: len(found) - 1 + len(ops) == limit
    while queue:
        v = queue.pop(0)
        for read, op in by(v, "reads_variable"):
            if op not in ops:
                if full():
                    return found, ops, facts, {op, *queue, *deep}
                ops[op] = found[v]
                facts.append((read, False))
                for write, to in by(op, "writes_variable"):
                    if to in found:
                        facts.append((write, True))
                    elif found[v] == depth:
                        deep.add(op)
                    elif full():
                        return found, ops, facts, {to, *queue, *deep}
                    else:
                        found[to] = found[v] + 1
                        facts.append((write, False))
                        queue.append(to)
            else:
                facts.append((read, False))
    return found, ops, facts, deep


@pytest.mark.parametrize("depth, limit", [(5, 1), (5, 2), (5, 3), (5, 4), (1, 6), (0, 3), (5, 40)])
def test_variable_impact_under_a_limit_is_a_queue(spark, depth, limit):
    reads = [("v1", "o1"), ("v1", "o2"), ("v2", "o2"), ("v2", "o3"), ("v3", "o1"), ("v3", "o4"), ("v4", "o5")]
    writes = [("o1", "v2"), ("o1", "v3"), ("o2", "v3"), ("o2", "v4"), ("o3", "v1"), ("o4", "v5"), ("o5", "v4"), ("o5", "v6")]
    rows = [(f"e{(7 * k) % 31:02}", "reads_variable", *r) for k, r in enumerate(reads)] + [(f"e{(11 * k + 3) % 37:02}w", "writes_variable", *w) for k, w in enumerate(writes)]
    e = spark.createDataFrame(rows, "id string, type string, src string, dst string").withColumn("value", F.lit(None).cast("string"))
    got = variables.walk_variable_impact(e, "v1", depth, limit)
    found, ops, facts, rest = queue_of_variables(rows, "v1", depth, limit)
    assert {r["id"]: r["depth"] for r in got.variables.collect()} == found
    assert {r["id"]: r["depth"] for r in got.operations.collect()} == ops
    assert sorted((r["edge"], r["cycle"]) for r in got.facts.collect()) == sorted(facts)
    assert {r["id"] for r in got.continuation.collect()} == rest and got.limit_hit == (len(found) - 1 + len(ops) == limit and bool(rest))


def test_impact_tells_cycles_and_boundaries_by_mode(spark):
    n = spark.createDataFrame([(x, "Dataset") for x in "abcd"], "id string, type string")
    e = [("e1", "derives", "a", "b"), ("e2", "derives", "b", "c"), ("e3", "derives", "c", "b"), ("e4", "filters_dataset", "c", "d")]
    e = spark.createDataFrame([(*r, "OBSERVED", "EXACT") for r in e], "id string, type string, src string, dst string, evidence_kind string, resolution string")
    got = impact.impact(n, e, "a", ("structural", "value_flow"), 5)
    assert sorted((r["mode"], r["target"], r["path_edges"], r["path_nodes"]) for r in got.cycles.collect()) == [(m, "b", ["e1", "e2", "e3"], ["a", "b", "c", "b"]) for m in ("structural", "value_flow")]
    assert {(r["mode"], r["id"]): r["reasons"] for r in got.boundaries.collect() if r["reasons"]} == {("structural", "d"): ["sink"], ("value_flow", "c"): ["cycle"]}
    assert {r["id"]: r["reasons"] for r in got.nodes.collect()} == {"b": [], "c": ["cycle"], "d": ["sink"]}


def test_explanation_follows_derivation_records(spark):
    n = spark.createDataFrame([("call", "MacroCall"), ("def", "MacroDefinition"), ("x", "Dataset"), ("y", "Dataset")], "id string, type string")
    e = spark.createDataFrame([("e1", "derives", "x", "y", ["def", "call", "call", "gone"])], "id string, type string, src string, dst string, derivation_refs array<string>")
    f = spark.createDataFrame([("f1", "a", ["y"], None), ("f2", "b", [], ["e1"]), ("f3", "c", ["call"], [])], "id string, type string, affected_nodes array<string>, affected_edges array<string>")
    got = lambda limit: sorted(tuple(r) for r in graph.explanation(n, e, f, "e1", limit).collect())
    assert got(9) == [("finding", "f1", "finding", "a", False), ("finding", "f2", "finding", "b", False), ("path", "call", "node", "MacroCall", False), ("path", "def", "node", "MacroDefinition", False)]
    assert [(r[1], r[4]) for r in got(1)] == [("f1", False), ("f2", True), ("call", False), ("def", True)]
    with pytest.raises(ValueError):
        graph.explanation(n, e, f, "none")


def test_problems_and_degrees_dealt_by_a_count_are_the_same(spark):
    nodes = spark.createDataFrame([("a", "Dataset", "A", 0), ("s", "Step", "S", 0), ("s", "Dataset", "again", 1)], "id string, type string, label string, pos int")
    rows = [("e1", "reads_dataset", "a", "s"), ("e2", "reads_dataset", "a", "gone"), ("e3", "writes_dataset", "a", "s"), ("e4", "reads_dataset", None, "s")]
    edges = spark.createDataFrame(rows, "id string, type string, src string, dst string")
    full = edges.selectExpr("*", "'OBSERVED' AS evidence_kind", "'EXACT' AS resolution", "CAST(NULL AS DOUBLE) AS confidence", "0 AS pos")
    told = [sorted(tuple(r) for r in graph.problems(nodes, full, parts).collect()) for parts in (None, 3)]
    assert told[0] == told[1] and ("edges", "e2", "dangling dst") in told[1] and ("edges", "e3", "illegal endpoints") in told[1]
    counted = [sorted(tuple(r) for r in graph.degrees(nodes, edges, parts).collect()) for parts in (None, 3)]
    assert counted[0] == counted[1] == [("a", 3), ("s", 3), ("s", 3)]
