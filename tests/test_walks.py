"""Walks over random graphs against plain queues, over an index, and with everything too large to be held at once."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph, impact, index, trace, variables

KINDS = [("OBSERVED", "EXACT"), ("RESOLVED", "EXACT"), ("RESOLVED", "PARTIAL"), ("HEURISTIC", "PARTIAL"), ("UNKNOWN", "UNRESOLVED")]
RANK = dict(zip(KINDS, (0, 0, 1, 1, 2), strict=True))
TYPES = ["reads_variable", "writes_variable", "derives", "filters_dataset", "reads_dataset", "writes_dataset"]


def random_graph(seed, size=14, edges=34):
    r = random.Random(seed)
    nodes = {f"n{k:02}": r.choice(["Dataset", "Variable", "Step", "Step", "SqlStatement", "UnknownVariable", "ExternalFile"]) for k in range(size)}
    nodes["n00"] = "Dataset"
    names = list(nodes)
    rows = []
    for k in r.sample(range(100, 100 + 3 * edges), edges):
        a, b = r.choice(names), r.choice(names)
        rows.append((f"e{k}", r.choice(TYPES), a, b, *r.choice(KINDS)))
    return nodes, rows


def tables(spark, nodes, rows):
    return spark.createDataFrame(list(nodes.items()), "id string, type string"), spark.createDataFrame(rows, "id string, type string, src string, dst string, evidence_kind string, resolution string")


def queue(nodes, rows, seed, modes, depth, limit):
    """What a plain queue keeps: (best by mode and node, reasons, continuation, limit hit, depth hit)."""
    own = {"value_flow": impact.MODE_EDGES["value_flow"], "selection": impact.MODE_EDGES["selection"]}
    out = {}
    for e in sorted(rows):
        out.setdefault(e[2], []).append(e)
    best, todo, met, why, rest = {}, [], [], {}, set()
    for m in modes:
        best[m, seed] = (0, (), (seed,))
        todo.append((m, seed, 0, *best[m, seed]))
    deep = False
    while todo:
        m, n, at, rank, path, through = todo.pop(0)
        if best[m, n] != (rank, path, through):
            continue
        said = why.setdefault((m, n), set())
        if nodes[n].startswith("Unknown"):
            said.add("unknown_node")
            continue
        if nodes[n] == "ExternalFile":
            said.add("external_file")
            continue
        some = [e for e in out.get(n, []) if m == "structural" or e[1] in own[m]]
        if not some:
            said.add("sink")
        went = cycle = False
        for e in some:
            to = e[3]
            new = (max(rank, RANK[e[4:]]), (*path, e[0]), (*through, to))
            better = (m, to) not in best or (-new[0], new[1]) < (-best[m, to][0], best[m, to][1])
            if to in through:
                cycle = True
                if better:
                    best[m, to] = new
                continue
            then = at + (nodes[to] in impact.COUNTED)
            if then > depth:
                deep = True
                said.add("depth")
                rest.add(n)
                continue
            if to not in met:
                if limit is not None and len(met) == limit:
                    said.add("limit")
                    return best, met, why, rest | {to}, True, deep
                met.append(to)
            if better:
                best[m, to] = new
                todo.append((m, to, then, *new))
            went = True
        if cycle and not went:
            said.add("cycle")
    return best, met, why, rest, False, deep


@pytest.mark.parametrize(("seed", "modes", "depth", "limit", "held"), [(1, ("structural",), 20, 1, 20_000), (2, ("structural",), 20, 4, 0), (3, ("structural", "selection"), 3, 6, 20_000), (4, ("structural", "value_flow", "selection"), 20, 5, 0), (5, ("value_flow",), 20, 3, 20_000), (6, ("structural",), 1, 9, 0), (7, ("structural", "value_flow"), 2, 7, 0), (8, ("structural",), 20, 20, 20_000), (9, ("structural", "selection"), 20, 13, 0), (10, ("structural",), 0, 3, 0), (11, ("structural", "value_flow"), 20, None, 20_000)])
def test_impact_is_a_queue(spark, monkeypatch, seed, modes, depth, limit, held):
    monkeypatch.setattr(index, "HELD", held)
    nodes, rows = random_graph(seed)
    best, met, why, rest, full, deep = queue(nodes, rows, "n00", modes, depth, limit)
    got = impact.impact(*tables(spark, nodes, rows), "n00", modes, depth, limit)
    want = {n: (sorted(m for m in modes if (m, n) in best), max(best[m, n][0] for m in modes if (m, n) in best)) for n in met}
    found = {r["id"]: r for r in got.nodes.collect()}
    assert {n: (r["modes"], r["rank"]) for n, r in found.items()} == want
    assert {(r["mode"], r["target"]): (r["rank"], tuple(r["path_edges"]), tuple(r["path_nodes"])) for r in got.paths.collect() if r["target"] != "n00"} == {k: v for k, v in best.items() if k[1] in met}
    assert {r["id"] for r in got.continuation.collect()} == rest and (got.limit_hit, got.depth_hit) == (full, deep)
    assert {(r["mode"], r["id"]): r["reasons"] for r in got.boundaries.collect() if r["reasons"]} == {k: [x for x in impact.REASONS if x in v] for k, v in why.items() if v}
    for n, r in found.items():
        assert r["reasons"] == [x for x in impact.REASONS if any(x in why.get((m, n), ()) for m in modes)]


@pytest.mark.parametrize(("seed", "direction", "depth", "limit"), [(1, "downstream", 20, None), (2, "upstream", 2, None), (3, "both", 20, 3), (4, "downstream", 1, 5), (5, "both", 20, 40), (6, "upstream", 20, 2)])
def test_walks_that_grow_give_what_small_ones_give(spark, monkeypatch, seed, direction, depth, limit):
    nodes, rows = random_graph(seed, 16, 60)
    rows = [(e[0], "reads_dataset" if k % 2 else "writes_dataset", *e[2:]) for k, e in enumerate(rows)]
    stored = index.build(*tables(spark, nodes, rows))
    plain = lambda t: (sorted(map(tuple, t.nodes.collect())), sorted(map(tuple, t.edges.collect())), sorted(r["id"] for r in t.continuation.collect()), t.limit_hit, t.depth_hit)
    small = plain(trace.trace_lineage(stored.nodes, None, "n00", direction, depth, limit, stored))
    monkeypatch.setattr(index, "HELD", 0)
    assert plain(trace.trace_lineage(*tables(spark, nodes, rows), "n00", direction, depth, limit)) == small
    assert plain(trace.trace_lineage(stored.nodes, None, "n00", direction, depth, limit, stored)) == small


@pytest.mark.parametrize(("seed", "depth", "limit"), [(1, 20, None), (2, 1, None), (3, 20, 4), (4, 0, 3), (5, 3, 9), (6, 20, 200), (7, 2, 1)])
def test_variable_walks_that_grow_give_what_small_ones_give(spark, monkeypatch, seed, depth, limit):
    r = random.Random(seed)
    ends = [(f"v{r.randrange(9)}", f"o{r.randrange(7)}") for _ in range(44)]
    rows = [(f"e{k:03}", *(("reads_variable", v, o) if k % 2 else ("writes_variable", o, v)), str(k)) for k, (v, o) in enumerate(ends)]
    r.shuffle(rows)
    e = spark.createDataFrame(rows, "id string, type string, src string, dst string, value string")
    plain = lambda x: (*[sorted(map(tuple, d.collect())) for d in (x.variables, x.operations, x.facts)], sorted(y["id"] for y in x.continuation.collect()), x.limit_hit, x.depth_hit)
    small = plain(variables.walk_variable_impact(e, "v0", depth, limit))
    monkeypatch.setattr(index, "HELD", 0)
    assert plain(variables.walk_variable_impact(e, "v0", depth, limit)) == small and len(small[0]) > 0


def test_impact_as_joins_gives_the_ranks_of_the_queue(spark, monkeypatch):
    monkeypatch.setattr(index, "HELD", 0)
    nodes, rows = random_graph(21, 14, 30)
    best, met, *_ = queue(nodes, rows, "n00", ("structural",), 20, None)
    got = impact.impact(*tables(spark, nodes, rows), "n00", ("structural",), 20)
    assert {r["id"]: r["rank"] for r in got.nodes.collect()} == {n: best["structural", n][0] for n in met}


def test_a_missing_far_end_is_refused_and_so_is_a_wrong_start(spark):
    nodes, edges = tables(spark, {"a": "Dataset", "v": "Variable"}, [("e1", "reads_dataset", "a", "gone", "OBSERVED", "EXACT")])
    for walk in (lambda: impact.impact(nodes, edges, "a", limit=5), lambda: trace.trace_lineage(nodes, edges, "a")):
        with pytest.raises(ValueError, match="missing node"):
            walk()
    e = edges.withColumn("value", F.lit(None).cast("string"))
    for start, message in (("a", "must be"), ("none", "not found")):
        with pytest.raises(ValueError, match=message):
            variables.walk_variable_impact(e, start, 2, nodes=nodes)


def test_as_of_with_a_second_history(spark):
    r = random.Random(5)
    keys = [f"k{k}" for k in range(8)]
    first = [(r.choice(keys[:4]), r.randrange(20), f"a{k}") for k in range(12)]
    second = [(r.choice(keys), r.randrange(20), f"b{k}") for k in range(20)]
    first, second = ([x for j, x in enumerate(some) if x[:2] not in {y[:2] for y in some[:j]}] for some in (first, second))
    uses = [(f"u{k}", r.choice(keys), r.randrange(22)) for k in range(60)]
    ddl = "key string, at int, value string"
    got = graph.as_of(spark.createDataFrame(uses, "use string, key string, at int"), spark.createDataFrame(first, ddl), ["key"], "at", "at", ["value"], spark.createDataFrame(second, ddl))

    def plain(key, at):
        history = first if any(k == key for k, _, _ in first) else second
        return max(((t, v) for k, t, v in history if k == key and t < at), default=(0, None))[1]

    assert {x["use"]: x["value"] for x in got.collect()} == {u: plain(k, t) for u, k, t in uses}


def exchanges(df):
    text = df._jdf.queryExecution().simpleString()
    return sum("Exchange hashpartitioning" in line for line in text.splitlines()), text


def test_a_large_frontier_meets_stored_edges_where_they_lie(spark):
    nodes = spark.range(60).selectExpr("concat('n', id) AS id", "'Step' AS type")
    edges = spark.range(200).selectExpr("concat('e', id) AS id", "'reads_dataset' AS type", "concat('n', id % 60) AS src", "concat('n', id * 7 % 60) AS dst")
    made = index.build(nodes, edges, 4)
    front = nodes.where("id < 'n3'").select(F.col("id").alias("f_id"))
    for up in (False, True):
        side, here, there = made.side(up)
        met = index.at(side, here, front, "f_id", index.SMALL + 1)
        assert exchanges(met)[0] == 1, exchanges(met)[1]  # the frontier's alone
        want = {(r["id"], r[here]) for r in edges.collect() if r[here] < "n3"}
        assert {(r["id"], r[here]) for r in met.collect()} == want
        assert side.where("far_type IS NULL").count() == 0 and side.count() == 200
    assert made.out.columns == made.into.columns
