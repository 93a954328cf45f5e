"""Commands over graph files and projects: run, validate, render-mermaid, render-findings, query-search,
query-lineage, query-impact, explain-edge.  Exit codes: 0 done, 1 problems found, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bounds, graph, impact, raw, trace, variables
from .sources import config, contracts, programs, sinks
from .sources.store import settled


def _rows(df: DataFrame) -> list:
    return [r.asDict(True) for r in df.toLocalIterator()]


def _flat(edges: DataFrame) -> DataFrame:
    """Edges with evidence_kind, resolution and confidence as columns, whichever way the file nests them."""
    nested = "evidence" in edges.columns and edges.schema["evidence"].dataType.typeName() == "struct"
    for name, key in (("evidence_kind", "kind"), ("resolution", "resolution"), ("confidence", "confidence")):
        if name not in edges.columns:
            has = nested and key in edges.schema["evidence"].dataType.names
            edges = edges.withColumn(name, F.col(f"evidence.{key}") if has else F.lit(None).cast("double" if key == "confidence" else "string"))
    if "derivation_refs" not in edges.columns:
        has = nested and "derivation_refs" in edges.schema["evidence"].dataType.names
        edges = edges.withColumn("derivation_refs", (F.col("evidence.derivation_refs") if has else F.lit(None)).cast("array<string>"))
    return edges


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    """Reads a project, by its configuration or whole below one folder, and writes the run's tables."""
    before: list = []
    if a.config:
        c = config.read(a.config)
        if c.blocked:
            print(json.dumps({"status": "FAILED", "problems": [vars(x) for x in c.problems]}))
            return 1
        output, declared = str(c.output), [str(x) for x in c.programs]
        roots = list(map(str, c.roots))
        own = programs.snapshot(spark, roots, [str(c.setup), *declared])
        texts = own.files
        order = spark.createDataFrame(list(zip(declared, range(len(declared)), strict=True)), "path string, rank int")
        main = texts.join(F.broadcast(order), "path")  # as many as are declared
        setup = texts.where(F.col("path") == str(c.setup)).withColumn("rank", F.lit(-1))
        below = F.lit(False)
        for x in c.macro_roots:
            below = below | F.col("path").startswith(f"{x}/")
        context = {"library": texts, "folders": own.folders, "macros": texts.where(below & F.lower("path").endswith(".sas")), "os_base": c.os_base, "roots": roots}
        if c.contracts:
            places = list(map(str, c.contracts))
            # fixed value: macros with this beginning are the documented ones
            called = programs.called_macros(texts.where(below).unionByName(main.drop("rank")).unionByName(setup.drop("rank"))).where("name LIKE 'gm%'")
            context["contracts"] = contracts.read_contracts(contracts.wanted(programs.read_sources(spark, *places, glob="*.md"), places, called))
        first = settled(programs.facts(setup, role="SetupFile", **context))
        said = [{"type": x.type, "status": x.status, "severity": x.severity, "object": x.key, "message": x.message, "line_start": None, "affected_nodes": []} for x in c.problems]
        before = [programs.told(spark, said), first]
        context["setup"] = programs.carried(first)
        shown = {"programs": declared, "setup": str(c.setup), "roots": roots, "macro_roots": list(map(str, c.macro_roots)), "contracts": list(map(str, c.contracts)), "os_base": c.os_base}
    elif a.sources and a.output:
        output, shown = a.output, {"folder": a.sources}
        own = programs.snapshot(spark, [a.sources])
        main = own.files.where(F.lower("path").endswith(".sas"))
        context = {"library": own.files, "folders": own.folders, "macros": main}
    else:
        raise ValueError("run needs --config, or a folder and an output")
    name = sinks.reserve(spark, output)
    try:
        found = reduce(DataFrame.unionByName, before, programs.facts(main, **context))
        nodes, edges, findings = programs.graph(found)
        own.check()
        sinks.write_tables(output, name, nodes=nodes, edges=edges, findings=findings, manifest=sinks.manifest(own.files, findings, shown))
    except Exception:
        sinks.remove_run(spark, output, name)  # of this run only
        raise
    status = graph.run_status(findings).first()["status"]
    print(json.dumps({"run_id": name, "status": status}))
    return int(status == "FAILED")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("sources", nargs="?")
    run.add_argument("output", nargs="?")
    run.add_argument("--config")
    for name in ("validate", "render-mermaid", "render-findings", "query-search", "query-lineage", "query-impact", "explain-edge"):
        c = sub.add_parser(name)
        c.add_argument("graph")
        if name == "query-search":
            c.add_argument("query")
        if name == "query-lineage":
            c.add_argument("node")
            c.add_argument("--direction", default="both")
            c.add_argument("--depth", type=int, default=bounds.DEPTH)
            c.add_argument("--limit", type=int, default=bounds.LIMIT)
        if name == "query-impact":
            c.add_argument("--variable")
            c.add_argument("--node")
            c.add_argument("--mode", action="append")
            c.add_argument("--depth", type=int, default=bounds.DEPTH)
            c.add_argument("--limit", type=int, default=bounds.LIMIT)
        if name == "explain-edge":
            c.add_argument("edge")
            c.add_argument("--limit", type=int, default=bounds.LIMIT)
    try:
        a = p.parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0) and 2
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    try:
        if a.command == "run":
            return _run(spark, a)
        if a.command == "validate":
            found = _rows(raw.in_order(raw.problems(*raw.read(spark, a.graph))))
            print(json.dumps(found))
            return int(bool(found))
        g = sinks.read_graph(spark, a.graph)
        nodes, edges, findings = g["nodes"], _flat(g["edges"]), g["findings"]
        if a.command == "render-mermaid":
            print(sinks.diagram(nodes, edges), end="")
        elif a.command == "render-findings":
            print(sinks.report(findings), end="")
        elif graph.run_status(findings).first()["status"] == "FAILED":
            print("the graph's run failed", file=sys.stderr)
            return 1
        elif a.command == "query-search":
            print(json.dumps(_rows(graph.search_nodes(nodes, a.query))))
        elif a.command == "query-lineage":
            t = trace.trace_lineage(nodes, edges, a.node, a.direction, a.depth, a.limit)
            print(json.dumps({"start": a.node, "nodes": _rows(t.nodes), "edges": _rows(t.edges), "truncated": t.truncated, "continuation": _rows(t.continuation)}))
        elif a.command == "query-impact" and (a.node or a.mode):
            i = impact.impact(nodes, edges, a.node or a.variable, tuple(a.mode or ("structural",)), a.depth, a.limit)
            print(json.dumps({"seed": a.node or a.variable, "nodes": _rows(i.nodes.orderBy("id")), "boundaries": _rows(i.boundaries.where(F.size("reasons") > 0).orderBy("id", "mode")), "paths": _rows(i.paths.union(i.cycles).orderBy("target", "mode", "path_edges")), "truncated": i.limit_hit or i.depth_hit, "continuation": sorted(r["id"] for r in i.continuation.collect()) if i.limit_hit else []}))
        elif a.command == "query-impact":
            v = variables.walk_variable_impact(edges if "value" in edges.columns else edges.withColumn("value", F.lit(None).cast("string")), a.variable, a.depth, a.limit)
            print(json.dumps({"start": a.variable, "variables": _rows(v.variables), "operations": _rows(v.operations), "facts": _rows(v.facts), "limit_hit": v.limit_hit, "depth_hit": v.depth_hit, "continuation": _rows(v.continuation)}))
        else:
            found = _rows(graph.explanation(nodes, edges, findings, a.edge, a.limit).orderBy("section", "id"))
            row = _rows(graph.explain_edge(edges, findings, a.edge))[0]
            shown = {s: [r for r in found if r["section"] == s and not r["omitted"]] for s in ("path", "finding")}
            print(json.dumps({"edge": row, "resolution_path": shown["path"], "findings": shown["finding"], "continuation": sorted(r["id"] for r in found if r["omitted"])}, default=str))
        return 0
    except (ValueError, TypeError) as error:
        print(str(error), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
