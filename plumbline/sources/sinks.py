"""Graph tables out of and into files: JSON, manifest, flow diagram, findings report."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import diagram_id
from ..operators.view import with_capability
from ..operators.vocabulary import SCHEMA_VERSIONS

# What a diagram shows, and the order of a report's sections.
SHOWN = ("Dataset", "UnknownDataset", "Step", "SqlStatement", "MacroCall", "ExternalFile", "UnknownMacro")
DRAWN = ("reads_dataset", "writes_dataset", "reads_external_file", "writes_external_file", "implemented_by", "passes_parameter")
SECTIONS = ("BLOCKED", "REQUIRES_DECISION", "MACRO_CONFLICT", "UNRESOLVED_MACRO_SOURCE", "UNRESOLVED_MACRO_VARIABLE", "UNQUALIFIED_VARIABLE", "CONDITIONAL_BRANCH_UNRESOLVED", "NOT_EXECUTED", "SUPPORTED")


def run_id() -> str:
    return f"{datetime.now(UTC):%Y%m%dT%H%M%S}Z-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _unfinished(path: str, run: str) -> str:
    return f"{path}/_unfinished-{run}"  # readers leave names with an underscore out


def reserve(spark: SparkSession, path: str, tries: int = 5) -> str:
    """A run's name that is this caller's alone: a marker is created for it where none was, in one step of the
    file system; a name that is taken is left for another."""
    for _ in range(tries):
        name = run_id()
        fs, marker = _folder(spark, f"{_unfinished(path, name)}/_reserved")
        if fs.exists(_folder(spark, f"{path}/{name}")[1]):
            continue
        try:
            fs.create(marker, False).close()
            return name
        except Exception as error:  # a Java exception; only one that tells of the marker is a name taken
            if "FileAlreadyExists" not in str(error):
                raise
    raise RuntimeError(f"no free name for a run below {path} in {tries} tries")


def write_tables(path: str, run: str, **tables: DataFrame) -> None:
    """The tables of a run that was reserved, below a name that no reader takes for a run, then renamed in one step: a run is
    there whole or not at all, and never written twice."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run)).write.mode("errorifexists").parquet(f"{_unfinished(path, run)}/{name}")
    fs, held = _folder(spark, _unfinished(path, run))
    final = _folder(spark, f"{path}/{run}")[1]
    if fs.exists(final) or not fs.rename(held, final):
        raise RuntimeError(f"the run {run} is there already")
    fs.delete(_folder(spark, f"{path}/{run}/_reserved")[1], False)


def remove_run(spark: SparkSession, path: str, run: str) -> None:
    """What one run left that could not be written whole."""
    for place in (_unfinished(path, run), f"{path}/{run}"):
        fs, where = _folder(spark, place)
        fs.delete(where, True)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id) of the finished runs below a folder."""
    fs, where = _folder(spark, path)
    names = [s.getPath().getName() for s in (fs.listStatus(where) if fs.exists(where) else []) if s.isDirectory()]
    return spark.createDataFrame([(n,) for n in names if not n.startswith(("_", "."))], "run_id string")


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max("run_id").alias("run_id"))


def manifest(sources: DataFrame, findings: DataFrame, configuration: dict | None = None) -> DataFrame:
    """A row a source (path, sha256, n_bytes), then one with the configuration, as JSON, and the number of findings."""
    files = sources.select("path", "sha256", "n_bytes", F.lit(None).cast("string").alias("configuration"), F.lit(None).cast("long").alias("findings"))
    none = F.lit(None)
    body = F.lit(json.dumps(configuration or {}, sort_keys=True))
    whole = findings.agg(F.count("*").alias("findings")).select(none.cast("string").alias("path"), none.cast("string").alias("sha256"), none.cast("long").alias("n_bytes"), body.alias("configuration"), "findings")
    return files.unionByName(whole)


def upgraded(envelope: dict) -> dict:
    """The envelope of a 0.2.0 graph as 0.3.0: its version, its producer's, and that edges have evidence.  Edges are normalised as a table."""
    if envelope.get("schema_version") != SCHEMA_VERSIONS[0]:
        raise ValueError(f"an envelope of version {SCHEMA_VERSIONS[0]} is expected")
    schema = dict(envelope.get("schema") or {})
    schema |= {"producer_version": SCHEMA_VERSIONS[0], "capabilities": with_capability(schema.get("capabilities"))}
    return envelope | {"schema_version": SCHEMA_VERSIONS[-1], "schema": schema}


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, edges and findings of a graph's JSON file; other schema versions are refused."""
    raw = spark.read.option("multiLine", True).json(path)
    version = raw.select("schema_version").first()[0]
    if version not in SCHEMA_VERSIONS:
        raise ValueError(f"unsupported schema version: {version}")
    out = {}
    for name in ("nodes", "edges", "findings"):
        out[name] = raw.select(F.explode(name).alias("r")).select("r.*")
    out["edges"] = out["edges"].withColumnsRenamed({"from": "src", "to": "dst"})
    return out


def graph_json(nodes: DataFrame, edges: DataFrame, findings: DataFrame, run: str, status: str) -> str:
    """One JSON document, for graphs that one machine is to show."""
    rows = lambda df: [json.loads(r) for r in df.toJSON().toLocalIterator()]
    renamed = edges.withColumnsRenamed({"src": "from", "dst": "to"})
    body = {"schema_version": SCHEMA_VERSIONS[-1], "run_id": run, "run_status": status, "nodes": rows(nodes.orderBy("id")), "edges": rows(renamed.orderBy("id")), "findings": rows(findings.orderBy("id"))}
    return json.dumps(body, indent=2, ensure_ascii=False) + "\n"


def diagram_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a Mermaid flow chart.  An edge out of a parameter starts at the call that passes it; what a contract tells is dashed."""
    if "evidence_kind" not in edges.columns:
        edges = edges.withColumn("evidence_kind", F.lit(None).cast("string"))
    kept = nodes.where(F.col("type").isin(*SHOWN)).select("id", "label", "type")
    hop = edges.where("type = 'passes_parameter'").select(F.col("dst").alias("param"), F.col("src").alias("call"))
    drawn = edges.where(F.col("type").isin(*DRAWN, "resolves_to") & (F.col("type") != "passes_parameter")).join(hop, F.col("src") == F.col("param"), "left")
    ends = drawn.select(F.coalesce("call", "src").alias("a"), F.col("dst").alias("b"), "type", F.when(F.col("evidence_kind") == "CONTRACT_DERIVED", " -.->|").otherwise(" -->|").alias("arrow"))
    for end in ("a", "b"):
        ends = ends.join(kept.select(F.col("id").alias("k")), F.col(end) == F.col("k"), "left_semi")
    boxes = kept.select(F.lit(0).alias("part"), F.concat(diagram_id(F.col("id")), F.lit('["'), F.replace("label", F.lit('"'), F.lit("'")), F.lit('"]')).alias("line"))
    return boxes.unionByName(ends.select(F.lit(1).alias("part"), F.concat(diagram_id(F.col("a")), "arrow", "type", F.lit("| "), diagram_id(F.col("b"))).alias("line"))).distinct()


def diagram(nodes: DataFrame, edges: DataFrame) -> str:
    return "flowchart LR\n" + "".join(f"  {r['line']}\n" for r in diagram_lines(nodes, edges).orderBy("part", "line").toLocalIterator())


def report_rows(findings: DataFrame) -> DataFrame:
    """(section, rank, id, line): statuses beyond the known ones come last, none is dropped."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("status")), F.lit(0)), F.lit(len(SECTIONS) + 1))
    return findings.select(F.col("status").alias("section"), rank.alias("rank"), "id", F.concat(F.lit("- **"), "type", F.lit("** "), F.coalesce("object", F.lit("")), F.lit(": "), F.coalesce("message", F.lit(""))).alias("line"))


def report(findings: DataFrame) -> str:
    out, section = ["# Findings\n"], None
    for r in report_rows(findings).orderBy("rank", "section", "id").toLocalIterator():
        if r["section"] != section:
            section = r["section"]
            out.append(f"\n## {section}\n")
        out.append(r["line"] + "\n")
    return "".join(out)
