"""What a graph's viewer shows: hits, opacities, notes, drawn rows, and lists that a panel looks up."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import settled
from . import graph
from .hops import PROPAGATING

# An edge's opacity by the farther end's hops from a hit, and other opacities.
BANDS = (1.0, 0.9, 0.6, 0.35)
BEYOND, UNREACHED, IDLE, HOVER, DIMMED = 0.15, 0.03, 0.5, 0.9, 0.1
# Arrow heads by edge type.
ARROWS = {
    "reads_dataset": "vee",
    "reads_variable": "vee",
    "reads_external_file": "vee",
    "writes_dataset": "triangle",
    "writes_variable": "triangle",
    "writes_external_file": "triangle",
    "implemented_by": "circle",
}
MOST_NAMED = 2


def hit_set(nodes: DataFrame, click: str | None = None, searched: DataFrame | None = None, kind: str | None = None, library: str | None = None) -> DataFrame | None:
    """(id) of the hits: a clicked node alone, else what search and filter both let through; None without any of them."""
    if click:
        return nodes.sparkSession.createDataFrame([(click,)], "id string")
    if kind is None and library is None:
        return None if searched is None else searched.select("id").distinct()
    passed = graph.filter_nodes(nodes, kind, library).select("id")
    return passed if searched is None else searched.select("id").distinct().join(passed, "id", "left_semi")


def edge_opacity(edges: DataFrame, distances: DataFrame | None, highlighted: str | None = None) -> DataFrame:
    """(id, opacity): by the farther end's distance from a hit; a highlighted node's edges are raised, never lowered."""
    if distances is None:
        out = edges.select("id", "src", "dst", F.lit(IDLE).alias("opacity"))
    else:
        a, b = (distances.select(F.col("node").alias(end), F.col("dist").alias(f"{end}_dist")) for end in ("src", "dst"))
        met = edges.select("id", "src", "dst").join(a, "src", "left").join(b, "dst", "left")
        far = F.greatest("src_dist", "dst_dist")
        value = F.when(F.col("src_dist").isNull() | F.col("dst_dist").isNull(), UNREACHED)
        for hop, opacity in enumerate(BANDS):
            value = value.when(far == hop, opacity)
        out = met.select("id", "src", "dst", value.otherwise(BEYOND).alias("opacity"))
    if highlighted is not None:
        touched = (F.col("src") == highlighted) | (F.col("dst") == highlighted)
        out = out.withColumn("opacity", F.when(touched, F.greatest("opacity", F.lit(HOVER))).otherwise(F.col("opacity")))
    return out.select("id", "opacity")


def node_opacity(nodes: DataFrame, hits: DataFrame, bridges: DataFrame, distances: DataFrame | None = None, highlighted: str | None = None) -> DataFrame:
    """(id, opacity): hits, bridges and what a hit reaches stay, the rest is dimmed, a highlighted node is not."""
    shown = hits.select("id").unionByName(bridges.select(F.col("node").alias("id")))
    if distances is not None:
        shown = shown.unionByName(distances.select(F.col("node").alias("id")))
    met = nodes.select("id").join(shown.distinct().withColumn("shown", F.lit(True)), "id", "left")
    bright = F.col("shown").isNotNull() if highlighted is None else F.col("shown").isNotNull() | (F.col("id") == highlighted)
    return met.select("id", F.when(bright, 1.0).otherwise(DIMMED).alias("opacity"))


def without_lineage(hits: list[str], edges: DataFrame) -> list[str]:
    """Of some hits those that no lineage edge touches."""
    some = edges.sparkSession.createDataFrame([(h, k) for k, h in enumerate(hits)], "id string, place int")
    ends = edges.where(F.col("type").isin(*PROPAGATING))
    touched = ends.select(F.col("src").alias("id")).unionByName(ends.select(F.col("dst").alias("id")))
    return [r["id"] for r in some.join(touched.join(F.broadcast(some.select("id")), "id", "left_semi").distinct(), "id", "left_anti").orderBy("place").collect()]


def status_note(hits: list[str], pairs: DataFrame | None, edges: DataFrame, ceiling: int, labels: dict[str, str]) -> str | None:
    """What to say of hits without lineage and of a pair that is not connected; None for nothing.  pairs: (a, b, status)."""
    bare = without_lineage(hits, edges) if hits else []
    name = lambda i: f'"{labels.get(i, i)}"'
    note = None
    if bare:
        who = ", ".join(map(name, bare[:MOST_NAMED])) + (f", and {len(bare) - MOST_NAMED} more" if len(bare) > MOST_NAMED else "")
        note = f"No lineage edges (dataset reads/writes, external-file reads/writes, or implemented-by) to trace for: {who}."
        if len(bare) == len(hits):
            return note
    apart = None
    if pairs is not None:
        left = pairs.where((F.col("status") == "disconnected") & ~F.col("a").isin(*bare, "") & ~F.col("b").isin(*bare, "")).orderBy("a", "b").first()
        apart = left and f"{name(left['a'])} and {name(left['b'])} are not connected within {ceiling} hops."
    return " ".join(x for x in (apart, note) if x) or None


def _title() -> Column:
    source, target = F.col("src_label"), F.col("dst_label")
    return (
        F.when(F.col("type").isin("reads_dataset", "reads_variable"), F.concat(F.lit("reads "), source))
        .when(F.col("type").isin("writes_dataset", "writes_variable"), F.concat(F.lit("writes "), target))
        .when(F.col("type") == "implemented_by", F.concat(F.lit("implemented by "), target))
        .otherwise(F.col("type"))
    )


def render_model(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drawn nodes with label, group and value (degree, 1 at least), drawn edges with arrow and title."""
    kept, drawn = graph.render_rows(nodes, edges)
    named = kept.select("id", F.coalesce("label", "id").alias("label"), F.col("type").alias("group"))
    shown = named.join(graph.degrees(kept, drawn), "id").withColumnRenamed("degree", "value")
    arrow = F.lit(None).cast("string")
    for kind, head in ARROWS.items():
        arrow = F.when(F.col("type") == kind, head).otherwise(arrow)
    # named are the drawn nodes alone, so these joins leave what render_rows leaves and no edge travels for that besides
    out = edges.select("id", "src", "dst", "type")
    for end in ("src", "dst"):
        out = out.join(named.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end)
    return shown, out.select("id", "src", "dst", "type", arrow.alias("arrow"), _title().alias("title"))


def macro_parameters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parameters): of every macro call its parameters' names and values, by name."""
    own = nodes.where("type = 'MacroParameter'").select(F.col("id").alias("dst"), F.struct(F.col("label").alias("name"), "value").alias("one"))
    return edges.where("type = 'passes_parameter'").join(own, "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("one")).alias("parameters"))


def adjacency(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(node, type, edges): the ids of a node's edges of a type, as strings in order."""
    end = {"out": "src", "in": "dst"}[direction]
    return edges.groupBy(F.col(end).alias("node"), "type").agg(F.sort_array(F.collect_list("id")).alias("edges"))


CHUNK = 4096  # ids in a row of a long list


def adjacency_chunks(edges: DataFrame, direction: str = "out", size: int = CHUNK, parts: int | None = None) -> DataFrame:
    """(node, type, chunk, edges): the same lists cut into rows of at most so many ids, in order, so a hub makes many rows and no long one.

    Edges are dealt into ranges of (node, type, id) and sorted there; an edge's place in its list is its place in its range behind what
    earlier ranges hold of the list.  What a range holds of a list is a row, so the ranges of a hub are numbered from these alone.  parts: how many ranges, by default
    the session's shuffle partitions."""
    end = {"out": "src", "in": "dst"}[direction]
    parts = parts or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.select(F.col(end).alias("node"), "type", "id").repartitionByRange(parts, "node", "type", "id").sortWithinPartitions("node", "type", "id")
    dealt = settled(dealt.withColumn("part", F.spark_partition_id()))
    held = dealt.groupBy("node", "type", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("node", "type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("node", "type", "part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("node", "type", "part").orderBy("id"))
    placed = dealt.repartition(parts, "node", "type", "part").withColumn("own", own).join(held, ["node", "type", "part"])
    chunk = F.floor((F.col("before") + F.col("own") - 1) / size)
    placed = placed.select("node", "type", chunk.cast("int").alias("chunk"), "id").repartition(parts, "node", "type", "chunk")
    return placed.groupBy("node", "type", "chunk").agg(F.sort_array(F.collect_list("id")).alias("edges"))


def source_index(nodes: DataFrame) -> DataFrame:
    """(file, ids) of the nodes that stand in a file.  nodes: id, file."""
    return nodes.where("file IS NOT NULL").groupBy("file").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def inline_json(value) -> str:
    """JSON that may stand inside a page's script."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).replace("<", "\\u003c")


def inside_root(root: str, target: str) -> bool:
    """Whether a jump may open a file: it is the root or below it, whatever dots its path has."""
    base, own = posixpath.normpath(root.replace("\\", "/")), posixpath.normpath(target.replace("\\", "/"))
    return own == base or own.startswith(base + "/")


def with_capability(known: list[str] | None, added: str = "evidence_v1") -> list[str]:
    """A graph's capabilities and one more, each once, in order."""
    return list(dict.fromkeys([*(known if known is not None else ["dataset_lineage", "variable_lineage"]), added]))
