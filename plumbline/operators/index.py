"""A graph's adjacency, stored once for many queries.

Every edge stands in two tables with the type of its far end: `out`, in buckets by its source and sorted by it, and `into`,
the same by its destination.  A level of a walk asks for the edges at its frontier: few ids go to the scan as a filter, which opens only their
buckets; more are broadcast; beyond a counted size the frontier alone is dealt to the buckets.  No query over an index writes or shuffles
edges that it does not reach.

A walk whose levels stay small asks once a level and settles it where it is asked: up to ``HELD`` edges a level and as many nodes in all.
One that grows beyond starts again as joins of tables, with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..sources.store import parts_of, settled_by

FEW = 1_000  # ids that a scan filters by
SMALL = 100_000  # ids that are broadcast, some 10 MB
HELD = 20_000  # edges of a level, and nodes of a walk, that are settled without a table
CARRIED = {"evidence_kind": "string", "resolution": "string", "value": "string"}


@dataclass
class GraphIndex:
    nodes: DataFrame
    out: DataFrame | None  # id, type, src, dst, far_type (of dst; null where there is no such node), and CARRIED
    into: DataFrame | None  # the same with far_type of src

    def side(self, upstream: bool) -> tuple[DataFrame, str, str]:
        """(edges, near end, far end)"""
        return (self.into, "dst", "src") if upstream else (self.out, "src", "dst")


def _typed(kinds: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """edges with the type of an end; they are dealt by it and meet the buckets of the kinds, which stay."""
    far = kinds.select(F.col("id").alias("n_id"), F.col("type").alias(f"{end}_type")).hint("shuffle_hash")
    return edges.join(far, F.col(end) == F.col("n_id"), "left").drop("n_id")


def build(nodes: DataFrame, edges: DataFrame, parts: int | None = None, cached: bool = False, ways: tuple[str, ...] = ("downstream", "upstream")) -> GraphIndex:
    """nodes: id, type; edges: id, type, src, dst and any of CARRIED.  Of repeated node ids the least type counts.

    parts: buckets of a table, by default the session's shuffle partitions; cached: kept by the executors besides, in memory or on their disks, for a
    session that asks much.  A lost executor's share is read from the stored tables again.  ways: the sides that are stored; for both an edge travels
    three times, by its destination, by its source and back."""
    parts = parts or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = settled_by(nodes.select("id", "type").repartition(parts, "id").groupBy("id").agg(F.min("type").alias("type")), parts, "id")
    more = [(F.col(c) if c in edges.columns else F.lit(None)).cast(t).alias(c) for c, t in CARRIED.items()]
    edges, out, into = edges.select("id", "type", "src", "dst", *more), None, None
    if "downstream" in ways:
        typed = _typed(kinds, edges, "dst")
        typed = _typed(kinds, typed, "src") if "upstream" in ways else typed.repartition(parts, "src")
        out = settled_by(typed, parts, "src", "id")
    if "upstream" in ways:
        into = settled_by((_typed(kinds, edges, "src") if out is None else out.drop("dst_type")).repartition(parts, "dst"), parts, "dst", "id")
    out = out and out.drop("src_type").withColumnRenamed("dst_type", "far_type")
    made = GraphIndex(kinds, out, into and into.withColumnRenamed("src_type", "far_type"))
    if cached:
        for df in (made.nodes, made.out, made.into):
            df.persist(StorageLevel.MEMORY_AND_DISK).count()
    return made


def once(nodes: DataFrame, edges: DataFrame, *ways: str) -> GraphIndex:
    """An index for one query: the sides of the given ways alone, upstream or downstream.  Edges are counted first, so they should be a stored table."""
    return build(nodes, edges, parts_of(edges.sparkSession, edges.count()), ways=ways)


def held(edges: DataFrame, near: str, names: list[str]) -> list[Row] | None:
    """The edges at the named nodes, or None where they are more than are held."""
    if len(names) > FEW:
        return None
    # the range too: it leaves sorted parts out whose least and greatest ids are kept, however many names there are
    rows = edges.where(F.col(near).between(min(names), max(names)) & F.col(near).isin(*names)).limit(HELD + 1).collect()
    return rows if len(rows) <= HELD else None


def at(edges: DataFrame, near: str, frontier: DataFrame, key: str, count: int) -> DataFrame:
    """The edges whose near end is a key of the frontier, with the frontier's columns; count: its rows."""
    return edges.join(F.broadcast(frontier) if count <= SMALL else frontier.hint("shuffle_hash"), F.col(near) == F.col(key))
