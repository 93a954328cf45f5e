"""Bounded lineage over reads_dataset and writes_dataset edges, level by level.

A small walk is settled level by level from the edges at its frontier.  One that grows joins the frontier with the edges and their far ends' types, and
keeps what was visited in a table, so nothing but counters and, under a limit, at most that many rows reach the driver.  Only nodes of
type Dataset use up depth; an edge to a node already visited is kept and flagged as cycle; a neighbour beyond
the depth is left and its reader goes to the continuation.

With a limit, discovery is in order of the frontier's own order and then of edge ids, exactly as a queue
would give it, and the walk stops at the first neighbour beyond the limit.  Without one, the least edge id
of a level discovers a node.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import settled, settled_with
from . import bounds
from . import index as indexed

EDGE_TYPES = ("reads_dataset", "writes_dataset")
START_TYPES = ("Dataset", "Step", "SqlStatement")


@dataclass
class Trace:
    start: str
    nodes: DataFrame  # id, direction, hop, depth
    edges: DataFrame  # id, type, src, dst, cycle
    continuation: DataFrame  # id
    limit_hit: bool
    depth_hit: bool

    @property
    def truncated(self) -> bool:
        return self.limit_hit or self.depth_hit

    def visited_count(self) -> int:
        return self.nodes.select("id").union(self.nodes.sparkSession.createDataFrame([(self.start,)], "id string")).distinct().count()


def _small(ahead: DataFrame, here: str, start: str, direction: str, depth: int, limit: int | None):
    """The walk where every level is held at once, or None where it grows; rows instead of tables."""
    visited, frontier = {start}, {start: (0, 0)}  # rank, depth
    reached, walked, more, found, hop, limit_hit, depth_hit = [], [], [], 0, 0, False, False
    while frontier and not limit_hit:
        hop += 1
        rows = indexed.held(ahead, here, list(frontier))
        if rows is None or len(visited) > indexed.HELD:
            return None
        rows = sorted(((frontier[r[here]][0], r["id"], r) for r in rows), key=lambda x: x[:2])
        fits = lambda r: frontier[r[here]][1] + r["step"] <= depth
        first: dict[str, tuple] = {}
        for rank, id_, r in rows:
            if r["next"] not in visited:
                if r["step"] is None:
                    raise ValueError("lineage edge points to a missing node")
                if fits(r):
                    first.setdefault(r["next"], (rank, id_))
        new = sorted(first, key=first.get)
        cut = None
        if limit is not None and len(new) > limit - found:
            cut, limit_hit = first[new[limit - found]], True
            more += [new[limit - found], *(n for n, (rank, _) in frontier.items() if rank > cut[0])]
            new = new[: limit - found]
            rows = [x for x in rows if x[:2] < cut]
        found += len(new)
        deep = {r[here] for rank, id_, r in rows if r["next"] not in visited and (r["next"] not in first or (rank, id_) < first[r["next"]])}
        depth_hit, more = depth_hit or bool(deep), more + sorted(deep)
        for rank, id_, r in rows:
            own = first.get(r["next"])
            if r["next"] in visited or (own and (rank, id_) >= own):
                walked.append((id_, r["type"], r["src"], r["dst"], r["next"] in visited or (rank, id_) > own))
        ahead_of = {n: (k if limit is not None else 0, 0) for k, n in enumerate(new)}
        for _, id_, r in rows:
            if r["next"] in ahead_of and first[r["next"]][1] == id_:
                ahead_of[r["next"]] = (ahead_of[r["next"]][0], frontier[r[here]][1] + r["step"])
        reached += [(n, direction, hop, at) for n, (_, at) in ahead_of.items()]
        if limit_hit:
            more += new
        visited.update(new)
        frontier = ahead_of
    spark = ahead.sparkSession
    return (
        [spark.createDataFrame(reached, "id string, direction string, hop int, depth int")],
        [spark.createDataFrame(walked, "id string, type string, src string, dst string, cycle boolean")],
        [spark.createDataFrame([(x,) for x in more], "id string")],
        limit_hit,
        depth_hit,
    )


def _walk(index: indexed.GraphIndex, start: str, direction: str, depth: int, limit: int | None):
    spark = index.nodes.sparkSession
    edges, here, there = index.side(direction == "upstream")
    ahead = edges.where(F.col("type").isin(*EDGE_TYPES)).select("id", "type", "src", "dst", F.col(there).alias("next"), (F.col("far_type") == "Dataset").cast("int").alias("step"))
    if small := _small(ahead, here, start, direction, depth, limit):
        return small
    frontier = spark.createDataFrame([(start, 0, 0)], "f_id string, f_rank int, f_depth int")
    visited = frontier.select("f_id")
    reached, walked, more = [], [], []
    found, hop, limit_hit, depth_hit, ahead_of = 0, 0, False, False, 1
    while True:
        hop += 1
        at = Window.partitionBy("next")
        level = (
            indexed.at(ahead, here, frontier, "f_id", ahead_of)
            .join(visited.select(F.col("f_id").alias("v_id")), F.col("next") == F.col("v_id"), "left")
            .withColumn("fits", F.col("f_depth") + F.col("step") <= depth)
            .withColumn("order", F.struct("f_rank", "id"))
            .withColumn("first", F.min(F.when(F.col("fits"), F.col("order"))).over(at))
            .withColumn(
                "fate",
                F.when(F.col("v_id").isNotNull(), "cycle")
                .when(F.col("step").isNull(), "missing")
                .when(F.col("order") == F.col("first"), "found")
                .when(F.col("order") > F.col("first"), "cycle")
                .otherwise("deep"),
            )
        )
        level, counts = settled_with(
            level.select("id", "type", "src", "dst", "next", "f_id", "f_rank", (F.col("f_depth") + F.col("step")).alias("depth"), "fate"),
            {fate: F.col("fate") == fate for fate in ("found", "missing", "deep")},
        )
        if counts["missing"]:
            raise ValueError("lineage edge points to a missing node")
        ahead_of = counts["found"]
        cut = None
        new = level.where("fate = 'found'")
        if limit is not None and counts["found"]:
            first = new.orderBy("f_rank", "id").limit(limit - found + 1).collect()
            if len(first) > limit - found:
                cut, limit_hit = first.pop(), True
                more.append(spark.createDataFrame([(cut["next"],)], "id string"))
                more.append(frontier.where(F.col("f_rank") > cut["f_rank"]).select(F.col("f_id").alias("id")))
                before = (F.col("f_rank") < cut["f_rank"]) | ((F.col("f_rank") == cut["f_rank"]) & (F.col("id") < cut["id"]))
                level = level.where(before)
            found += len(first)
            new = spark.createDataFrame([(r["next"], i, r["depth"]) for i, r in enumerate(first)], "f_id string, f_rank int, f_depth int")
        else:
            new = new.select(F.col("next").alias("f_id"), F.lit(0).alias("f_rank"), F.col("depth").alias("f_depth"))
        if counts["deep"]:
            deep = level.where("fate = 'deep'").select(F.col("f_id").alias("id")).distinct()
            if cut is None or not deep.isEmpty():
                depth_hit = True
                more.append(deep)
        walked.append(level.where("fate <> 'deep'").select("id", "type", "src", "dst", (F.col("fate") == "cycle").alias("cycle")))
        reached.append(new.select(F.col("f_id").alias("id"), F.lit(direction).alias("direction"), F.lit(hop).alias("hop"), F.col("f_depth").alias("depth")))
        if limit_hit:
            more.append(new.select(F.col("f_id").alias("id")))
        if limit_hit or not counts["found"]:
            break
        frontier, visited = new, visited.union(new.select("f_id"))
        if hop % 8 == 0:
            visited = settled(visited)
    return reached, walked, more, limit_hit, depth_hit


def trace_lineage(nodes: DataFrame, edges: DataFrame | None, start: str, direction: str = "both", depth: int = bounds.DEPTH, limit: int | None = bounds.LIMIT, index: indexed.GraphIndex | None = None) -> Trace:
    """nodes: id, type, ...; edges: id, type, src, dst; with an index both are its own.  For both directions an edge's
    cycle flag wins."""
    if direction not in ("upstream", "downstream", "both"):
        raise ValueError("direction must be upstream, downstream, or both")
    bounds.check(depth, limit)
    kind = nodes.where(F.col("id") == start).select("type").first()
    # fixed values: the words of these errors, by which an editor knows them
    if kind is None:
        raise ValueError(f"node not found: {start}")
    if kind["type"] not in START_TYPES:
        raise ValueError("lineage start must be Dataset, Step, or SqlStatement")
    ways = ("upstream", "downstream") if direction == "both" else (direction,)
    index = index or indexed.once(nodes, edges, *ways)
    reached, walked, more, limit_hit, depth_hit = [], [], [], False, False
    for way in ways:
        r, w, m, lh, dh = _walk(index, start, way, depth, limit)
        reached, walked, more = reached + r, walked + w, more + m
        limit_hit, depth_hit = limit_hit or lh, depth_hit or dh
    both = reduce(DataFrame.unionByName, walked).groupBy("id", "type", "src", "dst").agg(F.max("cycle").alias("cycle"))
    none = nodes.sparkSession.createDataFrame([], "id string")
    return Trace(start, reduce(DataFrame.unionByName, reached), both, reduce(DataFrame.unionByName, more, none).distinct(), limit_hit, depth_hit)
