"""Undirected hop distances from hit nodes over lineage edges, bridges, and the status of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import settled, settled_with
from . import index

# Edge types that carry lineage.
PROPAGATING = ("reads_dataset", "writes_dataset", "reads_variable", "writes_variable", "reads_external_file", "writes_external_file", "implemented_by")


def reach(edges: DataFrame, hits: list[str], ceiling: int = 3) -> DataFrame:
    """(hit, node, dist) for every node within the ceiling of every hit.

    A hop asks the edges from both ends for what is at the frontier, which is broadcast up to a counted size; edges are not turned round or shuffled."""
    spark = edges.sparkSession
    some = settled(edges.where(F.col("type").isin(*PROPAGATING)).select("src", "dst"))
    found = front = spark.createDataFrame([(h, h, 0) for h in sorted(set(hits))], "hit string, node string, dist int")
    count = len(set(hits))
    for hop in range(1, ceiling + 1):
        ways = [index.at(some, here, front, "node", count).select("hit", F.col(there).alias("node")) for here, there in (("src", "dst"), ("dst", "src"))]
        step = ways[0].unionByName(ways[1]).distinct().join(found, ["hit", "node"], "left_anti").withColumn("dist", F.lit(hop))
        front, counts = settled_with(step, {"all": F.lit(True)})
        count = counts["all"]
        if not count:
            break
        found = found.unionByName(front)
    return settled(found)


def distances(reached: DataFrame) -> DataFrame:
    return reached.groupBy("node").agg(F.min("dist").alias("dist"))


def _pairs(reached: DataFrame, hits: list[str]) -> DataFrame:
    own = reached.sparkSession.createDataFrame([(a, b) for a in sorted(set(hits)) for b in sorted(set(hits)) if a < b], "a string, b string")
    direct = reached.select(F.col("hit").alias("a"), F.col("node").alias("b"), "dist")
    return own.join(direct, ["a", "b"], "left")


def pair_status(reached: DataFrame, hits: list[str]) -> DataFrame:
    """(a, b, status): reachable or disconnected within the ceiling."""
    return _pairs(reached, hits).select("a", "b", F.when(F.col("dist").isNull(), "disconnected").otherwise("reachable").alias("status"))


def bridges(reached: DataFrame, hits: list[str]) -> DataFrame:
    """Nodes, not hits themselves, on a shortest way between two hits."""
    pairs = _pairs(reached, hits).where("dist IS NOT NULL").withColumnRenamed("dist", "whole")
    left = reached.select(F.col("hit").alias("a"), "node", F.col("dist").alias("da"))
    right = reached.select(F.col("hit").alias("b"), "node", F.col("dist").alias("db"))
    between = F.broadcast(pairs).join(left, "a").join(right, ["b", "node"])
    return between.where((F.col("da") + F.col("db") == F.col("whole")) & ~F.col("node").isin(*hits)).select("node").distinct()
