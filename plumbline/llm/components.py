"""Connected components of a table of edges by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v: long); label is the least node of the component.

    A round takes each node's least label among its neighbours' and then that label's own, so paths
    shrink by half; labels are a stored table, never on the driver."""
    both = tables.stored(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = tables.stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        lowered = labels.join(near, labels["node"] == near["u"]).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("to"))
        moved = lowered.join(jump, lowered["low"] == jump["j"], "left").select("node", F.col("label").alias("was"), F.least("low", F.coalesce("to", "low")).alias("label"))
        moved = tables.stored(moved)
        labels = moved.select("node", "label")
        if moved.where("label < was").isEmpty():
            return labels
