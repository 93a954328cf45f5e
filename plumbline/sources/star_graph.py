"""Property graphs out of the star-schema tables.

Lineage: part -> order step -> order -> customer statement -> customer -> nation step -> nation -> region
step -> region.  Variables: each event of a user reads the variable of its own type and writes that of the
user's next event, which makes natural cycles.  Ids carry keys, so no counters are needed and every edge is
built where its row is; only duplicate (part, order) pairs meet in an aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import parts_of, table


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _edges(df: DataFrame, name: Column, kind: str, src: Column, dst: Column, flag: Column | None = None) -> DataFrame:
    return df.select(name.alias("id"), F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), (flag if flag is not None else F.lit("N")).alias("flag"))


def lineage_parts(spark: SparkSession, sf_dir: str) -> int:
    """Among how many tasks the lineage edges are dealt; the tables' own counts tell it."""
    rows = {n: table(spark, sf_dir, n).count() for n in ("lineitem", "orders", "customer")}
    return parts_of(spark, rows["lineitem"] + 2 * rows["orders"] + 2 * rows["customer"])


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, src, dst, flag); flag is the greatest return flag of the lines behind a part's edge."""
    # pairs hardly repeat, so they are dealt before they meet: nothing is gathered or sorted where a file is read
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_returnflag").repartition(lineage_parts(spark, sf_dir), "l_partkey", "l_orderkey")
    lines = lines.groupBy("l_partkey", "l_orderkey").agg(F.max("l_returnflag").alias("flag"))
    orders, customer, nation, region = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region"))
    parts = [
        _edges(lines, F.concat(_id("e:r:p", "l_partkey"), _id(":o", "l_orderkey")), "reads_dataset", _id("dataset:part.", "l_partkey"), _id("step:o", "l_orderkey"), F.col("flag")),
        _edges(orders, _id("e:w:o", "o_orderkey"), "writes_dataset", _id("step:o", "o_orderkey"), _id("dataset:order.", "o_orderkey")),
        _edges(orders, _id("e:r:o", "o_orderkey"), "reads_dataset", _id("dataset:order.", "o_orderkey"), _id("sqlstatement:c", "o_custkey")),
        _edges(customer, _id("e:w:c", "c_custkey"), "writes_dataset", _id("sqlstatement:c", "c_custkey"), _id("dataset:customer.", "c_custkey")),
        _edges(customer, _id("e:r:c", "c_custkey"), "reads_dataset", _id("dataset:customer.", "c_custkey"), _id("step:n", "c_nationkey")),
        _edges(nation, _id("e:w:n", "n_nationkey"), "writes_dataset", _id("step:n", "n_nationkey"), _id("dataset:nation.", "n_nationkey")),
        _edges(nation, _id("e:r:n", "n_nationkey"), "reads_dataset", _id("dataset:nation.", "n_nationkey"), _id("step:r", "n_regionkey")),
        _edges(region, _id("e:w:r", "r_regionkey"), "writes_dataset", _id("step:r", "r_regionkey"), _id("dataset:region.", "r_regionkey")),
    ]
    return reduce(DataFrame.unionByName, parts)


def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, label)"""
    part, orders, customer, nation, region = (table(spark, sf_dir, n) for n in ("part", "orders", "customer", "nation", "region"))

    def nodes(df: DataFrame, prefix: str, key: str, kind: str, label: Column) -> DataFrame:
        return df.select(_id(prefix, key).alias("id"), F.lit(kind).alias("type"), label.alias("label"))

    return reduce(
        DataFrame.unionByName,
        [
            nodes(part, "dataset:part.", "p_partkey", "Dataset", F.col("p_name")),
            nodes(orders, "step:o", "o_orderkey", "Step", _id("order step ", "o_orderkey")),
            nodes(orders, "dataset:order.", "o_orderkey", "Dataset", _id("order.", "o_orderkey")),
            nodes(customer, "sqlstatement:c", "c_custkey", "SqlStatement", _id("customer statement ", "c_custkey")),
            nodes(customer, "dataset:customer.", "c_custkey", "Dataset", F.col("c_name")),
            nodes(nation, "step:n", "n_nationkey", "Step", _id("nation step ", "n_nationkey")),
            nodes(nation, "dataset:nation.", "n_nationkey", "Dataset", F.col("n_name")),
            nodes(region, "step:r", "r_regionkey", "Step", _id("region step ", "r_regionkey")),
            nodes(region, "dataset:region.", "r_regionkey", "Dataset", F.col("r_name")),
        ],
    )


def evidence(flag: Column) -> list[Column]:
    """Evidence kind and resolution from a flag: N observed, A heuristic, R unknown."""
    return [
        F.when(flag == "N", "OBSERVED").when(flag == "A", "HEURISTIC").otherwise("UNKNOWN").alias("evidence_kind"),
        F.when(flag == "N", "EXACT").when(flag == "A", "PARTIAL").otherwise("UNRESOLVED").alias("resolution"),
    ]


def variable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, src, dst, value): events as operations between their user's variables."""
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    events = table(spark, sf_dir, "events").withColumn("next_type", following)
    prefix = F.concat(_id("variable:events.u", "user_id"), F.lit("."))
    own, step = F.concat(prefix, F.col("event_type")), _id("step:e", "event_id")
    value = F.col("event_type")
    reads = events.select(_id("e:rv:", "event_id").alias("id"), F.lit("reads_variable").alias("type"), own.alias("src"), step.alias("dst"), value.alias("value"))
    writes = events.where("next_type IS NOT NULL").select(
        _id("e:wv:", "event_id").alias("id"), F.lit("writes_variable").alias("type"), step.alias("src"), F.concat(prefix, F.col("next_type")).alias("dst"), F.col("next_type").alias("value")
    )
    return reads.unionByName(writes)
