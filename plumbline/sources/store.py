"""Tables, and the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


ROWS = 500_000  # rows of a task, at most, where the rows are counted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's own checkpoint folder; a temporary one only on a single
    machine where neither is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='plumbline-')}")
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get()


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: loops keep short plans, and lost executors no rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled_by(df: DataFrame, parts: int, key: str, *order: str) -> DataFrame:
    """settled(df) in buckets by a key, a file a bucket, sorted inside: a join by the key reads it where it lies, and few keys few of its files.

    The rows must be dealt by repartition(parts, key) or a join by it.  The session's catalog holds the table's name, the shared folder its files."""
    spark, name = df.sparkSession, f"plumbline_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").bucketBy(parts, key).sortBy(key, *order).saveAsTable(name)
    return spark.table(name)


def parts_of(spark: SparkSession, rows: int) -> int:
    """Among how many tasks so many rows are dealt: a task's share stays the same however many there are."""
    return max(1, -(-rows // ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (ROWS // 10))))


def settled_with(df: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """settled(df), and how many rows meet each condition, counted by the job that writes."""
    seen = Observation()
    out = settled(df.observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()]))
    return out, seen.get
