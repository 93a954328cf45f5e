"""Shared folders, row counts and reading of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own
    checkpoint folder.  Where neither is set a temporary one is made on a single
    machine, as in tests; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.sparkContext.setCheckpointDir(base)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows written to the shared folder and read from there: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of a scan (joins multiply it), or from the partitions where it has
    none; only chooses how finely work is cut."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 56 else df.rdd.getNumPartitions() * (8 << 20)


def parts(df: DataFrame, each: int = 8 << 20) -> int:
    """How many partitions of about so many bytes df fills; at least the session's shuffle partitions."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, -(-input_bytes(df) // each)))


def text_bytes(column: str = "text"):
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")
