"""Data steps and sorts as DataFrame operations: an extension beyond static analysis, with Spark's semantics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_(*inputs: DataFrame) -> DataFrame:
    """SET a b: rows one table after the other, columns by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def merge(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """MERGE a b; BY k, for keys unique on either side: right values win where both have a column."""
    shared = [c for c in left.columns if c in right.columns and c not in by]
    a, b = left.alias("a"), right.alias("b")
    keys = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in by]
    rest = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in shared else F.col(f"a.{c}") for c in left.columns if c not in by]
    return a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by], "full").select(*keys, *rest, *[F.col(f"b.{c}") for c in right.columns if c not in by and c not in shared])


def _nth(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*[c for c in df.columns if c not in by])))


def sort_nodupkey(df: DataFrame, by: list[str]) -> DataFrame:
    """The first row of each key, in order of all its columns."""
    return _nth(df, by).where("_nth = 1").drop("_nth")


def sort_dupout(df: DataFrame, by: list[str]) -> DataFrame:
    """What sort_nodupkey leaves out."""
    return _nth(df, by).where("_nth > 1").drop("_nth")


def shape(df: DataFrame, keep: list[str] | None = None, drop: list[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    out = df.select(*keep) if keep else df
    return out.drop(*drop).withColumnsRenamed(rename or {})


def running_sum(df: DataFrame, value: Column, name: str, by: list[str], order: list[str]) -> DataFrame:
    """x + value; within groups, missing values adding nothing."""
    over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(value, F.lit(0))).over(over))


def branch(df: DataFrame, *conditions: Column) -> list[DataFrame]:
    """OUTPUT to several tables: the first condition that holds takes the row, the last table the rest."""
    out, taken = [], F.lit(False)
    for c in conditions:
        holds = F.coalesce(c, F.lit(False))
        out.append(df.where(holds & ~taken))
        taken = taken | holds
    return [*out, df.where(~taken)]
