"""Mixing sources to target weights by fitting subsets of documents to word budgets.

Documents are counted by source and exact length.  A source's budget beyond its whole passes is fitted
from these counts alone: every length gives its share, the rest is filled from the longest length
down until it is small, and a bounded-knapsack table over what is left then finds the budget, or, where it
misses it, larger tables over more of the documents the sum nearest below.  How many documents of a length are taken is thus known exactly; which ones
is settled by a seeded hash of doc_id.

The histogram has a row for each source and length, whatever the number of documents.  Ranks by hash
are taken in buckets of a length's documents, so a source or a length with most of the rows is spread.

Null texts have size 0 and are never taken; null sources form a source of their own, last in order.
Repeated rows are documents of their own; ties in the hash fall to row order within equal rows, which
are interchangeable.  An empty table gives no rows.  Other columns are carried along;
size, source_size, target and copies of the input are replaced by the results of these names.
"""

from __future__ import annotations

from itertools import cycle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 8
#: The first knapsack table covers this many words; what is above is filled by length first.
TABLE = 1 << 15
BUCKET_ROWS = 20_000
SEPARATORS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+, with built-in functions."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words for each source: share of all words dealt by weight, none above `most` times its own.

    sizes: (source, words) for every source.  Order: code points (UTF-8 bytes sort the same), null last."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = {s: w for (s, _), w in zip(order, cycle(weights), strict=False)}
    left, out, open_ = share * sum(n for _, n in order), {}, dict(order)
    while open_:
        by = sum(weight[s] for s in open_)
        full = [s for s, n in open_.items() if left * weight[s] / by >= most * n]
        if not full:
            return out | {s: left * weight[s] / by for s in open_}
        for s in full:
            out[s] = most * open_.pop(s)
        left = share * sum(n for _, n in order) - sum(out.values())
    return out


def _reached(lengths: np.ndarray, counts: np.ndarray, most: int, stop: int) -> tuple[int, list[tuple[int, int]], list[int]]:
    """Bounded knapsack: the sums up to most as a bit each, the items (length's place, documents) by powers of two,
    and the sums before every item; ends where stop is reached."""
    items = []
    for i in np.argsort(-lengths).tolist():
        if not 0 < lengths[i] <= most:
            continue
        spare, k = min(int(counts[i]), most // int(lengths[i])), 1
        while spare > 0:
            n = min(k, spare)
            items.append((i, n))
            spare -= n
            k *= 2
    reached, rows, mask = 1, [], (1 << (most + 1)) - 1
    for i, n in items:
        rows.append(reached)
        reached |= (reached << (n * int(lengths[i]))) & mask
        if reached >> stop & 1:
            break
    return reached, items, rows


def _chosen(lengths: np.ndarray, items: list[tuple[int, int]], rows: list[int], at: int) -> np.ndarray:
    out = np.zeros(len(lengths), np.int64)
    for (i, n), before in zip(reversed(items[: len(rows)]), reversed(rows), strict=True):
        if not before >> at & 1:
            out[i] += n
            at -= n * int(lengths[i])
    return out


def subset(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, at most counts, so that the words come nearest below budget.

    While the table misses the budget, documents are given back and a larger one is made, at last over all."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.floor(counts * (budget / total)).astype(np.int64) if total else counts * 0
    step = int(np.gcd.reduce(lengths))
    if step > 1:
        lengths, budget, total = lengths // step, budget // step, total // step
    order = np.argsort(-lengths)
    left = budget - int((take * lengths).sum())
    for i in order:
        if left <= TABLE:
            break
        if lengths[i]:
            more = min(int(counts[i] - take[i]), (left - TABLE) // int(lengths[i]) + 1, left // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    # over all documents, from what is taken or from what is left out
    need, longest, width = total - budget, int(lengths.max(initial=0)), TABLE
    whole = min(budget, need + longest)
    while left < whole:
        reached, items, rows = _reached(lengths, counts - take, left, left)
        if reached >> left & 1:
            return take + _chosen(lengths, items, rows, left)
        width *= 4
        for i in order:
            if left < width and lengths[i]:
                back = min(int(take[i]), -(-(width - left) // int(lengths[i])))
                take[i] -= back
                left += back * int(lengths[i])
    if budget <= need + longest:
        reached, items, rows = _reached(lengths, counts, budget, budget)
        return _chosen(lengths, items, rows, reached.bit_length() - 1)
    reached, items, rows = _reached(lengths, counts, need + longest, need)
    above = reached >> need
    return counts - _chosen(lengths, items, rows, need + (above & -above).bit_length() - 1)


def plan(counted: DataFrame, aims: DataFrame) -> DataFrame:
    """(source, size, passes, extra): whole passes over a source, and how many documents of a size
    come once more.  counted: source, size, n.  aims: source, target."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["size"].to_numpy(np.int64)
        counts = group["n"].to_numpy(np.int64)
        total, target = int((lengths * counts).sum()), float(group["target"].iloc[0])
        passes = int(target // total) if total else 0
        extra = subset(lengths, counts, int(round(target - passes * total))) if passes < MOST else counts * 0
        return pd.DataFrame({"s": group["s"], "size": lengths, "passes": passes, "extra": extra})

    joined = counted.join(aims, F.col("source").eqNullSafe(F.col("aim_source")))
    named = joined.select(F.col("source").alias("s"), "size", "n", "target", F.coalesce(F.col("source"), F.lit("")).alias("by"), F.col("source").isNull().alias("none"))
    return named.groupBy("by", "none").applyInPandas(fit, "s string, size long, passes int, extra long")


def mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, size: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and copies (0, 1 or 2): how often the mix takes each.

    size: words of a document where they are known; else its text is counted."""
    spark = docs.sparkSession
    sized = docs.withColumn("size", n_words(F.col("text")) if size is None else size).drop("source_size", "target", "copies")
    counted = tables.stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    of_source = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("rows")).collect()
    aim = targets([(r["source"], r["words"]) for r in of_source], weights, share)
    aims = spark.createDataFrame([(r["source"], r["words"], aim[r["source"]]) for r in of_source], "aim_source string, source_size long, target double")
    planned = tables.stored(plan(counted, aims))
    rows = sum(r["rows"] for r in of_source)
    buckets = max(1, rows // BUCKET_ROWS)
    dealt = sized.withColumn("mix_lot", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("mix_bucket", F.pmod("mix_lot", F.lit(buckets)).cast("int"))
    # a size's documents in each bucket, and how many the buckets before hold
    before = Window.partitionBy("source", "size").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("source", "size", "mix_bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(planned.withColumnRenamed("size", "p_size"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("p_size")))
        .join(aims, F.col("source").eqNullSafe(F.col("aim_source")))
        .select(
            F.col("source").alias("o_source"),
            F.col("size").alias("o_size"),
            F.col("mix_bucket").alias("o_bucket"),
            "source_size",
            "target",
            "passes",
            (F.col("extra") - F.col("before")).alias("extra_here"),
        )
    )
    own = Window.partitionBy("source", "size", "mix_bucket").orderBy("mix_lot", "doc_id")
    ranked = dealt.withColumn("mix_own", F.row_number().over(own))
    return (
        ranked.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("size") == F.col("o_size")) & (F.col("mix_bucket") == F.col("o_bucket")))
        .withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + (F.col("mix_own") <= F.col("extra_here")).cast("int")).otherwise(0))
        .drop("mix_lot", "mix_bucket", "mix_own", "o_source", "o_size", "o_bucket", "passes", "extra_here")
    )


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of the mix itself: each document as often as it is taken, with the columns of docs.

    Copies are settled on narrow rows; texts move once, to meet their number by doc_id and hash.  Rows that
    agree in doc_id, source and text are alike, and the first brings the copies of all."""
    key = {"key_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "key_hash": F.xxhash64("doc_id", "source", "text")}
    narrow = tables.stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *[c.alias(n) for n, c in key.items()]))
    taken = mix(narrow, seed, size=F.col("size")).where("copies > 0").groupBy(F.col("key_id").alias("t_id"), F.col("key_hash").alias("t_hash")).agg(F.sum("copies").cast("int").alias("copies_taken"))
    met = docs.withColumns(key).join(taken, (F.col("key_id") == F.col("t_id")) & (F.col("key_hash") == F.col("t_hash")))
    nth = F.row_number().over(Window.partitionBy("key_id", "key_hash").orderBy("key_id"))
    once = met.withColumn("nth", nth).where("nth = 1")
    return once.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies_taken")))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(tables.stored(docs), size=F.col("size")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
