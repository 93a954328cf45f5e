"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words, its pairs of neighbouring words, and its pairs with one word between,
each hashed to one of 2**20 places; a place counts once a text.  Per-coordinate rates and L1 sparsity
leave some hundreds of weights, which are broadcast to score every whole text of any table.

The classifier is fitted on at most ``SAMPLE`` labelled rows (those with the smallest seeded hash of
doc_id, so the same at every run); that bound is its only sample.  Labels come only from rows outside
the held-out fifth, crc32(doc_id as text) mod 5 = 0, and lang, source and doc_id are no features.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.  Null and empty texts score by the
bias alone.  Rows with null labels or ids teach nothing; without any labels every score is 0.  Repeated
rows score alike; repeated labels, and rows that repeat a labelled doc_id, count as often as they stand, up to the bound; columns of the input that share a
result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables
from .words import ALNUM, U64, Words, by_bytes, mix

PLACES = 1 << 20
SAMPLE = 12_000
EPOCHS = 3
RATE, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
THRESHOLD = 0.5


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every feature, in no order and with repeats."""
    text, h = words.texts_of(), words.hashes
    texts, places = [text], [h]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        same = text[:-gap] == text[gap:] if len(h) > gap else np.zeros(0, bool)
        pair = mix(h[:-gap] * U64(3) + h[gap:] * U64(5) + U64(salt)) if len(h) > gap else np.zeros(0, U64)
        texts.append(text[:-gap][same] if len(h) > gap else np.zeros(0, np.int64))
        places.append(pair[same])
    return np.concatenate(texts), (np.concatenate(places) & U64(PLACES - 1)).astype(np.int64)


def train(texts: list[bytes | None], labels: np.ndarray, seed: int = 9) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) of FTRL-proximal over the given texts."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)  # the last is the bias, without L1
    l1 = np.full(PLACES + 1, L1)
    l1[PLACES] = 0.0
    own = []
    for at in range(0, len(texts), 200):
        text, place = features(Words(texts[at : at + 200], ALNUM))
        order = np.lexsort((place, text))
        text, place = text[order], place[order]
        first = np.ones(len(text), bool)
        first[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
        cuts = np.searchsorted(text[first], np.arange(len(texts[at : at + 200]) + 1))
        own += [np.append(place[first][a:b], PLACES).astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    rng = np.random.default_rng(seed)

    def weight(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * l1[at]) / ((BETA + np.sqrt(n[at])) / RATE + L2)
        return np.where(np.abs(zz) > l1[at], w, 0.0)

    for _ in range(EPOCHS):
        for k in rng.permutation(len(own)):
            at = own[k]
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[k]
            before = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - before) / RATE * w
    w = weight(np.arange(PLACES + 1))
    places = np.flatnonzero(w[:PLACES])
    return places, w[places], float(w[PLACES])


def held_out(doc_id, folds: int = 5):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learnt from labels (doc_id, toxic) of documents outside the held-out fifth."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(9), F.col("label_id")), "label_id", "label")
        .limit(sample)
    )
    chosen = F.broadcast(tables.stored(chosen))  # at most `sample` rows of two numbers
    rows = docs.join(chosen, docs["doc_id"] == chosen["label_id"]).select("label_id", "label", F.col("text").cast("binary").alias("text"))
    # however often a labelled doc_id repeats, at most `sample` rows go on: the bound holds for rows, not for labels alone
    rows = rows.orderBy(F.xxhash64(F.lit(9), F.col("label_id")), "label_id", "label", F.xxhash64("text")).limit(sample)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["label_id", "label"], kind="stable")
        places, weights, bias = train(group["text"].tolist(), group["label"].to_numpy(float))
        return pd.DataFrame({"place": [*places.tolist(), PLACES], "weight": [*weights.tolist(), bias]})

    # the sample is bounded, and so is the one task that learns from it
    learnt = rows.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "place long, weight double").collect()
    learnt.sort()
    places = np.array([r["place"] for r in learnt if r["place"] < PLACES], np.int64)
    weights = np.array([r["weight"] for r in learnt if r["place"] < PLACES])
    return places, weights, next((r["weight"] for r in learnt if r["place"] == PLACES), -30.0)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """docs with score, 0 to 1, and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights, bias = shared.value
        table = np.zeros(PLACES, np.float64)
        table[places] = weights
        for batch in by_bytes(batches, "text", 1 << 20):
            words = Words(batch.column("text").cast(pa.binary()).to_pylist(), ALNUM)
            text, place = features(words)
            known = np.flatnonzero(table[place])
            pairs = np.unique(text[known] * PLACES + place[known])
            total = bias + np.bincount(pairs // PLACES, table[pairs % PLACES], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], schema.names)

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, tables.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
