"""Quality: histogram gradient-boosted trees over document statistics.

``statistics`` gives each whole text the numbers of ``NAMES``: lengths, shares of kinds of bytes and words, and how
much repeats.  Trees are grown level by level on histograms: every statistic is cut at quantiles into at most
``BINS`` bins, and gradients and Hessians of the logistic loss are summed by node, statistic and bin.  All trees have
one depth and lie flat in three arrays (statistic, cut, leaf), so a batch walks all of them with ``DEPTH`` steps
of numpy.  A node without a useful cut sends all rows left.

The forest is fitted on at most ``SAMPLE`` labelled rows (those with the smallest seeded hash of doc_id, so the same
at every run); that bound is its only sample.  What travels to the one task that fits is these rows' statistics, never
their texts.  Labels come only from rows outside the held-out quarter, crc32(doc_id as text) mod 4 = 2; labels, lang,
source and doc_id are no statistics.

Words are [^\\x20\\x09-\\x0D]+.  Null and empty texts have all statistics 0 and score by them.  Rows with null labels or
ids teach nothing; without any labels every score is 0.5.  Repeated rows score alike; repeated labels count as often as
they stand, up to the bound; columns of the input that share a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables
from .words import PLAIN, U64, Words, by_bytes, mix

SAMPLE = 20_000
TREES, DEPTH, BINS = 80, 4, 64
RATE, L2, LEAST = 0.15, 1.0, 1.0  # step, ridge of leaves, least Hessian of a side
THRESHOLD = 0.7

NAMES = [
    "log_words", "mean_word", "spread_word", "log_longest", "upper", "digits", "punctuation", "wide", "space",
    "distinct_words", "top_word", "same_as_before", "distinct_pairs", "top_pair", "bare_punctuation", "sentence_ends", "odd_ends", "double_ends",
    "all_upper", "capital", "log_lines", "distinct_lines", "words_a_line",
]

_BYTES = np.arange(256)
_UPPER, _LOWER = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT, _WIDE = (_BYTES >= 48) & (_BYTES <= 57), _BYTES > 127
_PUNCT = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_END = np.isin(_BYTES, list(b".,;:?!"))


def _sums(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of flags[a:b] for each pair."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[b] - total[a]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)


def _repeats(group: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, occurrences of the most frequent key) of each group."""
    order = np.lexsort((keys, group))
    g, k = group[order], keys[order]
    first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))) if len(g) else np.zeros(0, np.int64)
    runs, most = np.diff(np.append(first, len(g))), np.zeros(n, np.int64)
    np.maximum.at(most, g[first], runs)
    return np.bincount(g[first], minlength=n), most


def statistics_of(texts: list[bytes | None]) -> np.ndarray:
    """One row of NAMES a text."""
    n, words = len(texts), Words(texts, PLAIN)
    data = np.frombuffer(words.buf, np.uint8)
    a, b = words.text_at[:-1], words.text_at[1:] - 1  # each text is followed by a line end of its own
    size, count, owner = b - a, words.counts, words.texts_of()
    lengths = words.ends - words.starts
    per_text = lambda flags: np.bincount(owner[flags], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, lengths)
    mean = _share(np.bincount(owner, lengths, n), count)
    square = _share(np.bincount(owner, lengths.astype(float) ** 2, n), count)
    distinct, top = _repeats(owner, words.hashes, n)
    near = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = np.maximum(count - 1, 0)
    pair_distinct, pair_top = _repeats(owner[near], mix(words.hashes[near] * U64(3) + words.hashes[near + 1]), n)
    again = near[words.hashes[near] == words.hashes[near + 1]]
    last, before = data[words.ends - 1], data[np.maximum(words.ends - 2, 0)]
    punct = _sums(_PUNCT[data], words.starts, words.ends)
    double = (lengths > 1) & _PUNCT[last] & _PUNCT[before]
    cut = np.flatnonzero(data == 10)
    line_at = np.append(0, cut[:-1] + 1)
    line_owner = np.searchsorted(words.text_at, line_at, "right") - 1
    line_words = np.searchsorted(words.starts, cut) - np.searchsorted(words.starts, line_at)
    some = line_words > 0
    chain = np.zeros(len(words) + 1, U64)  # a line's words in order, by their hashes and places in it
    place = np.arange(len(words)) - np.repeat(np.searchsorted(words.starts, line_at), line_words)
    np.cumsum(mix(words.hashes + place.astype(U64) * U64(0x9E3779B97F4A7C15)), out=chain[1:])
    first_word = np.searchsorted(words.starts, line_at[some])
    line_key = chain[first_word + line_words[some]] - chain[first_word]
    lines = np.bincount(line_owner[some], minlength=n)
    line_distinct, _ = _repeats(line_owner[some], line_key, n)
    kinds = [_share(_sums(kind[data], a, b), size) for kind in (_UPPER, _DIGIT, _PUNCT, _WIDE)]
    upper_in = _sums(_UPPER[data], words.starts, words.ends)
    return np.column_stack(
        [
            np.log1p(count), mean, np.sqrt(np.maximum(square - mean**2, 0)), np.log1p(longest), *kinds, _share(_sums(~PLAIN.is_word[data], a, b), size),
            _share(distinct, count), _share(top, count), _share(np.bincount(owner[again], minlength=n), pairs),
            _share(pair_distinct, pairs), _share(pair_top, pairs), _share(per_text(punct == lengths), count), _share(per_text(_END[last]), count),
            _share(per_text(_PUNCT[last] & ~_END[last]), count), _share(per_text(double), count),
            _share(per_text((upper_in > 0) & (_sums(_LOWER[data], words.starts, words.ends) == 0)), count), _share(per_text(_UPPER[data[words.starts]]), count),
            np.log1p(lines), _share(line_distinct, lines), _share(count, lines),
        ]
    )


class Forest(NamedTuple):
    """Trees of one depth: statistic and cut of the inner nodes in level order, values of the leaves, and the bias."""

    feature: np.ndarray  # trees x (2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        rows, tree, node = np.arange(len(x))[:, None], np.arange(trees)[None, :], np.zeros((len(x), trees), np.int64)
        for _ in range(inner.bit_length()):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
        return 1 / (1 + np.exp(-np.clip(self.bias + self.leaf[tree, node - inner].sum(1), -30, 30)))


def cuts_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """At most bins-1 distinct cuts a statistic, at quantiles; a row lies above a cut if it is greater."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boosted trees over rows x with labels y, 0 or 1.  Ties of gain go to the first statistic, then to the lowest cut."""
    n, width = x.shape
    cuts = cuts_of(x, bins)
    binned = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)]).astype(np.int64)
    usable = np.arange(bins)[None, :] < np.array([len(c) for c in cuts])[:, None]
    edges = np.array([np.append(c, np.full(bins - len(c), np.inf)) for c in cuts])
    column = np.arange(width)[None, :] * bins + binned
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p0 / (1 - p0)))
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.full(n, bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, at = p - y, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 2**level
            place = (at[:, None] * (width * bins) + column).ravel()
            shape = (nodes, width, bins)
            below_g = np.bincount(place, np.repeat(g, width), nodes * width * bins).reshape(shape).cumsum(2)
            below_h = np.bincount(place, np.repeat(h, width), nodes * width * bins).reshape(shape).cumsum(2)
            all_g, all_h = below_g[:, :, -1:], below_h[:, :, -1:]
            above_g, above_h = all_g - below_g, all_h - below_h
            gain = below_g**2 / (below_h + L2) + above_g**2 / (above_h + L2) - all_g**2 / (all_h + L2)
            gain[~(usable[None] & (below_h >= LEAST) & (above_h >= LEAST))] = 0.0
            best = gain.reshape(nodes, -1).argmax(1)
            useful = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            f, b = np.where(useful, best // bins, 0), np.where(useful, best % bins, bins)
            feature[t, nodes - 1 : 2 * nodes - 1] = f
            cut[t, nodes - 1 : 2 * nodes - 1] = np.where(useful, edges[f, np.minimum(b, bins - 1)], np.inf)
            at = 2 * at + (binned[np.arange(n), f[at]] > b[at])
        leaf[t] = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + L2)
        margin += leaf[t, at]
    return Forest(feature, cut, leaf, bias)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def statistics(docs: DataFrame) -> DataFrame:
    """docs with the array column statistics, in the order of NAMES."""
    docs = docs.drop("statistics")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField("statistics", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            made = statistics_of(batch.column("text").cast(pa.binary()).to_pylist())
            rows = pa.ListArray.from_arrays(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32), made.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], schema.names)

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Forest:
    """The forest learnt from labels (doc_id, label) of documents outside the held-out quarter."""
    by_hash = F.xxhash64(F.lit(11), F.col("label_id"))
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label"))
        .orderBy(by_hash, "label_id", "label")
        .limit(sample)
    )
    chosen = F.broadcast(tables.stored(chosen))  # at most `sample` rows of two numbers
    rows = docs.join(chosen, docs["doc_id"] == chosen["label_id"]).select("label_id", "label", "text")
    # however often a labelled doc_id repeats, at most `sample` rows of numbers go on
    rows = statistics(rows).drop("text").orderBy(by_hash, "label_id", "label", "statistics").limit(sample)
    schema = "feature array<long>, cut array<double>, leaf array<double>, bias double"

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(key=group["statistics"].map(tuple)).sort_values(["label_id", "label", "key"], kind="stable")
        made = grow(np.stack(group["statistics"].tolist()), group["label"].to_numpy(float))
        return pd.DataFrame({"feature": [*made.feature], "cut": [*made.cut], "leaf": [*made.leaf], "bias": made.bias})

    learnt = rows.groupBy(F.lit(0).alias("all")).applyInPandas(learn, schema).collect()  # one row a tree
    if not learnt:
        return Forest(np.zeros((1, 1), np.int64), np.full((1, 1), np.inf), np.zeros((1, 2)), 0.0)
    return Forest(*(np.array([r[k] for r in learnt]) for k in ("feature", "cut", "leaf")), learnt[0]["bias"])


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """docs with score, 0 to 1, and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # a few thousand numbers
    docs = docs.drop("score", "predicted")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            x = statistics_of(batch.column("text").cast(pa.binary()).to_pylist())
            scores = np.concatenate([shared.value.predict(x[k : k + 2000]) for k in range(0, len(x), 2000)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], schema.names)

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, tables.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
