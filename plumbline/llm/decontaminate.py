"""Benchmark decontamination as a prefix-filtered set join with exact verification.

An item's windows are its runs of ``size`` consecutive words (one shorter window if it has fewer).  A
document holds a window only if it holds each of the window's shingles (three consecutive words, fewer
for shorter windows), so joining on one of them is necessary and enough to find it.  Shingles are
ordered by how often they occur in all documents, counted in a pass of its own, and each window joins on
its rarest: the prefix of the ordered set for containment 1.  A match fixes where the window would start;
positional and length bounds drop what would leave the document, and the words themselves decide.

The documents are never shuffled.  Windows are broadcast in blocks of at most ``BLOCK`` windows, a fixed
size; a larger benchmark takes more blocks, each a further map over the documents.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.  Null and empty texts have no
words and no hits; an item without words has no windows; a null item_id counts as the empty string;
repeated rows are judged each on its own; columns of the input that share a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables
from .words import ALNUM, U64, Words, by_bytes, gram_hashes, grams_within, ranges

WINDOW = 10
SHINGLE = 3
BLOCK = 200_000

ADDED = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """(window, items): each distinct window, its words joined by one space, and the items that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            words = Words(batch.column("text").to_pylist(), ALNUM, hashed=False)
            ids, lower = batch.column("item_id").to_pylist(), words.buf.lower()
            texts, owners = [], []
            for i, item in enumerate(ids):
                a, b = int(words.first[i]), int(words.first[i + 1])
                own = [lower[words.starts[k] : words.ends[k]] for k in range(a, b)]
                cuts = {b" ".join(own[k : k + size]) for k in range(max(1, len(own) - size + 1))} if own else ()
                texts += cuts
                owners += [item] * len(cuts)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(owners, pa.string())], ["window", "item"])

    prepared = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    return prepared.mapInArrow(cut, "window binary, item string").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Block:
    """Some windows as arrays: word hashes, lengths, texts and items, and later the shingle each joins on."""

    def __init__(self, rows: list) -> None:
        self.texts = [bytes(r["window"]) for r in rows]
        self.items = [list(r["items"]) for r in rows]
        words = Words(self.texts, ALNUM)
        self.lengths = words.counts.astype(np.int64)
        self.width = int(self.lengths.max(initial=1))
        self.hashes = np.zeros((len(rows), self.width), U64)
        at = ranges(np.zeros(len(rows), np.int64), self.lengths)
        self.hashes[np.repeat(np.arange(len(rows)), self.lengths), at] = words.hashes
        self.sizes = np.minimum(self.lengths, SHINGLE)

    def shingles(self) -> list[tuple[int, np.ndarray]]:
        """(size, sorted distinct hashes)"""
        out = []
        for n in sorted(set(self.sizes.tolist())):
            some = [gram_hashes(self.hashes[i, : self.lengths[i]], n) for i in np.flatnonzero(self.sizes == n)]
            out.append((n, np.unique(np.concatenate(some))))
        return out

    def join_on_rarest(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Choose each window's shingle.  Windows with a shingle that no document has occur nowhere."""
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        chosen: dict[int, list[tuple[int, int, int]]] = {}
        for i in range(len(self.texts)):
            n = int(self.sizes[i])
            own = gram_hashes(self.hashes[i, : self.lengths[i]], n)
            keys, seen = counts[n]
            often = seen[np.searchsorted(keys, own)]
            k = int(np.lexsort((own, often))[0])
            if often[k]:
                chosen.setdefault(n, []).append((int(own[k]), i, k))
        for n, rows in chosen.items():
            rows.sort()
            key = np.array([r[0] for r in rows], U64)
            keys, first = np.unique(key, return_index=True)
            self.index[n] = (keys, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence."""
        at, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        text_of, lower = words.texts_of(), None
        for n, (keys, first, window, offset) in self.index.items():
            grams, places = grams_within(words, n)
            k = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            found = np.flatnonzero(keys[k] == grams)
            if not len(found):
                continue
            k, places = k[found], places[found]
            each = first[k + 1] - first[k]
            rows = ranges(first[k], each)
            w, start = window[rows], np.repeat(places, each) - offset[rows]
            text = np.repeat(text_of[places], each)
            fits = (start >= words.first[text]) & (start + self.lengths[w] <= words.first[text + 1])
            w, start = w[fits], start[fits]
            same = np.ones(len(w), bool)
            for j in range(self.width):
                live = same & (j < self.lengths[w])
                same[live] = words.hashes[start[live] + j] == self.hashes[w[live], j]
            w, start = w[same], start[same]
            lower = words.buf.lower() if lower is None else lower
            exact = [
                b" ".join(lower[words.starts[i] : words.ends[i]] for i in range(s, s + self.lengths[v])) == self.texts[v]
                for s, v in zip(start.tolist(), w.tolist(), strict=True)
            ]
            at.append(start[exact])
            which.append(w[exact])
        return np.concatenate(at), np.concatenate(which)


def _count(docs: DataFrame, shingles: list[tuple[int, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Occurrences of the given shingles in all documents: one row a task and shingle seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(len(keys), np.int64) for _, keys in shared.value]
        for batch in by_bytes(batches, "text"):
            words = Words(batch.column("text").to_pylist(), ALNUM)
            for (n, keys), s in zip(shared.value, seen, strict=True):
                grams, _ = grams_within(words, n)
                k = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                s += np.bincount(k[keys[k] == grams], minlength=len(keys))
        for k, s in enumerate(seen):
            some = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int64)), pa.array(s[some])], ["k", "at", "n"])

    shared = docs.sparkSession.sparkContext.broadcast(shingles)
    seen = [np.zeros(len(keys), np.int64) for _, keys in shingles]
    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "k int, at long, n long")
    for r in counted.groupBy("k", "at").agg(F.sum("n").alias("n")).toLocalIterator():
        seen[r["k"]][r["at"]] = r["n"]
    return {n: (keys, s) for (n, keys), s in zip(shingles, seen, strict=True)}


def _stage(docs: DataFrame, block: Block) -> DataFrame:
    """One map over the documents: spans (first, end of disjoint hit runs, alternating) and items grow."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in by_bytes(batches, "text"):
            words = Words(batch.column("text").cast(pa.binary()).to_pylist(), ALNUM)
            at, which = block.hits(words)
            names = batch.schema.names
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            text = words.texts_of()[at]
            order = np.argsort(text, kind="stable")
            cuts = np.flatnonzero(np.diff(text[order])) + 1
            for own in np.split(order, cuts) if len(order) else ():
                i = int(text[own[0]])
                base = int(words.first[i])
                runs = [*zip(spans[i][::2], spans[i][1::2], strict=True)]
                runs += zip((at[own] - base).tolist(), (at[own] - base + block.lengths[which[own]]).tolist(), strict=True)
                merged: list[int] = []
                for a, b in sorted(runs):
                    if merged and a <= merged[-1]:
                        merged[-1] = max(merged[-1], b)
                    else:
                        merged += [a, b]
                spans[i] = merged
                items[i] = sorted({*items[i], *(x for w in set(which[own].tolist()) for x in block.items[w])})
            new = {"spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(words.counts.astype(np.int64))}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs with n_words, n_hit, n_items, items, items_sha256 and contaminated."""
    windows = tables.stored(windows_of(items, size))
    blocks = max(1, -(-windows.count() // block))
    out = docs.drop(*ADDED, "spans").withColumns(
        {"spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>"), "n_words": F.lit(0).cast("long")}
    )
    for k in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        made = Block(own.collect())
        made.join_on_rarest(_count(docs, made.shingles()) if made.texts else {})
        out = _stage(out, made)
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", F.array_sort("items")), 256),
            "contaminated": n_hit > 0,
        }
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside occurrences of benchmark windows, and the items they come from."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, tables.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
