"""Substring dedup: repeated windows of words found with compressed FM-indexes, a shard each.

A window is ``size`` consecutive words of a document.  Its key is the least hash of its grams of GRAM words, so
equal windows have equal keys wherever they stand.  A document falls into segments: maximal runs of
windows with one key.  Keys that stand but once in the whole corpus cannot belong to a repeated window;
they are counted exactly, and those seen again are marked in a filter of fixed size (as it fills, more
segments pass, none is lost).  Segments that pass meet in shards by key.

A shard indexes its distinct segments, weighted by how often each occurs: suffix array of the words,
its Burrows-Wheeler transform in a wavelet matrix of packed bits with rank directories.  All segments
stream through it from their ends: a backward step prefixes a word; at full length the last word is given
up first by widening to the interval of the shorter match.  This yields the matching statistics up to
``size``; where a full window's interval weighs two or more, it stands elsewhere.  Words are compared
themselves, not hashes.

A key that very many segments share (a common passage) would make one heavy shard.  Such keys, at most
1000 by their definition, send their windows one by one, dealt by the window's own hash and each distinct
one but once from a task.

Words are [^\\x20\\x09-\\x0D]+.  Null and short texts have no windows.  A repeated row is another
occurrence; documents are known by doc_id and the hash of their text, so null or equal doc_ids do no
harm.  An empty table gives no rows; extra columns are carried along, replaced where names clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import marks, tables
from .words import PLAIN, U64, Words, by_bytes, gram_hashes, mix, powers, ranges

WINDOW = 35
GRAM = 8
HOT_BITS = 1 << 22  # of the filter of such keys: half a megabyte
HOT_LEAST = 20_000  # segments of a key beyond which its windows are dealt one by one
SHARD_SEGMENTS = 12_000
ADDED = ["n_words", "n_removed", "kept"]


# ---- segments


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def segments(words: Words, size: int) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, key, times the key's gram stands in it) of all segments."""
    gram = min(GRAM, size)
    n = words.counts - size + 1
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, U64), np.empty(0, np.int64))
    if not (n > 0).any():
        return none
    grams = gram_hashes(words.hashes, gram)
    keys_all = sliding_min(grams, size - gram + 1)
    at = ranges(words.first[:-1], np.maximum(n, 0))
    text = np.repeat(np.arange(len(n)), np.maximum(n, 0))
    keys = keys_all[at]
    cut = np.ones(len(at), bool)
    cut[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(cut)
    runs = np.diff(np.append(first, len(at)))
    key = keys[first]
    begin = at[first]
    # whether the gram stands more than once within the segment's words
    spans = runs + size - gram
    inside = ranges(begin, spans)
    same = grams[inside] == np.repeat(key, spans)
    times = np.add.reduceat(same.astype(np.int64), np.cumsum(spans) - spans)
    return text[first], begin, runs, key, times


_B1, _B2 = 0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1


def span_ids(words: Words, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the words begin .. begin+length-1."""
    out = []
    for base in (_B1, _B2):
        n = len(words) + 1
        sums = np.zeros(n, U64)
        np.cumsum(mix(words.hashes ^ U64(base)) * powers(base, n - 1), out=sums[1:])
        inverse = powers(pow(base, -1, 2**64), n)
        out.append(mix((sums[begin + length] - sums[begin]) * inverse[begin] + length.astype(U64)).view(np.int64))
    return out[0], out[1]


# ---- the index


class WaveletMatrix:
    """Rank of any symbol before any place: a packed bitmap and its rank directory for each bit."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.levels, seq = [], symbols
        for level in range(self.bits - 1, -1, -1):
            on = (seq >> level) & 1
            packed = np.zeros(len(seq) // 64 + 1, np.uint64)
            raw = np.packbits(on.astype(np.uint8), bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            ones = np.bitwise_count(packed).astype(np.int64)
            self.levels.append((level, packed, np.cumsum(ones) - ones, int(len(seq) - on.sum())))
            on = on.astype(bool)
            seq = np.concatenate([seq[~on], seq[on]])
        self.base = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, packed, directory, zeros in self.levels:
            word = at >> 6
            low = packed[word] & ((U64(1) << (at & 63).astype(U64)) - U64(1))
            ones = directory[word] + np.bitwise_count(low)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.base[symbol]


class FMIndex:
    """Over texts of word numbers from 1; 0 ends each.  Suffixes are ordered by `size` words or more, which
    is all that matches of up to `size` words ask for."""

    def __init__(self, texts: np.ndarray, weights: np.ndarray, size: int) -> None:
        n, top = len(texts), int(texts.max(initial=0))
        rank, h, kept = texts.astype(np.int64), 1, {}
        shrink, need = size - 1, 0
        while True:
            kept[h] = rank
            if h >= size:
                break
            after = np.zeros(n, np.int64)
            after[: n - h] = rank[h:] + 1 if h < n else 0
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)
            h *= 2
        self.order = np.argsort(rank, kind="stable")
        # suffixes that share their first size-1 words stand together: name that prefix by powers of two
        group = np.zeros(n, np.int64)
        for p in sorted(kept, reverse=True):
            if shrink & p and p <= shrink:
                part = np.zeros(n, np.int64)
                part[: n - need] = kept[p][need:] + 1 if need < n else 0
                _, group = np.unique(group * (int(part.max(initial=0)) + 1) + part, return_inverse=True)
                need += p
        sorted_group = group[self.order]
        edge = np.ones(n + 1, bool)
        edge[1:-1] = sorted_group[1:] != sorted_group[:-1]
        edges = np.flatnonzero(edge)
        which = np.cumsum(edge[:-1]) - 1
        self.left, self.right = edges[which], edges[which + 1]
        self.wavelet = WaveletMatrix(texts[self.order - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(texts, minlength=top + 1))])
        self.weight = np.concatenate([[0], np.cumsum(weights[self.order])])
        self.n = n

    def repeated(self, texts: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int, least: int = 2) -> np.ndarray:
        """For every place of the streamed texts: whether the window of `size` words there weighs `least` or more.

        texts[starts[i] : starts[i]+lengths[i]] are streamed from their ends, side by side."""
        out = np.zeros(len(texts), bool)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n)
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -step, "left"))
            at = starts[:live] + lengths[:live] - 1 - step
            a, b = lo[:live], hi[:live]
            if step >= size:  # give up the last word: the interval of the first size-1
                a, b = self.left[a], self.right[np.maximum(b - 1, a)]
            symbol = texts[at]
            a = self.before[symbol] + self.wavelet.rank(symbol, a)
            b = self.before[symbol] + self.wavelet.rank(symbol, b)
            lo[:live], hi[:live] = a, b
            if step >= size - 1:
                out[at] = self.weight[b] - self.weight[a] >= least
        return out


def repeated_windows(texts: list[bytes], weights: np.ndarray, size: int) -> list[np.ndarray]:
    """For each distinct text of a shard, which of its windows stand elsewhere too (weights: occurrences)."""
    words = Words(texts, PLAIN, hashed=False)
    names: dict[bytes, int] = {}
    buf = words.buf
    ids = np.fromiter((names.setdefault(buf[s:e], len(names) + 1) for s, e in zip(words.starts.tolist(), words.ends.tolist(), strict=True)), np.int64, len(words))
    lengths = words.counts
    starts = words.first[:-1] + np.arange(len(texts))
    stream = np.zeros(len(ids) + len(texts), np.int64)
    stream[ranges(starts, lengths)] = ids
    index = FMIndex(stream, np.repeat(weights, lengths + 1), size)
    found = np.zeros(len(stream), bool)
    once = np.flatnonzero(weights < 2)
    if len(once):
        found = index.repeated(stream, starts[once], lengths[once], size)
    out = [found[s : s + n - size + 1] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    return [np.ones(len(f), bool) if w > 1 else f for f, w in zip(out, weights.tolist(), strict=True)]


# ---- over tables


def _keys(docs: DataFrame, size: int) -> DataFrame:
    """(key, times, segments): summed by task, then over all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            _, _, _, key, times = segments(Words(batch.column("text").to_pylist(), PLAIN), size)
            distinct, at, n = np.unique(key, return_inverse=True, return_counts=True)
            total = np.bincount(at, times, len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(np.minimum(total, 2**31 - 1).astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "times", "n"])

    counted = docs.select("text").mapInArrow(count, "key long, times int, n int")
    return counted.groupBy("key").agg(F.sum("times").alias("times"), F.sum("n").alias("n")).where("times > 1")


_SEGMENT = "shard int, a long, b long, doc_id long, hashed long, first int, n int, words binary"


def _passing(docs: DataFrame, size: int, filled: np.ndarray, hot: np.ndarray, shards: int) -> DataFrame:
    """Segments with repeated keys, and single windows of hot keys; words only where a task first meets them."""
    shared = docs.sparkSession.sparkContext.broadcast((filled, hot))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, hot = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in by_bytes(batches, "text"):
            words = Words(batch.column("text").to_pylist(), PLAIN)
            text, begin, n, key, _ = segments(words, size)
            keep = np.flatnonzero(marks.passing(filled, key))
            text, begin, n, key = text[keep], begin[keep], n[keep], key[keep]
            heavy = marks.passing(hot, key)
            if heavy.any():
                each = np.where(heavy, n, 1)
                offset = ranges(np.zeros(len(n), np.int64), each)
                text, key, alone = np.repeat(text, each), np.repeat(key, each), np.repeat(heavy, each)
                begin, n = np.repeat(begin, each) + offset, np.where(alone, 1, np.repeat(n, each))
            else:
                alone = heavy
            length = n + size - 1
            a, b = span_ids(words, begin, length)
            shard = (np.where(alone, mix(key ^ a.view(U64)), mix(key)) % U64(shards)).astype(np.int32)
            own = []
            for x, y, s, e in zip(a.tolist(), b.tolist(), words.starts[begin].tolist(), words.ends[begin + length - 1].tolist(), strict=True):
                new = (x, y) not in seen
                if new:
                    seen.add((x, y))
                own.append(words.buf[s:e] if new else None)
            first = begin - words.first[text]
            columns = [pa.array(shard), pa.array(a), pa.array(b), batch.column("doc_id").take(pa.array(text)), batch.column("hashed").take(pa.array(text))]
            columns += [pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SEGMENT.split(", ")])

    return docs.select("doc_id", "hashed", "text").mapInArrow(emit, _SEGMENT)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _covered(passing: DataFrame, size: int) -> DataFrame:
    """(doc_id, hashed, first, end): runs of words under repeated windows."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        named = pd.MultiIndex.from_arrays([group["a"], group["b"]])
        which, distinct = pd.factorize(named)
        texts: list[bytes] = [b""] * len(distinct)
        for k, w in zip(which, group["words"], strict=True):
            if w is not None:
                texts[k] = w
        flags = repeated_windows(texts, np.bincount(which), size)
        spans = [_runs(f) for f in flags]
        each = np.array([len(s) for s, _ in spans])[which]
        row = np.repeat(np.arange(len(group)), each)
        begin = np.concatenate([spans[k][0] for k in which]) if len(row) else np.empty(0, np.int64)
        end = np.concatenate([spans[k][1] for k in which]) if len(row) else np.empty(0, np.int64)
        base = group["first"].to_numpy()[row]
        return pd.DataFrame({"doc_id": group["doc_id"].astype("Int64").to_numpy()[row], "hashed": group["hashed"].to_numpy()[row], "first": base + begin, "end": base + end + size - 1})

    return passing.groupBy("shard").applyInPandas(search, "doc_id long, hashed long, first int, end int")


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, n_removed and kept: the kept words joined by one space."""
    docs = docs.drop(*ADDED, "hashed", "spans").withColumn("hashed", F.xxhash64("text"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "hashed", F.col("text").cast("binary").alias("text"))
    keys = tables.stored(_keys(plain, size))
    n = keys.agg(F.sum("n")).first()[0] or 0
    # a filter of fixed size too: a key that passes it by chance is dealt window by window as well, by every task alike
    hot = marks.build(keys.where(F.col("n") > HOT_LEAST), "key", HOT_BITS)
    shards = max(1, -(-n // SHARD_SEGMENTS))
    covered = _covered(_passing(plain, size, marks.build(keys, "key"), hot, shards), size)
    spans = covered.groupBy(F.col("doc_id").alias("s_id"), F.col("hashed").alias("s_hashed")).agg(F.collect_set(F.struct("first", "end")).alias("spans"))  # repeated rows have the same
    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("s_id")) & F.col("hashed").eqNullSafe(F.col("s_hashed")), "left").drop("s_id", "s_hashed", "hashed")
    kept = [f for f in joined.schema if f.name != "spans"]
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + added)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            words = Words(batch.column("text").cast(pa.binary()).to_pylist(), PLAIN, hashed=False)
            spans, out = batch.column("spans").to_pylist(), []
            gone = np.zeros(len(words) + 1, np.int64)
            for k, own in enumerate(spans):
                for s in own or ():
                    gone[words.first[k] + s["first"]] += 1
                    gone[words.first[k] + s["end"]] -= 1
            keep = np.cumsum(gone)[:-1] == 0
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                at = np.flatnonzero(keep[a:b]) + a
                out.append(b" ".join([words.buf[s:e] for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]).decode("utf-8", "surrogatepass"))
            left = np.add.reduceat(np.append(keep, 0).astype(np.int64), np.minimum(words.first[:-1], len(keep))) * (words.counts > 0) if len(out) else words.counts
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(words.counts), pa.array(words.counts - left), pa.array(out, pa.string())], schema.names)

    return joined.select(*[f.name for f in kept], "spans").mapInArrow(cut, schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, those removed, and the sha256 of those kept."""
    found = remove_repeats(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
