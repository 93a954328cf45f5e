"""N-gram Jaccard join of documents with Bayesian candidate pruning.

A document's shingles are its runs of five words (all its words, if it has fewer).  Documents with equal
sets of shingles form a class, known by a 128-bit digest of the set, and count once from there on.
MinHash signatures of 128 values, 16 bits each, are cut into 32 bands; classes that share a band are
candidates: a pair of similarity 0.8 shares none with a chance of 5e-8.  Candidates' signatures are
compared 16 values at a time, and a pair is dropped as soon as the posterior probability that its
similarity reaches the threshold falls below ``TOLERANCE``.  Pairs that last tie classes into clusters, and
within a cluster every pair is verified on the sets themselves (64-bit hashes of whole shingles), so
links are exact and each is counted once.

Groups are never expanded into rows of pairs: a band's members are compared in blocks inside a task,
clusters are verified in blocks of classes by bitmaps, and what comes out is a row for a class with the
number of its links and one edge of a spanning forest.  Bands with the very same members are compared once.

Words are [^\\x20\\x09-\\x0D]+.  Documents without words, null texts among them, link to nothing, and each is
its own group; so is a row with a null doc_id.  Repeated rows belong to one class.  An empty table gives
no rows; other columns are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import marks, tables
from .components import components
from .words import PLAIN, U64, Words, by_bytes, grams_within, mix, ranges

NGRAM = 5
HASHES, BANDS = 128, 32
STEP = 16
TOLERANCE = 1e-6
NUMERATOR, DENOMINATOR = 4, 5  # the threshold, 0.8
BAND_BLOCK = 4096
EXACT_BLOCK, EXACT_SHINGLES = 1024, 4_000_000  # classes, and shingles, of a block that is verified
BITMAP = 1 << 15  # shingles compared at once
SLICE, ROWS = 1 << 19, 256  # shingles sorted, and rows of bits filled, at once

_RNG = np.random.default_rng(5)
_MULTIPLY = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): each text's distinct shingles, sorted, one text after the other."""
    grams, at = grams_within(words, NGRAM)
    text = words.texts_of()[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < NGRAM))
    if len(short):
        own = []
        for k in short.tolist():
            h = U64(0)
            with np.errstate(over="ignore"):
                for x in words.hashes[words.first[k] : words.first[k + 1]]:
                    h = h * U64(0x9E3779B97F4A7C15) + x
            own.append(h)
        grams, text = np.concatenate([grams, mix(np.array(own, U64) + U64(1))]), np.concatenate([text, short])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[first], np.bincount(text[first], minlength=len(words.counts))


def signatures(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """uint16 values, HASHES for each text with shingles."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(starts), HASHES), np.uint16)
    if not len(starts):
        return out
    # a few thousand shingles at a time stay in cache for all hash functions
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 16_384, "left")))
        end = int(starts[to]) if to < len(starts) else len(grams)
        part, own = grams[starts[at] : end], starts[at:to] - starts[at]
        for k in range(HASHES):
            least = np.minimum.reduceat((part * _MULTIPLY[k] + _ADD[k]) >> U64(16), own)
            out[at:to, k] = (mix(least) & U64(0xFFFF)).astype(np.uint16)
        at = to
    return out


def digests(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's set, whatever its order; zeros for no shingles."""
    out = []
    ends = np.cumsum(counts)
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        sums = np.zeros(len(grams) + 1, U64)
        np.cumsum(mix(grams ^ U64(salt)), out=sums[1:])
        out.append(np.where(counts > 0, mix(sums[ends] - sums[ends - counts] + counts.astype(U64)), U64(0)).view(np.int64))
    return out[0], out[1]


def least_matches(threshold: float = NUMERATOR / DENOMINATOR, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on).  With a uniform prior the posterior of similarity >= t
    after m matches of n is the chance of at most m successes in n+1 trials of chance t."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


_LEAST = least_matches()


def lasting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of signatures a[i], b[i] outlast the comparison."""
    live, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, least in _LEAST:
        matches[live] += (a[live, n - STEP : n] == b[live, n - STEP : n]).sum(1, dtype=np.int32)
        live = live[matches[live] >= least]
        if not len(live):
            break
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def clusters(sig: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """For each row, the first row of its cluster: rows tied by lasting pairs.  With sides, only pairs of
    rows on different sides count.  Rows already tied are not compared again."""
    label = np.arange(len(sig))
    for i in range(len(sig) - 1):
        other = np.arange(i + 1, len(sig))
        other = other[label[other] != label[i]]
        if side is not None:
            other = other[side[other] != side[i]]
        if not len(other):
            continue
        hit = other[lasting(np.broadcast_to(sig[i], (len(other), HASHES)), sig[other])]
        if len(hit):
            joined = np.unique(np.append(label[hit], label[i]))
            label[np.isin(label, joined)] = joined[0]
    return label


# ---- over tables


def _signed(docs: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            grams, counts = shingles(Words(batch.column("text").to_pylist(), PLAIN))
            a, b = digests(grams, counts)
            sig = iter(signatures(grams, counts))
            sigs = [next(sig).tobytes() if c else None for c in counts.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a), pa.array(b), pa.array(counts.astype(np.int32)), pa.array(sigs, pa.binary()), batch.column("text_hash")], ["doc_id", "a", "b", "n", "sig", "text_hash"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    return plain.mapInArrow(sign, "doc_id long, a long, b long, n int, sig binary, text_hash long")


def _bands(classes: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.int64).reshape(-1, BANDS)
            a = np.repeat(batch.column("a").to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(band), pa.array(sig.ravel())], ["a", "band", "key"])

    return classes.select("a", "sig").mapInArrow(cut, "a long, band int, key long")


def _blocks(df: DataFrame, of: Column, member: str) -> DataFrame:
    """df with lo, hi: each row once for every pair of its group's `of` blocks that its block is in."""
    return (
        df.withColumn("of", F.ceil(of).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64(member), F.col("of")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("of", "other")
    )


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups out of a partition sorted by names; a group is bounded by its block's size."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        head = tuple(k[0] for k in keys)
        if held and head != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.flatnonzero(change)
        last = tuple(k[-1] for k in keys)
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _groups(table: pa.Table, names: list[str]) -> np.ndarray:
    """Bounds of the groups of a sorted table."""
    change = np.zeros(len(table), bool)
    for n in names:
        k = table.column(n).to_numpy()
        change[1:] |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change), [len(table)]])


def _candidates(classes: DataFrame) -> DataFrame:
    """(u, v): ties of classes by pairs that outlast the comparison of signatures."""
    bands = tables.stored(_bands(classes))
    spread = bands.groupBy("band", "key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("a").cast("decimal(38,0)")).alias("members")).where("size > 1")
    kept = spread.groupBy("size", "members").agg(F.min(F.struct("band", "key")).alias("at")).select("size", "at.band", "at.key")
    # a key's members, and their signatures; a band's hot key goes by blocks
    rows = _blocks(bands.join(kept, ["band", "key"]), F.col("size") / F.lit(BAND_BLOCK), "a").join(classes.select("a", "sig"), "a")
    names = ["band", "key", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, names):
            a = table.column("a").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            own, lo, hi = (table.column(n).to_numpy() for n in ("own", "lo", "hi"))
            bounds = _groups(table, names)
            sizes = np.diff(bounds)
            two = bounds[:-1][(sizes == 2) & (lo[bounds[:-1]] == hi[bounds[:-1]])]
            hit = two[lasting(sig[two], sig[two + 1])] if len(two) else two
            u, v = [a[hit]], [a[hit + 1]]
            for at in np.flatnonzero((sizes > 2) | ((sizes == 2) & (lo[bounds[:-1]] != hi[bounds[:-1]]))).tolist():
                s, e = int(bounds[at]), int(bounds[at + 1])
                label = clusters(sig[s:e], own[s:e] if lo[s] != hi[s] else None)
                tied = np.flatnonzero(label != np.arange(e - s))
                u.append(a[s + label[tied]])
                v.append(a[s + tied])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    # the least member comes first and is the root of its group, so that bands of one group give the same ties
    dealt = rows.select(*names, "own", "a", "sig").repartition(tables.parts(bands), *names).sortWithinPartitions(*names, "a")
    return dealt.mapInArrow(compare, "u long, v long").distinct()


def _meet(sets: list[np.ndarray], both: np.ndarray) -> None:
    """Add to both[i, j], i < j, how many hashes sets i and j share: bitmaps over the hashes that two have, a slice
    of these at a time."""
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    use = shared[at]
    row, column = np.repeat(np.arange(len(sets)), list(map(len, sets)))[use], (np.cumsum(shared) - 1)[at[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(shared.sum()), BITMAP):
        lo, hi = np.searchsorted(column, (start, start + BITMAP))
        words = -(-min(BITMAP, int(shared.sum()) - start) // 64)
        packed = np.zeros((len(sets), words), np.uint64)
        order = lo + np.argsort(row[lo:hi], kind="stable")
        y, x = row[order], column[order] - start
        for top in range(0, len(sets), ROWS):
            own = slice(*np.searchsorted(y, (top, top + ROWS)))
            bits = np.zeros((min(ROWS, len(sets) - top), words * 64), bool)
            bits[y[own] - top, x[own]] = True
            packed[top : top + ROWS] = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(len(sets) - 1):
            both[i, i + 1 :] += np.bitwise_count(packed[i] & packed[i + 1 :]).sum(1, dtype=np.int32)


def linked(sets: list[np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of sorted hash arrays reach the threshold, exactly: shared hashes are counted for one range of
    values after the other, so that sorting takes the memory of one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    parts = max(1, -(-int(sizes.sum()) // SLICE))
    cuts = np.array([k * 2**64 // parts for k in range(1, parts)], U64)
    bounds = np.stack([np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]]) for s in sets])
    both = np.zeros((len(sets), len(sets)), np.int32)
    for k in range(parts):
        _meet([s[a:b] for s, (a, b) in zip(sets, bounds[:, k : k + 2].tolist(), strict=True)], both)
    out = np.zeros(both.shape, bool)
    for i in range(len(sets) - 1):
        common = both[i, i + 1 :].astype(np.int64)
        out[i, i + 1 :] = DENOMINATOR * common >= NUMERATOR * (sizes[i] + sizes[i + 1 :] - common)
    if side is not None:
        out &= side[:, None] != side[None, :]
    return out | out.T


def _labels(links: np.ndarray) -> np.ndarray:
    label, at = np.full(len(links), -1), 0
    for i in range(len(links)):
        if label[i] < 0:
            front = np.array([i])
            label[i] = i
            while len(front):
                near = links[front].any(0) & (label < 0)
                front = np.flatnonzero(near)
                label[front] = i
    return label


def _verified(docs: DataFrame, ties: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, root, links) of every class in a cluster and block: its links there, and one it is linked with."""
    labelled = components(ties).join(sizes, F.col("node") == F.col("a")).select("a", "label", "n")
    of_label = labelled.groupBy("label").agg(F.greatest(F.count("*") / F.lit(EXACT_BLOCK), F.sum("n") / F.lit(EXACT_SHINGLES)).alias("of"))
    sized = tables.stored(labelled.join(of_label, "label").select("a", "label", "of"))
    filled = docs.sparkSession.sparkContext.broadcast(marks.build(sized, "a"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task's classes that pass
        for batch in by_bytes(batches, "text", 2 << 20):
            grams, counts = shingles(Words(batch.column("text").to_pylist(), PLAIN))
            a, _ = digests(grams, counts)
            ends = np.cumsum(counts)
            keep, own = [], []
            for k in np.flatnonzero(marks.passing(filled.value, a) & (counts > 0)).tolist():
                if int(a[k]) not in seen:
                    seen.add(int(a[k]))
                    keep.append(k)
                    own.append(grams[ends[k] - counts[k] : ends[k]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(own, pa.binary())], ["a", "grams"])

    sets = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(cut, "a long, grams binary")
    sets = sets.join(sized, "a").dropDuplicates(["a"])
    names = ["label", "lo", "hi"]
    rows = _blocks(sets, F.col("of"), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, names):
            a, own = table.column("a").to_numpy(), table.column("own").to_numpy()
            lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
            grams = [np.frombuffer(g.as_buffer(), U64) for g in table.column("grams")]
            bounds = _groups(table, names)
            out: list[tuple] = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                links = linked(grams[s:e], own[s:e] if lo[s] != hi[s] else None)
                label = _labels(links)
                out += zip(a[s:e].tolist(), a[s + label].tolist(), links.sum(1).tolist(), strict=True)
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "root", "links"])

    dealt = rows.select(*names, "own", "a", "grams").repartition(tables.parts(docs), *names).sortWithinPartitions(*names, "a")
    return tables.stored(dealt.mapInArrow(verify, "a long, root long, links long"))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of docs: the least doc_id among all that links connect it
    with, and how many other classes of equal shingle sets reach the threshold with its own."""
    return _grouped(docs).select("doc_id", "class_id", "n_links")


def _grouped(docs: DataFrame) -> DataFrame:
    """The rows of join() with a hash of their text."""
    signed = tables.stored(_signed(docs))
    classes = tables.stored(signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("sig").alias("sig")))
    verified = _verified(docs, tables.stored(_candidates(classes)), classes.select("a", "n"))
    groups = components(verified.where("a <> root").select(F.col("a").alias("u"), F.col("root").alias("v")))
    links = verified.groupBy("a").agg(F.sum("links").alias("links"))
    of_class = classes.select("a", "b", "least").join(groups, F.col("a") == F.col("node"), "left").withColumn("label", F.coalesce("label", "a"))
    least = of_class.groupBy("label").agg(F.min("least").alias("class_id"))
    named = of_class.join(least, "label").join(links, "a", "left").select("a", "b", "class_id", F.coalesce("links", F.lit(0)).alias("n_links"))
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "text_hash")
    return signed.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "a", "b", "text_hash").join(named, ["a", "b"]).select("doc_id", "class_id", "n_links", "text_hash").unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs but for those that another of their group stands for: the one with the least
    doc_id stays (of repeated rows, one), and so do rows without words or doc_id."""
    joined = tables.stored(_grouped(docs))
    gone = joined.where("doc_id <> class_id").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    kept = docs.join(gone, (F.col("doc_id").cast("long") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), "left_anti")
    twice = joined.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice_id"))
    if twice.isEmpty():
        return kept
    once = kept.join(twice, F.col("doc_id").cast("long") == F.col("twice_id"), "left_anti")
    again = kept.join(twice, F.col("doc_id").cast("long") == F.col("twice_id"), "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group and the number of its links."""
    return join(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))
