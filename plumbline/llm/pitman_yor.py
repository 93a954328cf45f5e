"""Language-model scores of texts by a hierarchical Pitman-Yor model.

Three levels: a token after two others (leaf restaurants), after one (their shared parents), and the
smoothed unigram base that all parents share.  Seating is sampled by Gibbs sweeps: for every dish of every
restaurant the number of its tables, the one figure of a seating that prediction asks for, is drawn
given the last sweep's tables of the others, by one law for any number of customers (`draw_tables` tells how near it is
kept beyond ``EXACT``).  Tables of the leaves are the parents' customers.  Predictive
probabilities are averaged over ``SAMPLES`` sweeps after ``BURN``; a text's score is the sum of their logarithms.

Nothing but words' hashes moves.  Maps cut texts into tokens and send each, packed, to the bucket of the
token before it, where its restaurants live whole; the most frequent words, ``HOT`` at most, travel as their numbers in
a broadcast list, all others by their hashes.  Buckets ask the owners of their words for counts over
all of the corpus and then seat, predict and return sums a text.  A row is a bucket's words for one owner, or
a slice's tokens for one bucket, and none is empty, so rows grow with the tokens at most; words and distinct
words of the corpus are one sum over the owners.

A context with more than ``SPLIT`` tokens has its leaves dealt to units, by the token before it, under one
parent still: in every sweep units send its leaves' tables by word to at most ``SEATS`` units, each adds them up
and seats the parent for its words, and all hear the parent's tables before they seat their leaves.  The
``HOT`` most frequent contexts are split at most, so one that stays whole has ``SPLIT`` tokens or about two of every
``HOT`` of the corpus.

Every draw is a function of the dish (its words' hashes) and the sweep, and tokens' logarithms are added as
whole numbers, so a score depends on the texts alone: not on buckets, splits, partitions or the files' codec.

Tokens are words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, then one end.  A word is known by 56 bits of its
hash, the second word back too.  Null and empty texts have the end alone.  Repeated rows are texts of their
own.  A null doc_id counts as the empty text when rows are held out.  Without training rows every token
has the base's probability.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .words import PLAIN, U64, WordKind, Words, by_bytes, mix

LOWER = WordKind(bytes(np.flatnonzero(~PLAIN.is_word).tolist()), lower=True)
END, BEGIN = U64(1), U64(2)
NONE = np.empty(0, U64)  # no common words
DISCOUNT, STRENGTH = (0.7, 0.8), (2.0, 1.0)  # of parents and of leaves
BURN, SAMPLES = 3, 4
EXACT = 1024  # customers up to which Stirling numbers are tabled
FAR, MANY = EXACT // 2, 300  # tables that are told apart beyond, and their mode beyond which the normal law stands
ADD = 0.1
BUCKET_BYTES = 7 << 19  # of the scan's estimate, doubled, for each bucket: some 1.2 million tokens
LEAST_BUCKETS = 64  # unless they would be of less than 256 KB
PER_OWNER = 8  # buckets for each owner of words
MOST_PARTS = 50_000  # partitions of an exchange; with more buckets some share one, each its own group still
SLICE = 6 << 20
HOT = 1 << 16  # frequent words that have numbers, and contexts that may be dealt to several units
TOLD = 1 << 17  # a slice tells of the words with this part of its tokens
LEVELS = 8  # of counts between one number and its double
SPLIT = 400_000  # tokens after a context for each of its units
SEATS = 4096  # units of a context that seat its parent
BASE_STEPS, MODEL_STEPS = 1e9, 1e7  # a text's sums of a bucket, and every token's, are whole numbers of such parts


# ---- packing


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as byte planes, compressed."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        wide = a.dtype.itemsize
        out.append(struct.pack("<IIc", len(a), wide, a.dtype.kind.encode()))
        out.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, wide).T).tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        size, wide, kind = struct.unpack_from("<IIc", raw, at)
        at += 9
        planes = np.frombuffer(raw, np.uint8, size * wide, at).reshape(wide, size)
        out.append(np.ascontiguousarray(planes.T).view(f"{kind.decode()}{wide}").ravel() if size else np.empty(0, f"{kind.decode()}{wide}"))
        at += size * wide
    return out


def _least(values: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


# ---- tokens


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(token, text) of all texts in turn: the words' hashes, then an end."""
    counts = words.counts + 1
    ends = np.cumsum(counts)
    out = np.full(int(ends[-1]) if len(ends) else 0, END, U64)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = (words.hashes >> U64(8)) | U64(1 << 55)
    return out, np.repeat(np.arange(len(counts)), counts)


def _before(token: np.ndarray, text: np.ndarray, steps: int) -> np.ndarray:
    out = np.full(len(token), BEGIN, U64)
    if len(token) > steps:
        same = text[steps:] == text[:-steps]
        out[steps:][same] = token[:-steps][same]
    return out


def _owner(word: np.ndarray, owners: int) -> np.ndarray:
    return (mix(word ^ U64(0x5851F42D4C957F2D)) % U64(owners)).astype(np.int64)


class Kin:
    """Frequent words; very frequent contexts and the numbers of their units, which follow the buckets'."""

    def __init__(self, words: list[int], units: list[int], first: int, common: np.ndarray = NONE) -> None:
        self.common = common  # the frequent words, sorted
        order = np.argsort(np.array(words, U64))
        self.words, self.units = np.array(words, U64)[order], np.array(units, np.int64)[order]
        self.first = first + np.cumsum(self.units) - self.units
        self.total, self.seats = int(self.units.sum()), SEATS

    def of(self, number: int) -> range:
        """The units that seat the parent of this unit's context."""
        k = int(np.searchsorted(self.first, number, "right")) - 1
        return range(int(self.first[k]), int(self.first[k]) + min(self.seats, int(self.units[k])))

    def deal(self, before: np.ndarray, second: np.ndarray, bucket: np.ndarray) -> None:
        """Puts the unit's number where the token before is such a context."""
        at = _place(self.words, before)
        own = at >= 0
        bucket[own] = self.first[at[own]] + (mix(second[own]) % self.units[at[own]].astype(U64)).astype(np.int64)


def _hot(docs: DataFrame) -> list[tuple[int, int]]:
    """(word, units of its context) of the most frequent words, HOT of them at most; 1 unit up to SPLIT tokens.

    A slice tells of those with 1/TOLD of its own tokens, so less than 1/TOLD of the corpus goes unseen.  Whole levels of
    counts are taken, the highest first, so that no more than is taken reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            token, _ = tokens(Words(batch.column("text").to_pylist(), LOWER))
            word, n = np.unique(token, return_counts=True)
            some = n * TOLD >= len(token)
            yield pa.RecordBatch.from_arrays([pa.array(word[some].view(np.int64)), pa.array(n[some].astype(np.int64))], ["word", "n"])

    counted = tables.stored(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    level, lowest, taken = F.floor(F.log2("n") * LEVELS), None, 0
    for row in counted.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        taken += row["words"]
        if taken > HOT:
            break
        lowest = row["level"]
    most = counted.where(level >= lowest).collect() if lowest is not None else []
    return [(int(np.int64(r["word"]).view(U64)), -(-r["n"] // SPLIT)) for r in most]


def _coded(words: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps between the numbers of common words, then between the hashes of others; sorted, the common ones first."""
    at = _place(common, words)
    n = int((at >= 0).sum())
    return _least(np.diff(at[:n], prepend=0)), np.diff(words[n:], prepend=U64(0))


def _plain(numbers: np.ndarray, others: np.ndarray, common: np.ndarray) -> np.ndarray:
    return np.concatenate([common[np.cumsum(numbers, dtype=np.int64)], np.cumsum(others, dtype=U64)])


# ---- seating


@lru_cache
def stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """Logarithms of generalized Stirling numbers S(c, t), c and t from 1."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, n):
        t = np.arange(1, c + 1)
        stay = out[c, t] + np.log(c - t * discount)
        out[c + 1, 1 : c + 1] = np.logaddexp(stay, out[c, 0:c])
        out[c + 1, c + 1] = 0.0
    return out


@lru_cache
def _far(discount: float) -> np.ndarray:
    """Rows of log S(c, t) - log gamma(c) + discount * log c, t up to ``FAR``, for c without end, ``EXACT`` and half of it."""
    log_s, t = stirling(discount), np.arange(1, FAR + 1)
    gamma = np.array([math.lgamma(x) for x in range(1, FAR + 1)])
    row = lambda c: log_s[c, 1 : FAR + 1] - math.lgamma(c) + discount * math.log(c)
    return np.stack([-math.lgamma(1 - discount) - gamma - (t - 1) * math.log(discount), row(EXACT), row(EXACT // 2)])


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number between 0 and 1 for every key, the same at every place and run."""
    return ((mix(key + U64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))) >> U64(12)).astype(np.float64) + 0.5) / 2**52


def draw_tables(key: np.ndarray, sweep: int, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, log_s: np.ndarray) -> np.ndarray:
    """Tables of every dish given the other dishes' tables in its restaurant.

    A row a dish: key (its own number), customers, others (tables of the others), parent (its probability there).  The law is
    S(customers, t) * parent^t * (strength + discount * others) ... (strength + discount * (others + t - 1)).  Its Stirling numbers are exact up to
    ``EXACT`` customers; beyond, their logarithms lie on a parabola over customers^-discount between EXACT/2, EXACT and no end, within a
    thousandth of the true mean up to 100 tables and a twenty-fifth up to ``MANY``.  Dishes that must have more tables than these are drawn by the normal law at the mode."""
    out = np.minimum(customers, 1)
    many = np.flatnonzero((customers > 1) & (customers <= EXACT))
    u = uniform(key, 1000 * sweep)

    def drawn(own: np.ndarray, log_numbers: np.ndarray) -> None:
        t = np.arange(1, log_numbers.shape[-1] + 1)
        weight = log_numbers + t * np.log(parent[own])[:, None]
        weight += np.cumsum(np.log(strength + discount * (others[own][:, None] + t - 1)), axis=1)
        upto = np.cumsum(np.exp(weight - weight.max(1)[:, None]), axis=1)
        out[own] = 1 + (u[own][:, None] * upto[:, -1:] > upto[:, :-1]).sum(1)

    order = many[np.argsort(customers[many], kind="stable")]
    for own in np.split(order, np.flatnonzero(np.diff(customers[order])) + 1) if len(order) else ():
        c = int(customers[own[0]])
        for part in np.array_split(own, max(1, len(own) * c // 1_000_000)):
            drawn(part, log_s[c, 1 : c + 1])
    big = np.flatnonzero(customers > EXACT)
    mode = parent[big] * (strength + discount * others[big]) / (discount * np.maximum(1 - parent[big], 1e-9))
    near, far = big[mode <= MANY], big[mode > MANY]
    a, b = EXACT**-discount, (EXACT // 2) ** -discount
    for part in np.array_split(near, max(1, len(near) * FAR // 1_000_000)) if len(near) else ():
        x = customers[part][:, None].astype(np.float64) ** -discount
        rows = _far(discount)
        drawn(part, rows[0] * ((x - a) * (x - b) / (a * b)) + rows[1] * (x * (x - b) / (a * (a - b))) + rows[2] * (x * (x - a) / (b * (b - a))))
    if len(far):
        mode = np.minimum(mode[mode > MANY], customers[far])
        spread = 1 / np.maximum(1 / mode - discount / (strength + discount * (others[far] + mode)), 1e-12)
        z = np.sqrt(-2 * np.log(u[far])) * np.cos(2 * np.pi * uniform(key[far], 1000 * sweep + 1))
        out[far] = np.clip(np.rint(mode + z * np.sqrt(spread)), 1, customers[far])
    return out


class Restaurants:
    """Leaves and parents over the training tokens of a bucket."""

    def __init__(self, leaf: np.ndarray, dish: np.ndarray, customers: np.ndarray, key: np.ndarray, dish_context: np.ndarray, dish_base: np.ndarray, dish_key: np.ndarray) -> None:
        """leaf (its restaurant), dish (of the parent), customers, key: a row a leaf dish; the rest: a row a parent dish."""
        self.leaf, self.dish, self.customers, self.key = leaf, dish, customers, key
        self.dish_context, self.base, self.dish_key = dish_context, dish_base, dish_key
        self.tables = np.ones(len(customers), np.int64)
        self.parent_tables = np.zeros(len(dish_base), np.int64)
        self.log_s = [stirling(d) for d in DISCOUNT]
        self.leaf_customers, self.swept = np.bincount(leaf, customers).astype(np.int64), 0

    def sweep(self) -> None:
        d, s, k, own = DISCOUNT, STRENGTH, self.swept, self.dish_context
        self.parent_customers = np.bincount(self.dish, self.tables, len(self.base)).astype(np.int64)
        # of the last sweep; an empty restaurant in the first
        others = np.bincount(own, self.parent_tables).astype(np.int64)[own] - self.parent_tables
        self.parent_tables = draw_tables(self.dish_key, 2 * k, self.parent_customers, others, self.base, d[0], s[0], self.log_s[0])
        self.context_customers = np.bincount(own, self.parent_customers)
        self.context_tables = np.bincount(own, self.parent_tables)
        self.predicted = (self.parent_customers - d[0] * self.parent_tables + (s[0] + d[0] * self.context_tables[own]) * self.base) / (s[0] + self.context_customers[own])
        others = np.bincount(self.leaf, self.tables).astype(np.int64)[self.leaf] - self.tables
        self.tables = draw_tables(self.key, 2 * k + 1, self.customers, others, self.predicted[self.dish], d[1], s[1], self.log_s[1])
        self.leaf_tables = np.bincount(self.leaf, self.tables)
        self.swept += 1

    def probability(self, base: np.ndarray, context: np.ndarray, dish: np.ndarray, leaf: np.ndarray, leaf_dish: np.ndarray) -> np.ndarray:
        """Predictive probability; -1 where a context, dish, leaf or leaf dish was not seen in training."""
        d, s = DISCOUNT, STRENGTH
        p = base.copy()
        k = np.flatnonzero(context >= 0)
        c = context[k]
        seen = np.where(dish[k] >= 0, (self.parent_customers - d[0] * self.parent_tables)[dish[k]] if len(self.base) else 0.0, 0.0)
        p[k] = (seen + (s[0] + d[0] * self.context_tables[c]) * p[k]) / (s[0] + self.context_customers[c])
        k = np.flatnonzero(leaf >= 0)
        c = leaf[k]
        seen = np.where(leaf_dish[k] >= 0, (self.customers - d[1] * self.tables)[leaf_dish[k]] if len(self.customers) else 0.0, 0.0)
        p[k] = (seen + (s[1] + d[1] * self.leaf_tables[c]) * p[k]) / (s[1] + self.leaf_customers[c])
        return p


def _place(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where asked stand in the sorted known; -1 where they don't."""
    if not len(known):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


def parent_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context ^ U64(0xA24BAED4963EE407)) + word)


def leaf_key(context: np.ndarray, second: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(parent_key(context, word) + mix(second ^ U64(0x9FB21C651E98DF25)))


def _parts(blobs: list[bytes], common: np.ndarray) -> list[list[np.ndarray]]:
    parts = [_unpack(b) for b in blobs]
    return [[_plain(p[0], p[1], common), p[2], _plain(p[3], p[4], common), *p[5:]] for p in parts]


def vocabulary(blobs: list[bytes], common: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray]:
    """The words of a bucket's tokens and how often each stands in training texts."""
    some = []
    for p in _parts(blobs, common):
        words, train = p[3].astype(np.int64), (p[5] & 1).astype(bool)
        n = np.bincount(words[train], minlength=len(p[2]))
        used = np.bincount(words, minlength=len(p[2])) > 0
        some.append((p[2][used], n[used]))
    vocab, at = np.unique(np.concatenate([w for w, _ in some]), return_inverse=True)
    return vocab, np.bincount(at, np.concatenate([n for _, n in some]), len(vocab)).astype(np.int64)


class Bucket:
    """All tokens that follow the contexts of one bucket; different (context, second, word) are a row each."""

    def __init__(self, blobs: list[bytes], batches: list[int], common: np.ndarray = NONE) -> None:
        order = sorted(range(len(blobs)), key=lambda k: (batches[k], blobs[k]))
        parts = _parts([blobs[k] for k in order], common)
        self.batches = [batches[k] for k in order]
        self.docs = [p[7] for p in parts]  # doc_ids of the batch, in the one blob that brings them
        self.known_ids = [p[8] for p in parts]
        self.base = np.cumsum([0, *[int(p[6][0]) for p in parts]])  # texts in the batches before
        # a blob's hashes are those of its words and of the second words back

        def numbered(column: int) -> tuple[np.ndarray, np.ndarray]:
            known = np.unique(np.concatenate([p[2][np.bincount(p[column], minlength=len(p[2])) > 0] for p in parts]))
            return known, np.concatenate([np.searchsorted(known, p[2])[p[column]] for p in parts])

        self.vocab, word = numbered(3)
        seconds, second = numbered(4)
        contexts, context = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        context = np.repeat(context, np.concatenate([p[1] for p in parts]).astype(np.int64))
        flags = np.concatenate([p[5].astype(np.int32) for p in parts])
        self.text = (flags >> 1) + np.repeat(self.base[:-1].astype(np.int32), [len(p[3]) for p in parts])
        train = (flags & 1).astype(bool)
        del parts, flags
        leaf, back = context * len(seconds) + second, int(len(self.vocab)).bit_length()
        del context, second
        if (len(contexts) * len(seconds)).bit_length() + back > 63:  # a key would not hold both
            leaf = np.unique(leaf, return_inverse=True)
            names, leaf = leaf
        else:
            names = None
        unique, inverse = np.unique((leaf << back) | word, return_inverse=True)
        del leaf, word
        self.inverse = inverse.astype(np.int32)
        self.customers = np.bincount(inverse[train], minlength=len(unique))
        self.word, leaf = unique & ((1 << back) - 1), unique >> back
        new = np.append(True, leaf[1:] != leaf[:-1]) if len(leaf) else np.zeros(0, bool)
        self.leaf, of_leaf = np.cumsum(new) - 1, leaf if names is None else names[leaf]
        self.context = of_leaf // max(1, len(seconds))
        self.parent_key = parent_key(contexts[self.context], self.vocab[self.word])
        self.key = leaf_key(contexts[self.context], seconds[of_leaf % max(1, len(seconds))], self.vocab[self.word])

    def sums(self, counts: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, ...]:
        """For every text of every batch: its tokens here, those known, base and model logarithms."""
        base = (counts + ADD) / (total + ADD * (distinct + 1))
        bits = max(1, int(len(self.vocab)).bit_length())
        dish_key = (self.context << bits) | self.word
        taught = np.flatnonzero(self.customers)
        dishes, at = np.unique(dish_key[taught], return_index=True)
        leaves, heads = np.unique(self.leaf[taught]), np.unique(dishes >> bits)
        dish, leaf, head = _place(dishes, dish_key), _place(leaves, self.leaf), _place(heads, self.context)
        leaf_dish = np.full(len(self.word), -1)
        leaf_dish[taught] = np.arange(len(taught))
        rest = Restaurants(leaf[taught], dish[taught], self.customers[taught], self.key[taught], np.searchsorted(heads, dishes >> bits), base[dishes & ((1 << bits) - 1)], self.parent_key[taught[at]])
        p = np.zeros(len(self.word))
        for k in range(BURN + SAMPLES):
            rest.sweep()
            if k >= BURN:
                p += rest.probability(base[self.word], head, dish, leaf, leaf_dish)
        return self.by_text(counts, base, p / SAMPLES)

    def by_text(self, counts: np.ndarray, base: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
        n = int(self.base[-1])
        known = counts[self.word] > 0
        return (
            np.bincount(self.text, minlength=n),
            np.bincount(self.text[known[self.inverse]], minlength=n),
            np.rint(np.bincount(self.text, np.log10(base)[self.word][self.inverse], n) * -BASE_STEPS).astype(np.int64),
            np.bincount(self.text, np.rint(np.log10(p) * -MODEL_STEPS)[self.inverse], n).astype(np.int64),
        )


class Unit:
    """A part of the leaves of one very frequent context; its parent is kept by several units together."""

    def __init__(self, blobs: list[bytes], batches: list[int], number: int, seats: range, common: np.ndarray) -> None:
        self.bucket, self.number, self.seats = Bucket(blobs, batches, common), number, seats
        b = self.bucket
        self.word, self.leaf, self.customers, self.leaves = b.word, b.leaf, b.customers, int(b.leaf[-1]) + 1 if len(b.leaf) else 0
        self.taught = np.flatnonzero(self.customers)
        slot = _owner(b.vocab, len(seats))
        order = np.argsort(slot, kind="stable")
        cuts = np.searchsorted(slot[order], np.arange(len(seats) + 1))
        self.slots = [order[a:e] for a, e in zip(cuts[:-1], cuts[1:], strict=True)]
        # every word's key in the parent
        self.parent_key = np.zeros(len(b.vocab), U64)
        self.parent_key[b.word] = b.parent_key

    def asked(self, tables_: np.ndarray) -> list[np.ndarray]:
        """The parent's customers from here, by the unit that seats the word."""
        sums = np.bincount(self.word[self.taught], tables_, len(self.bucket.vocab)).astype(np.int64)
        return [sums[at] for at in self.slots]

    def sweep(self, k: int, tables_: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """New tables of the leaves; parent: the probability of every word there."""
        own = self.taught
        others = np.bincount(self.leaf[own], tables_, self.leaves).astype(np.int64)[self.leaf[own]] - tables_
        return draw_tables(self.bucket.key[own], 2 * k + 1, self.customers[own], others, parent[self.word[own]], DISCOUNT[1], STRENGTH[1], stirling(DISCOUNT[1]))

    def probability(self, tables_: np.ndarray, parent: np.ndarray) -> np.ndarray:
        d, s = DISCOUNT[1], STRENGTH[1]
        seated = np.zeros(len(self.customers), np.int64)
        seated[self.taught] = tables_
        of_leaf, at = np.bincount(self.leaf, seated, self.leaves)[self.leaf], np.bincount(self.leaf, self.customers, self.leaves)[self.leaf]
        return (self.customers - d * seated + (s + d * of_leaf) * parent[self.word]) / (s + at)


def seat_parent(words: list[np.ndarray], counts: list[np.ndarray], sums: list[np.ndarray], held: np.ndarray | None, total: int, distinct: int, everywhere: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(customers, tables, place of every word asked) of the words that one unit seats for its context.

    A row of words (by their keys), counts (in the corpus) and sums (of leaves' tables) for each unit; held: the
    tables of the last sweep; everywhere: all tables of the restaurant then."""
    known, at = np.unique(np.concatenate(words), return_inverse=True)
    of_corpus = np.zeros(len(known), np.int64)
    of_corpus[at] = np.concatenate(counts)
    customers = np.zeros(len(known), np.int64)
    np.add.at(customers, at, np.concatenate(sums).astype(np.int64))
    others = np.zeros(len(known), np.int64) if held is None else everywhere - held.astype(np.int64)
    base = (of_corpus + ADD) / (total + ADD * (distinct + 1))
    return customers, draw_tables(known, 2 * k, customers, others, base, DISCOUNT[0], STRENGTH[0], stirling(DISCOUNT[0])), at


# ---- over tables


def _dealt(docs: DataFrame, buckets: int, kin: Kin, shared: Broadcast | None = None) -> DataFrame:
    """(bucket, batch, blob): tokens by the bucket of the one before, or by the unit of a very frequent one."""
    shared = shared or docs.sparkSession.sparkContext.broadcast(kin)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in by_bytes(batches, "text", SLICE):
            token, text = tokens(Words(batch.column("text").to_pylist(), LOWER))
            before, second = _before(token, text, 1), _before(token, text, 2)
            bucket = (mix(before) % U64(buckets)).astype(np.int64)
            shared.value.deal(before, second, bucket)
            flags = (text << 1) | batch.column("train").to_numpy(zero_copy_only=False).astype(np.int64)[text]
            common = shared.value.common
            order = np.lexsort((before, _place(common, before) < 0, bucket))
            some, starts = np.unique(bucket[order], return_index=True)
            ids = batch.column("doc_id")
            known = np.array(ids.is_valid())
            ids = ids.fill_null(0).to_numpy()
            number = part << 24 | seq
            seq += 1
            out: list[tuple[int, bytes]] = []
            for b, a, e in zip(some.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                own = order[a:e]
                head = np.flatnonzero(np.append(True, before[own][1:] != before[own][:-1]))
                words, index = np.unique(np.concatenate([token[own], second[own]]), return_inverse=True)
                first = np.argsort(_place(common, words) < 0, kind="stable")
                index = np.argsort(first)[index]
                bring = not a  # the first blob brings the doc_ids
                blob = _pack(
                    *_coded(before[own][head], common), _least(np.diff(np.append(head, len(own)))), *_coded(words[first], common), _least(index[: len(own)]), _least(index[len(own) :]), _least(flags[own]),
                    np.array([batch.num_rows]), ids if bring else ids[:0], known.astype(np.uint8) if bring else np.empty(0, np.uint8),
                )
                out.append((b, blob))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(next(columns), pa.int32()), pa.array([number] * len(out), pa.int64()), pa.array(next(columns), pa.binary())], ["bucket", "batch", "blob"])

    return docs.select("doc_id", "train", "text").mapInArrow(emit, "bucket int, batch long, blob binary")


def _ask(group: pd.DataFrame, owners: int, kin: Kin) -> pd.DataFrame:
    vocab, counts = vocabulary(group["blob"].tolist(), kin.common)
    owner = _owner(vocab, owners)
    order = np.argsort(owner, kind="stable")
    some, starts = np.unique(owner[order], return_index=True)
    pieces = np.split(order, starts[1:])
    return pd.DataFrame({"owner": some, "bucket": int(group["bucket"].iloc[0]), "blob": [_pack(np.diff(vocab[at], prepend=U64(0)), _least(counts[at])) for at in pieces]})


def _together(group: pd.DataFrame) -> tuple[list[list[np.ndarray]], np.ndarray, np.ndarray]:
    """What an owner is asked, each word's place among its words, and these words' counts."""
    asked = [_unpack(b) for b in group["blob"]]
    for a in asked:
        a[0] = np.cumsum(a[0], dtype=U64)
    words, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, at, np.concatenate([a[1].astype(np.int64) for a in asked]))
    return asked, at, total


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    asked, at, total = _together(group)
    ends = np.cumsum([len(a[0]) for a in asked])
    own = [_pack(_least(total[at[e - len(a[0]) : e]])) for a, e in zip(asked, ends, strict=True)]
    return pd.DataFrame({"bucket": group["bucket"].to_numpy(), "owner": group["owner"].to_numpy(), "blob": own, "all": 0})


def _totals(group: pd.DataFrame) -> pd.DataFrame:
    total = _together(group)[2]
    return pd.DataFrame({"all": [0], "total": [total.sum()], "distinct": [(total > 0).sum()]})


def _counts(vocab: np.ndarray, told: pd.DataFrame, owners: int) -> np.ndarray:
    counts, owner = np.zeros(len(vocab), np.int64), _owner(vocab, owners)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(owners + 1))
    for o, blob in zip(told["owner"].tolist(), told["blob"], strict=True):
        counts[order[cuts[o] : cuts[o + 1]]] = _unpack(blob)[0]
    return counts


def _score(left: pd.DataFrame, right: pd.DataFrame, owners: int, kin: Kin) -> pd.DataFrame:
    bucket = Bucket(left["blob"].tolist(), left["batch"].tolist(), kin.common)
    total, distinct = int(right["total"].iloc[0]), int(right["distinct"].iloc[0])
    return _sent(bucket, bucket.sums(_counts(bucket.vocab, right, owners), total, distinct), total)


def _sent(bucket: Bucket, sums: tuple[np.ndarray, ...], total: int) -> pd.DataFrame:
    rows: dict[int, list[np.ndarray]] = {}
    for k, number in enumerate(bucket.batches):
        s = slice(int(bucket.base[k]), int(bucket.base[k + 1]))
        some = np.flatnonzero(sums[0][s])
        n, known, base, model = (x[s][some] for x in sums)
        rows[number] = [*[_least(x) for x in (np.diff(some, prepend=0), n, n - known, base, model)], bucket.docs[k], bucket.known_ids[k]]
    return pd.DataFrame({"batch": list(rows), "blob": [_pack(*v) for v in rows.values()], "train_tokens": total})


# Messages between the units of a context: (bucket, at, kind, blob), to and from.
MESSAGE = "bucket int, at int, kind int, blob binary"
ASK, ANSWER, LEAVES, PARENT = range(4)


def _messages(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "at", "kind", "blob"])


def _of(rows: pd.DataFrame, kind: int) -> list[tuple[int, list[np.ndarray]]]:
    some = rows[rows["kind"] == kind].sort_values("at")
    return [(int(at), _unpack(blob)) for at, blob in zip(some["at"], some["blob"], strict=True)]


def _introduce(left: pd.DataFrame, right: pd.DataFrame, owners: int, kin: Kin) -> pd.DataFrame:
    """A unit's words with their counts in the corpus and its leaves' first tables, to those who seat them."""
    number = int(left["bucket"].iloc[0])
    unit = Unit(left["blob"].tolist(), left["batch"].tolist(), number, kin.of(number), kin.common)
    counts = _counts(unit.bucket.vocab, right, owners)
    facts = np.array([right["total"].iloc[0], right["distinct"].iloc[0]], np.int64)
    sums = unit.asked(np.ones(len(unit.taught), np.int64))
    return _messages([(to, number, ASK, _pack(unit.parent_key[at], _least(counts[at]), _least(own), facts)) for to, at, own in zip(unit.seats, unit.slots, sums, strict=True)])


def _seat(first: pd.DataFrame, then: pd.DataFrame | None, k: int) -> pd.DataFrame:
    """The k-th draw of a parent's tables for the words of one unit, told to all units.  first: the introductions."""
    if not len(first):  # a unit that seats nothing
        return then[then["kind"] == LEAVES] if then is not None else _messages([])
    number = int(first["bucket"].iloc[0])
    intro = _of(first, ASK)
    total, distinct = intro[0][1][3].tolist()
    sums, held, everywhere, out = [x[2] for _, x in intro], None, 0, []
    if then is not None:
        asks = _of(then, ASK)
        sums, everywhere = [x[0] for _, x in asks], int(asks[0][1][1][0])
        held = _of(then, PARENT)[0][1][0]
        out = list(then[then["kind"] == LEAVES].itertuples(index=False, name=None))
    customers, drawn, at = seat_parent([x[0] for _, x in intro], [x[1] for _, x in intro], sums, held, total, distinct, everywhere, k)
    out.append((number, number, PARENT, _pack(_least(drawn))))
    facts, start = np.array([total, distinct, customers.sum(), drawn.sum()], np.int64), 0
    for to, x in intro:
        own = at[start : start + len(x[0])]
        start += len(x[0])
        out.append((to, number, ANSWER, _pack(_least(customers[own]), _least(drawn[own]), x[1], facts)))
    return _messages(out)


def _sweep(left: pd.DataFrame, right: pd.DataFrame, k: int, kin: Kin) -> pd.DataFrame:
    """The k-th draw of a unit's leaves; after the last one its sums a text."""
    last = k == BURN + SAMPLES - 1
    if not len(left):  # seats words for others only
        return _messages(list(right[right["kind"] == PARENT].itertuples(index=False, name=None))) if not last else pd.DataFrame({"batch": [], "blob": [], "train_tokens": []})
    number = int(left["bucket"].iloc[0])
    unit = Unit(left["blob"].tolist(), left["batch"].tolist(), number, kin.of(number), kin.common)
    seen = np.zeros((3, len(unit.bucket.vocab)), np.int64)  # the parent's customers and tables, the corpus's counts
    sizes = np.zeros(2, np.int64)
    for at, x in _of(right, ANSWER):
        seen[:, unit.slots[at - unit.seats.start]] = x[:3]
        sizes += x[3][2:]
        total, distinct = x[3][:2].tolist()
    base = (seen[2] + ADD) / (total + ADD * (distinct + 1))

    def parent(customers: np.ndarray, tables_: np.ndarray, both: np.ndarray) -> np.ndarray:
        d, s = DISCOUNT[0], STRENGTH[0]
        return (customers - d * tables_ + (s + d * both[1]) * base) / (s + both[0])

    # leaves' tables, then for every sample so far: its leaves' tables, the parent's customers, tables and their sums
    past = [a.astype(np.int64) for a in _of(right, LEAVES)[0][1]] if k else [np.ones(len(unit.taught), np.int64)]
    drawn = unit.sweep(k, past[0], parent(*seen[:2], sizes))
    samples = past[1:] + ([drawn, *seen[:2], sizes] if k >= BURN else [])
    if last:
        p = sum(unit.probability(samples[i], parent(*samples[i + 1 : i + 4])) for i in range(0, len(samples), 4))
        return _sent(unit.bucket, unit.bucket.by_text(seen[2], base, p / SAMPLES), total)
    out = [(number, number, LEAVES, _pack(*[_least(a) for a in [drawn, *samples]]))]
    out += right[right["kind"] == PARENT].itertuples(index=False, name=None)
    out += [(to, number, ASK, _pack(_least(own), sizes[1:])) for to, own in zip(unit.seats, unit.asked(drawn), strict=True)]
    return _messages(out)


def _units(dealt: DataFrame, told: DataFrame, owners: int, shared: Broadcast, parts: int) -> DataFrame:
    """(batch, blob, train_tokens) from the units: sweeps in step."""
    own = dealt.groupBy("bucket")
    sweep = lambda k: lambda a, b: _sweep(a, b, k, shared.value)
    seat = lambda k: lambda a, b: _seat(a, b, k)
    intro = own.cogroup(told.groupBy("bucket")).applyInPandas(lambda a, b: _introduce(a, b, owners, shared.value), MESSAGE).repartition(min(parts, shared.value.total), "bucket")
    seated, last = intro.groupBy("bucket").applyInPandas(lambda a: _seat(a, None, 0), MESSAGE), BURN + SAMPLES - 1
    for k in range(last):
        swept = own.cogroup(seated.groupBy("bucket")).applyInPandas(sweep(k), MESSAGE)
        seated = intro.groupBy("bucket").cogroup(swept.groupBy("bucket")).applyInPandas(seat(k + 1), MESSAGE)
    return own.cogroup(seated.groupBy("bucket")).applyInPandas(sweep(last), "batch long, blob binary, train_tokens long")


def _gather(group: pd.DataFrame) -> pd.DataFrame:
    parts = [_unpack(b) for b in group["blob"]]
    ids, known_ids = next((p[5], p[6]) for p in parts if len(p[5]))
    out = np.zeros((4, len(ids)), np.int64)
    for p in parts:
        some = np.cumsum(p[0], dtype=np.int64)
        n, unknown, base, model = (x.astype(np.int64) for x in p[1:5])
        for o, values in zip(out, (n, n - unknown, base, model), strict=True):
            o[some] += values
    frame = pd.DataFrame({"n_tokens": out[0], "n_known": out[1], "base_score": out[2] / -BASE_STEPS, "score": out[3] / -MODEL_STEPS})
    frame["doc_id"] = pd.Series(ids).astype("Int64").where(known_ids.astype(bool))
    frame["train_tokens"] = int(group["train_tokens"].iloc[0])
    return frame


def held_out(doc_id, folds: int = 10):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out(F.col("doc_id"))).alias("train"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    scanned = tables.input_bytes(docs)
    buckets = max(1, scanned * 2 // BUCKET_BYTES, min(LEAST_BUCKETS, scanned >> 18))
    owners = max(1, buckets // PER_OWNER)
    frequent = _hot(plain)
    hot = [x for x in frequent if x[1] > 1]
    kin = Kin([w for w, _ in hot], [n for _, n in hot], buckets, np.unique(np.array([int(BEGIN), *[w for w, _ in frequent]], U64)))
    shared = docs.sparkSession.sparkContext.broadcast(kin)
    groups = min(MOST_PARTS, buckets + kin.total)
    # one exchange, read by those who ask for counts and by those who score
    dealt = _dealt(plain, buckets, kin, shared).repartition(groups, "bucket")
    # what is not deterministic stays above an exchange, so that all read the same one
    number = F.col("bucket") + F.floor(F.rand(0))
    asked = (dealt.where(number >= 0) if hot else dealt).groupBy("bucket").applyInPandas(lambda g: _ask(g, owners, shared.value), "owner int, bucket int, blob binary").repartition(owners, "owner")
    totals = asked.groupBy("owner").applyInPandas(_totals, "all int, total long, distinct long").groupBy("all").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"))
    told = asked.groupBy("owner").applyInPandas(_answer, "bucket int, owner int, blob binary, all int").repartition(groups, "bucket").join(F.broadcast(totals), "all")  # of one row
    units = None
    if hot:
        units = _units(dealt.where(number >= buckets), told.where(number >= buckets), owners, shared, groups)
        dealt, told = dealt.where(number < buckets), told.where(number < buckets)
    scored = dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(lambda a, b: _score(a, b, owners, shared.value), "batch long, blob binary, train_tokens long")
    if units is not None:
        scored = scored.unionByName(units)
    gathered = scored.groupBy("batch").applyInPandas(_gather, "doc_id long, n_tokens long, n_known long, base_score double, score double, train_tokens long")
    return gathered.withColumn("held_out", held_out(F.col("doc_id")))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base score and model score."""
    scored = score(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
