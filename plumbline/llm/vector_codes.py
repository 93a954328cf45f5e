"""Vector code compression: product codes fitted by Lloyd rounds with Hamerly's bounds, all in integers.

A component x counts as floor(256*x).  A vector is cut into ``PARTS`` consecutive parts, equal ones where its length
allows, else the last ones are longer by one.  Each part position has a codebook, at first that part of the vectors with the
``ENTRIES`` smallest vec_ids.  A round assigns every part to its nearest entry (squared Euclidean distance, ties to
the lower index) and replaces each entry by the floor of its parts' mean; entries without parts stay.

Between rounds each vector keeps, for every part, its entry, an upper bound of the distance to it and a lower bound of that
to the second nearest one, in 1/256ths, rounded away from each other.  As entries move, the bounds give way by as
much as they moved.  A part is searched in full only where the upper bound isn't strictly below the lower one, nor
strictly below half the way from its entry to the next; then no other entry can be as near, so ties come out as in a full search.

Vectors are mapped, never shuffled: a task sums its parts by entry, and only these sums are.  Codebooks travel to the driver
and back; they hold 64 vectors' numbers, whatever the table holds.  The state of a round is a stored table.

Rows are dropped whose vector is null, holds null or non-finite components, or components whose size is 65,536
or more (their squares could leave 64 bits).  Vectors of another length than the first codebook entries' get null codes and
errors.  Ties among the smallest vec_ids go by the vector itself, null vec_ids last.  Repeated rows count as often as they stand.  No
rows give no codebooks and no rows.  Columns of the input that share a result's name are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 16
FEW_LABELS = 100_000  # rows of a label and a sum that may be broadcast; more are joined by shuffle
STATE = ["part_code", "upper", "lower"]
ADDED = ["code", "error", "codes", "scans"]


def bounds_of(length: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return [k * length // parts for k in range(parts + 1)]


def _root(square: np.ndarray, up: bool) -> np.ndarray:
    """A root in 1/256ths, rounded up or down; one more (or less) covers what a double root may be off."""
    root = np.sqrt(square.astype(np.float64)) * SCALE
    return np.ceil(root).astype(np.int64) + 1 if up else np.maximum(np.floor(root).astype(np.int64) - 1, 0)


class Codebook:
    """The entries of one part position, and how far they lie apart and have moved since the bounds were set."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None) -> None:
        self.entries = entries
        count = len(entries)
        apart = ((entries[:, None] - entries[None]) ** 2).sum(2)
        apart[np.arange(count), np.arange(count)] = np.iinfo(np.int64).max // 4
        self.half = _root(apart.min(1), False) // 2 if count > 1 else np.full(count, 1 << 60)
        moved = np.zeros(count, np.int64) if before is None else _root(((entries - before) ** 2).sum(1), True)
        if before is not None:
            moved[(entries == before).all(1)] = 0
        self.moved = moved
        order = np.argsort(-moved, kind="stable")
        self.most = np.full(count, moved[order[0]])  # how far any other entry moved at most
        self.most[order[0]] = moved[order[1]] if count > 1 else 0

    def search(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest entry, upper bound, lower bound of the second nearest) by all distances."""
        code, upper, lower = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for k in range(0, len(parts), 4096):
            own = np.zeros((len(parts[k : k + 4096]), len(self.entries)), np.int64)
            for j in range(parts.shape[1]):
                own += (parts[k : k + 4096, j : j + 1] - self.entries[None, :, j]) ** 2
            rows, best = np.arange(len(own)), own.argmin(1)  # the first of equal ones
            upper[k : k + 4096] = _root(own[rows, best], True)
            own[rows, best] = np.iinfo(np.int64).max // 4
            code[k : k + 4096] = best
            lower[k : k + 4096] = _root(own.min(1), False) if len(self.entries) > 1 else 1 << 60
        return code, upper, lower

    def error(self, parts: np.ndarray, code: np.ndarray) -> np.ndarray:
        return ((parts - self.entries[code]) ** 2).sum(1)

    def assign(self, parts: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same as search after the entries moved, and which parts were searched in full."""
        upper, lower = upper + self.moved[code], np.maximum(lower - self.most[code], 0)
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.half[code]))
        upper[open_] = _root(self.error(parts[open_], code[open_]), True)
        open_ = open_[upper[open_] >= np.maximum(lower[open_], self.half[code[open_]])]
        code = code.copy()
        code[open_], upper[open_], lower[open_] = self.search(parts[open_])
        return code, upper, lower, open_


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is usable, with it as integers, ``ints``."""
    usable = F.col(column).isNotNull() & ~F.coalesce(F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST)), F.lit(False))
    whole = F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return vectors.drop("ints", *STATE).where(usable).withColumn("ints", whole)


def _matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).astype(np.int64)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, width, dtype=np.int32), pa.array(values.ravel(), kind))


def assigned(state: DataFrame, books: list[np.ndarray], before: list[np.ndarray] | None, ends: list[int]) -> DataFrame:
    """state with new part_code, upper, lower, and error and scans (parts searched in full)."""
    made = [Codebook(b, None if before is None else before[k]) for k, b in enumerate(books)]
    shared = state.sparkSession.sparkContext.broadcast(made)
    fields = [f for f in state.schema if f.name not in (*STATE, "error", "scans")]
    made_types = [*(T.ArrayType(t) for t in (T.IntegerType(), T.LongType(), T.LongType())), T.LongType(), T.IntegerType()]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in zip([*STATE, "error", "scans"], made_types, strict=True))])
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = _matrix(batch, "ints", ends[-1])
            code, upper, lower = (np.zeros((batch.num_rows, parts), np.int64) for _ in range(3))
            error, scans = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            if before is not None:
                was = [_matrix(batch, name, parts) for name in STATE]
            for k, book in enumerate(shared.value):
                own = ints[:, ends[k] : ends[k + 1]]
                if before is None:
                    code[:, k], upper[:, k], lower[:, k] = book.search(own)
                    scans += 1
                else:
                    code[:, k], upper[:, k], lower[:, k], searched = book.assign(own, *(w[:, k] for w in was))
                    scans[searched] += 1
                error += book.error(own, code[:, k])
            arrays = [batch.column(f.name) for f in fields]
            arrays += [_lists(code, pa.int32()), _lists(upper, pa.int64()), _lists(lower, pa.int64()), pa.array(error), pa.array(scans)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return state.mapInArrow(run, schema)


def moved(state: DataFrame, books: list[np.ndarray], ends: list[int]) -> list[np.ndarray]:
    """The codebooks with each entry at the floor of its parts' mean."""
    parts, entries, width = len(books), len(books[0]), ends[-1]
    part_of = np.repeat(np.arange(parts), np.diff(ends))  # of each component

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(entries * width, np.int64), np.zeros(entries * parts, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ints, code = _matrix(batch, "ints", width), _matrix(batch, "part_code", parts)
            np.add.at(sums, (code[:, part_of] * width + np.arange(width)).ravel(), ints.ravel())
            np.add.at(counts, (code * parts + np.arange(parts)).ravel(), 1)
        place = np.flatnonzero(np.concatenate([sums, counts]))
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(np.concatenate([sums, counts])[place])], ["place", "total"])

    total = np.zeros(entries * (width + parts), dtype=object)
    totals = state.select("ints", "part_code").mapInArrow(run, "place int, total long").groupBy("place").agg(F.sum("total").alias("total"))
    for r in totals.toLocalIterator():  # entries * (width + parts) rows at most
        total[r["place"]] = r["total"]
    sums, counts = total[: entries * width].reshape(entries, width), total[entries * width :].reshape(entries, parts)
    return [
        np.array([[s // counts[e, k] if counts[e, k] else int(b) for s, b in zip(sums[e, ends[k] : ends[k + 1]], book[e], strict=True)] for e in range(entries)], np.int64).reshape(book.shape)
        for k, book in enumerate(books)
    ]


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(usable rows with code, codes, error and scans; codebooks: an array of entries a part)."""
    vectors = vectors.drop(*(c for c in ADDED if c not in (column, id_column)))
    rows = kept(vectors, column)
    first = rows.orderBy(F.col(id_column).asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    if not first or not first[0]["ints"]:
        empty = {"code": F.lit(None).cast("string"), "codes": F.lit(None).cast("array<int>"), "error": F.lit(None).cast("long"), "scans": F.lit(None).cast("int")}
        return rows.drop("ints").withColumns(empty), []
    ends = bounds_of(len(first[0]["ints"]), parts)
    fits = F.size("ints") == ends[-1]
    whole = np.array([r["ints"] for r in first if len(r["ints"]) == ends[-1]], np.int64)
    books = [whole[:, a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    before, scans = None, F.lit(0)
    state = rows.where(fits)
    for _ in range(rounds):
        state = tables.stored(assigned(state.withColumn("scanned", scans), books, before, ends))
        before, books = books, moved(state, books, ends)
        scans = F.col("scanned") + F.col("scans")
    last = assigned(state.withColumn("scanned", scans), books, before, ends)
    digits = max(2, (entries - 1).bit_length() + 3 >> 2)
    hexed = F.transform("part_code", lambda c: F.lpad(F.lower(F.hex(c)), digits, "0"))
    out = last.withColumns({"code": F.concat_ws("", hexed), "codes": F.col("part_code"), "scans": F.col("scanned") + F.col("scans")})
    names = [*vectors.columns, "code", "codes", "error", "scans"]
    other = rows.where(~fits).withColumns({"code": F.lit(None).cast("string"), "codes": F.lit(None).cast("array<int>"), "error": F.lit(None).cast("long"), "scans": F.lit(0)})
    return out.select(*names).unionByName(other.select(*names)), books


def with_group_sum(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value over equal by (nulls are equal) as name: summed in tasks first, then joined back."""
    sums = tables.stored(rows.groupBy(F.col(by).alias("_by")).agg(F.sum(value).alias(name)))
    few = sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    return rows.join(F.broadcast(sums) if few else sums, rows[by].eqNullSafe(sums["_by"])).drop("_by")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector with its code, its error and its label's."""
    rows, books = compress(tables.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = with_group_sum(tables.stored(rows.select("vec_id", "label", "code", "error")), "label", "error", "label_error")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
