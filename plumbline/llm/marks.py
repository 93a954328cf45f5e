"""A filter of fixed size over 64-bit keys of a table: two bits a key, built in chunks by many tasks.

It never misses a key that it was built from; as it fills, it lets more of the others pass, and its
size stays the same.  What passes is to be joined exactly afterwards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, mix

BITS = 1 << 27
CHUNK = 1 << 21


def _places(keys: np.ndarray, size: int = BITS) -> np.ndarray:
    h = mix(keys.astype(U64) ^ U64(0xD6E8FEB86659FD93))
    return np.stack([h & U64(size - 1), (h >> U64(32)) & U64(size - 1)]).astype(np.int64)


def build(keys: DataFrame, column: str, size: int = BITS) -> np.ndarray:
    """The filter as bits, so many as size, a power of two and CHUNK at least: 16 MB where it is not given."""

    def chunk(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(CHUNK, np.uint8)
        bits[group["bit"].to_numpy()] = 1
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy().view(U64), size))
            yield pa.RecordBatch.from_arrays([pa.array((at // CHUNK).astype(np.int32)), pa.array((at % CHUNK).astype(np.int32))], ["chunk", "bit"])

    out = np.zeros(size // 8, np.uint8)
    spread_out = keys.select(F.col(column).cast("long")).mapInArrow(spread, "chunk int, bit int")
    for r in spread_out.groupBy("chunk").applyInPandas(chunk, "chunk int, bits binary").toLocalIterator():  # size / CHUNK rows
        out[r["chunk"] * (CHUNK // 8) : (r["chunk"] + 1) * (CHUNK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def passing(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _places(keys, 8 * len(marks))
    return ((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(0)
