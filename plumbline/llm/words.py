"""Words of texts as numpy arrays: byte spans and 64-bit hashes, without a Python object per word.

Texts are UTF-8 bytes.  A word is a maximal run of word bytes; bytes above 0x7F always belong to a
word, so no character is cut.  Hashes are polynomials modulo 2**64 over per-byte random values,
mixed at the end; callers that need exactness compare the bytes themselves afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
PIECE = 1 << 16  # bytes hashed at once: keeps the working arrays in cache


class WordKind:
    """Which bytes make words, and whether A-Z count as a-z."""

    def __init__(self, separators: bytes, lower: bool) -> None:
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        values = np.random.default_rng(20_240_501).integers(1, 2**63, 256, dtype=np.uint64)
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32
        self.values = values[self.fold]
        self.values[~self.is_word] = 0


#: Words [^\x20\x09-\x0D]+, unchanged.
PLAIN = WordKind(bytes([0x20, *range(0x09, 0x0E)]), lower=False)
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: ASCII letters, digits, and all beyond ASCII.
ALNUM = WordKind(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 17), base, U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        if n <= 1 << 20:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Words:
    """The words of some texts: starts and ends in buf, hashes, and first[i]:first[i+1] for text i."""

    def __init__(self, texts: list[bytes | None], kind: WordKind, hashed: bool = True) -> None:
        lens = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        self.buf = b"\n".join(t or b"" for t in texts) + b"\n"
        data = np.frombuffer(self.buf, np.uint8)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = kind.is_word[data]
        change = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = change[0::2], change[1::2]
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lens + 1, out=at[1:])
        self.first = np.searchsorted(self.starts, at)
        self.text_at = at
        self.hashes = _hashed(data, self.starts, self.ends, kind) if hashed else None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts_of(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: WordKind) -> np.ndarray:
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        n = int(ends[j - 1]) - base
        sums = np.zeros(n + 1, U64)
        np.cumsum(kind.values[data[base : base + n]] * powers(_BASE, n), out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * powers(_INV, n)[s] + (e - s).astype(U64)
        i = j
    return mix(out)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive words that start at each place; len(hashes)-n+1 of them."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = np.zeros(m, U64)
    for k in range(n):
        out *= U64(_BASE)
        out += hashes[k : k + m]
    return mix(out)


def grams_within(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie within one text, and the index of each one's first word."""
    all_of = gram_hashes(words.hashes, n)
    counts = np.maximum(words.counts - n + 1, 0)
    at = ranges(words.first[:-1], counts)
    return all_of[at] if len(at) else np.empty(0, U64), at


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... counts[i] of them, for all i in turn."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def by_bytes(batches: Iterator, column: str, limit: int = 4 << 20) -> Iterator:
    """Arrow record batches cut into slices with at most limit bytes of the column (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
