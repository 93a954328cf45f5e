"""Token ids in directly addressable codes.

Ids are cut into 8-bit chunks by level.  Level 0 holds the low chunk of every id; a continuation bitmap
tells which ids go on, and those alone have a chunk in the next level, in the same order.  A rank
directory counts the set bits before every 512th, so the place of id i in the next level is the rank of
bit i: any token is read with a few steps and without decoding others.

A file is a row (part, seq, n_docs, n_tokens, file) of a table in the shared folder, in the store that
Spark writes to, whatever it is.  Files follow each other by part and seq in ascending doc_id order;
each holds whole documents and the doc_ids themselves.

Encoding keeps ids by stretches of text between single spaces or line ends, which byte-level BPE of this kind never
joins, so the tokenizer sees a frequent stretch once; the memory has a fixed size and, when full, forgets
those seen least.  Strings of special tokens in a text become those tokens, as the library has it by default; a text
with one is encoded whole.  ``ordinary=True`` takes them for text.

Null texts count as empty and give the end id alone; null doc_ids come first; repeated rows are
documents of their own, in any order among themselves; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables
from .words import by_bytes, mix, ranges

END = 0
RANK_BITS = 512
FILE_TOKENS = 1 << 18
MEMORY = 1_500_000
MAGIC = b"DAC1"

# The pieces that byte-level BPE of this kind cuts ASCII text into, and how it writes their bytes.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_WRITTEN = {b: 256 + b for b in range(33)} | {127: 289}

# The same for many stretches at once.  Bytes are letters, numbers, others, line ends or, where pieces are not runs of one of these, ODD.
LETTER, NUMBER, OTHER, LINE, ODD = range(5)
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_UNITS = np.zeros(256, "<u2")
_UNITS[_SELF] = _SELF
_UNITS[_UNITS == 0] = 256 + np.arange(256 - len(_SELF))
_KIND = np.full(256, ODD, np.uint8)
_KIND[33:128] = OTHER
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]], _KIND[0x30:0x3A], _KIND[0x0A], _KIND[0x27] = LETTER, NUMBER, LINE, ODD
# U+00A1 to U+027F, by the last bits of the first byte and those of the second
_PAIR = np.full(0x280, LETTER, np.uint8)
_PAIR[:0xA1], _PAIR[0xA1:0xC0], _PAIR[[0xD7, 0xF7]] = ODD, OTHER, OTHER
_PAIR[[0xAA, 0xB5, 0xBA]], _PAIR[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = LETTER, NUMBER
MERGED = 1 << 18  # characters given to the library at once

_EDGE = np.zeros(256, bool)
_EDGE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


def stretches(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, counts): the texts cut at single spaces and line ends between characters that are no white space.

    Where a neighbour may be white space beyond ASCII there is no cut: a longer stretch is still right."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = b"\n" * 8 + b"\n".join(texts) + b"\n" * 8
    data = np.frombuffer(buf, np.uint8)
    at = 8 + np.cumsum(lens + 1) - (lens + 1)
    cut = (data == 0x20) | (data == 0x0A)
    cut[at - 1] = cut[:8] = cut[-8:] = False  # between texts
    cuts = np.flatnonzero(cut)
    left, right = data[cuts - 1], data[cuts + 1]
    cuts, high = (x[~(_EDGE[left] | _EDGE[right])] for x in (cuts, (left >= 0x80) | (right >= 0x80)))
    far = cuts[high]
    if len(far):

        def wide(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
            """Whether bytes may open U+0085, U+00A0, U+1680, U+2000-205F or U+3000."""
            return ((two == 0xC2) & ((three == 0x85) | (three == 0xA0))) | ((one == 0xE1) & (two == 0x9A)) | ((one == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((one == 0xE3) & (two == 0x80))

        before = wide(data[far - 3], data[far - 2], data[far - 1])
        behind = wide(data[far + 1], data[far + 2], data[far + 3]) | wide(data[far], data[far + 1], data[far + 2])
        high[high] = before | behind
        cuts = cuts[~high]
    counts = 1 + np.bincount(np.searchsorted(at, cuts, "right") - 1, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    heads = np.zeros(int(counts.sum()), bool)
    heads[np.cumsum(counts) - counts] = True
    starts = np.empty(len(heads), np.int64)
    starts[heads], starts[~heads] = at, cuts + 1
    tails = np.zeros(len(heads), bool)
    tails[np.cumsum(counts) - 1] = True
    ends = np.empty(len(heads), np.int64)
    ends[tails], ends[~tails] = at + lens, cuts
    return buf, starts, ends, counts


class Encoder:
    """Texts to ids of a byte-level BPE tokenizer file.

    A stretch of up to 16 bytes is known by its length and its first and last 8 bytes, exactly, so a batch is
    looked up in arrays; longer ones are kept in a dictionary.  What is new is cut into pieces, in arrays where these
    are plain runs and by the library's pre-tokenizer where they are beyond Latin, and merged by the library's model."""

    _held: dict[tuple, Encoder] = {}

    @classmethod
    def of(cls, path: str, ordinary: bool = False) -> Encoder:
        """One for each Python worker, kept from task to task."""
        if (path, ordinary) not in cls._held:
            cls._held[path, ordinary] = cls(path, ordinary)
        return cls._held[path, ordinary]

    def __init__(self, path: str, ordinary: bool = False) -> None:
        """ordinary: strings of special tokens are text like any other."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        pre = self.tokenizer.pre_tokenizer
        self.plain = isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None
        self.special = [] if ordinary else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.pre = self.tokenizer.model, pre
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        own = isinstance(self.model, models.BPE) and not (self.model.dropout or self.model.continuing_subword_prefix or self.model.end_of_word_suffix)
        self.runs = own and self.plain and all(chr(c) in vocab for c in _UNITS.tolist())
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # bytes of each token
        self.width[list(vocab.values())] = list(map(len, vocab))
        self.merger = Tokenizer(self.model)  # merges pieces that are given line by line
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.pieces: dict[str, list[int]] = {}
        self.long: dict[bytes, int] = {}
        self.keys = np.zeros((4, 0), np.uint64)  # hash (sorted), length, first and last bytes
        self.place = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.seen = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the stretches seen most: half of the memory at most."""
        keep = self.seen > max(1, int(np.partition(self.seen, -MEMORY // 2)[-MEMORY // 2]))
        moved, old = np.cumsum(keep) - 1, np.flatnonzero(keep)
        each = np.diff(self.at)[keep]
        self.ids = self.ids[ranges(self.at[old], each)]
        self.at = np.concatenate([[0], np.cumsum(each)])
        self.seen = self.seen[old] // 2
        known = keep[self.place]
        self.keys, self.place = self.keys[:, known], moved[self.place[known]]
        self.long = {s: int(moved[k]) for s, k in self.long.items() if keep[k]}
        self.pieces.clear()

    def _ids(self, text: str) -> list[int]:
        if not text.isascii():
            pieces = [p for p, _ in self.pre.pre_tokenize_str(text)]
        elif text[text[:1] == " " :].isalpha():
            return [t.id for t in self.model.tokenize(text.translate(_WRITTEN))]
        else:
            pieces = [p.translate(_WRITTEN) for p in _PIECES.findall(text)]
        out: list[int] = []
        for piece in pieces:
            known = self.pieces.get(piece)
            if known is None:
                known = self.pieces[piece] = [t.id for t in self.model.tokenize(piece)]
            out += known
        return out

    def _merged(self, byte: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, ids, counts): those of the stretches, of so many bytes each, whose pieces are plain runs, and their ids."""
        own = np.cumsum(size) - size
        kind = _KIND[byte]
        pair = np.flatnonzero((byte >= 0xC2) & (byte <= 0xC9))
        kind[pair] = kind[pair + 1] = _PAIR[((byte[pair] & 31).astype(np.int64) << 6) | (byte[pair + 1] & 63)]
        spaced = own[size > 1]
        spaced = spaced[byte[spaced] == 0x20]
        kind[spaced] = np.where(kind[spaced + 1] == LINE, ODD, kind[spaced + 1])
        lines = kind == LINE
        kind[1:][lines[1:] & lines[:-1]] = ODD
        which = np.ones(len(size), bool)
        which[np.searchsorted(own, np.flatnonzero(kind == ODD), "right") - 1] = False
        use, each = np.repeat(which, size), size[which]
        byte, kind, to = byte[use], kind[use], np.cumsum(each)
        if not self.runs or not len(byte):
            return np.zeros(len(size), bool), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        head = np.ones(len(byte), bool)
        head[1:] = kind[1:] != kind[:-1]
        head[(to - each)[each > 0]] = True
        units = np.full(len(byte) + int(head.sum()), 10, "<u2")
        units[np.arange(len(byte)) + np.cumsum(head)] = _UNITS[byte]
        text, ids, at = units.tobytes().decode("utf-16-le"), [], 0
        while at < len(text):
            end = text.find("\n", at + MERGED)
            end = len(text) if end < 0 else end
            ids.append(np.array(self.merger.encode_batch_fast([text[at:end]], add_special_tokens=False)[0].ids, np.uint32))
            at = end
        found = np.concatenate(ids)
        ends = np.concatenate([[0], np.cumsum(self.width[found])])
        last = np.searchsorted(ends, to)
        if ends[-1] != len(byte) or (ends[last] != to).any():
            raise ValueError("the tokens of a byte-level tokenizer do not add up to its text")
        return which, found, np.diff(last, prepend=0)

    def _learn(self, buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of new stretches."""
        size = ends - starts
        which, ids, counts = self._merged(np.frombuffer(buf, np.uint8)[ranges(starts, size)], size)
        rest = np.flatnonzero(~which)
        got = [self._ids(buf[a:b].decode()) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        each = np.zeros(len(size), np.int64)
        each[which], each[rest] = counts, np.fromiter(map(len, got), np.int64, len(got))
        at = self.at[-1] + np.concatenate([[0], np.cumsum(each)])
        learnt = np.empty(int(each.sum()), np.uint32)
        learnt[ranges(at[:-1][which] - at[0], counts)] = ids
        learnt[ranges(at[rest] - at[0], each[rest])] = np.fromiter((i for g in got for i in g), np.uint32, int(each[rest].sum()))
        first = len(self.at) - 1
        self.at = np.concatenate([self.at, at[1:]])
        self.ids = np.concatenate([self.ids, learnt])
        self.seen = np.concatenate([self.seen, np.zeros(len(size), np.int64)])
        return np.arange(first, first + len(size))

    def _places(self, buf: bytes, starts: np.ndarray, ends: np.ndarray, head: np.ndarray) -> np.ndarray:
        size = (ends - starts).astype(np.uint64)
        view = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        first = view[starts] & ~np.where(size < 8, np.uint64(2**64 - 1) << (np.minimum(size, np.uint64(7)) * np.uint64(8)), np.uint64(0))
        last = np.where(size > 8, view[np.maximum(ends - 8, 0)], np.uint64(0))
        before = np.where(head, 0, np.frombuffer(buf, np.uint8)[starts - 1]).astype(np.uint64)
        length = size + (before << np.uint64(32))
        key = mix(first ^ mix(last + length))
        short = size <= 16
        out = np.full(len(starts), -1)
        begins = starts - ~head  # with the space or line end before

        own = np.flatnonzero(short)
        found, where, back = np.unique(key[own], return_index=True, return_inverse=True)
        facts = np.stack([key, length, first, last])
        rep = own[where]
        same = (facts[1:, own] == facts[1:, rep[back]]).all(0)
        at = np.minimum(np.searchsorted(self.keys[0], found), max(0, self.keys.shape[1] - 1))
        hit = (self.keys[:, at] == facts[:, rep]).all(0) if self.keys.shape[1] else np.zeros(len(found), bool)
        places = np.full(len(found), -1)
        places[hit] = self.place[at[hit]]
        taken = (self.keys[0, at] == found) & ~hit if self.keys.shape[1] else np.zeros(len(found), bool)
        new = np.flatnonzero(~hit & ~taken)
        if len(new):
            places[new] = self._learn(buf, begins[rep[new]], ends[rep[new]])
            spot = np.searchsorted(self.keys[0], found[new])
            self.keys = np.insert(self.keys, spot, facts[:, rep[new]], axis=1)
            self.place = np.insert(self.place, spot, places[new])
        out[own] = np.where(same, places[back], -1)
        # longer stretches, and any whose hash belongs to another
        rest = np.flatnonzero(out < 0)
        names = [buf[a:b] for a, b in zip(begins[rest].tolist(), ends[rest].tolist(), strict=True)]
        if fresh := {n: k for n, k in zip(names, rest.tolist(), strict=True) if n not in self.long}:
            own = np.fromiter(fresh.values(), np.int64, len(fresh))
            self.long |= zip(fresh, self._learn(buf, begins[own], ends[own]).tolist(), strict=True)
        out[rest] = [self.long[n] for n in names]
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each)"""
        whole = {k: self.tokenizer.encode(t.decode(), add_special_tokens=False).ids for k, t in enumerate(texts) if not self.plain or any(s in t for s in self.special)}
        if whole:
            texts = [b"" if k in whole else t for k, t in enumerate(texts)]
        if len(self.seen) > MEMORY:
            self.forget()
        buf, starts, ends, counts = stretches(texts)
        head = np.zeros(len(starts), bool)
        head[np.cumsum(counts) - counts] = True
        which = self._places(buf, starts, ends, head)
        self.seen += np.bincount(which, minlength=len(self.seen))
        each = self.at[which + 1] - self.at[which]
        out = self.ids[ranges(self.at[which], each)]
        total = np.concatenate([[0], np.cumsum(each)])
        last = np.cumsum(counts)
        n = total[last] - total[last - counts]
        for k in sorted(whole, reverse=True):  # their place is empty so far
            out = np.insert(out, int(n[:k].sum()), whole[k])
        for k, ids in whole.items():
            n[k] = len(ids)
        return out, n


# ---- the file format


def _bitmap(on: np.ndarray) -> tuple[bytes, bytes]:
    bits = np.packbits(on, bitorder="little")
    padded = np.zeros(-(-len(on) // RANK_BITS) * (RANK_BITS // 8), np.uint8)
    padded[: len(bits)] = bits
    per = np.bitwise_count(padded.reshape(-1, RANK_BITS // 8)).sum(1, dtype=np.int64)
    return padded.tobytes(), (np.cumsum(per) - per).astype("<u4").tobytes()


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: header, doc_ids, counts, then for every level its chunks, bitmap and rank directory."""
    levels, left = [], ids.astype(np.uint32)
    while True:
        rest = left >> np.uint32(8)
        more = rest > 0
        levels.append(((left & np.uint32(255)).astype(np.uint8).tobytes(), *_bitmap(more)))
        left = rest[more]
        if not len(left):
            break
    known = np.array([d is not None for d in doc_ids], np.uint8)
    out = [MAGIC, struct.pack("<QQI", len(doc_ids), len(ids), len(levels)), known.tobytes()]
    out += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.asarray(counts, "<u8").tobytes()]
    for level in levels:
        for part in level:
            out += [struct.pack("<Q", len(part)), part]
    return b"".join(out)


class TokenFile:
    """Reads a file made by pack()."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        docs, self.n_tokens, levels = struct.unpack_from("<QQI", data, 4)
        at = 24
        known = np.frombuffer(data, np.uint8, docs, at)
        ids = np.frombuffer(data, "<i8", docs, at + docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.counts = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        at += 17 * docs
        self.levels = []
        for _ in range(levels):
            parts = []
            for kind in (np.uint8, np.uint8, "<u4"):
                (n,) = struct.unpack_from("<Q", data, at)
                parts.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at + 8))
                at += 8 + n
            self.levels.append(parts)

    def tokens(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, by rank alone."""
        at = np.asarray(places, np.int64)
        out, live = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, bits, directory) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            live, at = live[on], at[on]
            if not len(at):
                break
            block = at // RANK_BITS
            row = bits.reshape(-1, RANK_BITS // 8)[block]
            byte = (at % RANK_BITS) >> 3
            whole = np.where(np.arange(RANK_BITS // 8) < byte[:, None], np.bitwise_count(row), 0).sum(1, dtype=np.int64)
            last = row[np.arange(len(at)), byte] & ((1 << (at & 7)) - 1).astype(np.uint8)
            at = directory[block].astype(np.int64) + whole + np.bitwise_count(last).astype(np.int64)
        return out

    def all(self) -> np.ndarray:
        """All ids in turn: each level's chunks go to the places whose bits are set."""
        out, at = np.zeros(self.n_tokens, np.uint32), None
        for level, (chunks, bits, _) in enumerate(self.levels):
            value = chunks.astype(np.uint32) << np.uint32(8 * level)
            if at is None:
                out[:] = value
            else:
                out[at] |= value
            on = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
            at = np.flatnonzero(on) if at is None else at[on]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(np.arange(self.starts[k], self.starts[k] + self.counts[k]))


# ---- tables of files


def write(docs: DataFrame, tokenizer: str, end: int = END, ordinary: bool = False) -> DataFrame:
    """Files of all texts in ascending doc_id order, stored: (part, seq, n_docs, n_tokens, file)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = Encoder.of(tokenizer, ordinary)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def file() -> pa.RecordBatch:
            docs = [d for x in held for d in x[0]]
            counts, ids = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            made = pack(docs, counts, ids)
            columns = [pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int32()), (len(docs), pa.int64()), (len(ids), pa.int64()), (made, pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_docs", "n_tokens", "file"])

        for batch in by_bytes(batches, "text", 4 << 20):
            ids, counts = encoder.encode([t or b"" for t in batch.column("text").to_pylist()])
            ids = np.insert(ids, np.cumsum(counts), end)
            held.append((batch.column("doc_id").to_pylist(), counts + 1, ids))
            if sum(len(x[2]) for x in held) >= FILE_TOKENS:
                yield file()
                held, seq = [], seq + 1
        if held:
            yield file()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    ordered = ordered.repartitionByRange(tables.parts(ordered), "doc_id").sortWithinPartitions("doc_id")
    return tables.stored(ordered.mapInArrow(encode, "part int, seq int, n_docs long, n_tokens long, file binary"))


def starts(files: DataFrame) -> DataFrame:
    """(part, seq, before): the ids in all files before each one."""
    sizes = files.select("part", "seq", "n_tokens")
    so_far = Window.rowsBetween(Window.unboundedPreceding, -1)
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    by_part = by_part.select("part", F.coalesce(F.sum("n").over(so_far.orderBy("part")), F.lit(0)).alias("parts_before"))
    own = F.coalesce(F.sum("n_tokens").over(so_far.partitionBy("part").orderBy("seq")), F.lit(0))
    return sizes.select("part", "seq", own.alias("own")).join(by_part, "part").select("part", "seq", (F.col("parts_before") + F.col("own")).alias("before"))


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                file = TokenFile(data)
                raw = file.all().astype("<u4").view(np.uint8)
                crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(file.starts.tolist(), file.counts.tolist(), strict=True)]
                columns = [pa.array(file.doc_ids, pa.int64()), pa.array(file.starts + before), pa.array(file.counts), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = tables.stored(starts(files))
    if before.count() <= 500_000:  # a row for some 260,000 tokens: 12 MB at most
        before = F.broadcast(before)
    return files.join(before, ["part", "seq"]).select("file", "before").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and crc32 of ids, read back from files of all whole texts."""
    import public_tokenizers

    return read(write(tables.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
