"""TIFF pages in a binary column: a reader and a writer in numpy.

The reader walks the chain of image directories in either byte order, decodes stored, PackBits, LZW and
deflate strips and tiles, undoes horizontal differencing and gives one row per page.  Samples of 1, 8 or 16
bits, chunky or planar; those of 1 bit come as a byte each, 0 or 1, as stored.  The writer lays any bytes out as 8-bit RGB pages 64 pixels wide, in strips or
tiles, with the same codings.

A value that is null, empty or no TIFF gives one row with the reason in ``error`` and no page, so no
row of the input vanishes; a page that cannot be decoded gives its row with ``error``, and the others
stand, but for those after a directory whose link cannot be read.  Directory loops end the walk.  Equal bytes give equal pages; other columns are carried along;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables
from .words import by_bytes

# Fixed values of the format: tags, codings, field types.
WIDTH, HEIGHT, BITS, CODING, PHOTO = 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 317, 322, 323, 324, 325
STORED, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELDS = {1: "B", 3: "H", 4: "I"}

ROW = 192  # bytes: 64 pixels of three samples
PAGE_ROWS = 1024
STRIP = 64
TILE = 16
CODINGS = (PACKBITS, LZW, DEFLATE)


# ---- codings


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, got = [], 0, 0
    while i < len(data) and got < size:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
            got += n + 1
        elif n > 128:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
            got += 257 - n
        else:
            i += 1
    return b"".join(out)


def _packbits_row(row: bytes) -> bytes:
    out, i, n = [], 0, len(row)
    literal = 0
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and row[j] == row[i]:
            j += 1
        if j - i < 3 and i < n:
            i = j
            if i - literal < 126 and i < n:
                continue
            run = b""
        else:
            run = bytes((257 - (j - i), row[i]))
        end = i
        while literal < end:
            k = min(128, end - literal)
            out += [bytes((k - 1,)), row[literal : literal + k]]
            literal += k
        if run:
            out.append(run)
            i = literal = j
    return b"".join(out)


def packbits_encode(data: bytes, row: int) -> bytes:
    """Rows are packed each on its own, as the format asks for."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, row)
    same = rows[:, 1:] == rows[:, :-1]
    plain = ~(same[:, 1:] & same[:, :-1]).any(1)
    heads = [(at, min(128, row - at)) for at in range(0, row, 128)]
    pieces = [x for at, n in heads for x in (np.full((len(rows), 1), n - 1, np.uint8), rows[:, at : at + n])]
    literal = np.concatenate(pieces, axis=1)
    if plain.all():
        return literal.tobytes()
    return b"".join(literal[k].tobytes() if ok else _packbits_row(rows[k].tobytes()) for k, ok in enumerate(plain.tolist()))


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, one code early; 256 clears and 257 ends."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, last = list(base), [], b""
    width, held, have = 9, 0, 0
    for byte in data:
        held = held << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = held >> have
        held &= (1 << have) - 1
        if code < 256 or code > 257:
            if not last:
                last = table[code]
                out.append(last)
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            if code > len(table):
                raise ValueError("LZW code beyond the table")
            table.append(last + entry[:1])
            out.append(entry)
            last = entry
            n = len(table)
            if n >= 511:
                width = 12 if n >= 2047 else 11 if n >= 1023 else 10
        elif code == 256:
            table, width, last = list(base), 9, b""
        else:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out: list[tuple[int, int]] = [(256, 9)]
    table: dict[int, int] = {}
    following, width, now = 258, 9, -1
    for byte in data:
        if now < 0:
            now = byte
            continue
        key = now << 8 | byte
        code = table.get(key)
        if code is not None:
            now = code
            continue
        out.append((now, width))
        table[key] = following
        following += 1
        now = byte
        if following >= 512:
            if following == 4094:
                out.append((256, 12))
                table, following, width = {}, 258, 9
            else:
                width = 12 if following >= 2048 else 11 if following >= 1024 else 10
    if now >= 0:
        out.append((now, width))
        following += 1
        if following >= 512:
            width = 12 if following >= 2048 else 11 if following >= 1024 else 10
    out.append((257, width))
    codes, widths = np.array(out, np.int64).T
    # 12 bits a code, of which the last `width` are kept
    bits = (codes[:, None] >> np.arange(11, -1, -1)) & 1
    return np.packbits(bits[np.arange(11, -1, -1) < widths[:, None]].astype(np.uint8)).tobytes()


def _decoded(coding: int, data: bytes, size: int) -> bytes:
    if coding == STORED:
        return data
    if coding == PACKBITS:
        return packbits_decode(data, size)
    if coding == LZW:
        return lzw_decode(data)
    if coding in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"coding {coding}")


def _encoded(coding: int, data: bytes, row: int) -> bytes:
    if coding == PACKBITS:
        return packbits_encode(data, row)
    return lzw_encode(data) if coding == LZW else zlib.compress(data, 1) if coding == DEFLATE else data


# ---- reading


@dataclass
class Page:
    index: int
    width: int = 0
    height: int = 0
    samples: int = 0
    bits: int = 0
    coding: int = 0
    pixels: bytes = b""
    error: str | None = None


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags = {}
    for k in range(n):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, entry)
        if kind not in FIELDS:
            continue
        need = count * struct.calcsize(FIELDS[kind])
        place = entry + 8 if need <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
        tags[tag] = struct.unpack_from(f"{order}{count}{FIELDS[kind]}", data, place)
    return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _pixels(data: bytes, order: str, tags: dict, page: Page) -> bytes:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    page.width, page.height = one(WIDTH, 0), one(HEIGHT, 0)
    page.samples, page.bits, page.coding = one(SAMPLES, 1), one(BITS, 1), one(CODING, STORED)
    if page.bits not in (1, 8, 16):
        raise ValueError(f"{page.bits} bits a sample")
    kind = np.dtype(f"{order}u2" if page.bits == 16 else np.uint8)
    planes = page.samples if one(PLANAR, 1) == 2 else 1
    deep = page.samples // planes
    tiled = TILE_AT in tags
    across = one(TILE_WIDTH, 0) if tiled else page.width
    down = one(TILE_HEIGHT, 0) if tiled else min(one(STRIP_ROWS, page.height), page.height)
    where, sizes = (tags[TILE_AT], tags[TILE_BYTES]) if tiled else (tags[STRIP_AT], tags[STRIP_BYTES])
    wide, high = -(-page.width // across), -(-page.height // down)
    out = np.zeros((page.height, page.width, page.samples), kind)
    for k, (at, n) in enumerate(zip(where, sizes, strict=True)):
        plane, cell = divmod(k, wide * high)
        top, left = cell // wide * down, cell % wide * across
        rows = down if tiled else min(down, page.height - top)
        line = -(-across * deep * page.bits // 8)  # rows begin at whole bytes
        size = rows * line
        raw = _decoded(page.coding, data[at : at + n], size)
        if len(raw) < size:
            raise ValueError("short strip or tile")
        if page.bits == 1:
            block = np.unpackbits(np.frombuffer(raw, np.uint8, size).reshape(rows, line), axis=1, count=across * deep).reshape(rows, across, deep)
        else:
            block = np.frombuffer(raw, kind, rows * across * deep).reshape(rows, across, deep)
        if one(PREDICTOR, 1) == 2 and page.bits == 1:
            raise ValueError("predictor 2 over 1 bit a sample")
        elif one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        elif one(PREDICTOR, 1) != 1:
            raise ValueError(f"predictor {one(PREDICTOR, 1)}")
        part = out[top : top + rows, left : left + across, plane * deep : (plane + 1) * deep]
        part[:] = block[: part.shape[0], : part.shape[1]]
    return out.astype(kind.newbyteorder("=")).tobytes()


def read_pages(data: bytes | None) -> list[Page]:
    """All pages in the order of the directories."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]) if data else b"")
    if not order:
        return [Page(0, error="not a TIFF")]
    pages: list[Page] = []
    seen: set[int] = set()
    bad = (ValueError, KeyError, IndexError, ZeroDivisionError, struct.error, zlib.error)
    try:
        (at,) = struct.unpack_from(f"{order}I", data, 4)
    except bad as error:
        return [Page(0, error=f"{type(error).__name__}: {error}"[:200])]
    while at and at not in seen:
        seen.add(at)
        page, here, at = Page(len(pages)), at, 0
        pages.append(page)
        try:
            # the link first: a directory's own faults don't end the walk
            (n,) = struct.unpack_from(f"{order}H", data, here)
            (at,) = struct.unpack_from(f"{order}I", data, here + 2 + 12 * n)
            page.pixels = _pixels(data, order, _directory(data, order, here)[0], page)
        except bad as error:
            page.error = f"{type(error).__name__}: {error}"[:200]
    return pages or [Page(0, error="no directory")]


# ---- writing


def write_tiff(payload: bytes, coding: int, tiled: bool, predictor: bool) -> bytes:
    """payload: whole rows of 192 bytes.  Pages of at most 1024 rows."""
    if len(payload) % ROW or not payload:
        raise ValueError(f"payload must be a positive multiple of {ROW} bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    out, size = [b"II*\0", b""], 8
    patch = 1  # where in out the next directory's place goes
    for top in range(0, len(rows), PAGE_ROWS):
        image = rows[top : top + PAGE_ROWS]
        down = TILE if tiled else min(STRIP, len(image))
        where, sizes = [], []
        for at in range(0, len(image), down):
            block = image[at : at + down]
            if tiled and len(block) < down:
                block = np.concatenate([block, np.zeros((down - len(block), *block.shape[1:]), np.uint8)])
            if predictor:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            data = _encoded(coding, block.tobytes(), ROW)
            where.append(size)
            sizes.append(len(data))
            data += b"\0" * (len(data) % 2)
            out.append(data)
            size += len(data)
        tags = [(WIDTH, 4, [ROW // 3]), (HEIGHT, 4, [len(image)]), (BITS, 3, [8, 8, 8]), (CODING, 3, [coding]), (PHOTO, 3, [2])]
        if not tiled:
            tags.append((STRIP_AT, 4, where))
        tags.append((SAMPLES, 3, [3]))
        if not tiled:
            tags += [(STRIP_ROWS, 4, [down]), (STRIP_BYTES, 4, sizes)]
        tags.append((PLANAR, 3, [1]))
        if predictor:
            tags.append((PREDICTOR, 3, [2]))
        if tiled:
            tags += [(TILE_WIDTH, 4, [ROW // 3]), (TILE_HEIGHT, 4, [TILE]), (TILE_AT, 4, where), (TILE_BYTES, 4, sizes)]
        start = size
        beyond, own = start + 2 + 12 * len(tags) + 4, []
        more = b""
        for tag, kind, values in tags:
            raw = struct.pack(f"<{len(values)}{FIELDS[kind]}", *values)
            head = struct.pack("<HHI", tag, kind, len(values))
            if len(raw) <= 4:
                own.append(head + raw.ljust(4, b"\0"))
            else:
                own.append(head + struct.pack("<I", beyond + len(more)))
                more += raw + b"\0" * (len(raw) % 2)
        out[patch] = struct.pack("<I", start)
        out += [struct.pack("<H", len(tags)) + b"".join(own), struct.pack("<I", 0), more]
        patch = len(out) - 2
        size = beyond + len(more)
    return b"".join(out)


# ---- tables

PAGE_FIELDS = "page int, width int, height int, samples int, bits int, coding int, pixels binary, error string"


def pages(df: DataFrame, column: str = "media") -> DataFrame:
    """One row per page: the other columns of df, then page, width, height, samples, bits, coding, pixels, error."""
    added = T.StructType.fromDDL(PAGE_FIELDS)
    kept = [f for f in df.schema if f.name != column and f.name not in added.names]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, column):
            for k, data in enumerate(batch.column(column).to_pylist()):
                own = pa.array([k], pa.int64())
                for p in read_pages(data):
                    values = (p.index, p.width, p.height, p.samples, p.bits, p.coding, p.pixels, p.error)
                    kinds = (*[pa.int32()] * 6, pa.binary(), pa.string())
                    columns = [batch.column(f.name).take(own) for f in kept] + [pa.array([v], t) for v, t in zip(values, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + added.names)

    return df.select(*[f.name for f in kept], column).mapInArrow(walk, T.StructType([T.StructField(f.name, f.dataType) for f in [*kept, *added]]))


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + b" " * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def stored_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a TIFF.  The text's crc32 picks coding and layout, so
    equal texts have equal media and all codings see all kinds of text."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            media, sizes = [], []
            for text in batch.column("text").to_pylist():
                payload = payload_of(text)
                layout = zlib.crc32(payload) % 6
                coding = CODINGS[layout % 3]
                media.append(write_tiff(payload, coding, layout >= 3, coding == DEFLATE or layout == 4))
                sizes.append(len(text or b""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What is read back from each medium: digests of the payload and a line of figures of its samples."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in by_bytes(batches, "media"):
            columns: list[list] = [[] for _ in names[2:]]
            for data in batch.column("media").to_pylist():
                found = read_pages(data)
                payload = b"".join(p.pixels for p in found)
                samples = np.frombuffer(payload, np.uint8)
                share = np.bincount(samples >> 4, minlength=16) * 1000 // max(1, len(samples))
                mean = int(samples.sum(dtype=np.int64)) * 1000 // max(1, len(samples))
                said = f"pages={len(found)} coding={found[0].coding} mean={mean} sixteenths={'/'.join(map(str, share))}"
                errors = [p.error for p in found if p.error]
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), errors[0] if errors else said)
                for c, v in zip(columns, values, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    return media.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as a TIFF, read back, with digests and features."""
    return features(stored_texts(tables.read(spark, sf_dir, "documents")))
