"""Shards by a k-d tree over document metadata: DataFrame functions only.

Each node of the tree is cut along the widest of its dimensions (spans are compared after scaling
every dimension to its range over the whole table) at a weighted median: the place where the bytes
on either side stand as the leaves to be made there.  Medians are found over the distributed rows by
refining histograms of a 62-bit key: 20 bits of the dimension, 32 of the text's crc32, 10 of a hash of
doc_id.  A round sends the driver at most 2**11 sums a node for NODES nodes at a time, whatever the number of
rows; the tree itself, a number a leaf, is on the driver, so shards should be some thousands at most.  Refinement
ends as soon as a cut is as near as ``tolerance`` of a leaf, so equal texts (equal key but for the
last ten bits) stay in one leaf unless their group is heavier than that; such a hot group is cut by
its doc_id hashes.

Every dimension is a function of the text (its bytes, the share of multi-byte characters, its bytes a
space), so copies share their coordinates whatever their source says.

Null texts count as empty, empty texts weigh 1, ties fall to the text's crc32 and then to doc_id's
hash, repeated rows stay together, an empty table gives no rows, and other columns are carried along
or ignored.  Null doc_ids hash like any other value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

#: Right shifts that lay bare 10 or 11 more bits of the key in each round.
SHIFTS = (52, 42, 31, 20, 10, 0)
CELLS = 20
DIMENSIONS = ("bytes", "width", "words")
#: Rows a slot window takes at most, roughly.
SLOT_ROWS = 20_000
#: Nodes of a level that are cut by the same jobs.
NODES = 128


@dataclass
class Cut:
    """Inner node: rows whose key along dim is below `at` go left.  A leaf has no dim."""

    leaves: int
    first: int  # number of its leftmost leaf
    dim: int | None = None
    at: int = 0
    left: Cut | None = None
    right: Cut | None = None
    path: list = field(default_factory=list)  # (dim, at, goes right) from the root


def coordinates(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text)
    return [
        F.log2(size.cast("double") + 1),
        (size - F.length(text)) / F.greatest(size, F.lit(1)),
        F.log2((size + 1) / (size - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1)),
    ]


def size_of(column: str = "text") -> Column:
    """UTF-8 bytes of the text, plus 1."""
    return tables.text_bytes(column) + F.lit(1)


def crc_of(column: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(column), F.lit("")))


def _key(scaled: Column, crc: Column, hashed: Column) -> Column:
    cell = F.least(F.floor(scaled * F.lit(1 << CELLS)), F.lit((1 << CELLS) - 1)).cast("long")
    return F.shiftleft(cell, 42).bitwiseOR(F.shiftleft(crc, 10)).bitwiseOR(hashed)


@dataclass
class Tree:
    root: Cut
    low: list[float]
    high: list[float]

    def keys(self, docs: DataFrame) -> list[Column]:
        crc, hashed = crc_of(), F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 10))
        out = []
        for c, lo, hi in zip(coordinates(docs), self.low, self.high, strict=True):
            out.append(_key((c - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.0), crc, hashed))
        return out

    def shard(self, keys: list[Column]) -> Column:
        """The leaf of a row as one expression: no join, no shuffle."""

        def at(node: Cut) -> Column:
            if node.dim is None:
                return F.lit(node.first)
            return F.when(keys[node.dim] < F.lit(node.at), at(node.left)).otherwise(at(node.right))

        return at(self.root).cast("int")


def _within(node: Cut, keys: list[Column]) -> Column:
    out = F.lit(True)
    for dim, at, right in node.path:
        out = out & (keys[dim] >= F.lit(at) if right else keys[dim] < F.lit(at))
    return out


def _index(nodes: list[Cut], keys: list[Column]) -> Column:
    out = F.lit(None).cast("int")
    for i, node in reversed(list(enumerate(nodes))):
        out = F.when(_within(node, keys), F.lit(i)).otherwise(out)
    return out


def _cut(rows: DataFrame, keys: list[Column], level: list[Cut], slack: float) -> None:
    """Settles dimension and place of some nodes of a level together."""
    at_node = rows.withColumn("node", _index(level, keys)).where("node is not null")
    cells = [F.shiftright(k, 42) for k in keys]
    spans = {
        r["node"]: r
        for r in at_node.groupBy("node")
        .agg(
            F.sum("size").alias("size"),
            *[(F.max(c) - F.min(c)).alias(f"span{d}") for d, c in enumerate(cells)],
        )
        .collect()
    }
    state = []
    for i, node in enumerate(level):
        span = spans.get(i)
        node.dim = max(range(len(keys)), key=lambda d, s=span: (s[f"span{d}"] if s else 0, -d))
        goal = (span["size"] if span else 0) * (node.leaves // 2) / node.leaves
        state.append({"goal": goal, "below": 0, "prefix": 0, "open": bool(span)})
    before = 62
    for shift in SHIFTS:
        if not any(s["open"] for s in state):
            break
        at = F.lit(None).cast("long")
        inside = F.lit(False)
        for i, (node, s) in enumerate(zip(level, state, strict=True)):
            if s["open"]:
                here = F.col("node") == i
                at = F.when(here, F.shiftright(keys[node.dim], shift)).otherwise(at)
                inside = inside | (here & (F.shiftright(keys[node.dim], before) == F.lit(s["prefix"])))
        bins: dict[int, list] = {}
        for r in at_node.where(inside).groupBy("node", at.alias("bin")).agg(F.sum("size").alias("size")).collect():
            bins.setdefault(r["node"], []).append((r["bin"], r["size"]))
        for i, (node, s) in enumerate(zip(level, state, strict=True)):
            if not s["open"]:
                continue
            below = s["below"]
            for b, w in sorted(bins[i]):
                if below + w >= s["goal"]:
                    break
                below += w
            # either edge of the bin that the goal falls into is a possible cut
            if below + w - s["goal"] <= s["goal"] - below:
                node.at, off = (b + 1) << shift, below + w - s["goal"]
            else:
                node.at, off = b << shift, s["goal"] - below
            s |= {"below": below, "prefix": b, "open": off > slack}
        before = shift


def grow(rows: DataFrame, low: list[float], high: list[float], leaves: int, tolerance: float) -> Tree:
    """rows: size and k0, k1, ... by dimension.  Levels are grown together, so jobs go with the depth."""
    keys = [F.col(f"k{d}") for d in range(len(low))]
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / leaves
    root = Cut(leaves, 0)
    level = [root]
    while level := [n for n in level if n.leaves > 1]:
        for at in range(0, len(level), NODES):
            _cut(rows, keys, level[at : at + NODES], slack)
        following = []
        for node in level:
            half = node.leaves // 2
            node.left = Cut(half, node.first, path=[*node.path, (node.dim, node.at, False)])
            node.right = Cut(node.leaves - half, node.first + half, path=[*node.path, (node.dim, node.at, True)])
            following += [node.left, node.right]
        level = following
    return Tree(root, low, high)


def fit(docs: DataFrame, shards: int = 8, target_bytes: int | None = None, tolerance: float = 0.004) -> tuple[Tree, DataFrame]:
    """The tree over docs (doc_id, text), and its narrow stored rows: doc_id, size, text_crc32, k0, ...
    With target_bytes the number of leaves follows from the table's bytes."""
    coords = coordinates(docs)
    narrow = tables.stored(
        docs.select(
            "doc_id",
            size_of().alias("size"),
            crc_of().alias("text_crc32"),
            *[c.alias(f"c{d}") for d, c in enumerate(coords)],
        )
    )
    ends = narrow.agg(
        F.sum("size").alias("size"),
        *[f(f"c{d}").alias(f"{n}{d}") for d in range(len(coords)) for n, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    low = [ends[f"lo{d}"] or 0.0 for d in range(len(coords))]
    high = [ends[f"hi{d}"] or 0.0 for d in range(len(coords))]
    if target_bytes:
        shards = max(1, -(-(ends["size"] or 0) // target_bytes))
    hashed = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 10))
    keyed = narrow.select(
        "doc_id",
        "size",
        "text_crc32",
        *[
            _key(((F.col(f"c{d}") - F.lit(low[d])) / F.lit(high[d] - low[d])) if high[d] > low[d] else F.lit(0.0), F.col("text_crc32"), hashed).alias(f"k{d}")
            for d in range(len(coords))
        ],
    )
    return grow(keyed, low, high, shards, tolerance), keyed


def with_slots(sharded: DataFrame, rows: int) -> DataFrame:
    """A gapless slot from 0 in each shard: hash buckets are numbered on their own and set off by
    the counts of those before, so no task orders a whole shard."""
    buckets = max(1, rows // SLOT_ROWS)
    bucketed = sharded.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    offsets = bucketed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        bucketed.withColumn("own", F.row_number().over(own))
        .join(offsets, ["shard", "bucket"])
        .withColumn("slot", (F.col("before") + F.col("own") - 1).cast("long"))
    )


def assign(docs: DataFrame, shards: int = 8, target_bytes: int | None = None) -> DataFrame:
    """docs with a column shard; the texts stay where they are."""
    tree, _ = fit(docs, shards, target_bytes)
    return docs.withColumn("shard", tree.shard(tree.keys(docs)))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, crc32, shard 0 to 7 and slot; law `bytes`."""
    tree, narrow = fit(tables.read(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    sharded = narrow.withColumn("shard", tree.shard([F.col(f"k{d}") for d in range(len(tree.low))]))
    return with_slots(sharded, narrow.count()).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
