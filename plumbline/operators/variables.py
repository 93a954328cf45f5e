"""Variable impact: forward from a variable over reads_variable and then writes_variable edges.

Without a limit levels are as in trace: an operation expands only when first met, later reads of it are further facts;
a write to a variable already visited is a fact flagged as cycle; depth counts variables.  With a limit
the first so many operations and variables are kept in the order of a queue: variables as they were met, their reads by
edge id, and behind each new operation its writes by edge id.  The rest goes to the continuation.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import settled, settled_with
from . import bounds
from . import index as indexed


FACT = "edge string, `on` string, value string, cycle boolean"


@dataclass
class VariableImpact:
    start: str
    variables: DataFrame  # id, depth
    operations: DataFrame  # id, depth, via_edges
    facts: DataFrame  # edge, on, value, cycle
    continuation: DataFrame  # id
    depth_hit: bool
    limit_hit: bool = False


def walk_variable_impact(edges: DataFrame | None, start: str, depth: int = bounds.DEPTH, limit: int | None = None, nodes: DataFrame | None = None, index: indexed.GraphIndex | None = None) -> VariableImpact:
    """edges: id, type, src, dst, value; with an index they are its own, and so are the nodes.  Where nodes are known, the start must be one
    of type Variable or UnknownVariable."""
    bounds.check(depth, limit)
    edges, nodes = (index.out, index.nodes) if index else (edges, nodes)
    if nodes is not None:
        kind = nodes.where(F.col("id") == start).select("type").first()
        # fixed values: the words of these errors
        if kind is None:
            raise ValueError(f"variable not found: {start}")
        if kind["type"] not in ("Variable", "UnknownVariable"):
            raise ValueError("impact start must be a Variable or UnknownVariable")
    if small := _small(edges, start, depth, limit):
        return small
    if limit is not None:
        return _limited(edges, start, depth, limit)
    spark = edges.sparkSession
    reads, writes = (edges.where(F.col("type") == t).select("id", "src", "dst", "value") for t in ("reads_variable", "writes_variable"))
    frontier = spark.createDataFrame([(start,)], "v string")
    variables, operations, facts, more = [frontier.select(F.col("v").alias("id"), F.lit(0).alias("depth"))], [], [], []
    seen_v, seen_o, level, depth_hit, ahead_of = frontier, spark.createDataFrame([], "o string"), 0, False, 1
    while level <= depth:
        # the reads of the frontier; an operation's first one expands it
        met = indexed.at(reads, "src", frontier, "v", ahead_of).select("id", F.col("dst").alias("o"), "value")
        met = met.join(seen_o.withColumn("old", F.lit(True)), "o", "left").withColumn("first", F.min("id").over(Window.partitionBy("o")))
        met = met.withColumn("new", F.col("old").isNull() & (F.col("id") == F.col("first"))).drop("old", "first")
        met, counts = settled_with(met, {"all": F.lit(True), "new": F.col("new")})
        if not counts["all"]:
            break
        facts.append(met.select(F.col("id").alias("edge"), F.col("o").alias("on"), "value", F.lit(False).alias("cycle")))
        new = met.where("new").select("o")
        operations.append(new.select("o", F.lit(level).alias("depth")))
        seen_o = seen_o.union(new)
        out = indexed.at(writes, "src", new, "o", counts["new"]).select("id", "o", F.col("dst").alias("v"), "value")
        known = seen_v.select(F.col("v").alias("k"))
        out = out.join(known, F.col("v") == F.col("k"), "left").withColumn("first", F.min("id").over(Window.partitionBy("v")))
        out = out.withColumn("cycle", F.col("k").isNotNull() | ((F.col("id") > F.col("first")) & F.lit(level < depth)))
        out, counts = settled_with(out, {"ahead": ~F.col("cycle")})
        if level == depth:
            if counts["ahead"]:
                depth_hit = True
                more.append(out.where("NOT cycle").select(F.col("o").alias("id")).distinct())
            out = out.where("cycle")
        facts.append(out.select(F.col("id").alias("edge"), F.col("o").alias("on"), "value", "cycle"))
        level += 1
        frontier, ahead_of = out.where("NOT cycle").select("v"), counts["ahead"]
        variables.append(frontier.select(F.col("v").alias("id"), F.lit(level).alias("depth")))
        seen_v = seen_v.union(frontier)
        if level % 8 == 0:
            seen_v, seen_o = settled(seen_v), settled(seen_o)
    all_facts = reduce(DataFrame.unionByName, facts, spark.createDataFrame([], FACT))
    own = reduce(DataFrame.unionByName, operations, spark.createDataFrame([], "o string, depth int"))
    done = _with_reads(own, all_facts, reads)
    none = spark.createDataFrame([], "id string")
    return VariableImpact(start, reduce(DataFrame.unionByName, variables), done, all_facts, reduce(DataFrame.unionByName, more, none), depth_hit)


def _small(edges: DataFrame, start: str, depth: int, limit: int | None) -> VariableImpact | None:
    """The walk where the reads and writes of every level are held at once, or None where it grows.

    Under a limit what is met has the place of a queue: its variable's turn, the read, the write.  Without one the least id of a level comes first."""
    reads, writes = (edges.where(F.col("type") == t).select("id", "src", "dst", "value") for t in ("reads_variable", "writes_variable"))
    variables, operations, via, facts, more, depth_hit, cut = {start: 0}, {}, {}, [], [], False, None
    front, level = [start], 0
    while front and level <= depth and cut is None:
        met = indexed.held(reads, "src", front)
        if met is None or len(variables) + len(operations) > indexed.HELD:
            return None
        turn = dict(zip(front, range(len(front)) if limit is not None else [0] * len(front), strict=True))
        met = sorted((((turn[r["src"]], r["id"], ""), r) for r in met), key=lambda x: x[0])
        first: dict[str, tuple] = {}
        for place, r in met:
            if r["dst"] not in operations:
                first.setdefault(r["dst"], place)
        out = indexed.held(writes, "src", list(first)) if first else []
        if out is None:
            return None
        out = sorted((((*first[w["src"]][:2], w["id"]) if limit is not None else (0, "", w["id"]), w) for w in out), key=lambda x: x[0])
        ahead: dict[str, tuple] = {}
        for place, w in out:
            if w["dst"] not in variables:
                ahead.setdefault(w["dst"], place)
        kept = sorted([(place, o, True) for o, place in first.items()] + [(place, v, False) for v, place in ahead.items() if level < depth])
        room = len(kept) if limit is None else limit - len(operations) - len(variables) + 1  # the start is not counted
        if len(kept) > room:
            cut, kept = kept[room], kept[:room]
            met, out = ([x for x in some if x[0] < cut[0]] for some in (met, out))
        for _, r in met:
            facts.append((r["id"], r["dst"], r["value"], False))
            via.setdefault(r["dst"], set()).add(r["id"])
        deep = sorted({w["src"] for _, w in out if w["dst"] in ahead}) if level == depth else []
        for place, w in out:
            if w["dst"] not in ahead:
                facts.append((w["id"], w["src"], w["value"], True))
            elif level < depth:
                facts.append((w["id"], w["src"], w["value"], place > ahead[w["dst"]]))
        depth_hit, more = depth_hit or bool(deep), more + deep
        operations |= {o: level for _, o, is_operation in kept if is_operation}
        later = [v for _, v, is_operation in kept if not is_operation]
        level += 1
        variables |= dict.fromkeys(later, level)
        if cut:
            more += [cut[1], *front[cut[0][0] + 1 :], *later]
        front = later
    spark = edges.sparkSession
    return VariableImpact(
        start,
        spark.createDataFrame(list(variables.items()), "id string, depth int"),
        spark.createDataFrame([(o, d, sorted(via[o])) for o, d in operations.items()], "id string, depth int, via_edges array<string>"),
        spark.createDataFrame(facts, FACT),
        spark.createDataFrame([(x,) for x in dict.fromkeys(more)], "id string"),
        depth_hit,
        cut is not None,
    )


def _with_reads(operations: DataFrame, facts: DataFrame, reads: DataFrame) -> DataFrame:
    """(id, depth, via_edges) of operations (o, depth)."""
    via = facts.join(reads.select(F.col("id").alias("edge")), "edge").groupBy(F.col("on").alias("o")).agg(F.sort_array(F.collect_set("edge")).alias("via_edges"))
    return operations.join(via, "o", "left").select(F.col("o").alias("id"), "depth", "via_edges")


def _limited(edges: DataFrame, start: str, depth: int, limit: int) -> VariableImpact:
    """What is kept, limit rows and 5000 at most, is held by the driver; candidates and facts are not."""
    spark = edges.sparkSession
    reads, writes = (edges.where(F.col("type") == t).select("id", "src", "dst", "value") for t in ("reads_variable", "writes_variable"))
    few = lambda names, name: F.broadcast(spark.createDataFrame([(n,) for n in names], f"{name} string"))
    variables, operations, facts, more, depth_hit, cut = {start: 0}, {}, [], [], False, None
    front, level = [start], 0
    while front and cut is None:
        turn = F.broadcast(spark.createDataFrame(list(zip(front, range(len(front)), strict=True)), "v string, turn int"))
        met = settled(reads.join(turn, F.col("src") == F.col("v")).select("turn", F.col("id").alias("read"), F.lit("").alias("write"), F.col("dst").alias("o"), "value"))
        place = F.struct("turn", "read", "write")
        new = settled(met.join(few(operations, "o"), "o", "left_anti").groupBy("o").agg(F.min(place).alias("at")).select("o", "at.*"))
        out = writes.join(new.drop("write"), F.col("src") == F.col("o")).select("turn", "read", F.col("id").alias("write"), "o", F.col("dst").alias("v"), "value")
        out = out.join(few(variables, "k"), F.col("v") == F.col("k"), "left").withColumn("old", F.col("k").isNotNull()).drop("k")
        first = out.groupBy("v").agg(F.min(place).alias("first"))
        out = settled(out.join(first, "v").withColumn("cycle", F.col("old") | (F.lit(level < depth) & (place > F.col("first")))))
        candidates = new.select("turn", "read", "write", F.col("o").alias("id"))
        if level < depth:
            candidates = candidates.unionByName(out.where("NOT cycle").select("turn", "read", "write", F.col("v").alias("id")))
        room = limit - len(operations) - len(variables) + 1  # the start is not counted
        kept = candidates.orderBy("turn", "read", "write").limit(room + 1).collect()
        if len(kept) > room:
            cut = kept.pop()
        ahead = place < F.struct(*[F.lit(cut[n]).alias(n) for n in ("turn", "read", "write")]) if cut else F.lit(True)
        met, out = met.where(ahead), out.where(ahead)
        facts.append(met.select(F.col("read").alias("edge"), F.col("o").alias("on"), "value", F.lit(False).alias("cycle")))
        facts.append((out if level < depth else out.where("cycle")).select(F.col("write").alias("edge"), F.col("o").alias("on"), "value", "cycle"))
        if level == depth:
            deep = [r["o"] for r in out.where("NOT cycle").select("o").distinct().collect()]  # of kept operations
            depth_hit, more = bool(deep), more + deep
        operations |= {r["id"]: level for r in kept if not r["write"]}
        later = [r["id"] for r in kept if r["write"]]
        level += 1
        variables |= dict.fromkeys(later, level)
        if cut:
            more += [cut["id"], *front[cut["turn"] + 1 :], *later]
        front = later
    all_facts = reduce(DataFrame.unionByName, facts, spark.createDataFrame([], FACT))
    done = _with_reads(spark.createDataFrame(list(operations.items()), "o string, depth int"), all_facts, reads)
    return VariableImpact(start, spark.createDataFrame(list(variables.items()), "id string, depth int"), done, all_facts, few(dict.fromkeys(more), "id"), depth_hit, cut is not None)


def owning_program(operations: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, program): the least-edge-id container.  A statement's is its block's; others' is their own;
    null where none is known.  operations: id, type; edges: id, type, src, dst."""

    def holder(kinds: list[str], name: str) -> DataFrame:
        return edges.where(F.col("type").isin(kinds)).groupBy(F.col("dst").alias(f"{name}_of")).agg(F.min_by("src", "id").alias(name))

    block, step = holder(["contains_sql_statement"], "block"), holder(["contains_step", "calls_macro"], "step")
    out = operations.join(block, F.col("id") == F.col("block_of"), "left")
    key = F.when(F.col("type") == "SqlStatement", F.col("block")).otherwise(F.col("id"))
    return out.withColumn("key", key).join(step, F.col("key") == F.col("step_of"), "left").select("id", F.col("step").alias("program"))
