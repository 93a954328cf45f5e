"""Evidence-weighted downstream impact by mode.

For every mode and node the path of weakest evidence is kept: higher rank first, then the least path of
edge ids.  States that improve go on to the next level, as in a queue, until none does.  Modes run
together, as a column.

Under a limit the result is that of a queue: its states in order, its nodes as they are first met, its stop at the first node
beyond the limit, its continuation.  A node has two states there, whether it was met and its weakest path so far.  The queue
goes level by level: one question to the edges a level, and the driver holds what is kept, 5000 nodes at most.  Of a node with very many
edges only those are fetched that lie before the place where the limit must have been reached.  Without a limit a walk that stays small goes
the same way, and one that grows as joins of tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import settled, settled_with
from . import bounds
from . import index as indexed

# The edge types of each mode (structural has all), and the order of boundary reasons.
MODES = ("structural", "value_flow", "selection")
MODE_EDGES = {
    "value_flow": ("reads_variable", "writes_variable", "derives"),
    "selection": ("conditioned_by", "filters_dataset", "joins_on", "groups_by", "sorts_by"),
}
REASONS = ("unknown_node", "external_file", "depth", "limit", "sink", "cycle")
COUNTED = ("Dataset", "UnknownDataset", "Variable", "UnknownVariable")
SMALL = 20_000  # states of a frontier, with their paths, that are broadcast
COMPACTED = 4  # levels after which the settled states become one table again
UNKNOWN = ("UnknownDataset", "UnknownVariable", "UnknownMacro")


def certainty(kind: Column, resolution: Column) -> Column:
    """0 known, 1 possible, 2 unresolved."""
    known = (kind == "OBSERVED") | ((kind == "RESOLVED") & (resolution == "EXACT"))
    possible = kind.isin("RESOLVED", "CONTRACT_DERIVED", "HEURISTIC")
    return F.when(known, 0).when(possible, 1).otherwise(2)


@dataclass
class Impact:
    seed: str
    nodes: DataFrame  # id, modes, classification, rank, reasons
    paths: DataFrame  # mode, target, rank, path_edges, path_nodes
    depth_hit: bool
    continuation: DataFrame  # id
    limit_hit: bool = False
    cycles: DataFrame | None = None  # as paths: those that come back to a node of their own, other than kept ones
    boundaries: DataFrame | None = None  # mode, id, reasons of every state, the seed's too


def _in_modes(modes: tuple[str, ...]) -> Column:
    """The modes that an edge is active in, by its type."""
    return F.array_compact(F.array(*[F.when(F.lit(m == "structural") | F.col("type").isin(*MODE_EDGES.get(m, ("",))), m) for m in modes]))


def _ordered(reasons: Column) -> Column:
    return F.filter(F.array(*map(F.lit, REASONS)), lambda r: F.array_contains(reasons, r))


def impact(nodes: DataFrame, edges: DataFrame | None, seed: str, modes: tuple[str, ...] = ("structural",), depth: int = bounds.DEPTH, limit: int | None = None, index: indexed.GraphIndex | None = None) -> Impact:
    """nodes: id, type; edges: id, type, src, dst, evidence_kind, resolution; with an index both are its own."""
    bounds.check(depth, limit)
    if unknown := set(modes) - set(MODES):
        raise ValueError(f"unknown modes: {sorted(unknown)}")
    spark = nodes.sparkSession
    index = index or indexed.once(nodes, edges, "downstream")
    nodes, modes = index.nodes, tuple(m for m in MODES if m in modes)
    if nodes.where(F.col("id") == seed).isEmpty():
        raise ValueError(f"node not found: {seed}")
    small = _queue(index, seed, modes, depth, limit)
    if small is not None:
        return small
    kinds = nodes.select(F.col("id").alias("n_id"), "type")
    stop = F.col("type").isin(*UNKNOWN) | (F.col("type") == "ExternalFile")
    state = "mode string, node string, depth int, rank int, path_edges array<string>, path_nodes array<string>"
    front = spark.createDataFrame([(m, seed, 0, 0, [], [seed]) for m in modes], state)
    # settled states, a table a level and now and then one of all; a state's best is the first of its rows by this order
    better = Window.partitionBy("mode", "node").orderBy(F.desc("rank"), F.col("path_edges"), F.col("new"))
    known, depth_hit, reasons, cycles, ahead_of = [front.withColumn("loop", F.lit(False))], False, [], [], len(modes)
    out_of = index.out.where("far_type IS NOT NULL").select(F.explode(_in_modes(modes)).alias("e_mode"), "id", "src", "dst", certainty(F.col("evidence_kind"), F.col("resolution")).alias("own"), F.col("far_type").isin(*COUNTED).cast("int").alias("counted"))
    while True:
        own = settled(front.join(kinds, F.col("node") == F.col("n_id")).drop("n_id"))
        going = own.where(~stop)
        level = (
            out_of.join(F.broadcast(going) if ahead_of <= SMALL else going, (F.col("node") == F.col("src")) & (F.col("mode") == F.col("e_mode")))
            .select("mode", "node", "depth", "rank", "path_edges", "path_nodes", "id", "dst", "own", "counted")
            .withColumn("loop", F.array_contains("path_nodes", F.col("dst")))
            .withColumn("to_depth", F.col("depth") + F.col("counted"))
        )
        level, counts = settled_with(level, {"deep": ~F.col("loop") & (F.col("to_depth") > depth)})
        depth_hit = depth_hit or bool(counts["deep"])
        reasons.append(
            own.select("mode", "node", F.col("type").alias("node_type"))
            .join(level.select(F.col("mode").alias("e_mode"), F.col("node").alias("from"), "id", "loop", "to_depth"), (F.col("node") == F.col("from")) & (F.col("mode") == F.col("e_mode")), "left")
            .groupBy("mode", "node")
            .agg(
                F.max(F.when(F.col("node_type").isin(*UNKNOWN), "unknown_node").when(F.col("node_type") == "ExternalFile", "external_file").when(F.col("id").isNull(), "sink")).alias("ends"),
                F.max(~F.col("loop") & (F.col("to_depth") > depth)).alias("deep"),
                (F.max(F.col("loop")) & ~F.max(~F.col("loop") & (F.col("to_depth") <= depth))).alias("closed"),
            )
        )
        step = level.where(F.col("loop") | (F.col("to_depth") <= depth)).select(
            "mode",
            F.col("dst").alias("node"),
            F.col("to_depth").alias("depth"),
            F.greatest("rank", "own").alias("rank"),
            F.concat("path_edges", F.array("id")).alias("path_edges"),
            F.concat("path_nodes", F.array("dst")).alias("path_nodes"),
            "loop",
        )
        cycles.append(step.where("loop").select("mode", F.col("node").alias("target"), "rank", "path_edges", "path_nodes"))
        # candidates against what is known of the same states alone
        first = step.withColumn("new", F.lit(1)).withColumn("place", F.row_number().over(better)).where("place = 1").drop("place")
        held = reduce(DataFrame.unionByName, known).withColumn("new", F.lit(0)).join(first.select("mode", "node"), ["mode", "node"], "left_semi")
        improved = held.unionByName(first).withColumn("place", F.row_number().over(better)).where("place = 1 AND new = 1").drop("place", "new")
        improved, counts = settled_with(improved, {"open": ~F.col("loop"), "all": F.lit(True)})
        if counts["all"]:
            known.append(improved)
        if not counts["open"]:
            break
        if len(known) > COMPACTED:
            whole = reduce(DataFrame.unionByName, known).withColumn("new", F.lit(0)).withColumn("place", F.row_number().over(better))
            known = [settled(whole.where("place = 1").drop("place", "new"))]
        front, ahead_of = improved.where("NOT loop").drop("loop"), counts["open"]
    best = settled(reduce(DataFrame.unionByName, known).withColumn("new", F.lit(0)).withColumn("place", F.row_number().over(better)).where("place = 1").drop("place", "new", "loop"))
    reasons = reduce(DataFrame.unionByName, reasons)
    reached = best.where(F.col("node") != seed)
    ends = reasons.groupBy("mode", F.col("node").alias("id")).agg(
        F.collect_set("ends").alias("ends"), F.max("deep").alias("deep"), F.max("closed").alias("closed")
    )
    listed = F.concat("ends", F.when(F.col("deep"), F.array(F.lit("depth"))).otherwise(F.array()), F.when(F.col("closed"), F.array(F.lit("cycle"))).otherwise(F.array()))
    boundaries = settled(ends.select("mode", "id", _ordered(listed).alias("reasons")))
    of_node = boundaries.groupBy(F.col("id").alias("r_node")).agg(_ordered(F.flatten(F.collect_list("reasons"))).alias("reasons"))
    grouped = reached.groupBy("node").agg(F.max("rank").alias("rank"), F.sort_array(F.collect_set("mode")).alias("modes"))
    unknown = F.col("type").isin(*UNKNOWN)
    out = (
        grouped.join(kinds, F.col("node") == F.col("n_id"))
        .join(of_node, F.col("node") == F.col("r_node"), "left")
        .select(
            F.col("node").alias("id"),
            "modes",
            F.when(unknown | (F.col("rank") == 2), "unresolved_boundary").when(F.col("rank") == 1, "possibly_impacted").otherwise("known_impacted").alias("classification"),
            "rank",
            "reasons",
        )
    )
    paths = best.where(F.size("path_edges") > 0).select("mode", F.col("node").alias("target"), "rank", "path_edges", "path_nodes")
    # what a walk cut by depth may go on from
    more = ends.where("deep").select("id").distinct()
    around = reduce(DataFrame.unionByName, cycles).where(F.col("target") != seed).join(paths, ["mode", "target", "path_edges"], "left_anti").select(*paths.columns)
    return Impact(seed, out, paths, depth_hit, more, cycles=around, boundaries=boundaries)


def _ahead(index: indexed.GraphIndex, modes: tuple[str, ...], level: dict[str, bool], reached: list[str], room: int | None) -> dict[str, list] | None:
    """By node its edges in id order, as far as a queue with so much room can get, None where that is without bound; level: nodes, and whether all
    their states may take a counted step.

    A node's edges that every mode has and every state may take each add their far end if it is new: behind the
    (room + 1)-th of these the queue has stopped, however much room other nodes took before."""
    own = F.size(_in_modes(modes))
    edges = index.out.where(own > 0).select("src", "id", "type", "dst", "far_type", certainty(F.col("evidence_kind"), F.col("resolution")).alias("own"), (own == len(modes)).alias("sure"))
    rows = indexed.held(edges, "src", list(level))
    if rows is None and room is not None:
        rows = _before_the_limit(edges, level, reached, room)
    if rows is None:
        return None
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["src"], []).append(r)
    return {k: sorted(v, key=lambda r: r["id"]) for k, v in out.items()}


def _before_the_limit(edges: DataFrame, level: dict[str, bool], reached: list[str], room: int) -> list:
    spark = edges.sparkSession
    front = spark.createDataFrame(list(level.items()), "f_id string, open boolean")
    near = settled(indexed.at(edges, "src", front, "f_id", len(level)))
    known = F.broadcast(spark.createDataFrame([(x,) for x in reached], "k string"))
    sure = near.where(F.col("sure") & (F.col("open") | ~F.coalesce(F.col("far_type").isin(*COUNTED), F.lit(True)))).join(known, F.col("dst") == F.col("k"), "left_anti")
    first = sure.groupBy("src", "dst").agg(F.min("id").alias("cut"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("cut"))
    cuts = first.withColumn("place", place).where(F.col("place") <= room + 1).where(F.col("place") == room + 1).select(F.col("src").alias("c_src"), "cut")
    some = near.join(F.broadcast(cuts), F.col("src") == F.col("c_src"), "left").where(F.col("cut").isNull() | (F.col("id") <= F.col("cut")))
    return some.select("src", "id", "type", "dst", "far_type", "own").collect()


def _queue(index: indexed.GraphIndex, seed: str, modes: tuple[str, ...], depth: int, limit: int | None) -> Impact | None:
    """None where there is no limit and the walk grows beyond what is held."""
    spark = index.out.sparkSession
    types = {seed: index.nodes.where(F.col("id") == seed).first()["type"]}
    best: dict[tuple[str, str], tuple] = {(m, seed): (0, (), (seed,)) for m in modes}  # rank, edges, nodes
    queue = [(m, seed, 0, 0, (), (seed,)) for m in modes]
    met: dict[str, None] = {}
    reasons: dict[tuple[str, str], set] = {}
    around: dict[tuple[str, str], dict] = {}
    more: list[str] = []
    depth_hit = limit_hit = False
    better = lambda key, rank, path: key not in best or (-rank, path) < (-best[key][0], best[key][1])
    current = lambda x: best[x[:2]][:2] == (x[3], x[4])

    while queue and not limit_hit:
        level: dict[str, bool] = {}
        for x in queue:
            if current(x) and types[x[1]] not in (*UNKNOWN, "ExternalFile"):
                level[x[1]] = level.get(x[1], True) and x[2] < depth
        edges = _ahead(index, modes, level, [seed, *met], None if limit is None else limit - len(met)) if level else {}
        if edges is None or (limit is None and len(best) > indexed.HELD):
            return None
        queue, popped = [], queue
        for mode, node, at, rank, path, through in popped:
            if not current((mode, node, at, rank, path)):
                continue  # a better state of the node stands further on
            why = reasons.setdefault((mode, node), set())
            if types[node] in UNKNOWN or types[node] == "ExternalFile":
                why.add("external_file" if types[node] == "ExternalFile" else "unknown_node")
                continue
            active = [e for e in edges.get(node, ()) if e["type"] in MODE_EDGES.get(mode, (e["type"],))]
            if not active:
                why.add("sink")
                continue
            expanded = closed = False
            for e in active:
                to = e["dst"]
                if e["far_type"] is None:
                    raise ValueError(f"impact edge {e['id']} points to a missing node")
                types[to] = e["far_type"]
                new = (max(rank, e["own"]), (*path, e["id"]), (*through, to))
                if to in through:
                    closed = True
                    around.setdefault((mode, to), {})[new[1]] = new
                    if better((mode, to), *new[:2]):
                        best[mode, to] = new
                    continue
                deeper = at + (e["far_type"] in COUNTED)
                if deeper > depth:
                    depth_hit = True
                    why.add("depth")
                    more.append(node)
                    continue
                if to not in met:
                    if limit is not None and len(met) == limit:
                        limit_hit = True
                        why.add("limit")
                        more.append(to)
                        break
                    met[to] = None
                if better((mode, to), *new[:2]):
                    best[mode, to] = new
                    queue.append((mode, to, deeper, *new))
                expanded = True
            if closed and not expanded:
                why.add("cycle")
            if limit_hit:
                break
    told = lambda some: [r for r in REASONS if r in some]
    rows, paths, cycles = [], [], []
    for node in met:
        own = {m: best[m, node] for m in modes if (m, node) in best}
        rank = max(x[0] for x in own.values())
        kind = "unresolved_boundary" if types[node] in UNKNOWN or rank == 2 else "possibly_impacted" if rank == 1 else "known_impacted"
        rows.append((node, sorted(own), kind, rank, told(set().union(*(reasons.get((m, node), ()) for m in own)))))
        paths += [(m, node, *map(list_of, x)) for m, x in own.items()]
        cycles += [(m, node, *map(list_of, x)) for m in own for key, x in around.get((m, node), {}).items() if key != own[m][1]]
    path = "mode string, target string, rank int, path_edges array<string>, path_nodes array<string>"
    return Impact(
        seed,
        spark.createDataFrame(rows, "id string, modes array<string>, classification string, rank int, reasons array<string>"),
        spark.createDataFrame(paths, path),
        depth_hit,
        spark.createDataFrame([(x,) for x in dict.fromkeys(more)], "id string"),
        limit_hit,
        spark.createDataFrame(cycles, path),
        spark.createDataFrame([(m, n, told(why)) for (m, n), why in reasons.items()], "mode string, id string, reasons array<string>"),
    )


def list_of(x):
    return list(x) if isinstance(x, tuple) else x
