"""Joins, aggregates and checks over graph tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bounds, vocabulary

# ---- projections and search


def project_nodes(nodes: DataFrame) -> DataFrame:
    """id, type, label, and the place in the source where known."""
    source = F.col("source") if "source" in nodes.columns else F.lit(None)
    place = source if "source" not in nodes.columns else F.when(source.isNotNull(), F.struct(*[F.col(f"source.{n}").alias(n) for n in ("file", "line_start", "line_end")]))
    return nodes.select("id", "type", "label", *([place.alias("source")] if "source" in nodes.columns else []))


def search_nodes(nodes: DataFrame, query: str, limit: int | None = bounds.LIMIT) -> DataFrame:
    """Nodes whose label or type contains the query, whatever the case (lower(), so ß is not ss), with
    `place` in id order and `omitted` beyond the limit.  An empty query matches all."""
    if not isinstance(query, str):
        raise TypeError("query must be a string")
    bounds.check(0, limit)
    asked = query.lower()
    found = nodes.where(F.lower("label").contains(asked) | F.lower("type").contains(asked)).select("id", "type", "label")
    if limit is None:
        return found.withColumn("omitted", F.lit(False))
    kept = found.orderBy("id").limit(limit).select(F.col("id").alias("k"))
    return found.join(F.broadcast(kept), F.col("id") == F.col("k"), "left").select("id", "type", "label", F.col("k").isNull().alias("omitted"))


def _library() -> Column:
    own = F.nullif(F.regexp_extract(F.lower("id"), r"^(?:unknown)?dataset:([a-z_][a-z0-9_]{0,7})\..+", 1), F.lit(""))
    return F.when(F.col("type").isin("Dataset", "UnknownDataset"), own)


def filter_nodes(nodes: DataFrame, kind: str | None = None, library: str | None = None) -> DataFrame:
    """By type and library; nodes that show no library pass every library."""
    own = _library()
    out = nodes if kind is None else nodes.where(F.col("type") == kind)
    return out if library is None else out.where(F.coalesce(own == library.lower(), F.lit(True)))


def facets(nodes: DataFrame) -> DataFrame:
    return nodes.select("type").distinct().orderBy("type")


def library_facets(nodes: DataFrame) -> DataFrame:
    """(library) of all datasets that show one, in order."""
    return nodes.select(_library().alias("library")).where("library IS NOT NULL").distinct().orderBy("library")


def render_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to draw: without comment blocks and macro parameters and what touches them."""
    kept = nodes.where(~F.col("type").isin("CommentBlock", "MacroParameter"))
    ends = kept.select(F.col("id").alias("k"))
    out = edges
    for end in ("src", "dst"):
        out = out.join(ends, F.col(end) == F.col("k"), "left_semi")
    return kept, out


# ---- aggregates


def by_type(records: DataFrame) -> DataFrame:
    return records.groupBy("type").agg(F.count("*").alias("n"))


def _dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Dealt among a counted number of tasks, which small rows in many do not bring together again; without a count as joins deal them."""
    return df.repartition(parts, *keys) if parts else df


def degrees(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges at each node, one at least.  parts: among how many tasks nodes and edges are dealt."""
    ends = _dealt(edges.select(F.col("src").alias("e")).union(edges.select("dst")), parts, "e").groupBy("e").agg(F.count("*").alias("n"))
    return _dealt(nodes.select("id"), parts, "id").join(ends, F.col("id") == F.col("e"), "left").select("id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("degree"))


def run_status(findings: DataFrame, *by: str) -> DataFrame:
    """COMPLETE, PARTIAL or FAILED: one row, or one for each value of the columns by, such as program."""
    # Statuses that leave a run partial.
    partial = "REQUIRES_DECISION NOT_EXECUTED UNRESOLVED_MACRO_VARIABLE UNRESOLVED_MACRO_SOURCE MACRO_CONFLICT CONDITIONAL_BRANCH_UNRESOLVED UNQUALIFIED_VARIABLE".split()
    rank = F.max(F.when(F.col("status") == "BLOCKED", 2).when(F.col("status").isin(partial), 1).otherwise(0))
    return findings.groupBy(*by).agg(F.element_at(F.array(*map(F.lit, ("COMPLETE", "PARTIAL", "FAILED"))), F.coalesce(rank, F.lit(0)) + 1).alias("status"))


def findings_of(findings: DataFrame) -> DataFrame:
    """(object, findings): what affects each node, edge or other object."""
    some = [F.coalesce(F.col(c), F.array()) for c in ("affected_nodes", "affected_edges", "affected_objects") if c in findings.columns]
    touched = findings.withColumn("object_id", F.explode(reduce(F.array_union, some)))
    return touched.groupBy("object_id").agg(F.sort_array(F.collect_set("id")).alias("findings"))


# ---- as-of and interval joins


def as_of(uses: DataFrame, events: DataFrame, keys: list[str], use_order: str, event_order: str, values: list[str], fallback: DataFrame | None = None) -> DataFrame:
    """uses with the values of the last event of the same keys strictly before.

    fallback: a second history with the columns of events, asked for keys that events does not know at all; a key with events,
    be they all later, keeps to these.  Both histories and the uses are merged in order and the last event of each history is carried
    on: one sort by key, no pairs."""
    told = F.struct(*[F.col(v) for v in values])
    histories = [events] if fallback is None else [events, fallback]
    kind = events.select(told.alias("e")).schema["e"].dataType
    none, own = F.lit(None).cast(kind), [F.col(n).alias(f"_u_{n}") for n in uses.columns]
    names = [f"_event{k}" for k in range(len(histories))]
    both = uses.select(*keys, F.col(use_order).alias("_order"), F.lit(0).alias("_kind"), *[none.alias(n) for n in names], *own)
    for k, history in enumerate(histories):
        side = [F.lit(None).cast(t).alias(f"_u_{n}") for n, t in uses.dtypes]
        both = both.unionByName(history.select(*keys, F.col(event_order).alias("_order"), F.lit(k + 1).alias("_kind"), *[(told.cast(kind) if j == k else none).alias(n) for j, n in enumerate(names)], *side))
    before = Window.partitionBy(*keys).orderBy("_order", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(n, ignorenulls=True).over(before) for n in names]
    if fallback is not None:
        known = F.max(F.col("_kind") == 1).over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        last = [F.when(known, last[0]).otherwise(last[1])]
    both = both.withColumn("_last", last[0])
    return both.where("_kind = 0").select(*[F.col(f"_u_{n}").alias(n) for n in uses.columns], *[F.col(f"_last.{v}").alias(v) for v in values])


def is_prefix(short: Column, long: Column) -> Column:
    return F.slice(long, 1, F.size(short)) == short


def innermost(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """points (file, line) with the id of the narrowest span (file, line_start, line_end, id, pos) over them;
    ties go to the lesser pos.  Spans are dealt to the buckets of lines they touch, so the join is on equal
    buckets and compares ranges only inside."""
    dealt = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line_start") / width), F.floor(F.col("line_end") / width))))
    at = points.withColumn("bucket", F.floor(F.col("line") / width))
    hit = at.join(dealt, ["file", "bucket"]).where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    best = hit.groupBy("file", "line").agg(F.min_by("id", F.struct(F.col("line_end") - F.col("line_start"), "pos")).alias("id"))
    return points.join(best, ["file", "line"], "left")


def read_never_written(nodes: DataFrame, edges: DataFrame, work: tuple[str, ...] = ("work",), libraries: DataFrame | None = None) -> DataFrame:
    """(dataset, edge): datasets that are read and neither written nor imported, with their first read.

    Those of the libraries in work are left out, and with libraries (name, value) those of any that stands for one of them."""
    reads = edges.where("type = 'reads_dataset'").groupBy(F.col("src").alias("dataset")).agg(F.min("id").alias("edge"))
    made = edges.where("type IN ('writes_dataset', 'reads_external_file')").select(F.col("dst").alias("m"))
    named = nodes.where("type = 'Dataset'").select(F.col("id").alias("n"))
    found = reads.join(named, F.col("dataset") == F.col("n"), "left_semi").join(made, F.col("dataset") == F.col("m"), "left_anti")
    found = found.withColumn("library", F.regexp_extract("dataset", r"^dataset:([^.]*)\.", 1))
    if libraries is not None:
        found = found.join(libraries.select(F.col("name").alias("l"), "value"), F.col("library") == F.col("l"), "left").withColumn("library", F.coalesce("value", "library"))
    return found.where(~F.col("library").isin(*work)).select("dataset", "edge")


def rebinds(setup: DataFrame, program: DataFrame) -> DataFrame:
    """(name, setup_value, value): program bindings that differ from setup's last.  Both: name, value, ord."""
    last = setup.groupBy(F.lower("name").alias("k")).agg(F.max_by("value", "ord").alias("setup_value"))
    return program.join(last, F.lower("name") == F.col("k")).where("value <> setup_value").select("name", "setup_value", "value")


# ---- explanation


def explain_edge(edges: DataFrame, findings: DataFrame, edge_id: str) -> DataFrame:
    """One row: the edge with its evidence and the findings on it or on its ends."""
    edge = edges.where(F.col("id") == edge_id)
    near = F.array("id", "src", "dst")
    f = findings.withColumn("object_id", F.explode(F.array_union("affected_nodes", "affected_edges"))).select("object_id", F.col("id").alias("finding"))
    hit = edge.withColumn("near", near).join(f, F.expr("array_contains(near, object_id)"), "left").groupBy("id").agg(F.sort_array(F.collect_set("finding")).alias("findings"))
    return edge.join(hit, "id")


def explanation(nodes: DataFrame, edges: DataFrame, findings: DataFrame, edge_id: str, limit: int | None = bounds.LIMIT) -> DataFrame:
    """(section, id, category, type, omitted): the records an edge derives from (`path`), then findings on it or on its ends
    (`finding`); of each those beyond the limit, in id order, are omitted.  edges: id, type, src, dst, derivation_refs."""
    bounds.check(0, limit)
    edge = edges.where(F.col("id") == edge_id)
    if edge.isEmpty():
        raise ValueError(f"edge not found: {edge_id}")
    path = resolution_path(edge.select(F.explode("derivation_refs").alias("ref")), nodes, edges, findings)
    near = edge.select(F.explode(F.array("id", "src", "dst")).alias("object_id"))
    linked = findings_of(findings).join(F.broadcast(near), "object_id", "left_semi").select(F.explode("findings").alias("id")).distinct()  # three names
    hit = findings.join(linked, "id", "left_semi").select("id", F.lit("finding").alias("category"), "type")
    out = []
    for section, found in (("path", path), ("finding", hit)):
        kept = (found if limit is None else found.orderBy("id").limit(limit)).select(F.col("id").alias("k"))
        kept = kept if limit is None else F.broadcast(kept)
        out.append(found.join(kept, F.col("id") == F.col("k"), "left").select(F.lit(section).alias("section"), "id", "category", "type", F.col("k").isNull().alias("omitted")))
    return out[0].unionByName(out[1])


def resolution_path(refs: DataFrame, nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """(id, category, type): records behind derivation references; findings over edges over nodes."""
    some = [d.select("id", "type", F.lit(k).alias("rank"), F.lit(n).alias("category")) for k, (n, d) in enumerate((("node", nodes), ("edge", edges), ("finding", findings)))]
    records = reduce(DataFrame.unionByName, some).join(refs.select(F.col("ref").alias("id")).distinct(), "id", "left_semi")
    return records.groupBy("id").agg(F.max_by(F.struct("category", "type"), "rank").alias("r")).select("id", "r.category", "r.type").orderBy("id")


# ---- validation and normalisation


def problems(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(section, object, problem) of every record that breaks a rule.

    nodes: id, type, label, pos; edges: id, type, src, dst, evidence_kind, resolution, confidence, pos.
    parts: among how many tasks nodes and edges are dealt."""
    spark = nodes.sparkSession
    kinds = spark.createDataFrame([(t,) for t in vocabulary.NODE_TYPES], "t string")
    edge_kinds = spark.createDataFrame([(t,) for t in vocabulary.EDGE_TYPES], "t string")

    def say(df: DataFrame, section: str, problem: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col("id").alias("object"), F.lit(problem).alias("problem"))

    twice = _dealt(nodes, parts, "id").withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("nth > 1")
    ends = _dealt(nodes.select(F.col("id").alias("n_id"), "type", "pos"), parts, "n_id").groupBy("n_id").agg(F.min_by("type", "pos").alias("n_type"))
    ends = ends.hint("shuffle_hash") if parts else ends
    found = [
        say(nodes.where("id IS NULL OR type IS NULL OR label IS NULL"), "nodes", "missing key"),
        say(nodes.join(F.broadcast(kinds), F.col("type") == F.col("t"), "left_anti").where("type IS NOT NULL"), "nodes", "unknown type"),
        say(twice, "nodes", "duplicate id"),
        say(edges.where("id IS NULL OR type IS NULL OR src IS NULL OR dst IS NULL"), "edges", "missing key"),
        say(edges.join(F.broadcast(edge_kinds), F.col("type") == F.col("t"), "left_anti").where("type IS NOT NULL"), "edges", "unknown type"),
        say(edges.where(F.col("evidence_kind").isNotNull() & ~F.col("evidence_kind").isin(*vocabulary.EVIDENCE_KINDS)), "edges", "evidence kind"),
        say(edges.where(F.col("resolution").isNotNull() & ~F.col("resolution").isin(*vocabulary.RESOLUTIONS)), "edges", "evidence resolution"),
        say(edges.where("evidence_kind = 'UNKNOWN' AND confidence IS NOT NULL"), "edges", "unknown evidence with confidence"),
    ]
    for end in ("src", "dst"):
        found.append(say(_dealt(edges.where(F.col(end).isNotNull()).select("id", end), parts, end).join(ends, F.col(end) == F.col("n_id"), "left_anti"), "edges", f"dangling {end}"))
    typed = edges.join(F.broadcast(edge_kinds), F.col("type") == F.col("t"), "left_semi")
    for end in ("src", "dst"):
        typed = _dealt(typed.select("id", "type", "src", "dst", *[c for c in typed.columns if c == "src_type"]), parts, end).join(ends.select(F.col("n_id").alias(f"{end}_id"), F.col("n_type").alias(f"{end}_type")), F.col(end) == F.col(f"{end}_id"))
    legal = F.broadcast(vocabulary.pairs_table(spark))
    found.append(say(typed.join(legal, (F.col("type") == F.col("edge_type")) & (F.col("src_type") == F.col("from_type")) & (F.col("dst_type") == F.col("to_type")), "left_anti"), "edges", "illegal endpoints"))
    return reduce(DataFrame.unionByName, found)


def normalize(edges: DataFrame) -> DataFrame:
    """Edges of schema 0.2.0 as 0.3.0: where evidence is missing, it is unknown and was not attempted."""
    return edges.withColumns({"resolution": F.when(F.col("evidence_kind").isNull(), "NOT_ATTEMPTED").otherwise(F.col("resolution")), "evidence_kind": F.coalesce("evidence_kind", F.lit("UNKNOWN"))})
