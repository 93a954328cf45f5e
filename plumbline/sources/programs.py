"""Source programs as tables, and the graph of a run out of their facts.

Files are read as binary rows and hashed; each program is parsed by one task (a program is a sequence, its
macro state a fold), with the texts it may include at hand; facts come out as rows, and nodes, edges and
findings are numbered by one ordering over (program, place) at the end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as relations
from .config import SEGMENTS, SUFFIXES
from .facts import Carried, Program, macro_sites
from .includes import targets
from .lexer import lex
from .macros import in_file
from .store import settled

# Files that are never read.
PROHIBITED = (".sas7bdat", ".sas7bcat", ".xpt", ".xls", ".xlsx", ".csv", ".rtf", ".pdf")


class SourceChanged(RuntimeError):
    """A file with two contents in a run."""


def _plain(path: str):
    return F.regexp_replace(path, "^file:(//)?", "")


def read_sources(spark: SparkSession, *paths: str, glob: str = "*.[sS][aA][sS]") -> DataFrame:
    """(path, text, sha256, n_bytes) of every file below the paths; a byte-order mark is dropped."""
    if any(p.lower().endswith(PROHIBITED) for p in paths):
        raise ValueError("data files are not read")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(list(paths))
    return files.select(_plain("path").alias("path"), F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("text"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes")).dropDuplicates(["path", "sha256"])


def check_unchanged(sources: DataFrame) -> None:
    if changed := sources.groupBy("path").agg(F.countDistinct("sha256").alias("n")).where("n > 1").limit(1).collect():
        raise SourceChanged(changed[0]["path"])


def _readable(paths: DataFrame) -> DataFrame:
    """Those whose ending and folders are not prohibited."""
    ending = "|".join(re.escape(x) for x in dict.fromkeys(PROHIBITED + SUFFIXES))
    return paths.where(~F.lower("path").rlike(rf"(^|/)({'|'.join(SEGMENTS)})(/|$)") & ~F.lower("path").rlike(rf"({ending})$"))


@dataclass
class Snapshot:
    """The texts of a run, read once: every stage has them from here.  files: path, text, sha256, n_bytes; folders: path; roots with glob, and
    extra, the files read beside these: where files are from."""

    files: DataFrame
    folders: DataFrame
    roots: list[str]
    glob: str
    extra: list[str]

    def check(self) -> None:
        """Reads the same files again; raises SourceChanged where one is gone or has other bytes."""
        check_unchanged(self.files)
        spark = self.files.sparkSession
        try:
            now = _readable(read_sources(spark, *self.roots, glob=self.glob))
            now = now.unionByName(read_sources(spark, *self.extra, glob="*")) if self.extra else now
            now = now.select("path", F.col("sha256").alias("now"))
            other = self.files.join(now, "path", "left").where("now IS NULL OR now <> sha256").limit(1).collect()
        except Exception as error:  # the reader's own error for a file that is gone
            if "PATH_NOT_FOUND" in str(error) or "FileNotFound" in str(error) or "FILE_NOT_EXIST" in str(error):
                raise SourceChanged(str(error).splitlines()[0]) from error
            raise
        if other:
            raise SourceChanged(other[0]["path"])


def snapshot(spark: SparkSession, roots: list[str], named: list[str] = (), glob: str = "*.[sS][aA][sS]") -> Snapshot:
    """The files that match below the roots, those named, and all that these include, in any number of steps.

    Names alone are listed for the rest of the roots; of these only what is included is ever opened."""
    listed = _readable(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select(_plain("path").alias("path")))
    listed = settled(listed)
    files = settled(_readable(read_sources(spark, *roots, glob=glob)))
    fresh = files
    declared = spark.createDataFrame([(x,) for x in named], "path string")
    extra = [r["path"] for r in declared.join(files.select("path"), "path", "left_anti").collect()]
    if extra:
        files = fresh = files.unionByName(settled(read_sources(spark, *extra, glob="*")))
    while True:
        asked = include_links(fresh).select(F.col("target").alias("path")).distinct()
        wanted = [r["path"] for r in asked.join(listed, "path", "left_semi").join(files.select("path"), "path", "left_anti").toLocalIterator()]  # names of included files
        if not wanted:
            break
        fresh = settled(read_sources(spark, *wanted, glob="*"))
        files, extra = files.unionByName(fresh), extra + wanted
    parents = F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), k -> array_join(slice(split(path, '/'), 1, k), '/'))")
    return Snapshot(settled(files), settled(listed.select(F.explode(parents).alias("path")).distinct()), list(roots), glob, extra)


def statements(sources: DataFrame) -> DataFrame:
    """(path, order, kind, text, line_start, line_end, terminated) of every statement and comment."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, p.order, p.kind, p.text, p.line_start, p.line_end, p.terminated) for path, text in zip(batch["path"], batch["text"], strict=True) for p in lex(text or "").pieces]
            yield pd.DataFrame(rows, columns=["path", "order", "kind", "text", "line_start", "line_end", "terminated"])

    return sources.select("path", "text").mapInPandas(cut, "path string, `order` int, kind string, text string, line_start int, line_end int, terminated boolean")


def called_macros(sources: DataFrame) -> DataFrame:
    """(name) of everything that any source calls like a macro."""
    return sources.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"%(\w+)"), F.lit(1))).alias("name")).distinct()


def macro_index(sources: DataFrame) -> DataFrame:
    """(name, path) of macro definitions."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for path, text in zip(batch["path"], batch["text"], strict=True) for x in macro_sites(path, text or "")], columns=["name", "path"])

    return sources.select("path", "text").mapInPandas(find, "name string, path string")


def include_links(sources: DataFrame) -> DataFrame:
    """(path, target): which file names which other in an include whose path is known."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(path, x) for path, text in zip(batch["path"], batch["text"], strict=True) for x in targets(path, text or "")], columns=["path", "target"])

    # a text without the word needs no lexer
    return sources.select("path", "text").where(F.lower("text").contains("%include")).mapInPandas(find, "path string, target string")


def included(programs: DataFrame, library: DataFrame) -> DataFrame:
    """(program, path): all that each program includes, over any number of files between, found or not.

    A level joins what the last one found with the links; files met before are left, so cycles end."""
    links = settled(include_links(library.select("path", "text").unionByName(programs.select("path", "text")).distinct()))
    seen = front = settled(links.join(programs.select("path"), "path", "left_semi").select(F.col("path").alias("program"), F.col("target").alias("path")).distinct())
    while not front.isEmpty():
        ahead = front.join(links, "path").select("program", F.col("target").alias("path")).distinct()
        front = settled(ahead.join(seen, ["program", "path"], "left_anti"))
        seen = seen.unionByName(front)
    return seen


def _context(programs: DataFrame, library: DataFrame | None, folders: DataFrame | None, macros: DataFrame | None, contracts: DataFrame | None) -> DataFrame:
    """(program, rank, role, path, text): a program and whatever its parser needs beside it, a row a file."""
    own = programs.select(F.col("path").alias("program"), "rank", F.lit("main").alias("role"), "path", "text")
    parts = [own]
    ranks = programs.select(F.col("path").alias("program"), "rank")
    if library is not None:
        pairs = settled(included(programs, library))
        parts.append(pairs.join(library.select("path", "text"), "path").withColumn("role", F.lit("include")))
        if folders is not None:
            parts.append(pairs.join(folders, "path", "left_semi").select("program", "path", F.lit(None).cast("string").alias("text"), F.lit("include").alias("role")))
        parts[1:] = [x.join(ranks, "program").select(*own.columns) for x in parts[1:]]
    if macros is not None or contracts is not None:
        texts = reduce(DataFrame.unionByName, parts)
        called = settled(texts.select("program", "rank", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"%(\w+)"), F.lit(1))).alias("name")).distinct())
        if macros is not None:
            sites = called.join(macro_index(macros), "name").select("program", "rank", "path").distinct()
            parts.append(sites.join(macros.select("path", "text"), "path").withColumn("role", F.lit("macro")).select(*own.columns))
        if contracts is not None:
            usable = contracts.where(F.size("errors") == 0).select(F.col("macro").alias("name"), "path", F.to_json(F.struct("macro", "parameters")).alias("text"))
            parts.append(called.join(usable, "name").withColumn("role", F.lit("contract")).select(*own.columns))
    return reduce(DataFrame.unionByName, parts)


SHARE = 500  # programs of a task, about; their rows are few, so their bytes do not tell how long they take
BATCH = 5_000  # facts that a task hands on together
FACT = "program string, rank int, place int, kind string, body string"


def facts(
    programs: DataFrame,
    setup: Carried | dict[str, str] | None = None,
    macros: DataFrame | None = None,
    library: DataFrame | None = None,
    contracts: DataFrame | None = None,
    os_base: str | None = None,
    folders: DataFrame | None = None,
    roots: list[str] | None = None,
    role: str = "Program",
) -> DataFrame:
    """(program, rank, place, kind, body): a row a fact of programs (path, text, and rank where they have an order).

    library: texts that may be included; macros: files that define macros; contracts: as read_contracts gives them; folders: paths that are
    no files.  Each program meets what it includes and calls by joins, and is parsed in one task with these alone.
    kind is node, edge, finding, library (a libref and what it stands for), or state, what a setup carries on."""
    rank = F.col("rank") if "rank" in programs.columns else F.lit(0)
    programs = programs.select("path", "text", rank.cast("int").alias("rank"))
    shared = programs.sparkSession.sparkContext.broadcast((setup, os_base, roots))  # one setup's bindings

    def rows(path: str, rank: int, text: str, **context) -> list[tuple]:
        setup, os_base, roots = shared.value
        made = Program(path, text, setup, os_base=os_base, roots=roots, role=role, **context)
        some = {"node": made.facts.nodes.values(), "edge": made.facts.edges, "finding": made.facts.findings, "library": [{"name": k, "value": v} for k, v in made.libraries.items()]}
        some["state"] = [vars(made.carried())] if role == "SetupFile" else []
        return [(path, rank, k, kind, json.dumps(x)) for kind, own in some.items() for k, x in enumerate(own)]

    columns = ["program", "rank", "place", "kind", "body"]

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for path, text, rank in batch.itertuples(index=False) for x in rows(path, rank, text or "")], columns=columns)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Programs one after the other, as the sort leaves them; a program may go over several batches."""
        out: list[tuple] = []
        lines = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        for (path, rank), group in groupby(lines, key=lambda r: r[:2]):
            some: dict[str, list] = {}
            for _, _, role, at, text in group:
                some.setdefault(role, []).append((at, None if pd.isna(text) else text))
            of = lambda role: sorted(some.get(role, []), key=lambda r: r[0])  # noqa: B023, E731
            sites: dict[str, list] = {}
            for at, text in of("macro"):
                for d in in_file(at, text or ""):
                    sites.setdefault(d.name, []).append(d)
            documents = [json.loads(text) for _, text in of("contract")]
            out += rows(path, int(rank), some["main"][0][1] or "", files=dict(of("include")), macros=sites, contracts={d["macro"]: d for d in documents})
            if len(out) >= BATCH:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    if library is None and macros is None and contracts is None:
        return programs.mapInPandas(alone, FACT)
    dealt = _context(programs, library, folders, macros, contracts).select("program", "rank", "role", "path", "text").repartition(max(1, -(-programs.count() // SHARE)), "program", "rank")
    return dealt.sortWithinPartitions("program", "rank").mapInPandas(whole, FACT)


def carried(found: DataFrame) -> Carried:
    """What the setup among the facts carries on; a row."""
    state = found.where("kind = 'state'").first()
    return Carried(**json.loads(state["body"])) if state else Carried()


def told(spark: SparkSession, findings: list[dict], rank: int = -2) -> DataFrame:
    """Findings that stand before all programs, such as a configuration's, as facts."""
    return spark.createDataFrame([("", rank, k, "finding", json.dumps(x)) for k, x in enumerate(findings)], FACT)


LATE = 1 << 30  # the rank of what is told when all programs are known
_NODE = "id string, type string, label string, pattern string, by_vars array<string>, by_directions array<string>, usable_for_static_resolution boolean, where_condition string, value string, sort_option string, cardinality_effect string, sql_subtype string, keep_vars array<string>, drop_vars array<string>, rename_map map<string,string>, branch_text array<string>, row_allocation_inferred boolean, status string, branches array<string>, candidate_text string, template_derived boolean"
_EDGE = "type string, src string, dst string, evidence_kind string, resolution string, line_start int, line_end int, value string, operator string, expression string, condition_text string, predicate_text string, join_kind string, direction string, output_kind string, materialized boolean, dbms string, sheet string, getnames string, dataset_name string, macro_name string, template_derived boolean, derivation_refs array<string>"
_FINDING = "type string, status string, severity string, object string, message string, line_start int, affected_nodes array<string>"


def graph(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and findings of a run, with counted ids; nodes of one id are one, the first stays.

    Counting runs over the run's facts in order, by rank, then program by program: every number is its program's offset
    plus its place, so no task orders the facts of all programs.  Datasets that are read and never written get a
    finding each, behind all others; a library that is last an alias of WORK counts as WORK."""

    found = settled(found)

    def kind(name: str, ddl: str) -> DataFrame:
        return found.where(F.col("kind") == name).select("program", "rank", "place", F.from_json("body", ddl).alias("b")).select("program", "rank", "place", "b.*")

    def numbered(df: DataFrame, name: str, *by: str) -> DataFrame:
        before = Window.partitionBy(*by).orderBy("rank", "program").rowsBetween(Window.unboundedPreceding, -1)
        offset = df.groupBy("program", "rank", *by).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        own = F.row_number().over(Window.partitionBy("program", "rank", *by).orderBy("place"))
        return df.join(offset, ["program", "rank", *by]).withColumn(name, F.col("before") + own).drop("before")

    nodes = kind("node", _NODE)
    local = nodes.where("id LIKE '~%'").select("program", "rank", "place", "id", F.split("id", "~")[1].alias("prefix"))
    counted = numbered(local, "nth", "prefix")
    counted = counted.withColumn("new_id", F.concat("prefix", F.lit(":"), F.lpad("nth", F.greatest(F.lit(3), F.length(F.col("nth").cast("string"))), F.lit("0"))))
    names = settled(counted.select(F.col("program").alias("n_program"), F.col("id").alias("old"), "new_id"))

    def renamed(df: DataFrame, column: str) -> DataFrame:
        return df.join(names, (F.col("program") == F.col("n_program")) & (F.col(column) == F.col("old")), "left").withColumn(column, F.coalesce("new_id", column)).drop("n_program", "old", "new_id")

    # the first of equal ids, found where they are before they meet
    named = renamed(nodes, "id")
    rest = [c for c in named.columns if c not in ("id", "rank", "place")]
    nodes = named.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("rank", "program", "place")).alias("n")).select("id", *[f"n.{c}" for c in rest])
    nodes = settled(nodes.select("program", "id", *[c for c in rest if c != "program"]))
    # of an edge's derivation the call has a counted id, the definition's stands as it is
    made = kind("edge", _EDGE).withColumn("call", F.try_element_at("derivation_refs", F.lit(1))).withColumn("definition", F.try_element_at("derivation_refs", F.lit(2)))
    made = renamed(renamed(renamed(made, "src"), "dst"), "call").withColumn("derivation_refs", F.when(F.col("call").isNotNull(), F.array("call", "definition"))).drop("call", "definition")
    edges = settled(numbered(made, "nth"))
    last = kind("library", "name string, value string").groupBy("name").agg(F.max_by("value", F.struct("rank", "program", "place")).alias("value"))
    unwritten = relations.read_never_written(nodes, edges.withColumn("id", F.struct("nth", "program", "line_start")), libraries=last)
    edges = edges.select(F.concat(F.lit("edge:"), F.lpad("nth", F.greatest(F.lit(3), F.length(F.col("nth").cast("string"))), F.lit("0"))).alias("id"), *[c for c in edges.columns if c not in ("nth", "rank", "place")])
    label = F.substring_index("dataset", ":", -1)
    late = unwritten.select(
        F.col("edge.program").alias("program"), F.lit(LATE).alias("rank"), F.col("edge.nth").cast("int").alias("place"), F.lit("dataset_read_never_written").alias("type"), F.lit("SUPPORTED").alias("status"),
        F.lit("INFORMATION").alias("severity"), label.alias("object"), F.concat(label, F.lit(" is read but no program writes it")).alias("message"), F.col("edge.line_start").alias("line_start"), F.array("dataset").alias("affected_nodes"),
    )
    findings = numbered(kind("finding", _FINDING).unionByName(late), "nth")
    number = F.lpad("nth", F.greatest(F.lit(3), F.length(F.col("nth").cast("string"))), F.lit("0"))
    findings = findings.withColumn("node", F.explode_outer("affected_nodes"))
    findings = renamed(findings, "node").groupBy("program", "nth", "type", "status", "severity", "object", "message", "line_start").agg(F.collect_list("node").alias("affected_nodes"))
    findings = findings.select(F.concat(F.lit("finding:"), number, F.lit(":"), "type").alias("id"), *[c for c in findings.columns if c not in ("nth", "place", "node", "affected_nodes")], "affected_nodes", F.array().cast("array<string>").alias("affected_edges"))
    return nodes, settled(edges), settled(findings)
