"""The graph's vocabulary as data: node types, edge types with their legal endpoints, schema versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Node types.
NODE_TYPES = (
    "CommentBlock CommentedStatement ConditionalBranch Dataset ExternalFile InactiveEvidence Library MacroCall MacroConditional MacroConflict "
    "MacroContract MacroDefinition MacroLoop MacroParameter MacroSourceFile MacroVariable Program SetupFile SqlBlock SqlStatement Step "
    "UnknownDataset UnknownMacro UnknownVariable Variable"
).split()

# Edge type, types it may come from, types it may go to.
ENDPOINTS = """
calls_macro: Program SetupFile > MacroCall
comment_mentions_dataset: CommentBlock > InactiveEvidence
comment_mentions_macro: CommentBlock > InactiveEvidence
conditional_candidate: MacroConditional MacroLoop > ConditionalBranch
conditioned_by: Variable UnknownVariable > Step MacroCall
conditioned_by: Variable > SqlStatement
contains_sql_statement: SqlBlock > SqlStatement
contains_step: Program SetupFile > Step SqlBlock
defined_in: MacroDefinition > Program SetupFile MacroSourceFile
defines_macro_variable: SetupFile Program > MacroVariable
depends_on: Dataset UnknownDataset > Dataset UnknownDataset
derives: Step MacroCall > Variable UnknownVariable
derives: SqlStatement > Variable
filters_dataset: Variable UnknownVariable > SqlStatement
groups_by: Variable UnknownVariable > SqlStatement
has_control_flow: MacroDefinition > MacroConditional MacroLoop
implemented_by: MacroCall > MacroConflict MacroDefinition UnknownMacro MacroContract
inactive_candidate_depends_on: InactiveEvidence > InactiveEvidence
inactive_candidate_reads: CommentedStatement > InactiveEvidence
inactive_candidate_writes: CommentedStatement > InactiveEvidence
joins_on: Variable UnknownVariable > SqlStatement
passes_parameter: MacroCall > MacroParameter
reads_dataset: Dataset UnknownDataset > Step MacroCall SqlStatement
reads_external_file: ExternalFile > Dataset UnknownDataset
reads_variable: Variable UnknownVariable > Step MacroCall SqlStatement
resolves_to: MacroParameter > UnknownDataset
sorts_by: Variable UnknownVariable > SqlStatement
writes_dataset: Step MacroCall SqlStatement > Dataset UnknownDataset
writes_external_file: Dataset UnknownDataset > ExternalFile
writes_variable: Step MacroCall > Variable UnknownVariable
writes_variable: SqlStatement > Variable
"""

EVIDENCE_KINDS = ("OBSERVED", "RESOLVED", "CONTRACT_DERIVED", "HEURISTIC", "UNKNOWN")
RESOLUTIONS = ("EXACT", "PARTIAL", "UNRESOLVED", "NOT_ATTEMPTED")
SCHEMA_VERSIONS = ("0.2.0", "0.3.0")


def endpoint_pairs() -> list[tuple[str, str, str]]:
    out = []
    for line in ENDPOINTS.strip().splitlines():
        kind, _, ends = line.partition(": ")
        src, _, dst = ends.partition(" > ")
        out += [(kind, a, b) for a in src.split() for b in dst.split()]
    return sorted(set(out))


EDGE_TYPES = tuple(sorted({k for k, _, _ in endpoint_pairs()}))


def pairs_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(endpoint_pairs(), "edge_type string, from_type string, to_type string")
