"""Contract documents of macros: Markdown with a heading, a purpose, a parameter table and examples."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .macros import bracketed

SCHEMA = "macro string, purpose string, parameters map<string,struct<required:boolean,default:string>>, examples array<string>, path string, errors array<string>"


def _cells(line: str) -> list[str]:
    cells = re.split(r"(?<!\\)\|", line.strip().strip("|"))
    return [html.unescape(re.sub(r"<br\s*/?>", " ", c.replace("\\|", "|"))).strip() for c in cells]


def parse(path: str, text: str) -> dict:
    """One document's contract; what is missing is listed in errors."""
    heading = re.search(r"^#\s+%?(\w+)\s*$", text, re.M)
    purpose = re.search(r"^##\s+Purpose\s*$(.*?)(?=^#|\Z)", text, re.M | re.S | re.I)
    parameters, errors, at = {}, [], None
    for line in text.splitlines():
        if not line.strip().startswith("|"):
            at = None
            continue
        cells = _cells(line)
        if at is None:
            low = [c.lower() for c in cells]
            at = (low.index("parameter"), low.index("default value")) if "parameter" in low and "default value" in low else ()
        elif at and not set("".join(cells)) <= set("-: ") and max(at) < len(cells):
            name, default = cells[at[0]].strip("`").lower(), cells[at[1]].strip("`")
            if name in parameters:
                errors.append(f"parameter {name} twice")
            parameters[name] = {"required": default.upper() == "REQUIRED", "default": None if default.upper() == "REQUIRED" else default}
    if not heading:
        errors.append("no heading")
    if not parameters:
        errors.append("no parameter table")
    name = heading[1] if heading else ""
    starts = [(m.start(), m.end() - 1) for m in re.finditer(rf"%{re.escape(name)}\s*\(", text, re.I)] if name else []
    # to the bracket that closes the first one, whatever strings and brackets stand between
    examples = list(dict.fromkeys(text[a:end] for a, b in starts if (end := bracketed(text, b)) > 0))
    return {"macro": name.lower(), "purpose": purpose[1].strip() if purpose else None, "parameters": parameters, "examples": examples, "path": path, "errors": errors}


def read_contracts(documents: DataFrame) -> DataFrame:
    """documents: path, text.  Documents of one macro name poison each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse(p, t or "") for p, t in zip(batch["path"], batch["text"], strict=True)], columns=["macro", "purpose", "parameters", "examples", "path", "errors"])

    found = documents.select("path", "text").mapInPandas(run, SCHEMA)
    twice = found.groupBy(F.col("macro").alias("m")).agg(F.count("*").alias("n"))
    doubled = F.when(F.col("n") > 1, F.array(F.lit("several documents"))).otherwise(F.array().cast("array<string>"))
    return found.join(twice, F.col("macro") == F.col("m")).withColumn("errors", F.concat("errors", doubled)).drop("m", "n")


def wanted(documents: DataFrame, roots: list[str], called: DataFrame) -> DataFrame:
    """The documents that a run needs.  Where any macro of the documented kind is called, these are the files directly in a
    root that have a called name, whatever its case; where none is, all files below the roots."""
    if called.isEmpty():
        return documents
    flat = F.regexp_extract("path", r"^(.*)/[^/]*$", 1).isin(*roots)
    stem = F.lower(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))
    return documents.where(flat).join(called.select(F.lower("name").alias("called")), stem == F.col("called"), "left_semi")


def match_parameters(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """(call, name, state): matched, missing (required and not passed) or unknown to the document.
    calls: call, macro, name."""
    asked = contracts.where(F.size("errors") == 0).select("macro", F.explode("parameters").alias("name", "rule"))
    each = calls.select("call", "macro").distinct().join(asked, "macro").select("call", "name", F.col("rule.required").alias("required"))
    passed = calls.select("call", F.lower("name").alias("name"), F.lit(True).alias("passed"))
    state = F.when(F.col("passed").isNull(), "missing").when(F.col("required").isNull(), "unknown").otherwise("matched")
    return each.join(passed, ["call", "name"], "full").where("passed IS NOT NULL OR required").select("call", "name", state.alias("state"))
