"""A project's declared context: which programs, which setup, where macros and contracts are, where results go.

Every problem of a configuration is told at once; nothing outside the declared roots and nothing prohibited is
ever opened.  Paths are relative to the configuration file.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

# Files that are never read, by ending or by a folder of their path.
SUFFIXES = (".sas7bdat", ".sas7bndx", ".sas7bcat", ".xpt", ".log", ".lst")
SEGMENTS = ("production", "prod", "logs", "outputs", "mprint")


@dataclass
class Problem:
    key: str
    type: str
    message: str
    status: str = "BLOCKED"
    severity: str = "ERROR"


@dataclass
class Config:
    programs: list[Path] = field(default_factory=list)
    setup: Path | None = None
    roots: list[Path] = field(default_factory=list)
    macro_roots: list[Path] = field(default_factory=list)
    contracts: list[Path] = field(default_factory=list)
    output: Path | None = None
    os_base: str | None = None
    problems: list[Problem] = field(default_factory=list)

    @property
    def blocked(self) -> bool:
        return any(p.status == "BLOCKED" for p in self.problems)


def prohibited(path: Path) -> str | None:
    """Why a path may not be read, or None."""
    if path.suffix.lower() in SUFFIXES:
        return f"ending {path.suffix}"
    return next((f"folder {part}" for part in path.parts if part.casefold() in SEGMENTS), None)


def inside(path: Path, roots: list[Path]) -> bool:
    return any(path == root or root in path.parents for root in roots)


def _listed(value) -> list:
    return [] if value in (None, "") else list(value) if isinstance(value, list) else [value]


def read(path: str) -> Config:
    import yaml

    out, here = Config(), Path(path).resolve().parent
    told = lambda key, kind, message, **more: out.problems.append(Problem(key, kind, message, **more))
    try:
        body = yaml.safe_load(Path(path).read_text(encoding="utf-8-sig"))
    except yaml.YAMLError as error:
        told(path, "config_malformed_yaml", str(error).splitlines()[0])
        return out
    if not isinstance(body, dict):
        told(path, "config_malformed_yaml", "the configuration is no mapping")
        return out
    place = lambda raw: (here / str(raw)).resolve()
    out.roots = [place(r) for r in _listed(body.get("allowed_roots"))]
    if not out.roots:
        told("allowed_roots", "config_missing_key", "allowed_roots is not declared")

    def source(key: str, raw) -> Path | None:
        """Containment is settled before a file is touched."""
        if raw in (None, ""):
            return told(key, "config_missing_key", f"{key} is not declared")
        own = place(raw)
        if why := prohibited(own):
            return told(key, "config_prohibited_artifact", f"{own}: {why}")
        if not inside(own, out.roots):
            return told(key, "config_outside_allowed_roots", f"{own} is outside allowed_roots")
        if not own.exists():
            return told(key, "config_file_missing", f"{own} does not exist")
        try:
            own.read_bytes()
        except OSError as error:
            return told(key, "config_file_unreadable", f"{own}: {error.strerror}")
        return own

    out.programs = [p for raw in _listed(body.get("main_program")) or [None] if (p := source("main_program", raw))]
    setups = _listed(body.get("setup_file"))
    if len(setups) > 1:
        told("setup_file", "config_multiple_setup_files", f"{len(setups)} setup files are declared")
    else:
        out.setup = source("setup_file", setups[0] if setups else None)
    for key, where in (("macro_roots", out.macro_roots), ("macro_contracts", out.contracts)):
        for raw in _listed(body.get(key)):
            own = place(raw)
            if why := prohibited(own):
                told(key, "config_prohibited_artifact", f"{own}: {why}")
            elif not inside(own, out.roots):
                told(key, "config_outside_allowed_roots", f"{own} is outside allowed_roots")
            elif not own.is_dir():
                told(key, "config_declared_root_missing", f"{own} does not exist", status="NOT_EXECUTED", severity="WARNING")
            else:
                where.append(own)
    if body.get("output_dir") in (None, ""):
        told("output_dir", "config_missing_key", "output_dir is not declared")
    else:
        out.output = place(body["output_dir"])
    if body.get("os_fvars_base") not in (None, ""):
        out.os_base = str(body["os_fvars_base"])
    return out
