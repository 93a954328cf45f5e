"""Included files in place: one order over the statements and comments of a program and of all that it includes.

A path is read as it stands; one with a macro reference stays open.  Relative paths start at the folder of the file
that includes.  An include that is not followed keeps its statement, behind a finding that tells why; a file's own
finding about text that never ends stands behind its last statement.  Pieces are numbered once, after splicing, so
definitions, bindings, sorts and ids of included files share one clock with those around them.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Mapping
from pathlib import PurePosixPath

from .config import inside, prohibited
from .lexer import Piece, lex

_INCLUDE = re.compile(r"%include\s+[\"']([^\"']+)[\"']", re.I)
_SCHEME = re.compile(r"[a-z][a-z0-9+.-]*://[^/]*|file:(?=/)", re.I)


def written(statement: str) -> str | None:
    """The path that an include statement names, as it stands."""
    m = _INCLUDE.match(statement)
    return m[1] if m else None


def place_of(raw: str, file: str) -> str:
    """The path of what `file` includes as `raw`."""
    scheme = _SCHEME.match(raw) or _SCHEME.match(file)
    head = scheme[0] if scheme else ""
    base = posixpath.dirname(file[len(head) :] if file.startswith(head) else file)
    return head + posixpath.normpath(posixpath.join(base, raw.removeprefix(head)))


def targets(path: str, text: str) -> list[str]:
    """The files that a file includes by a known path."""
    some = (written(p.text) for p in lex(text).pieces if p.kind == "statement")
    return list(dict.fromkeys(place_of(raw, path) for raw in some if raw and "&" not in raw))


def _rejected(raw: str, place: str, opened: tuple[str, ...], files: Mapping[str, str | None], roots: list[str] | None) -> tuple[str, str] | None:
    """(type, message) of why an include is not followed, in the order of the checks; None where it is."""
    if place in opened:
        return "include_cycle_detected", " > ".join((*opened, place))
    if why := prohibited(PurePosixPath(place)):
        return "include_prohibited_artifact", f"{raw}: {why}"
    if roots is not None and not inside(PurePosixPath(place), [PurePosixPath(r) for r in roots]):
        return "include_outside_allowed_roots", f"{place} is outside the allowed roots"
    if place not in files:
        return "include_file_missing", f"{place} does not exist"
    if files[place] is None:
        return "include_file_unreadable", f"{place} cannot be read"
    return None


def spliced(path: str, text: str, files: Mapping[str, str | None], roots: list[str] | None = None) -> list[Piece]:
    """Statements, comments and findings (their type as text) in order, each with the file it stands in."""
    out: list[Piece] = []

    def put(file: str, words: str, opened: tuple[str, ...]) -> None:
        scanned = lex(words)
        for p in scanned.pieces:
            p.file = file
            raw = written(p.text) if p.kind == "statement" else None
            if raw is None:
                out.append(p)
                continue
            if "&" in raw:
                why = ("include_path_unresolved", f"{raw} holds a macro reference")
            else:
                place = place_of(raw, file)
                why = _rejected(raw, place, opened, files, roots)
            if why:
                out.append(Piece("finding", why[0], p.line_start, p.line_end, file=file, note=why[1]))
                out.append(p)
            else:
                put(place, files[place] or "", (*opened, place))
        out.extend(Piece("finding", kind, line, line, file=file) for kind, line in scanned.findings)

    put(path, text, (path,))
    for k, p in enumerate(x for x in out if x.kind != "finding"):
        p.order = k
    return out
