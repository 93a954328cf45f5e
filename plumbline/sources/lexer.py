"""Program text into statements, comments and findings; pure functions of one file's text."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_STEP = re.compile(r"/\*|'|\"|;|[^/'\";]+|/", re.S)


@dataclass
class Piece:
    """A statement or comment with its lines; `order` counts pieces of a file, or of a program and what it includes,
    from 0."""

    kind: str  # statement, comment; finding behind splicing, with its type as text
    text: str
    line_start: int
    line_end: int
    order: int = 0
    terminated: bool = True
    file: str = ""
    note: str = ""


@dataclass
class Lexed:
    pieces: list[Piece] = field(default_factory=list)
    findings: list[tuple[str, int]] = field(default_factory=list)  # type, line


def lex(text: str) -> Lexed:
    """Statements end at semicolons outside quotes and comments.  `*` and `%*` open a comment only where a
    statement begins.  A string or comment that never ends is a finding and stops the scan."""
    text = text.removeprefix("﻿")
    starts = [0, *[m.end() for m in re.finditer("\n", text)]]
    line = lambda at: bisect_right(starts, at)
    out, held, begin, at = Lexed(), [], None, 0

    def put(kind: str, words: str, a: int, b: int, ended: bool = True) -> None:
        words = " ".join(words.split())
        if words:
            out.pieces.append(Piece(kind, words, line(a), line(max(a, b - 1)), len(out.pieces), ended))

    while at < len(text):
        if not "".join(held).strip():
            opening = re.compile(r"\s*(%?\*)").match(text, at)
            if opening:
                end = text.find(";", opening.end())
                if end < 0:
                    out.findings.append(("unterminated_comment", line(opening.start(1))))
                    return out
                put("comment", text[opening.start(1) : end], opening.start(1), end)
                at, held, begin = end + 1, [], None
                continue
        m = _STEP.match(text, at)
        token = m[0]
        if token == "/*":
            end = text.find("*/", at + 2)
            if end < 0:
                out.findings.append(("unterminated_comment", line(at)))
                return out
            put("comment", text[at + 2 : end], at, end + 2)
            held.append(" ")
            at = end + 2
            continue
        if token in "'\"":
            end = at + 1
            while True:
                end = text.find(token, end)
                if end < 0:
                    out.findings.append(("unterminated_string", line(at)))
                    return out
                if text[end + 1 : end + 2] != token:
                    break
                end += 2
            begin = at if begin is None else begin
            held.append(text[at : end + 1])
            at = end + 1
            continue
        if token == ";":
            if begin is not None:
                put("statement", "".join(held), begin, at)
            held, begin, at = [], None, at + 1
            continue
        if begin is None and token.strip():
            begin = at + len(token) - len(token.lstrip())
        held.append(token)
        at = m.end()
    if begin is not None:
        put("statement", "".join(held), begin, len(text), ended=False)
    return out


@dataclass
class Block:
    """A data step, a procedure, or a statement that stands alone."""

    kind: str  # data, proc name, or "" for one that stands alone
    pieces: list[Piece]
    closed: bool = True


_OPEN = re.compile(r"(data|proc)\b\s*(\w*)", re.I)


def blocks(pieces: list[Piece]) -> list[Block]:
    """A block opens at data or proc and closes at run (procedures also at quit) or at the next opener."""
    out: list[Block] = []
    now: Block | None = None
    for p in pieces:
        if p.kind != "statement":
            continue
        opens = _OPEN.match(p.text)
        if opens and not re.match(r"data\s*=", p.text, re.I):
            if now:
                now.closed = False
            now = Block("data" if opens[1].lower() == "data" else opens[2].lower(), [p])
            out.append(now)
        elif now is None or p.text.startswith("%") or re.match(r"libname\b", p.text, re.I):
            out.append(Block("", [p]))
        else:
            now.pieces.append(p)
            if re.fullmatch(r"run", p.text, re.I) or (now.kind != "data" and re.fullmatch(r"quit", p.text, re.I)):
                now = None
    if now:
        now.closed = False
    return out


def masked(text: str) -> str:
    """The same length with the insides of strings blanked."""
    return re.sub(r"'[^']*'|\"[^\"]*\"", lambda m: m[0][0] + " " * (len(m[0]) - 2) + m[0][-1], text)


def split_top(text: str, by: str = ",") -> list[str]:
    """Parts between separators outside strings and parentheses."""
    out, depth, last, plain = [], 0, 0, masked(text)
    for i, c in enumerate(plain):
        depth += (c == "(") - (c == ")")
        if c == by and depth == 0:
            out.append(text[last:i].strip())
            last = i + 1
    return [*out, text[last:].strip()]
