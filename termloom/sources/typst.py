"""Prose of Typst markup, and where in the source it stands.

A scanner yields the markup's text and white space with their places. Code, maths, raw text, labels,
references, links and comments are passed over; content in brackets within code is markup again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

LINK = re.compile(r"https?://[^\s<>\"\[\](){}]*")
LABEL = re.compile(r"<[\w.:-]+>")
REF = re.compile(r"@[\w:-]+(?:\.[\w:-]+)*")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\s\\/*_`$<@#\"'\[\]~.\-=+:]+|.", re.DOTALL)
NAME = re.compile(r"[^\W\d][\w-]*")
STATEMENT = re.compile(r"(?:let|set|show|import|include|return|context|if|for|while)\b")
SHORTHAND = re.compile(r"\.\.\.|---|--|-\?|~")
#: Words of characters that begin nothing but text, with single spaces between them; no link begins within.
PLAIN = r"(?:[^\s\\/*_`$<@#\"'\[\]~.\-=+:h]|h(?!ttps?://))+"
RUN = re.compile(rf"{PLAIN}(?: {PLAIN})*")


class Scanner:
    """Tokens (kind, start, end): text, space, parbreak, linebreak, quote, escape; ``heading`` prefixed within one."""

    def __init__(self, source: str):
        self.s, self.n = source, len(source)

    def string(self, i: int) -> int:
        i += 1
        while i < self.n and self.s[i] != '"':
            i += 2 if self.s[i] == "\\" else 1
        return i + 1

    def comment(self, i: int) -> int:
        """The end of a comment at i, or i."""
        if self.s.startswith("//", i):
            end = self.s.find("\n", i)
            return self.n if end < 0 else end
        if self.s.startswith("/*", i):
            depth, j = 1, i + 2
            while j < self.n and depth:
                if self.s.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                elif self.s.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                else:
                    j += 1
            return j
        return i

    def raw(self, i: int) -> int:
        ticks = len(re.compile("`+").match(self.s, i)[0])
        if ticks == 2:
            return i + 2
        end = self.s.find("`" * ticks, i + ticks)
        return self.n if end < 0 else end + ticks

    def maths(self, i: int) -> int:
        i += 1
        while i < self.n and self.s[i] != "$":
            i = self.string(i) if self.s[i] == '"' else i + 2 if self.s[i] == "\\" else i + 1
        return i + 1

    def group(self, i: int, heading: bool) -> Iterator:
        """Code between brackets that opens at i; returns its end. Content blocks within give tokens."""
        close = {"(": ")", "{": "}"}[self.s[i]]
        i += 1
        while i < self.n and self.s[i] != close:
            i = yield from self.code_part(i, heading)
        return i + 1

    def code_part(self, i: int, heading: bool) -> Iterator:
        c = self.s[i]
        if (end := self.comment(i)) > i:
            return end
        if c == '"':
            return self.string(i)
        if c == "`":
            return self.raw(i)
        if c == "$":
            return self.maths(i)
        if c == "[":
            return (yield from self.content(i, heading))
        if c in "({":
            return (yield from self.group(i, heading))
        return i + 1

    def content(self, i: int, heading: bool) -> Iterator:
        end = yield from self.markup(i + 1, heading, "]")
        return end + 1

    def code(self, i: int, heading: bool) -> Iterator:
        """What follows a hash at i - 1: a statement to its line's end, or an expression with its calls."""
        if STATEMENT.match(self.s, i):
            while i < self.n and self.s[i] not in "\n;]":
                i = yield from self.code_part(i, heading)
            return i + 1 if i < self.n and self.s[i] == ";" else i
        if i < self.n and self.s[i] in "({":
            i = yield from self.group(i, heading)
        elif i < self.n and self.s[i] == "[":
            i = yield from self.content(i, heading)
        elif i < self.n and self.s[i] == '"':
            i = self.string(i)
        elif m := NAME.match(self.s, i):
            i = m.end()
        elif m := re.compile(r"[\d.]+\w*").match(self.s, i):
            return m.end()
        while i < self.n:
            if self.s[i] == "(":
                i = yield from self.group(i, heading)
            elif self.s[i] == "[":
                i = yield from self.content(i, heading)
            elif self.s[i] == "." and (m := NAME.match(self.s, i + 1)):
                i = m.end()
            else:
                break
        return i + 1 if i < self.n and self.s[i] == ";" else i

    def markup(self, i: int, heading: bool = False, close: str = "") -> Iterator:
        s, start_of_line, outer, depth = self.s, True, heading, 0
        while i < self.n:
            c = s[i]
            if c == close and not depth:
                return i
            if (not start_of_line or c.isalpha()) and (m := RUN.match(s, i)):
                yield ("text", i, m.end(), heading)
                i, start_of_line = m.end(), False
                continue
            if m := SPACE.match(s, i):
                lines = m[0].count("\n")
                heading = outer if lines else heading
                yield ("parbreak" if lines > 1 else "space", i, m.end(), heading)
                i, start_of_line = m.end(), start_of_line or lines > 0
                continue
            if start_of_line:
                start_of_line = False
                if m := re.compile(r"=+(?=[ \t\n]|$)").match(s, i):
                    heading, i = True, m.end()
                    continue
                if m := re.compile(r"(?:[-+]|\d+\.)(?=\s)").match(s, i):
                    i, start_of_line = m.end(), False
                    continue
                if m := re.compile(r"/(?=\s+[^\n:]+:)").match(s, i):
                    colon = s.index(":", i)
                    part = yield from Scanner(s[:colon]).markup(m.end(), heading)
                    i = part + 1
                    continue
            if (end := self.comment(i)) > i:
                i, start_of_line = end, False
            elif m := LINK.match(s, i):
                i = m.end()
            elif c == "\\":
                if i + 1 < self.n and not s[i + 1].isspace():
                    m = re.compile(r"\\u\{[0-9a-fA-F]+\}").match(s, i)
                    end = m.end() if m else i + 2
                    yield ("escape", i, end, heading)
                    i = end
                else:
                    yield ("linebreak", i, i + 1, heading)
                    i += 1
            elif c == "`":
                i = self.raw(i)
            elif c == "$":
                i = self.maths(i)
            elif m := LABEL.match(s, i):
                i = m.end()
            elif m := REF.match(s, i):
                i = m.end()
                if i < self.n and s[i] == "[":
                    skipped = self.content(i, heading)
                    i = _finish(skipped)
            elif c == "#" and re.compile(r"#[\w({\[\"]").match(s, i):
                i = yield from self.code(i + 1, heading)
            elif c in "\"'":
                yield ("quote", i, i + 1, heading)
                i += 1
            elif c in "*_" and not (i and s[i - 1].isalnum() and i + 1 < self.n and s[i + 1].isalnum()):
                i += 1
            elif m := SHORTHAND.match(s, i):
                i = m.end()
            else:
                j = i
                while j < self.n and not (j > i and (s[j].isspace() or s[j] in "\\`$<@#\"'" or s[j] == close and not depth or self.comment(j) > j or LINK.match(s, j) or SHORTHAND.match(s, j))):
                    if s[j] in "*_" and not (s[j - 1 : j].isalnum() and s[j + 1 : j + 2].isalnum()) and j > i:
                        break
                    depth += (s[j] == "[") - (s[j] == "]") if close else 0
                    j += 1
                yield ("text", i, j, heading)
                i = j
        return i


def _finish(steps) -> int:
    """Run a part of the scan without its tokens; its end."""
    while True:
        try:
            next(steps)
        except StopIteration as done:
            return done.value


def scan(source: str) -> list[tuple[str, int, int, bool]]:
    return list(Scanner(source).markup(0))


def joined(tokens: list[tuple[str, int, int, bool]]) -> Iterator[tuple[str, int, int, bool]]:
    """Text with the single spaces within a line between its words is one token, as the words of a line are."""
    held = None
    for i, t in enumerate(tokens):
        if held and t[0] == "text" and held[0] == "text" and held[2] == t[1] and held[3] == t[3]:
            held = ("text", held[1], t[2], t[3])
            continue
        after = tokens[i + 1] if i + 1 < len(tokens) else None
        if held and held[0] == "text" and t[0] == "space" and t[2] - t[1] == 1 and held[2] == t[1] and after and after[0] == "text" and after[1] == t[2] and after[3] == held[3]:
            held = ("text", held[1], t[2], held[3])
            continue
        if held:
            yield held
        held = t
    if held:
        yield held


def extract_prose(source: str) -> str:
    return prose_of(source, scan(source))


def prose_of(source: str, tokens: list[tuple[str, int, int, bool]]) -> str:
    out, last = [], ""

    def put(x: str) -> None:
        nonlocal last
        if x:
            out.append(x)
            last = x[-1]

    for kind, start, end, heading in joined(tokens):
        if kind == "text" and not heading:
            put(" " if last and last not in "\n " else "")
            put(source[start:end])
        elif kind == "quote" and not heading:
            put('"')
        elif kind in ("parbreak", "linebreak"):
            put("\n")
        elif kind == "space" and last and last not in "\n ":
            put(" ")
        elif kind == "escape" and not heading:
            put(source[start + 1 : end])
    return "".join(out).strip()


def prose_ranges(source: str) -> list[tuple[int, int]]:
    """Character ranges of text and single white space outside headings, touching ones merged."""
    return ranges_of(scan(source))


def ranges_of(tokens: list[tuple[str, int, int, bool]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for kind, start, end, heading in tokens:
        if kind in ("text", "space") and not heading:
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
    return [tuple(x) for x in merged]
