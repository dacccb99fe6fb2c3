"""Prose of Markdown: paragraphs, lists, links' and images' text; no headings, code or HTML."""

from __future__ import annotations

import html
import re

from termloom.sources.frontmatter import strip

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]|$)")
SETEXT = re.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
QUOTE = re.compile(r"^ {0,3}> ?")
ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(?=\S)|[ \t]*$)")
HTML = re.compile(r"^ {0,3}<(?:/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$)|!--|\?|![A-Z])")
DEFINITION = re.compile(r"^ {0,3}\[[^\]]+\]:[ \t]*\S+")
INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<code>(?<!`)(?P<ticks>`+)(?!`)(?P<body>.+?)(?<!`)(?P=ticks)(?!`))|(?P<auto><(?P<url>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>]+)>)"
    r"|(?P<tag></?[A-Za-z][^<>]*>|<!--.*?-->)|(?P<entity>&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)|(?P<hard>(?: {2,}|\\)\n[ \t]*)|(?P<soft> ?\n[ \t]*)"
    r"|(?P<open>!?\[)|(?P<close>\](?:\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)|\[[^\]]*\])?)|(?P<run>\*+|_+)",
    re.DOTALL,
)


class Prose:
    """Collects text events: a space goes before each unless the text so far ends in white space."""

    def __init__(self):
        self.parts: list[str] = []
        self.last = ""

    def text(self, x: str) -> None:
        if x:
            if self.last and self.last not in "\n ":
                self.parts.append(" ")
            self.parts.append(x)
            self.last = x[-1]

    def line(self) -> None:
        self.parts.append("\n")
        self.last = "\n"


def inline(source: str, out: Prose) -> None:
    """Text events of a paragraph's content. Emphasis marks end an event even where nothing is shown for them."""
    at, waiting, brackets = 0, "", 0

    def flush() -> None:
        nonlocal waiting
        out.text(waiting)
        waiting = ""

    for m in INLINE.finditer(source):
        waiting += source[at : m.start()]
        at = m.end()
        kind = m.lastgroup if m.lastgroup not in ("ticks", "body", "url") else ("code" if m["code"] else "auto")
        if kind == "escape":
            flush()
            waiting = m[0][1]
        elif kind in ("code", "tag"):
            flush()
        elif kind == "auto":
            flush()
            out.text(m["url"])
        elif kind == "entity":
            flush()
            out.text(html.unescape(m[0]))
        elif kind in ("hard", "soft"):
            waiting = waiting.rstrip(" ") if kind == "soft" else waiting
            flush()
            out.line()
        elif kind == "open":
            flush()
            brackets += 1
            if "](" not in source[at:] and "][" not in source[at:]:
                waiting = m[0]
                brackets -= 1
        elif kind == "close":
            if brackets and len(m[0]) > 1:
                flush()
                brackets -= 1
            else:
                waiting += m[0]
        elif kind == "run":
            before, after = source[m.start() - 1 : m.start()], source[at : at + 1]
            inside = before.isalnum() and after.isalnum()
            if before.isspace() and after.isspace() or not before and after.isspace() or m[0][0] == "_" and inside:
                waiting += m[0]
            else:
                flush()
    waiting += source[at:]
    flush()


def blocks(lines: list[str], out: Prose, in_item: bool = False) -> None:
    """Walk the blocks of a document or of a container's content."""
    i, paragraph = 0, []

    def end() -> None:
        if paragraph:
            inline("\n".join(x.strip(" \t") if k else x.lstrip() for k, x in enumerate(paragraph)).rstrip(), out)
            out.line()
            paragraph.clear()

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            end()
            i += 1
        elif fence := FENCE.match(line):
            end()
            mark = fence[1]
            i += 1
            while i < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i]):
                i += 1
            i += 1
        elif ATX.match(line):
            end()
            i += 1
        elif paragraph and SETEXT.match(line):
            paragraph.clear()  # the lines so far were a heading
            i += 1
        elif RULE.match(line):
            end()
            i += 1
        elif QUOTE.match(line):
            end()
            part = []
            while i < len(lines) and (QUOTE.match(lines[i]) or part and lines[i].strip() and not ITEM.match(lines[i]) and not FENCE.match(lines[i]) and not ATX.match(lines[i])):
                part.append(QUOTE.sub("", lines[i], count=1))
                i += 1
            blocks(part, out)
        elif (item := ITEM.match(line)) and not (paragraph and (not item[3] or item[2][:-1].isdigit() and item[2][:-1] != "1")):
            end()
            width = len(item[1]) + len(item[2]) + min(len(item[3] or " "), 4)
            part = [line[width:]]
            i += 1
            while i < len(lines):
                follows = lines[i]
                if not follows.strip():
                    part.append("")
                elif len(follows) - len(follows.lstrip(" ")) >= width:
                    part.append(follows[width:])
                elif part[-1].strip() and not ITEM.match(follows) and not any(x.match(follows) for x in (FENCE, ATX, RULE, QUOTE)):
                    part.append(follows.lstrip())
                else:
                    break
                i += 1
            blocks(part, out, True)
            if out.last != "\n":
                out.line()
        elif not paragraph and line.startswith(("    ", "\t")):
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                i += 1
        elif not paragraph and HTML.match(line):
            while i < len(lines) and lines[i].strip():
                i += 1
        elif not paragraph and DEFINITION.match(line):
            i += 1
        else:
            paragraph.append(line)
            i += 1
    end()


def extract_prose(text: str) -> str:
    out = Prose()
    blocks(strip(text).replace("\r\n", "\n").split("\n"), out)
    return "".join(out.parts).strip()
