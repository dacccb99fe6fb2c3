"""YAML front matter: the block between two lines of three hyphens at a text's start."""

from __future__ import annotations

import re

FRONT = re.compile(r"\A\s*---\r?\n(?:.*?\n)??[ \t]*---[ \t]*(?:\r?\n|\Z)", re.DOTALL)


def strip(text: str) -> str:
    """The text without its front matter; unchanged where that isn't closed."""
    return FRONT.sub("", text, count=1)
