"""Licence scan: identifier tags and notice phrases by Aho-Corasick, licence expressions by shunting-yard.

One automaton runs over a text's words; it finds notice phrases, licence identifiers and the tag that
opens an expression. Expressions are then parsed where the tag stands in the text itself.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from termloom.llm.common import map_arrow, with_fields

#: Phrases whose places are the base result, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases and identifiers as words, their labels, and how sure they are.
MORE = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "redistribution and use in source and binary forms with or without modification": ("bsd", 0.9),
    "bsd license": ("bsd", 0.7),
    "isc license": ("isc", 0.7),
    "mozilla public license": ("mpl", 0.8),
    "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "boost software license": ("bsl", 0.8),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons zero": ("cc0", 0.8),
    "licensed under cc by": ("cc-by", 0.8),
    "licensed under cc by sa": ("cc-by-sa", 0.8),
    "licensed under cc by nc": ("cc-by-nc", 0.8),
    "licensed under cc by nd": ("cc-by-nd", 0.8),
    "released into the public domain": ("public-domain", 0.7),
    "this is free and unencumbered software": ("unlicense", 0.9),
    "all rights reserved": ("all-rights-reserved", 0.4),
}
BASE_SURE = 0.7
TAG = "spdx license identifier"
TAG_SURE = 0.95
TAG_AT = re.compile(r"spdx-license-identifier:[ \t]*([^\n]*)", re.IGNORECASE)
#: An identifier's label by its start, and whether it is permissive.
FAMILIES = {
    "mit": ("mit", True), "apache": ("apache", True), "bsd": ("bsd", True), "isc": ("isc", True), "zlib": ("zlib", True), "unlicense": ("unlicense", True),
    "bsl": ("bsl", True), "cc0": ("cc0", True), "cc-by-nc": ("cc-by-nc", False), "cc-by-nd": ("cc-by-nd", False), "cc-by-sa": ("cc-by-sa", False),
    "cc-by": ("cc-by", True), "gpl": ("gpl", False), "lgpl": ("lgpl", False), "agpl": ("agpl", False), "mpl": ("mpl", False), "epl": ("epl", False),
}
#: Bytes to words: A-Z lower-cased, what is no word character to a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, permissive boolean, score double"


@cache
def automaton() -> ahocorasick.Automaton:
    """Every phrase between spaces, so that only whole words match."""
    made = ahocorasick.Automaton()
    for phrase in [*BASE, *MORE, TAG]:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


def family(identifier: str) -> tuple[str, bool]:
    """Label of a licence identifier and whether it is permissive; unknown ones are labels of their own."""
    name = identifier.lower().rstrip("+")
    best = max((x for x in FAMILIES if name == x or name.startswith((f"{x}-", f"{x}."))), key=len, default=None)
    return FAMILIES[best] if best else (f"spdx:{name}", False)


def evaluate(expression: str) -> tuple[set[str], bool] | None:
    """Labels of a licence expression and whether it can be met by permissive licences alone.

    Shunting-yard: ``with`` binds before ``and``, ``and`` before ``or``; equals associate to the left. What
    follows a complete expression (a comment's end, say) is left out. None if there is no expression.
    """
    binds = {"or": 1, "and": 2, "with": 3}
    values: list[tuple[set[str], bool]] = []
    pending: list[str] = []
    wants_value = True
    deep = 0

    def apply() -> None:
        how, right, left = pending.pop(), values.pop(), values.pop()
        labels = left[0] if how == "with" else left[0] | right[0]
        met = left[1] if how == "with" else left[1] and right[1] if how == "and" else left[1] or right[1]
        values.append((labels, met))

    for token in re.findall(r"[()]|[A-Za-z0-9.+-]+|[^\s]", expression):
        low = token.lower()
        if wants_value:
            if token == "(":
                pending.append(token)
                deep += 1
            elif low in binds or not re.match(r"[A-Za-z0-9]", token):
                break
            else:
                name, free = family(token)
                values.append(({name}, free))
                wants_value = False
        elif token == ")" and deep:
            while pending[-1] != "(":
                apply()
            pending.pop()
            deep -= 1
        elif low in binds:
            while pending and pending[-1] != "(" and binds[pending[-1]] >= binds[low]:
                apply()
            pending.append(low)
            wants_value = True
        else:
            break
    if wants_value and pending and pending[-1] != "(":
        pending.pop()  # an operator without a right side
    while pending:
        if pending[-1] == "(":
            pending.pop()
        else:
            apply()
    return values[-1] if values else None


def scan(text: str | None) -> tuple:
    """The values of FIELDS for a text."""
    text = text or ""
    words = text.encode().translate(WORDS).split()
    stream = f" {b' '.join(words).decode()} "
    places: list[int] = []
    base, sure = set(), {}
    tagged, at, seen = False, 0, -1
    for end, phrase in automaton().iter(stream):
        start = end - len(phrase) - 1
        if start >= at:
            seen, at = seen + stream.count(" ", at, start + 1), start + 1
            word = seen
        else:
            word = seen - stream.count(" ", start + 1, at)
        if phrase == TAG:
            tagged = True
        elif phrase in BASE:
            places.append(word)
            base.add(BASE[phrase])
            sure[BASE[phrase]] = max(sure.get(BASE[phrase], 0), BASE_SURE)
        else:
            label, how = MORE[phrase]
            sure[label] = max(sure.get(label, 0), how)
    free = None
    for found in TAG_AT.finditer(text) if tagged else ():
        if (value := evaluate(found[1])) is not None:
            sure |= {x: max(sure.get(x, 0), TAG_SURE) for x in value[0]}
            free = value[1] if free is None else free and value[1]
    unsure = 1.0
    for how in sure.values():
        unsure *= 1 - how
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(sure)), free, 1 - unsure


def scan_licenses(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Add FIELDS to ``docs``, for every row and whole text; columns of these names are replaced.

    n_base counts all places of the base phrases, first_word and last_word are the smallest and largest
    start (null without any). ``permissive`` is null without an expression. A null or empty text has no
    words, no labels (empty strings) and score 0.
    """
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kept = docs.drop(*(x for x in names if x != text_col))
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in FIELDS.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = list(zip(*map(scan, batch.column(text_col).to_pylist()), strict=True))
        return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made, types)], [*batch.schema.names, *names])

    return map_arrow(kept, with_fields(kept, FIELDS), run)
