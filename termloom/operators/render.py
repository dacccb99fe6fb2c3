"""Index markers into sources, and the glossary."""

from __future__ import annotations

from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.batches import batch_of, map_arrow
from termloom.functions.text import escape_markup, fold, marker, see_also, term_label
from termloom.operators.curate import strings
from termloom.operators.search import Finder, spans
from termloom.scratch import discard, materialise

IMPORT = '#import "@preview/in-dexter:0.7.2": *'


def parent_chains(terms: DataFrame) -> DataFrame:
    """Columns term, chain: ancestors from the root to the parent, however many. A parent that isn't a term is still
    named; a chain that would come back to a term it has ends before it.

    Each round doubles the chains, so the rounds grow with the logarithm of the longest.
    """
    links = terms.select("term", "parent").dropDuplicates(["term"])
    # ``up``: the parent, its parent and so on, as far as known; ``top``: where to go on
    known = links.select("term", F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent")).alias("up"), F.col("parent").alias("top"))
    known = materialise(known, "chains")
    while True:
        more = known.select(F.col("term").alias("_name"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        longer = known.join(more, F.col("top") == F.col("_name"), "left")
        whole = F.concat("term_", "up", F.coalesce("_up", F.array().cast("array<string>")))
        longer = longer.withColumn("term_", F.array("term")).withColumn("whole", whole)
        # the first element that stands earlier in the whole ends the chain before it
        again = F.array_min(F.filter(F.transform("whole", lambda x, i: F.when(F.array_position(F.col("whole"), x) <= i, i)), lambda i: i.isNotNull()))
        step = longer.select("term", F.when(again.isNotNull(), F.slice("whole", F.lit(2), again - 1)).otherwise(F.slice("whole", F.lit(2), F.size("whole"))).alias("up"), F.when(again.isNull(), F.col("_top")).alias("top"))
        last, known = known, materialise(step, "chains")
        discard(last)
        if known.where("top is not null").isEmpty():
            break
    return known.select("term", F.reverse("up").alias("chain"))


def place_terms(terms: DataFrame, docs: DataFrame, main_only: bool = False) -> DataFrame:
    """Columns file, term, main, chain, offset (bytes; null: not found): one marker per term and file.

    ``docs``: file, content, ranges (null: whole text). Places of a term in a file are taken in order; the
    first gives ``main``. The term itself is sought first, then its aliases in order. Terms meet their file
    once, all together, and its text is searched once.
    """
    places = terms.select("term", strings("aliases").alias("aliases"), F.posexplode("locations").alias("pos", "at")).select("term", "aliases", "pos", "at.file", "at.main")
    if main_only:
        places = places.where("main")
    first = Window.partitionBy("term", "file").orderBy("pos")
    places = places.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "pos")
    wanted = F.struct("term", "main", F.concat(F.array("term"), F.col("aliases")).alias("names"))
    rows = places.groupBy("file").agg(F.collect_list(wanted).alias("wanted")).join(docs.select("file", "content", "ranges"), "file")

    schema = pa.schema([("file", pa.string()), ("term", pa.string()), ("main", pa.bool_()), ("offset", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for file, wanted, content, ranges in zip(*(batch.column(c).to_pylist() for c in ("file", "wanted", "content", "ranges")), strict=True):
            held = Finder(n for w in wanted for n in w["names"]).first(content, spans(ranges))
            for w in wanted:
                end = next((held[n.lower()][1] for n in w["names"] if n.lower() in held), None)
                out.append((file, w["term"], w["main"], None if end is None else len(content[:end].encode())))
        return batch_of(schema, out)

    found = map_arrow(rows.select("file", "wanted", "content", "ranges"), "file string, term string, main boolean, offset long", run)
    return found.join(parent_chains(terms), "term").select("file", "term", "main", "chain", "offset")


def annotate(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Columns file, annotated: markers put in from the end backwards, the import before them unless it is there.

    Files without markers stay as they are. Several markers at one place stand in order of their terms.
    """
    marks = placed.where("offset is not null").select("file", F.struct("offset", fold("term").alias("o"), "term", marker("term", "chain", "main").alias("text")).alias("m"))
    grouped = marks.groupBy("file").agg(F.array_sort(F.collect_list("m")).alias("marks"))
    rows = docs.select("file", "content").join(grouped, "file", "left")
    pairs = F.coalesce(F.transform("marks", lambda m: F.struct(m["offset"].alias("at"), m["text"].alias("text"))), F.array().cast("array<struct<at bigint, text string>>"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for content, marks in zip(batch.column("content").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            data, parts, last = (content or "").encode(), [], 0
            for m in marks:
                parts += [data[last : m["at"]], m["text"].encode()]
                last = m["at"]
            made = b"".join([*parts, data[last:]]).decode()
            out.append(f"{IMPORT}\n{made}" if marks and "in-dexter" not in made else made)
        return pa.RecordBatch.from_arrays([batch.column("file"), pa.array(out, pa.string())], ["file", "annotated"])

    return map_arrow(rows.select("file", "content", pairs.alias("marks")), "file string, annotated string", run)


def counters(placed: DataFrame) -> DataFrame:
    """One row: files with markers, markers, main ones, terms not found in a file of theirs."""
    put = F.col("offset").isNotNull()
    return placed.agg(
        F.count_distinct(F.when(put, F.col("file"))).alias("files"),
        F.count_if(put).alias("markers"),
        F.count_if(put & F.col("main")).alias("main_markers"),
        F.count_if(~put).alias("not_found"),
    )


def glossary_entries(terms: DataFrame) -> DataFrame:
    """Columns path, depth, term, label, body: what the glossary says of each term that it reaches from a root.

    ``path`` sorts entries as the glossary lists them. A term whose parent is missing, or whose parents form a
    cycle, isn't reached. A term's path is its chain of parents, so no level is joined after another.
    """
    body = F.concat(escape_markup("definition"), see_also(strings("see_also")))
    roots = terms.where("parent is null").select(F.col("term").alias("_root")).distinct()
    base = terms.join(parent_chains(terms).withColumnRenamed("term", "_of"), F.col("term") == F.col("_of"))
    reached = base.join(roots, F.coalesce(F.get("chain", F.lit(0)), F.col("term")) == F.col("_root"), "left_semi")
    path = F.transform(F.concat("chain", F.array("term")), fold)
    return reached.select(path.alias("path"), F.size("chain").alias("depth"), "term", term_label("term").alias("label"), body.alias("body"))


class Renderer(Protocol):
    """What a format has to offer; formats are found by name in RENDERERS."""

    def annotate(self, docs: DataFrame, placed: DataFrame) -> DataFrame: ...

    def glossary(self, terms: DataFrame, spacing: str | None = None) -> str: ...


class TypstRenderer:
    def annotate(self, docs: DataFrame, placed: DataFrame) -> DataFrame:
        return annotate(docs, placed)

    def glossary(self, terms: DataFrame, spacing: str | None = None) -> str:
        """The glossary as one text; its entries (at most as many as there are curated terms) come to the driver."""
        head = "// Generated by termloom\n\n"
        rows = glossary_entries(terms).orderBy("path").select("depth", "term", "label", "body").collect()
        if terms.isEmpty():
            return head
        out, open_ = [f"#terms(tight: false{f', spacing: {spacing}' if spacing else ''},\n"], []
        for i, r in enumerate(rows):
            pad = "  " * (1 + 2 * r.depth)
            name = _escape(r.term)
            if i + 1 < len(rows) and rows[i + 1].depth > r.depth:
                out.append(f"{pad}terms.item([{name} <{r.label}>], [{r.body}\n{pad}  #terms(tight: true,\n")
                open_.append(pad)
            else:
                out.append(f"{pad}terms.item([{name} <{r.label}>], [{r.body}]),\n")
                for _ in range(r.depth - (rows[i + 1].depth if i + 1 < len(rows) else 0)):
                    pad = open_.pop()
                    out.append(f"{pad}  )\n{pad}]),\n")
        return head + "".join(out) + ")\n"


def _escape(text: str) -> str:
    return "".join(f"\\{c}" if c in "@#<$_*" else c for c in text)


RENDERERS: dict[str, Renderer] = {"typst": TypstRenderer()}
