"""Whether curated terms still stand in their files, and what they might be called there."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.batches import batch_of, map_arrow
from termloom.functions.text import alias_forms
from termloom.operators.curate import strings
from termloom.operators.search import Finder, spans


def check_locations(terms: DataFrame, docs: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """A row per place: term, pos, file, status (resolved, unresolved, missing), suggestion.

    ``docs``: file, content, ranges (null: whole text; else a hit must lie within one). A term counts as found by
    itself or an alias. Where it isn't, the first of its shorter or plural forms that the file holds is suggested.
    Places meet their file once, with all their forms, and its text is searched once.
    """
    places = terms.select("term", strings("aliases").alias("aliases"), F.posexplode("locations").alias("pos", "at")).select("term", "aliases", "pos", F.col("at.file").alias("file"))
    if extensions:
        places = places.where(F.regexp_extract("file", r"\.([^./]+)$", 1).isin(extensions))
    wanted = F.struct("term", "pos", F.concat(F.array("term"), F.col("aliases")).alias("names"), alias_forms("term").alias("forms"))
    rows = places.groupBy("file").agg(F.collect_list(wanted).alias("wanted")).join(docs.select("file", "content", "ranges"), "file", "left")

    schema = pa.schema([("term", pa.string()), ("pos", pa.int32()), ("file", pa.string()), ("status", pa.string()), ("suggestion", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for file, wanted, content, ranges in zip(*(batch.column(c).to_pylist() for c in ("file", "wanted", "content", "ranges")), strict=True):
            held = Finder(f for w in wanted for f in w["names"] + w["forms"]).first(content, spans(ranges))
            for w in wanted:
                status = "missing" if content is None else "resolved" if any(n.lower() in held for n in w["names"]) else "unresolved"
                suggestion = next((f for f in w["forms"] if f.lower() in held), None) if status == "unresolved" else None
                out.append((w["term"], w["pos"], file, status, suggestion))
        return batch_of(schema, out)

    return map_arrow(rows.select("file", "wanted", "content", "ranges"), "term string, pos int, file string, status string, suggestion string", run)


def report(checked: DataFrame) -> DataFrame:
    """One row: places checked, resolved, unresolved (missing files among them)."""
    return checked.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if(F.col("status") != "resolved").alias("unresolved"),
    )


def suggestions(checked: DataFrame) -> DataFrame:
    """Columns term, alias, file: each pair of term and alias once, with its first file."""
    first = Window.partitionBy("term", "suggestion").orderBy("pos", "file")
    rows = checked.where("suggestion is not null").withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select("term", F.col("suggestion").alias("alias"), "file")


def without_places(terms: DataFrame) -> DataFrame:
    """Suggested terms: those that stand nowhere yet."""
    return terms.where(F.size("locations") == 0)
