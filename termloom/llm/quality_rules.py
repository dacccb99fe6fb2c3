"""Rules on a document's words and lines, and verdicts on hosts from the rules' failures.

Each document's counts are taken in one pass. Failures are summed by host; a host's failure rate is
shrunk towards the rate of all hosts by a beta prior whose strength is fitted to the hosts themselves,
so that a small host isn't condemned by a few pages. A host's verdict goes back to all its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import map_arrow, materialise

STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: A host whose shrunk failure rate is above this loses all its documents.
HOST_RATE = 0.5
#: Most hosts whose verdicts are broadcast; more are joined by a shuffle.
HOSTS_BROADCAST = 100_000


def repeated_words(words: list[bytes]) -> int:
    """Number of words in three-word windows that stand twice or more in ``words``."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    first = ids[:-2]
    for more in (ids[1:-1], ids[2:]):  # numbers of prefixes stay below n, so products stay exact
        _, first = np.unique(first * len(seen) + more, return_inverse=True)
    again = np.bincount(first)[first] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= again
    return int(covered.sum())


def stats_of(text: str | None) -> tuple[int, ...]:
    """The counts of STATS; a null text has none."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def document_stats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Columns id, host and those of STATS, for every row and whole text."""
    types = dict(docs.dtypes)
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    names = [x.split()[0] for x in STATS.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([stats_of(x) for x in batch.column("text").to_pylist()], np.int64).reshape(-1, len(names))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), *map(pa.array, made.T)], ["id", "host", *names])

    return map_arrow(rows, f"id {types[id_col]}, host {types[host_col]}, {STATS}", run)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Name of each rule and what fails it."""
    return {
        "base": base_failed(),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": (F.col("n_dup_lines") > 2) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "word_length": (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
    }


def host_verdicts(stats: DataFrame, limit: float = HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, rejected.

    The prior's mean is the failure rate of all documents. Its strength comes from the variance of the
    hosts' rates beyond what chance gives (method of moments, hosts weighted by documents); where there
    is none, hosts take the common rate. A null host is a host of its own.
    """
    failed = F.when(F.col("n_failed") > 0, 1).otherwise(0)
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(failed).alias("host_failed"))
    hosts = materialise(hosts, "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    total = hosts.agg(F.sum("host_docs"), F.sum("host_failed"), F.count(F.lit(1)), F.sum(F.col("host_docs") * rate * rate)).first()
    mean, strength = beta_prior(*total)
    shrunk = (F.col("host_failed") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.select("host", "host_docs", "host_failed", shrunk.alias("host_rate")).withColumn("host_rejected", F.col("host_rate") > limit)


def beta_prior(docs: int | None, failed: int | None, hosts: int, squares: float | None) -> tuple[float, float]:
    """Mean and strength (alpha + beta) of the prior. ``squares``: sum over hosts of documents times squared rate."""
    if not docs:
        return 0.0, 1.0
    mean = failed / docs
    beyond = squares / docs - mean * mean - mean * (1 - mean) * hosts / docs
    return mean, max(1.0, mean * (1 - mean) / beyond) if beyond > 0 else float(docs)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, counts, base_failed, failed rules, the host's rate and verdict, kept.

    A document stays if it fails no rule and its host isn't rejected. Null and empty texts have no words,
    fail the base rule and go. Rows of null host share one. Repeated rows are counted each. Columns other
    than the three named are neither read nor returned; an empty table gives an empty result.
    """
    stats = document_stats(docs, id_col=id_col, text_col=text_col, host_col=host_col)
    failing = [F.when(x, F.lit(name)) for name, x in rules().items()]
    stats = materialise(stats.withColumn("failed", F.array_compact(F.array(*failing))).withColumn("n_failed", F.size("failed")), "stats")
    verdicts = host_verdicts(stats)
    number = stats.select("host").distinct().count()
    verdicts = F.broadcast(verdicts) if number <= HOSTS_BROADCAST else verdicts
    found = stats.join(verdicts.withColumnRenamed("host", "own"), F.col("host").eqNullSafe(F.col("own")), "left").drop("own")
    return (
        found.withColumn("base_failed", F.array_contains("failed", "base"))
        .withColumn("kept", (F.col("n_failed") == 0) & ~F.col("host_rejected"))
        .withColumnsRenamed({"id": id_col, "host": host_col})
    )
