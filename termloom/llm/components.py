"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import discard, materialise


#: Most nodes whose least neighbours are broadcast; more are joined by a shuffle, each dealt to SALTS parts.
NODES_BROADCAST = 500_000
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (a, b) with the least of a's neighbours. The edges of a hub meet its least one in many tasks."""
    if least.count() <= NODES_BROADCAST:
        return edges.join(F.broadcast(least), "a")
    parts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    spread = least.withColumn("salt", F.explode(parts))
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))).join(spread, ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = _with_least(down, least).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """Columns node, component (its smallest node) for all nodes of ``edges`` (a, b) that aren't their component's smallest.

    A step is two aggregations with partial sums and two joins on small rows. The number of steps grows with the logarithm of the largest component's diameter; each is
    written to the shared folder, so no step's lineage reaches back to the start.
    """
    edges = materialise(edges.where("a != b").select("a", "b").distinct(), "links")
    before = None
    while True:
        wide = materialise(_large_star(edges).where("a != b").distinct(), "links")
        step = _small_star(wide).where("a != b").distinct()
        last, edges = edges, materialise(step, "links")
        discard(last, wide)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if tuple(now) == before:
            found = materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
            discard(edges)
            return found
        before = tuple(now)


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (as from ``components``) after more links (a, b), both materialised.

    The links are taken as links between components, so those that were found before aren't gone through again.
    """
    if links.isEmpty():
        return found
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    moved = found.join(over.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    done = materialise(moved.select("node", F.coalesce("into", "component").alias("component")).unionByName(over), "components")
    discard(over)
    return done
