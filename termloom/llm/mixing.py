"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents that belong to the same set of sources form a pattern. A pattern offers its words once for
each allowed repetition, each dearer than the one before; words flow through the pattern's sources to
the sources' quotas at least cost. Within a pattern whole documents are then selected in a seeded order.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import discard, materialise, n_words

#: Weights by the sources' order, repeating.
WEIGHTS = (3, 1, 2)
#: Most patterns that the driver routes (a few hundred bytes each); sources are few, patterns are sets of them.
PATTERNS_LIMIT = 100_000
#: Most rows of the plan's tables that are broadcast; larger ones are joined by a shuffle.
EDGES_BROADCAST = 500_000
#: Documents of a pattern that are ranked together, about, and buckets whose words are added up together.
BUCKET_DOCS = 4096
SPAN = 4096


def targets(sizes: dict, weights: tuple[int, ...], total: float, most: float) -> dict:
    """Share ``total`` by weight; no source gets more than ``most`` times its size, the rest share the excess."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    found: dict = {}
    open_ = list(order)
    while open_:
        left, all_weights = total - sum(found.values()), sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / all_weights > most * sizes[s]]
        if not above:
            return found | {s: left * weight[s] / all_weights for s in open_}
        found |= {s: float(most * sizes[s]) for s in above}
        open_ = [s for s in open_ if s not in found]
    return found


def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int) -> list[int]:
    """Words taken from each pattern: a min-cost flow of as many words as the quotas can take.

    ``patterns``: sources and words of each. Repetition r of a pattern's words costs r - 1 a word, so the
    total is convex. Successive shortest paths with potentials; the graph has a few arcs per pattern.
    """
    sources = {s: i for i, s in enumerate(quotas)}
    base = 2 + len(patterns)
    head: list[list[int]] = [[] for _ in range(base + len(sources))]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, cap: int, price: int) -> None:
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            head[x].append(len(to))
            to.append(y), room.append(c), cost.append(p)

    first = []
    for k, (names, words) in enumerate(patterns):
        first.append(len(to))
        for r in range(repeats):
            arc(0, 2 + k, words, r)
        for s in names:
            arc(2 + k, base + sources[s], words * repeats, 0)
    for s, quota in quotas.items():
        arc(base + sources[s], 1, quota, 0)
    rise = [0] * len(head)
    while True:
        far, via, heap = {0: 0}, {}, [(0, 0)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in head[x]:
                y = to[e]
                if room[e] and (n := d + cost[e] + rise[x] - rise[y]) < far.get(y, n + 1):
                    far[y], via[y] = n, e
                    heapq.heappush(heap, (n, y))
        if 1 not in far:
            break
        for x in range(len(head)):
            rise[x] += min(far.get(x, far[1]), far[1])
        # every node at hand now has arcs of no reduced cost towards the sink: push along all such paths
        while True:
            back, stack, seen = {}, [0], {0}
            while stack and 1 not in seen:
                x = stack.pop()
                for e in head[x]:
                    y = to[e]
                    if room[e] and y not in seen and cost[e] + rise[x] - rise[y] == 0:
                        seen.add(y)
                        back[y] = e
                        stack.append(y)
            if 1 not in seen:
                break
            path, x = [], 1
            while x:
                path.append(back[x])
                x = to[back[x] ^ 1]
            push = min(room[e] for e in path)
            for e in path:
                room[e] -= push
                room[e ^ 1] += push
    return [sum(room[e + 2 * r + 1] for r in range(repeats)) for e in first]


def fill_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Which of a bucket's units fill what is left: in seeded order each that still fits, then exchanges.

    An exchange gives a taken unit for one left out that is larger by at most the gap, the best of all such
    pairs, while one exists; ties go to the earlier unit.
    """
    rows = rows.sort_values(["u", "id", "mark"], kind="stable", na_position="last").reset_index(drop=True)
    sizes, gap = rows["size"].to_numpy(), int(rows["fill"].iloc[0]) if len(rows) else 0
    taken = np.zeros(len(rows), bool)
    for i, size in enumerate(sizes.tolist()):
        if size <= gap:
            taken[i] = True
            gap -= size
    while gap and taken.any() and not taken.all():
        inside, outside = np.flatnonzero(taken), np.flatnonzero(~taken)
        outside = outside[np.argsort(sizes[outside], kind="stable")]
        at = np.searchsorted(sizes[outside], sizes[inside] + gap, side="right") - 1
        gain = np.where(at >= 0, sizes[outside[at]] - sizes[inside], 0)
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        taken[inside[best]], taken[outside[at[best]]] = False, True
        gap -= int(gain[best])
    return rows.assign(extra=taken.astype("int64"))[["id", "mark", "pattern", "extra"]]


def pattern_of(sources: Column) -> Column:
    """A document's set of sources, as JSON."""
    return F.to_json(F.array_sort(F.array_distinct(sources)))


class Plan:
    """What the mix takes, in tables far smaller than the documents.

    A unit is what has one id and one text (``mark``, its hash), so rows that repeat both share a verdict and
    count as one. patterns: buckets and copies of each pattern. edges: per bucket, whether its units get one
    copy more (null: in part). split: for units of the buckets taken in part, whether they get one more.
    """

    def __init__(self, seed: int, patterns: DataFrame):
        self.seed, self.patterns = seed, patterns
        self.edges: DataFrame
        self.split: DataFrame

    def placed(self, rows: DataFrame) -> DataFrame:
        """Add base (copies of all), rest, u and bucket to rows with id, mark and pattern; units are dealt by a seeded hash."""
        own = self.patterns.select(F.col("pattern").alias("of"), F.col("copies").alias("base"), "rest", "buckets")
        rows = rows.join(F.broadcast(own), F.col("pattern").eqNullSafe(F.col("of"))).drop("of")  # PATTERNS_LIMIT rows at most
        rows = rows.withColumn("u", F.xxhash64(F.lit(self.seed), "id", "mark"))
        return rows.withColumn("bucket", F.floor((F.col("u").cast("double") / 2.0**64 + 0.5) * F.col("buckets")).cast("long")).drop("buckets")

    def copies(self, rows: DataFrame) -> DataFrame:
        """Add ``copies`` to rows with id, mark and pattern; the rows aren't shuffled while the plan's tables are small."""
        edges = self.edges.select(F.col("pattern").alias("edge_pattern"), F.col("bucket").alias("edge_bucket"), "more")
        split = self.split.select(F.col("id").alias("split_id"), F.col("mark").alias("split_mark"), F.col("pattern").alias("split_pattern"), "extra")
        edges, split = (F.broadcast(x) if x.count() <= EDGES_BROADCAST else x for x in (edges, split))
        found = self.placed(rows).join(edges, F.col("pattern").eqNullSafe(F.col("edge_pattern")) & (F.col("bucket") == F.col("edge_bucket")), "left")
        same = F.col("id").eqNullSafe(F.col("split_id")) & (F.col("mark") == F.col("split_mark")) & F.col("pattern").eqNullSafe(F.col("split_pattern"))
        found = found.join(split, F.col("more").isNull() & same, "left")
        return found.select(*rows.columns, (F.col("base") + F.coalesce("more", "extra", F.lit(0))).alias("copies"))


def running(sums: DataFrame) -> DataFrame:
    """Add ``before``: the words of all earlier buckets of a pattern. In two levels, so that no task holds all buckets."""
    wide = sums.withColumn("span", F.floor(F.col("bucket") / SPAN))
    spans = wide.groupBy("pattern", "span").agg(F.sum("words").alias("words"))
    spans = spans.withColumn("start", F.sum("words").over(Window.partitionBy("pattern").orderBy("span")) - F.col("words"))
    spans = spans.select(F.col("pattern").alias("of"), F.col("span").alias("at"), "start")
    inside = F.sum("words").over(Window.partitionBy("pattern", "span").orderBy("bucket")) - F.col("words")
    found = wide.withColumn("inside", inside).join(spans, F.col("pattern").eqNullSafe(F.col("of")) & (F.col("span") == F.col("at")))
    return found.select(*sums.columns, (F.col("start") + F.col("inside")).alias("before"))


def plan_mix(docs: DataFrame, sources: Column, *, id_col: str = "doc_id", text_col: str = "text", weights=WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 17) -> tuple[Plan, DataFrame, DataFrame]:
    """A plan, the documents' sizes (id, mark, names, pattern, size) and the sources (source, source_size, target)."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), sources.alias("names"), n_words(F.col(text_col)).alias("size"))
    rows = materialise(rows.withColumn("pattern", pattern_of(F.col("names"))), "sizes")
    groups = rows.groupBy("pattern").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    groups = materialise(groups, "patterns")
    if (found := groups.count()) > PATTERNS_LIMIT:
        raise ValueError(f"{found} patterns of sources; the driver routes at most {PATTERNS_LIMIT}")
    named = [(r, tuple(json.loads(r.pattern or "[]"))) for r in groups.collect()]
    discard(groups)
    sizes: dict = {}
    for r, names in named:
        for s in names:
            sizes[s] = sizes.get(s, 0) + r.words
    goal = targets(sizes, weights, share * sum(r.words for r, names in named if names), repeats)
    taken = route([(names, r.words) for r, names in named], {s: int(t) for s, t in goal.items()}, repeats)

    each = [(r.pattern, *(divmod(w, r.words) if r.words else (0, 0)), -(-r.docs // BUCKET_DOCS)) for (r, _), w in zip(named, taken, strict=True)]
    plan = Plan(seed, spark.createDataFrame(each, "pattern string, copies long, rest long, buckets long"))
    at = plan.placed(rows)
    sums = running(at.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")))
    sums = sums.withColumn("fill", F.col("rest") - F.col("before"))
    more = F.when(F.col("fill") >= F.col("words"), 1).when(F.col("fill") <= 0, 0).cast("long")
    plan.edges = materialise(sums.select("pattern", "bucket", "fill", more.alias("more")), "edges")
    parts = F.broadcast(plan.edges.where("more is null").select(F.col("pattern").alias("of"), F.col("bucket").alias("part"), "fill"))  # a row per pattern at most
    inside = at.join(parts, F.col("pattern").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("part")))
    units = inside.groupBy("id", "mark", "pattern").agg(F.sum("size").alias("size"), F.first("u").alias("u"), F.first("fill").alias("fill"))
    split = units.groupBy("pattern").applyInPandas(fill_up, f"id {kind}, mark long, pattern string, extra long")
    plan.split = materialise(split, "split")
    of_source = spark.createDataFrame([(s, sizes[s], float(goal[s])) for s in sizes], "source string, source_size long, target double")
    return plan, rows, of_source


def mix(docs: DataFrame, sources: Column, **settings) -> tuple[DataFrame, DataFrame]:
    """How often the mix takes each document, and the sources' sizes and targets.

    ``sources`` gives a document's sources as an array of strings; a null in it is a source, the last. The
    first result has a row per row of ``docs``: id, names (its sources), size (words), copies. The second
    has source, source_size, target. A document is taken 0 to ``repeats`` times; a source's words miss what
    was routed by less than the smallest document that didn't fit. Runs agree: the order is a hash of seed,
    id and text. Null texts have no words; a table without words takes nothing; documents without sources
    aren't taken. Rows that repeat id and text are one unit: they share a verdict and their sizes add up.
    Other columns are neither read nor returned.
    """
    plan, rows, of_source = plan_mix(docs, sources, **settings)
    return plan.copies(rows).select("id", "names", "size", "copies").withColumnRenamed("id", settings.get("id_col", "doc_id")), of_source


def mixed_documents(docs: DataFrame, sources: Column, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, with their columns whatever their names, each as often as the mix takes it."""
    plan, _, _ = plan_mix(docs, sources, id_col=id_col, text_col=text_col, **settings)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), pattern_of(sources).alias("pattern"))
    taken = plan.copies(rows).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
