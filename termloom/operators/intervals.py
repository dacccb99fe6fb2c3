"""Intervals: merging. Matches that lie within one are found by operators.search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """From (file, s, e): the unions of intervals that touch or overlap."""
    order = Window.partitionBy("file").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("file", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("file", "s", "e")
