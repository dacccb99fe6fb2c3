"""What the operators of this subpackage share: reading, scratch tables, word rules, broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.batches import cut, map_arrow
from termloom.scratch import discard, materialise, scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word of most operators: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark opens the path, so it may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone takes the faster ``lower``, which does the same there."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    """Number of words of ``WORD``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def broadcast_value(spark: SparkSession, value, limit: int, size: int):
    """Broadcast a value whose size in bytes is known and checked against ``limit``."""
    if size > limit:
        raise ValueError(f"{size} bytes to broadcast; the limit is {limit}")
    return spark.sparkContext.broadcast(value)


def bounded_sample(rows: DataFrame, id_col: str, most: int, seed: int, *ties: str) -> DataFrame:
    """The ``most`` rows of smallest seeded hash of their id (all rows, if they aren't more); ties by id, then ``ties``.

    Rows far above the hash that is to be expected for the last one are left out before the top-k, so that the
    top-k doesn't gather ``most`` rows from every task. Where repeated ids leave too few rows below that hash,
    it is raised until there are enough.
    """
    number = rows.count()
    u = F.xxhash64(F.lit(seed), id_col)
    share = (most + 10 * most**0.5 + 10) / max(number, 1)
    while number > 2 * most and share < 1:
        below = rows.where(u.cast("double") / 2.0**64 + 0.5 < share)
        if below.count() >= most:
            rows = below
            break
        share *= 4
    return rows.orderBy(u, id_col, *ties).limit(most)


def with_fields(df: DataFrame, fields: str) -> T.StructType:
    """The schema of ``df`` with more fields, given as DDL, at its end."""
    return T.StructType([*df.schema.fields, *df.sparkSession.createDataFrame([], fields).schema.fields])


__all__ = ["ascii_lower", "bounded_sample", "broadcast_value", "cut", "discard", "map_arrow", "materialise", "n_words", "scratch_dir", "table", "with_fields"]
