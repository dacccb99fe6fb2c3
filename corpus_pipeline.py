"""Documents to token ids in five stages; each stage's rows are the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import stages
from termloom.llm.common import materialise, table

STAGES = [
    ("language_id", stages.language),
    ("exact_dedup", stages.exact),
    ("near_dedup", stages.near),
    ("mixing", stages.mix),
    ("byte_bpe", stages.encode),
]

#: Language and mixing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Each stage is written as Parquet and read again, so none is repeated."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
