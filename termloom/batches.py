"""Arrow batches cut to a size in bytes, so that long texts don't pile up in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Python frees a batch of texts before it takes the next; bounds both sides' memory for long texts.
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, schema: str | T.StructType, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], most: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` in batches cut to about ``most`` bytes, so that long texts don't pile up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, most):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()  # a worker lives on between tasks

    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of about ``most`` bytes each (one row at least)."""
    if not batch.num_rows:
        return
    step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch."""
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
