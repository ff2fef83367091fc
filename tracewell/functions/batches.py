"""Arrow-batched functions over tables: batches bounded in rows and bytes, and memory that is given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: An Arrow batch holds so many rows and bytes at most: texts can be long, so a batch is kept small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Hands the memory that a worker has freed back to the system: workers live on, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def plain(values: pa.Array) -> list:
    """values.to_pylist(), a column at a time: scalars of nested rows are not made one by one. Keys of structs differ."""
    kind = values.type
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        ends, known = values.offsets.to_numpy().tolist(), values.is_valid().to_numpy(zero_copy_only=False).tolist()
        at = ends[0]
        inner = plain(values.values.slice(at, ends[-1] - at))
        return [inner[a - at : b - at] if ok else None for a, b, ok in zip(ends, ends[1:], known, strict=False)]
    if pa.types.is_struct(kind) and not values.null_count and kind.num_fields:
        names = [f.name for f in kind]
        return [dict(zip(names, row, strict=True)) for row in zip(*map(plain, values.flatten()), strict=True)]
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_boolean(kind):
        return values.to_numpy(zero_copy_only=False).tolist()
    return values.to_pylist()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), with bounded batches. A worker gives back what a task has freed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    bound(df.sparkSession)
    return df.mapInArrow(task, schema)
