"""Arrow columns in and out of Python workers, and the shared scratch folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kairospark.files import remove
from kairospark.scratch import scratch


_MADE: list[list[tuple[str, DataFrame]]] = []


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: the lineage is cut, and any executor can read it again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if _MADE:
        _MADE[-1].append((path, back))
    return back


@contextmanager
def tidied(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """What is stored within is removed at the end, but for what the list that this gives then holds: the tables that the result still reads."""
    kept: list[DataFrame] = []
    _MADE.append([])
    try:
        yield kept
    finally:
        for path, df in _MADE.pop():
            if not any(df is k for k in kept):
                remove(spark, path)


def thin_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default of 64 MB, unless the session already asks for another size: with long texts, a worker holds a batch and what is made of it. Registered queries do this to the session that they are given; operators change no setting."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, "16m")


def strings(column: pa.Array) -> list[str]:
    """Values of a string column, null as empty."""
    return column.fill_null("").to_pylist()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after the other, and where each row starts (one entry more than rows); null as empty. No copy of the text is made."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Each batch cut so that the named string column holds about `most` bytes in each slice; a longer single row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    pa.default_memory_pool().release_unused()  # a worker outlives its task


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list column from flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
