"""What Python workers hold at a time: batches of few rows, for texts may be long, and no free memory after a task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch, where a session leaves that to Spark.
BATCH_ROWS, BATCH_KEY = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small(df: DataFrame) -> DataFrame:
    """df. A session that leaves the size of Arrow batches to Spark has small ones from here on."""
    if df.sparkSession.conf.get(BATCH_KEY) == "10000":
        df.sparkSession.conf.set(BATCH_KEY, BATCH_ROWS)
    return df


def release() -> None:
    """Give free memory back to the system: a worker may wait long for its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def trimmed(work: Callable) -> Callable:
    """work for mapInArrow, after which free memory is given back."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return rows
