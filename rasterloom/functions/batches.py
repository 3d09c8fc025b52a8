"""Arrow batches bounded by bytes, into Python and out of it: by rows alone (10,000), one may take hundreds of MB."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch; a row counts ROW_BYTES more than its values take.
BATCH_BYTES, ROW_BYTES = 4 << 20, 128


def bound_batches(spark: SparkSession) -> None:
    """Bounds what the session's Python functions are given."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def in_batches(rows: Iterator[tuple[int, object]], make: Callable[[list], object]) -> Iterator:
    """What make builds of the rows, some MB of them at a time. Each comes with the bytes of its values; free memory goes back to the system at the end, as the worker lives on."""
    kept, size = [], 0
    try:
        for n, row in rows:
            kept.append(row)
            size += n + ROW_BYTES
            if size >= BATCH_BYTES:
                yield make(kept)
                kept, size = [], 0
        if kept:
            yield make(kept)
    finally:
        del kept
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)
