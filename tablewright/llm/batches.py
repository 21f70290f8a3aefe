"""Arrow batches of (id, text) for the operators that work on whole texts in Python tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 21
#: Limits of the Arrow batches between Spark and Python; Spark's own count rows only, and texts are long. A batch is a piece as a rule.
BATCH_BYTES, BATCH_ROWS = 15 << 17, 2000
#: Rows that the Parquet reader decodes at once; a batch of texts is one array on the heap, which grows by doubling.
READER_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits on the reader's and on Arrow batches, so that both sides of the pipe stay within bounds."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))


def give_back() -> None:
    """Return to the system what Arrow and the C library have free; worker processes outlive tasks and lie idle beside the next ones."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset of each text in them; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about ``PIECE_BYTES`` bytes of text; free memory goes back to the system after the last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_bytes(batch.column(column))[1][1:]
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()
