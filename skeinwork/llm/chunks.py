"""Texts of a partition cut into chunks that can be found again: work on a chunk can be sent away and its answer joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Bytes of text in a chunk; a longer text is a chunk by itself.
CHUNK_BYTES = 8 << 20


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(key, row batches) by the bytes of column text; the same rows in the same order give the same chunks."""
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index("text"))
        sums = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo, before = 0, 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(sums, before + limit - size, side="left")) + 1
            if hi > batch.num_rows:
                held.append(batch.slice(lo))
                size += int(sums[-1] - before)
                break
            held.append(batch.slice(lo, hi - lo))
            yield part << 32 | number, held
            number, held, size, lo, before = number + 1, [], 0, hi, int(sums[hi - 1])
    if held:
        yield part << 32 | number, held


def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their chunk's key as a first column."""
    for key, held in chunks(batches):
        for batch in held:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, key), pa.int64()), *batch.columns], names=["key", *batch.schema.names])
