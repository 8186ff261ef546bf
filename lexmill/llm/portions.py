"""Arrow batches in portions of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that a portion holds, unless one text alone is longer
PORTION = 4 << 20


def portions(batches: Iterator[pa.RecordBatch], at: int, limit: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in their order, in slices with at most ``limit`` bytes in column ``at``, or of one row.

    What a task makes of a portion, and sends back, is then bounded whatever the texts' lengths. Nulls have no bytes."""
    for batch in batches:
        column = batch.column(at)
        if pa.types.is_null(column.type):
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
