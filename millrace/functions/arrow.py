"""Arrow batches in pieces, so that what a task makes of them stays small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], size: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, as pieces of about ``size`` bytes of a text column, or of one row.

    A batch may hold 10,000 rows of any length. Only a piece should become Python
    objects at a time; unused memory is given back when a batch is done.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        pa.default_memory_pool().release_unused()
