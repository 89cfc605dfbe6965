"""Arrow batches in parts, for functions that make Python objects of each row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows whose objects a worker holds at once; Spark sends 10,000 in a batch.
ROWS = 128


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made of them does not lie beside that of a whole batch."""
    for b in batches:
        for i in range(0, max(1, b.num_rows), rows):
            yield b.slice(i, rows)
