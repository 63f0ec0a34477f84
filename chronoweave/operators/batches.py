"""Parts of Arrow batches: what a Python worker unpacks at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def parts(batches: Iterable[pa.RecordBatch], most: int = 1 << 20, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, at most ``rows`` and ``most`` bytes at a time (a row at least).

    Spark fills a batch up to 10,000 rows or 64 MB, whatever a row becomes in
    Python; so memory would grow with the table until batches are full.
    """
    for batch in batches:
        todo = [batch.slice(at, rows) for at in reversed(range(0, batch.num_rows, rows))]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > most:  # long rows may stand side by side
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part
