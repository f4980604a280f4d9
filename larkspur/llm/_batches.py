"""Arrow batches in Python workers: whole groups out of sorted batches, and record batches from columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that agree in ``keys`` (not null), from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for s, e in zip(starts, [*starts[1:], n], strict=True):
            now = tuple(v[s] for v in values)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray | pa.Array, dtype: str, width: int) -> np.ndarray:
    """A binary column of equal lengths as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)
