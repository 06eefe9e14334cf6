"""Whole groups out of a sorted stream of Arrow batches.

``mapInArrow`` sees a sorted partition as batches that cut groups anywhere. ``whole_groups`` re-cuts them so
that no group is split, which lets a kernel work on thousands of small groups in one vectorised call instead
of one Python call a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which the values of ``keys`` change, the first row included; nulls equal nulls."""
    n = table.num_rows
    if n == 0:
        return np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for key in keys:
        column = table[key].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        here, before = column.slice(1), column.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
        if column.null_count:
            differs = differs | (pc.is_null(here).to_numpy(zero_copy_only=False) != pc.is_null(before).to_numpy(zero_copy_only=False))
        change[1:] |= differs
    return np.flatnonzero(change)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 65536) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows (or one larger group) in which each group of ``keys`` is whole."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = int(group_starts(table, keys)[-1])
        if last:
            yield table.slice(0, last).combine_chunks()
        held = table.slice(last).combine_chunks().to_batches()
        count = table.num_rows - last
    if count:
        yield pa.Table.from_batches(held).combine_chunks()
