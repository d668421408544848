"""Whole groups of sorted Arrow rows, as they stream by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[int], list[int]]]:
    """Tables of whole groups of sorted rows, and where each group starts and ends."""
    rest: pa.Table | None = None
    for batch in _with_end(batches):
        rows = pa.Table.from_batches([batch]) if batch is not None else None
        table = pa.concat_tables([x for x in (rest, rows) if x is not None]) if rest is not None or rows is not None else None
        if table is None or not len(table):
            continue
        keys = [table.column(c).to_numpy() for c in by]
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        ends = np.r_[starts[1:], len(table)]
        # The last group may go on in the next batch.
        done = len(starts) if batch is None else len(starts) - 1
        rest = table.slice(int(starts[done])) if done < len(starts) else None
        if done:
            yield table, starts[:done].tolist(), ends[:done].tolist()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
