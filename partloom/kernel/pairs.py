"""Pairs of things that occur together, counted thing by thing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .csr import _summed

#: Ends of one thing's pairs that are held before they are counted.
HELD = 1 << 20
#: Rows that are handed on together.
GIVEN = 1 << 14


def counted(batches_in: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(u, other ends, how often each) of rows (u, list v) sorted by u. Memory is for a batch, HELD ends and the different ends of one u."""
    own, held, size = None, [], 0
    ends = times = np.empty(0, np.int64)

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return _summed(np.concatenate([ends, key]), np.concatenate([times, n])) if len(ends) else (key, n)

    for b in batches_in:
        if not b.num_rows:
            continue
        u, at, v = b.column("u").to_numpy(), b.column("v").offsets.to_numpy(), b.column("v").values.to_numpy()
        cuts = np.flatnonzero(np.diff(u)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(u)], strict=True):
            if own is not None and u[lo] != own:
                yield own, *merged()
                held, size, ends, times = [], 0, ends[:0], times[:0]
            own = int(u[lo])
            # A copy, as a part of a batch would keep all of it.
            held.append(v[at[lo] : at[hi]].copy() if hi == len(u) else v[at[lo] : at[hi]])
            size += len(held[-1])
            if size > HELD:
                ends, times = merged()
                held, size = [ends[:0]], 0
    if own is not None:
        yield own, *merged()


def totals(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: different pairs, and all with their repeats."""
    pairs = every = 0
    for _, ends, times in counted(batches_in):
        pairs, every = pairs + len(ends), every + int(times.sum())
    yield pa.RecordBatch.from_pydict({"pairs": pa.array([pairs], pa.int64()), "every": pa.array([every], pa.int64())})


def above(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, weight) of the pairs that occur more often than ``mean``, a further column of one value."""
    mean: list[float] = []

    def noted() -> Iterator[pa.RecordBatch]:
        for b in batches_in:
            if b.num_rows:
                mean[:] = [b.column("mean")[0].as_py()]
            yield b

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64, copy=False)) for x in rows], ["u", "v", "weight"])

    rows, size = ([], [], []), 0
    for u, ends, times in counted(noted()):
        keep = times > mean[0]
        for kept, x in zip(rows, (np.full(int(keep.sum()), u), ends[keep], times[keep]), strict=True):
            kept.append(x)
        size += len(rows[0][-1])
        if size > GIVEN:
            yield batch()
            rows, size = ([], [], []), 0
    if size:
        yield batch()
