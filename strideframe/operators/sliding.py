"""Sliding windows over blocks: every row is shuffled once, plus a halo of one window behind a block's edge.

A series is cut into blocks by position. A window belongs to one block, and a block sees the rows of all its windows, so
windows are views on its rows and never copied before they are used. Partitions are streams of series blocks in order;
``complete`` cuts the stream where a block ends, so small series share a batch and none is split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

# Positions per block, rows per batch, and windows whose rows are laid out at once.
BLOCK, BATCH_ROWS, STACK = 1 << 13, 1 << 14, 1 << 11


def in_blocks(df: DataFrame, pos: str, behind: Column, ahead: Column, block: int = BLOCK) -> DataFrame:
    """Each row in every block ``_blk`` whose windows may hold it: those at most ``behind`` before or ``ahead`` after it."""
    first, last = (F.floor((F.col(pos) + by) / F.lit(block)).cast("bigint") for by in (-behind, ahead))
    return df.withColumn("_blk", F.explode(F.sequence(first, last)))


def sorted_blocks(df: DataFrame, key: str, *order: str) -> DataFrame:
    return spread(df, key, "_blk").sortWithinPartitions(key, "_blk", *order)


def starts_of(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where a row's keys differ from those before it."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows:
        new[1:] = False
        for key in keys:
            values = table.column(key).to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
    return new


def complete(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = BATCH_ROWS) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows in which no run of equal ``keys`` is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(starts_of(table, keys))[-1])
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def matrix(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """``[rows, columns]`` of doubles, nulls as NaN."""
    return np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)


def stacks(data: np.ndarray, first: np.ndarray, lengths: np.ndarray, size: int = STACK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Window numbers and their rows ``[windows, columns, length]``, at most ``size`` windows of one length at a time."""
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        view = np.lib.stride_tricks.sliding_window_view(data, int(n), axis=0) if n else None
        for at in (same[i : i + size] for i in range(0, len(same), size)):
            yield at, view[first[at]] if n else np.empty((len(at), data.shape[1], 0))
