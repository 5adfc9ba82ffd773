"""Joins of blocks, in which the rows of one side are held while those of the other stream by, and portions of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of a held and a passing row that are looked at at a time: a few arrays of 16 MB.
PAIRS = 1 << 21


def meeting(held: DataFrame, passing: DataFrame, schema: str, hold: Callable[[pa.Table], Any], meet: Callable[[Any, pa.RecordBatch], pa.RecordBatch | None], *, tasks: int, numbered: bool = False) -> DataFrame:
    """``meet(hold(rows of held), some rows of passing)`` for each ``block`` (a long column of both sides).

    A block's held rows are in one task's memory together, so they have to be few; passing rows come in Arrow batches, however many
    there are, and of these so few at a time that they make about ``PAIRS`` pairs with the held ones. Both sides shuffle once, by
    block; a block with rows of one side only gives nothing. ``numbered`` blocks run from 0 below
    ``tasks`` and have a task each."""
    both = held.withColumn("__side", F.lit(0)).unionByName(passing.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    mine, theirs = held.columns, passing.columns

    def run(batches):
        block, rows, state, few = None, [], None, 1
        for batch in batches:
            at, side = batch.column("block").to_numpy(), batch.column("__side").to_numpy()
            change = np.flatnonzero((np.diff(at) != 0) | (np.diff(side) != 0)) + 1
            cuts = [0, *change.tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if at[a] != block:
                    block, rows, state = at[a], [], None
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    rows.append(part.select(mine))
                    continue
                if rows:
                    few = max(1, PAIRS // sum(x.num_rows for x in rows))
                    state, rows = hold(pa.Table.from_batches(rows)), []
                for c in range(0, b - a if state is not None else 0, few):
                    if (out := meet(state, part.slice(c, few).select(theirs))) is not None:
                        yield out

    dealt = both.repartitionById(tasks, F.col("block").cast("int")) if numbered else both.repartition(tasks, "block")
    return dealt.sortWithinPartitions("block", "__side").mapInArrow(run, schema)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: str = "f8") -> np.ndarray:
    """Rows of a binary column as vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


#: Bytes of text that become Python objects at a time.
PORTION = 1 << 20


def portions(batch: pa.RecordBatch, text: str, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts hold about ``most`` bytes, or one row: a batch holds up to ten thousand texts of any length."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype("i8")
    upto, a = np.cumsum(size), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - size[a] + most, "right")))
        yield batch.slice(a, b - a)
        a = b
