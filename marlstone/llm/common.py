"""Helpers shared by the training-data operators."""

from __future__ import annotations

import threading

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir, table_path  # noqa: F401

#: Rows of narrow intermediate tables in a file.
ROWS_PER_FILE = 65536


class _Made(threading.local):
    """The tables that a thread has written and not yet deleted, in order; queries that are built side by side don't see each other's."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_MADE = _Made()


def made() -> int:
    """A mark for ``forget``: what has been written so far."""
    return len(_MADE.paths)


def forget(spark: SparkSession, since: int, keep: tuple[str, ...]) -> None:
    """Delete the tables written since a mark, but for those of the names that what is returned still reads."""
    for path in [p for p in _MADE.paths[since:] if p.rsplit("/", 1)[1].rsplit("-", 1)[0] not in keep]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _MADE.paths.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_for(df: DataFrame, rows: int, least: int = 1) -> DataFrame:
    """``df`` in as many partitions as so many rows call for, ``least`` or more; never in more than it has."""
    return df.coalesce(max(least, -(-rows // ROWS_PER_FILE)))


def written(df: DataFrame, name: str, rows: int | None = None, least: int = 1) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation. ``rows``, if
    known, keeps a small table from being written as many tiny files."""
    spark = df.sparkSession
    path = table_path(spark, name)
    _MADE.paths.append(path)
    (df if rows is None else files_for(df, rows, least)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> str | list[str]:
    """Each name, with as many marks before it as keep it apart from the columns (in any case of letters)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        out.append(name)
    return out if len(out) > 1 else out[0]


def text_slices(batch, column: str, most: int):
    """(rows, their texts) of an Arrow batch, of about ``most`` bytes of text at most; a longer text comes alone.

    Texts leave Arrow a slice at a time, so a worker holds one slice's strings, whatever a batch's size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8"))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        rows = batch.slice(start, stop - start)
        yield rows, rows.column(column).to_pylist()
        start = stop
