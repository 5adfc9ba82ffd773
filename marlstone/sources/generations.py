"""Generations of a dataset: each is written once, one is active, a pointer says which.

Pointers are files numbered by revision. A new one is created without overwriting,
so of two activations that saw the same revision one fails. Files are reached by
Spark's file systems, wherever the folder is.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleRevision(RuntimeError):
    """Someone else has moved the pointer."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stage(df: DataFrame, folder: str, generation: str) -> None:
    """Write a generation; one that exists isn't written over."""
    df.write.mode("error").parquet(f"{folder}/generation={generation}")


def active(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """(revision, generation); (0, None) before the first activation."""
    fs, p = _fs(spark, f"{folder}/_pointer")
    if not fs.exists(p):
        return 0, None
    revision = max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=0)
    if not revision:
        return 0, None
    line = spark.read.text(f"{folder}/_pointer/{revision}").first()[0]
    return revision, json.loads(line)["generation"]


def activate(spark: SparkSession, folder: str, generation: str, *, seen: int, rows: int | None = None) -> int:
    """Point to ``generation`` if the revision is still ``seen`` and the generation holds ``rows`` rows; the new revision."""
    if rows is not None and (n := spark.read.parquet(f"{folder}/generation={generation}").count()) != rows:
        raise ValueError(f"generation {generation} has {n} rows, not {rows}")
    if active(spark, folder)[0] != seen:
        raise StaleRevision(f"revision {seen} isn't the newest")
    fs, p = _fs(spark, f"{folder}/_pointer/{seen + 1}")
    try:
        out = fs.create(p, False)
    except Exception as e:
        raise StaleRevision(f"revision {seen + 1} exists") from e
    out.write(bytearray(json.dumps({"generation": generation}, sort_keys=True).encode()))
    out.close()
    return seen + 1


def rollback(spark: SparkSession, folder: str) -> int:
    """Point to the generation before the active one, as a new revision."""
    revision, _ = active(spark, folder)
    if revision < 2:
        raise StaleRevision("there is no generation before")
    before = json.loads(spark.read.text(f"{folder}/_pointer/{revision - 1}").first()[0])["generation"]
    return activate(spark, folder, before, seen=revision)


def read_active(spark: SparkSession, folder: str) -> DataFrame:
    generation = active(spark, folder)[1]
    if generation is None:
        raise FileNotFoundError(f"no active generation in {folder}")
    return spark.read.parquet(f"{folder}/generation={generation}").withColumn("generation", F.lit(generation))
