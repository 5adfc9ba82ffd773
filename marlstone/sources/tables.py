"""Parquet table sources with fixed zones and projected columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event series with ``us``, its instants as microseconds (instants without a zone are UTC)."""
    return read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())))


def latest_by_key(base: DataFrame, changes: DataFrame, key: str, revision: str) -> DataFrame:
    """Upsert: of rows with the same key the one with the highest revision stays (one pre-aggregated shuffle)."""
    rows = base.unionByName(changes, allowMissingColumns=True)
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), revision).alias("row")).select("row.*")


def partial_update(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Merge the changes' non-null fields into the base rows of the same key."""
    c = changes.select(key, *[F.col(x).alias(f"__new_{x}") for x in changes.columns if x != key])
    new = {x: F.coalesce(F.col(f"__new_{x}"), F.col(x)) if x in base.columns else F.col(f"__new_{x}") for x in changes.columns if x != key}
    return base.join(c, key, "left").withColumns(new).drop(*[f"__new_{x}" for x in new])


def insert_ignore(batch: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The batch's rows whose key the target lacks, once each."""
    return batch.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files of a folder whose content starts with the PDF signature, with their content hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.filter(F.substring("content", 1, 5) == F.lit(b"%PDF-")).withColumn("source_hash", F.sha2("content", 256))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key) of keys that only one side has."""
    only = lambda a, b, name: a.select(key).distinct().join(b.select(key), key, "left_anti").select(F.lit(name).alias("side"), key)
    return only(left, right, "left").unionByName(only(right, left, "right"))
