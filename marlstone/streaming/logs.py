"""Structured Streaming over event files: deduplicated ingest, windowed counts, sampling, retention and forwarding once.

``drained`` runs a query over all that is there into Parquet under a checkpoint, in
the folder that all executors share, so nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import table_path

#: Share of a full queue from which on sampling keeps a tenth of its rate.
PRESSURE, UNDER_PRESSURE, SAMPLE_SPAN = 0.8, 0.1, 1_000_000


def stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 16) -> DataFrame:
    """The events as a file stream; ``maxFilesPerTrigger`` is the backpressure."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(sf_dir if sf_dir.endswith("*") else f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(rows: DataFrame, key: str = "event_id", late: str = "30 days") -> DataFrame:
    """State is kept for as long as a repeat may come, not for ever."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, width: str = "1 day", late: str = "30 days") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sampled(rows: DataFrame, rate: float, *, key: str = "event_id", fill: Column | None = None) -> DataFrame:
    """Rows whose hash is within the rate; where the queue is over 80 % full, within a tenth of it."""
    now = F.lit(rate) if fill is None else F.when(fill > PRESSURE, rate * UNDER_PRESSURE).otherwise(rate)
    h = F.conv(F.left(F.md5(F.col(key).cast("string")), F.lit(8)), 16, 10).cast("long")
    return rows.filter(h % SAMPLE_SPAN < now * SAMPLE_SPAN)


def retained(rows: DataFrame, *, time: str = "ts", now: Column, days: int) -> DataFrame:
    return rows.filter(F.col(time) >= now - F.expr(f"interval {days} days"))


def drained(df: DataFrame, mode: str) -> DataFrame:
    """Run a streaming query over all that is there and return its table.

    Appended rows go to Parquet; complete results replace the table at each batch."""
    spark = df.sparkSession
    path, checkpoint = table_path(spark, "stream"), table_path(spark, "checkpoint")
    schema = df.schema
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        q = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    else:
        q = w.format("parquet").option("path", path).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def replayed(outbox: DataFrame, *, key: str, order: str, done: str) -> DataFrame:
    """What an outbox still has to send: each idempotency key's first entry, unless one of its entries is done; in order."""
    per = outbox.groupBy(key).agg(F.min_by(F.struct(*[c for c in outbox.columns if c != key]), order).alias("e"), F.max(F.coalesce(F.col(done), F.lit(False))).alias("__done"), F.count(F.lit(1)).alias("attempts"))
    return per.filter(~F.col("__done")).select(key, "e.*", "attempts").orderBy(order)


def complete_lines(text: Column, offset: Column) -> Column:
    """(lines, next_offset) of a file's text from a byte offset: whole lines only; a last line without its end waits."""
    body = F.encode(text, "UTF-8")
    rest = F.substring(body, (offset + 1).cast("int"), F.length(body))
    said = F.decode(rest, "UTF-8")
    whole = F.when(F.contains(said, F.lit("\n")), F.substring(said, F.lit(1), F.length(said) - F.length(F.substring_index(said, "\n", -1))))
    lines = F.filter(F.split(F.coalesce(whole, F.lit("")), "\n"), lambda x: x != "")
    return F.struct(lines.alias("lines"), (offset + F.octet_length(F.coalesce(whole, F.lit("")))).cast("long").alias("next_offset"))


def forward(rows: DataFrame, target: str, checkpoint: str, key: str = "event_id", *, time: str | None = None, days: int | None = None):
    """Append new keys to a Parquet target, once each, whatever is replayed.

    With ``time`` and ``days`` keys are looked up only among the target's rows of that many days before the batch."""

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        new = df.dropDuplicates([key])
        try:
            old = spark.read.parquet(target).filter(F.col("epoch") != epoch)
        except Exception as e:  # the first batch has no target yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        else:
            if time and days is not None:
                first = df.agg(F.min(time)).first()[0]
                old = old.filter(F.col(time) >= F.lit(first) - F.expr(f"interval {days} days")) if first is not None else old
            new = new.join(old.select(key), key, "left_anti")
        new.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(target)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
