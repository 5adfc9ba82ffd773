"""Session windows over a stream, with late rows kept in a table of their own.

A batch's watermark is the latest event time of all batches before it less the delay.
Rows at or after it are on time and go to one table, rows before it and rows without a
time to another; both are written by batch number, so a batch that is run again after
a failure replaces itself and no row is lost or counted twice. Sessions are Spark's
session windows over what was on time, so they are the same whatever the batches.

Cases: a null key is a key; repeated rows count as often as they come; a null time is
late; an empty stream gives empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import table_path


@dataclass(frozen=True)
class Kept:
    """The tables of a stream: rows on time, late rows, and each batch's watermark and counts."""

    spark: SparkSession
    path: str
    schema: StructType

    def _read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def on_time(self) -> DataFrame:
        return self._read("on_time", self.schema)

    def late(self) -> DataFrame:
        return self._read("late", self.schema)

    def batches(self) -> DataFrame:
        """(batch, watermark_us, newest_us, on_time, late)."""
        return self._read("batches", StructType([StructField(c, LongType()) for c in ("watermark_us", "newest_us", "on_time", "late", "batch")]))

    def sessions(self, key: str, gap: str, *, time: str = "ts") -> DataFrame:
        """(key, start, end, n): a session ends when no row of its key comes for the gap."""
        rows = self.on_time().groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
        return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def kept(rows: DataFrame, path: str | None = None) -> Kept:
    """The tables' handle; makes the folders of an empty table."""
    spark = rows.sparkSession
    out = Kept(spark, path or table_path(spark, "sessions"), rows.schema)
    fs = spark._jvm.org.apache.hadoop.fs.Path(out.path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("on_time", "late", "batches"):
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{out.path}/{name}"))
    return out


def split_late(rows: DataFrame, into: Kept, *, delay_us: int, checkpoint: str, time: str = "ts") -> StreamingQuery:
    """Start a query over all that is there that writes rows on time and late rows apart."""

    def batch(df: DataFrame, epoch: int) -> None:
        before = into.batches().filter(F.col("batch") < epoch).agg(F.max("newest_us")).first()[0]
        us = F.unix_micros(time)
        ok = us.isNotNull() if before is None else F.coalesce(us >= before - delay_us, F.lit(False))
        df.persist()
        for name, part in (("on_time", df.filter(ok)), ("late", df.filter(~ok))):
            part.write.mode("overwrite").parquet(f"{into.path}/{name}/batch={epoch}")
        counts = df.agg(F.lit(None if before is None else before - delay_us).cast("long").alias("watermark_us"), F.max(us).alias("newest_us"), F.count_if(ok).alias("on_time"), F.count_if(~ok).alias("late"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{into.path}/batches/batch={epoch}")
        df.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
