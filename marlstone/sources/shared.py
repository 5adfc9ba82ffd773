"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session without that setting gets a folder of its own, once; on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("marlstone.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("marlstone.shared.dir", path)
    return path.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; a lost executor costs a reread."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files under a path; a table that has changed has another one."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(root, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


#: What was made of tables, by session, purpose and path, with the fingerprint it was made from.
_KEPT: dict[tuple, tuple[tuple, Any]] = {}


def kept(spark: SparkSession, purpose: str, path: str, make: Callable[[], Any], drop: Callable[[Any], None] = lambda _: None) -> Any:
    """What ``make`` gives for a table, made once a session and again when the table's files change; then the old one is dropped."""
    key, now = (spark.sparkContext.applicationId, purpose, path), fingerprint(spark, path)
    if key in _KEPT and _KEPT[key][0] == now:
        return _KEPT[key][1]
    if key in _KEPT:
        drop(_KEPT.pop(key)[1])
    _KEPT[key] = (now, make())
    return _KEPT[key][1]
