"""Files and stores: parsed-document caches, JSON lines by day, content-addressed objects, vector collections, catalogs.

Cases: an empty folder or table gives an empty result; bad JSON lines come back in
``_corrupt`` and don't stop a read; writing the same content twice is one object;
rows without a vector aren't stored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_FILE = r"_(\d{4}-\d{2}-\d{2})(?:\.jsonl|/|$)"


def parsed(files: DataFrame, cache: DataFrame | None, parse: Callable[[bytes], dict], *, version: str, schema: str) -> DataFrame:
    """(key, fields) of each file's content, from the cache where it has the key (parser version and content hash), else by ``parse``.

    ``parse`` is any function of the bytes, run in Arrow batches, so parsers are plugged in; a later one can be tried where it returns None."""
    key = F.sha2(F.concat(F.lit(f"{version}:").cast("binary"), F.unhex(F.sha2("content", 256))), 256)
    keyed = files.select(key.alias("key"), "content").dropDuplicates(["key"])
    new = keyed if cache is None else keyed.join(cache.select("key"), "key", "left_anti")
    fields = T._parse_datatype_string(schema).fieldNames()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [{"key": k, **(parse(bytes(c)) or {})} for k, c in zip(pdf["key"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["key", *fields])

    made = new.mapInPandas(run, f"key string, {schema}")
    if cache is None:
        return made
    return made.unionByName(keyed.select("key").join(cache.select("key", *fields), "key"))


def chained(*parsers: Callable[[bytes], dict | None]) -> Callable[[bytes], dict | None]:
    """The first parser's result that is something; one that fails counts as nothing."""

    def run(content: bytes) -> dict | None:
        for p in parsers:
            try:
                out = p(content)
            except Exception:  # a parser may fail in any way on broken input
                out = None
            if out:
                return out
        return None

    return run


def scan(spark: SparkSession, path: str, columns: list[str], *, size: int | None = None, key: str | None = None) -> DataFrame:
    """The projected columns of a table; with ``size`` its first rows by key."""
    rows = spark.read.parquet(path).select(*columns)
    return rows if size is None else rows.orderBy(key or columns[0]).limit(size)


def described(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).exists(p))


def write_vectors(chunks: DataFrame, path: str, *, vec_col: str = "embedding") -> None:
    """Rows that have a vector; scalar columns only, nulls left out by the reader."""
    scalars = [f.name for f in chunks.schema.fields if f.name == vec_col or not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    chunks.filter(F.col(vec_col).isNotNull()).select(*scalars).write.mode("append").parquet(path)


class ReadOnly:
    """A table that can be counted, read and searched, and nothing else."""

    def __init__(self, df: DataFrame) -> None:
        self._df = df

    def count(self) -> int:
        return self._df.count()

    def get(self, *columns: str, where: Column | None = None) -> DataFrame:
        rows = self._df if where is None else self._df.filter(where)
        return rows.select(*columns) if columns else rows

    def query(self, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return search(self._df)


def where(conditions: dict) -> Column:
    """A vector store's filter: {field: value | {"$in": [...]} | {"$ne": value}}, and {"$and": [...]}."""
    out = F.lit(True)
    for name, want in conditions.items():
        if name == "$and":
            for c in want:
                out = out & where(c)
        elif isinstance(want, dict):
            ((op, value),) = want.items()
            out = out & {"$in": lambda c, v: c.isin(list(v)), "$ne": lambda c, v: c.isNull() | (c != v), "$eq": lambda c, v: c == v}[op](F.col(name), value)
        else:
            out = out & (F.col(name) == want)
    return out


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_daily(df: DataFrame, path: str, *, time: str) -> None:
    """JSON lines in a folder for each day of ``time``."""
    df.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").json(path)


def kept_days(rows: DataFrame, *, today: Column, keep: int, day: str = "day") -> DataFrame:
    """Rows of the days that retention keeps; only their folders are read."""
    return rows.filter(F.col(day) >= F.date_sub(today, keep))


def old_days(rows: DataFrame, *, today: Column, keep: int, day: str = "day") -> DataFrame:
    return rows.select(day).distinct().filter(F.col(day) < F.date_sub(today, keep))


def delete_old_days(spark: SparkSession, path: str, *, today: str, keep: int, day: str = "day") -> list[str]:
    """Delete the folders of the days before ``today`` less ``keep`` days; returns these days. Only folder names come to the driver."""
    from datetime import date, timedelta

    first = (date.fromisoformat(today) - timedelta(days=keep)).isoformat()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for f in fs.listStatus(root) if fs.exists(root) else []:
        name = f.getPath().getName()
        if f.isDirectory() and name.startswith(f"{day}=") and name[len(day) + 1 :] < first and name[len(day) + 1 :].count("-") == 2:
            fs.delete(f.getPath(), True)
            gone.append(name[len(day) + 1 :])
    return sorted(gone)


def read_json(spark: SparkSession, path: str, schema: str, *, array: bool = False) -> DataFrame:
    """JSON lines, or an array a file; lines that don't fit keep their text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", array).option("columnNameOfCorruptRecord", "_corrupt").json(path)


@dataclass(frozen=True)
class Objects:
    """Content-addressed JSON objects: the name is the SHA-256 of the canonical bytes, checked at each read."""

    spark: SparkSession
    folder: str

    def _path(self, name: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def publish(self, value) -> str:
        body = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        name = hashlib.sha256(body.encode()).hexdigest()
        path, fs = self._path(name)
        if not fs.exists(path):
            out = fs.create(path, False)
            try:
                out.write(bytearray(body.encode()))
            finally:
                out.close()
        return name

    def resolve(self, name: str):
        body = self.spark.read.text(f"{self.folder}/{name}.json", wholetext=True).first()[0]
        if hashlib.sha256(body.encode()).hexdigest() != name:
            raise ValueError(f"the object {name} has been changed")
        return json.loads(body)


class Catalog:
    """Sources by id from several providers; a later provider's source replaces an earlier one's."""

    def __init__(self, *providers: Callable[[], dict[str, DataFrame]]) -> None:
        self.providers = providers

    def snapshot(self) -> tuple[str, dict[str, dict[str, str]]]:
        """(version, fields by source): the version is the first 16 digits of a SHA-256 of the fields."""
        sources: dict[str, dict[str, str]] = {}
        for p in self.providers:
            sources |= {i: dict(described(df)) for i, df in p().items()}
        body = json.dumps(sources, sort_keys=True)
        return hashlib.sha256(body.encode()).hexdigest()[:16], sources

    def authorized(self, allowed: dict[str, list[str]]) -> dict[str, DataFrame]:
        """The allowed columns of the allowed sources."""
        out: dict[str, DataFrame] = {}
        for p in self.providers:
            out |= {i: df.select(*[c for c in df.columns if c in allowed[i]]) for i, df in p().items() if i in allowed}
        return out

    @staticmethod
    def mentions(text: str, aliases: dict[str, str]) -> list[tuple[int, int, str]]:
        """(start, end, field) of the names in a text, longest first, none over another."""
        taken = bytearray(len(text))
        out = []
        for alias in sorted(aliases, key=lambda a: (-len(a), a)):
            at = text.find(alias)
            while alias and at >= 0:
                if not any(taken[at : at + len(alias)]):
                    taken[at : at + len(alias)] = b"\1" * len(alias)
                    out.append((at, at + len(alias), aliases[alias]))
                at = text.find(alias, at + 1)
        return sorted(out)


def recent(files: DataFrame, *, name: str, time: str, most: int = 12) -> DataFrame:
    """The latest files or jobs, newest first."""
    return files.orderBy(F.desc(time), name).limit(most)
