"""A written vector index: inverted lists of residual codes, probed by lists, exact at the end.

Each vector, brought to length one, goes to the list of its nearest centroid
(``clusters.centres``, learned from a bounded sample). A list is a folder; its files
hold ids, one-byte codes of what the centroid leaves over, and the vectors themselves.
A search reads the codes of the lists that its queries probe and nothing else of them,
keeps what may be among the ``k`` best by the codes' error bound, and reads the
vectors of these alone to rank them exactly. ``probes`` is a number of lists;
``calibrated`` finds the smallest that reaches a recall on a bounded sample of
queries, measured against all vectors.

``append`` writes a segment with the same centroids; a row with an id that is there
already replaces it. ``rebuilt`` writes all live rows anew, with centroids of their own.

Cases: rows with a null id or vector, a null or non-finite component, of length zero,
or of another number of components than most rows of the first segment take no part; ties by score (nine
digits) go to the smaller id; repeated ids of one segment count once (the vector that
sorts first); an empty table gives an empty index, in which nothing is found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import table_path, written
from .blocks import matrix, meeting
from .clusters import centres, nearest

#: Vectors that centroids are learned from, lists at most, rows of a block of a list, queries of a calibration.
SAMPLE, MOST_LISTS, BLOCK, TRIED = 65536, 4096, 65536, 64
SCALE = 4096


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    centroids: np.ndarray  # lists x components, in 1/SCALE
    segments: int
    rows: int

    @property
    def stored(self) -> DataFrame:
        return self.spark.read.schema("id long, code binary, step double, v array<double>, segment int, list int").parquet(f"{self.path}/rows")

    def live(self) -> DataFrame:
        """The stored rows without those that a later segment replaces."""
        if self.segments < 2:
            return self.stored
        gone = self.spark.read.schema("id long, before int").parquet(f"{self.path}/gone").groupBy("id").agg(F.max("before").alias("before"))
        return self.stored.join(gone, "id", "left").filter("before is null or segment >= before").drop("before")


def _unit(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = f"`{vec_col}`"
    ok = df.filter(F.expr(f"{v} is not null and not exists({v}, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))"))
    rows = ok.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.expr(f"transform({v}, x -> cast(x as double))").alias("x")).filter("id is not null")
    rows = rows.withColumn("n", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x))).filter("n > 0")
    return rows.select("id", F.transform("x", lambda x: x / F.col("n")).alias("v"))


def _write(index: VectorIndex, unit: DataFrame) -> int:
    """Write a segment; returns its number of rows."""
    shared, dim = index.spark.sparkContext.broadcast(index.centroids), index.centroids.shape[1]

    def run(batches):
        for batch in batches:
            part = batch.filter(pa.array(batch.column("v").value_lengths().to_numpy(zero_copy_only=False) == dim))
            v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            at, _ = nearest(np.floor(v * SCALE).astype("i8"), shared.value)
            left = v - shared.value[at] / SCALE
            step = np.abs(left).max(axis=1) / 127 + 1e-12
            code = np.rint(left / step[:, None]).astype("i1")
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), part.column("v"), pa.array(at.astype("i4"))], ["id", "code", "step", "v", "list"])

    rows = unit.groupBy("id").agg(F.min("v").alias("v"))
    coded = rows.mapInArrow(run, "id long, code binary, step double, v array<double>, list int")
    target = f"{index.path}/rows/segment={index.segments}"
    n = rows.count()
    files = max(1, n // 262144)
    coded.repartition(max(1, min(len(index.centroids), 256)), "list", F.pmod(F.xxhash64("id"), F.lit(files))).sortWithinPartitions("list", "id").write.partitionBy("list").parquet(target)
    return n


def build(df: DataFrame, *, lists: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex:
    """Write an index of ``df``; by default about the square root of the rows as lists."""
    spark = df.sparkSession
    unit = written(_unit(df, id_col, vec_col), "unit")
    common = unit.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    unit = unit.filter(F.size("v") == (common["dim"] if common else 1))
    n = unit.count()
    head = unit.orderBy(F.xxhash64("v"), "id").limit(min(n, SAMPLE))
    lists = lists or max(1, min(MOST_LISTS, math.isqrt(n)))
    found = centres(head, lists, id_col="id", vec_col="v", scale=SCALE, rounds=4) if n else np.zeros((1, 1), "i8")
    index = VectorIndex(spark, table_path(spark, "vectors"), found, 0, 0)
    return replace(index, segments=1, rows=_write(index, unit))


def append(index: VectorIndex, df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex:
    """The index with one more segment; what it holds under the same ids is replaced."""
    unit = written(_unit(df, id_col, vec_col), "unit")
    unit.select("id", F.lit(index.segments).alias("before")).distinct().write.mode("append").parquet(f"{index.path}/gone")
    return replace(index, segments=index.segments + 1, rows=index.rows + _write(index, unit))


def rebuilt(index: VectorIndex, *, lists: int | None = None) -> VectorIndex:
    """A new index of the live rows."""
    return build(index.live().select("id", "v"), lists=lists, id_col="id", vec_col="v")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, *, id_col: str = "vec_id", vec_col: str = "embedding", others: bool = False) -> DataFrame:
    """(query_id, rank, id, score): for each query the ``k`` rows of highest cosine in the ``probes`` lists nearest to it."""
    spark, dim = index.spark, index.centroids.shape[1]
    shared = spark.sparkContext.broadcast(index.centroids)
    probes = max(1, min(probes, len(index.centroids)))
    asked = written(_unit(queries, id_col, vec_col).distinct().select(F.xxhash64("id", "v").alias("qn"), F.col("id").alias("query_id"), F.col("v").alias("q")), "asked")

    def routed(batches):
        for batch in batches:
            part = batch.filter(pa.array(batch.column("q").value_lengths().to_numpy(zero_copy_only=False) == dim))
            q = part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            c = shared.value / SCALE
            far = (c**2).sum(axis=1) - 2 * (q @ c.T)
            at = np.argpartition(far, probes - 1, axis=1)[:, :probes].ravel()
            row = np.repeat(np.arange(len(q)), probes)
            yield pa.RecordBatch.from_arrays([part.column("qn").take(pa.array(row)), part.column("query_id").take(pa.array(row)), pa.array(at.astype("i4")), pa.array([x.tobytes() for x in q[row]], pa.binary())], ["qn", "query_id", "list", "q"])

    sent = written(asked.mapInArrow(routed, "qn long, query_id long, list int, q binary"), "probes")
    probed = sorted(r["list"] for r in sent.select("list").distinct().collect())  # a number a list
    rows = index.live().filter(F.col("list").isin(probed) if len(probed) < len(index.centroids) else F.lit(True))
    parts = max(1, index.rows // (len(index.centroids) * BLOCK) + 1)
    held = rows.select((F.col("list").cast("long") * 65536 + F.pmod(F.xxhash64("id"), F.lit(parts))).alias("block"), "id", "list", "code", "step")
    passing = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select((F.col("list").cast("long") * 65536 + F.col("part")).alias("block"), "qn", "query_id", "q")

    def hold(t: pa.Table):
        c = shared.value[t.column("list")[0].as_py()] / SCALE
        step = t.column("step").to_numpy()
        return t.column("id").to_numpy(), c + matrix(t.column("code"), dim, "i1") * step[:, None], step

    def meet(state, batch: pa.RecordBatch):
        ids, v, step = state
        q = matrix(batch.column("q"), dim)
        mid = q @ v.T
        half = np.abs(q).sum(axis=1)[:, None] * (step / 2)[None] + 1e-9
        if others:
            mid[ids[None] == batch.column("query_id").to_numpy()[:, None]] = -np.inf
        m = min(k, len(ids))
        floor = np.partition(mid - half, len(ids) - m, axis=1)[:, len(ids) - m]
        row, col = np.nonzero((mid + half >= floor[:, None]) & np.isfinite(mid))
        return pa.RecordBatch.from_arrays([batch.column("qn").take(pa.array(row)), batch.column("query_id").take(pa.array(row)), pa.array(ids[col]), pa.array(mid[row, col] - half[row, col]), pa.array(mid[row, col] + half[row, col])], ["qn", "query_id", "id", "lower", "upper"])

    found = meeting(held, passing, "qn long, query_id long, id long, lower double, upper double", hold, meet, tasks=max(1, min(len(probed) * parts, 4 * spark.sparkContext.defaultParallelism)))
    floor = F.nth_value("lower", k).over(Window.partitionBy("qn").orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = written(found.withColumn("floor", floor).filter("floor is null or upper >= floor").select("qn", "query_id", "id"), "near")
    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    exact = near.join(rows.select("id", "v"), "id").join(asked.select("qn", "q"), "qn").select("qn", "query_id", "id", F.round(dot, 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("score"), "id"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def files_probed(index: VectorIndex, lists: list[int]) -> list[str]:
    """The files that a search of these lists reads."""
    return sorted(r[0] for r in index.stored.filter(F.col("list").isin(lists)).select("_metadata.file_path").distinct().collect())  # a name a file


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (query_id, id) pairs that were found."""
    n = truth.count()
    return found.select("query_id", "id").join(truth.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / n if n else 1.0


def calibrated(index: VectorIndex, queries: DataFrame, k: int, *, target: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[int, float]:
    """(probes, recall): the fewest lists that reach the target on ``TRIED`` queries.

    What is probed is ranked exactly, so a true neighbour is found as soon as its list is probed: one search of all lists gives the recall of any number."""
    some = queries.filter(F.col(f"`{vec_col}`").isNotNull()).orderBy(F.xxhash64(f"`{id_col}`")).limit(TRIED)
    some = written(some.select(f"`{id_col}`", f"`{vec_col}`"), "tried")
    truth = search(index, some, k, len(index.centroids), id_col=id_col, vec_col=vec_col).select("query_id", "id")
    homes = truth.join(index.live().select("id", "list"), "id").groupBy("query_id").agg(F.collect_list("list").alias("lists")).collect()  # k lists a query
    vector = {r["id"]: np.array(r["v"]) for r in _unit(some, id_col, vec_col).collect()}
    c = index.centroids / SCALE
    needed = []
    for r in homes:
        q = vector[r["query_id"]]
        place = np.empty(len(c), "i8")
        place[np.argsort((c**2).sum(axis=1) - 2 * (c @ q), kind="stable")] = np.arange(len(c))
        needed += place[r["lists"]].tolist()
    if not needed:
        return len(c), 1.0
    needed.sort()
    probes = needed[max(0, math.ceil(target * len(needed)) - 1)] + 1
    return probes, sum(p < probes for p in needed) / len(needed)
