"""Exact nearest-neighbour join of many queries with many examples, by cosine.

Vectors are brought to length one, where the nearest by distance are the nearest by
cosine. Examples are dealt to the nearest of a bounded number of pivots and there into
rings by their distance to it. Blocks of up to about ``BLOCK`` rows take rings in order;
a ring that runs over a block's end is split by a hash. A query is sent once to a block
whatever number of its rings it needs, so what is shuffled is queries times blocks.
What the driver keeps is a row a ring: its distances and its number of rows.

A query first meets one block that is likely to be near, which bounds the distance of
its k-th neighbour; rings' numbers alone give a bound too. By the triangle inequality
only rings whose distances to their pivot differ from the query's by no more than the
bound can hold a neighbour, and the query goes to their blocks, with the score that it
has to reach: products in single precision leave out what falls short of it by more
than their error, the others are scored in double precision. Neither side is broadcast and
no pair is made outside of a common block. Of equal example vectors only the k + 1
smallest ids can be among the k nearest, so the others stay behind.

Cases: rows with a null id or vector, a null or non-finite component, or of length
zero take no part; vectors of another number of components than most examples take no part; a
query's own id is left out if ``others``; ties by score (nine digits) go to the smaller
id; repeated queries are one query, repeated ids with different vectors are queries
of their own; fewer than ``k`` examples give fewer rows; empty tables give none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from .blocks import matrix, meeting

PIVOTS, RING, BLOCK, SALTS = 64, 0.02, 65536, 32
#: Components of a block's vectors, scores that are worked on at a time, queries that are sent on at a time, and rows that are worth a task.
NUMBERS, SCORES, ROUTED, LEAST = 2**22, 2**22, 512, 1024
#: Room for rounding in distances; scores are held to nine digits.
SLACK = 1e-4


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): usable vectors of length one."""
    v = f"`{vec_col}`"
    ok = df.filter(F.expr(f"{v} is not null and not exists({v}, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))"))
    rows = ok.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.expr(f"transform({v}, x -> cast(x as double))").alias("x")).filter("id is not null")
    rows = rows.withColumn("n", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x))).filter("n > 0")
    return rows.select("id", F.transform("x", lambda x: x / F.col("n")).alias("v"))


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (v @ pivots.T), 0))


def _rows(batch: pa.RecordBatch, dim: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of that length, and their vectors."""
    size = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    part = batch.filter(pa.array(size == dim))
    return part, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def knn_join(queries: DataFrame, examples: DataFrame, k: int, *, query_id: str = "vec_id", example_id: str = "vec_id", vec_col: str = "embedding", others: bool = True, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, example_id, score): the ``k`` examples of highest cosine for each query."""
    spark = queries.sparkSession
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    few = _usable(examples, example_id, vec_col).withColumn("at", place("v", salt)).filter(F.col("at") <= k + 1).withColumn("at", place("v")).filter(F.col("at") <= k + 1).drop("at")
    e = written(few, "examples")
    common = e.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    chosen = e.filter(F.size("v") == common["dim"]).orderBy(F.xxhash64("v"), "id").limit(4 * pivots).collect() if common else []  # a bounded number of vectors
    schema = "query_id long, rank int, example_id long, score double"
    if not chosen:
        return spark.createDataFrame([], schema)
    dim = len(chosen[0]["v"])
    centre = np.unique(np.array([r["v"] for r in chosen if len(r["v"]) == dim]), axis=0)[:: max(1, len(chosen) // pivots)][:pivots]
    shared = spark.sparkContext.broadcast(centre)

    def placed(batches):
        for batch in batches:
            part, v = _rows(batch, dim)
            d = _distances(v, shared.value)
            cell = d.argmin(axis=1) if len(v) else np.zeros(0, "i8")
            near = d[np.arange(len(v)), cell]
            ring = np.floor(near / RING).astype("i8")
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(cell * 128 + ring), pa.array(near)], ["id", "v", "ring", "d"])

    e = written(e.mapInArrow(placed, "id long, v binary, ring long, d double"), "rings")
    rings = e.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).orderBy("ring").toArrow()  # 128 a pivot at most
    ring, n, lo, hi = (rings.column(c).to_numpy() for c in ("ring", "n", "lo", "hi"))
    total = int(n.sum())
    cores = spark.sparkContext.defaultParallelism
    most = max(1, min(BLOCK, NUMBERS // max(dim, 1)))
    blocks = max(-(-total // most), min(math.ceil(math.sqrt(cores)), -(-total // LEAST)))
    slices = max(1, min(-(-cores // blocks), -(-total // LEAST)))  # of the queries; each has the block's rows once more
    size = -(-total // blocks)
    starts = np.cumsum(n) - n
    opens, ends = starts // size, (starts + n - 1) // size  # each ring's first and last block
    blocks = int(ends[-1]) + 1
    has = np.arange(blocks)
    left, right = np.searchsorted(ends, has, "left"), np.searchsorted(opens, has, "right")  # each block's rings
    table = spark.sparkContext.broadcast((ring, n, lo, hi, starts, opens, ends, left, right))
    error = 1e-6 + 1.2e-7 * dim  # of a product of unit vectors in single precision, and of rounding

    def met(held: pa.Table):
        v = matrix(held.column("v"), dim)
        return held.column("id").to_numpy(), v, v.astype("f4")

    def best(state, batch: pa.RecordBatch):
        step = max(1, SCORES // len(state[0]))
        out = [_best(state, batch.slice(a, step)) for a in range(0, batch.num_rows, step)]
        return pa.concat_batches(out)

    def _best(state, batch: pa.RecordBatch):
        ids, v, single = state
        q, asker = matrix(batch.column("q"), dim), batch.column("query_id").to_numpy()
        near = q.astype("f4") @ single.T
        cut = batch.column("least").to_numpy(zero_copy_only=False).astype("f8") - error
        for i in np.flatnonzero(np.isnan(cut)).tolist():  # nothing known of this query yet
            row = np.where(ids == asker[i], np.float32(-np.inf), near[i]) if others else near[i]
            m = min(k, len(ids))
            cut[i] = np.partition(row, len(ids) - m)[len(ids) - m] - 2 * error
        row, col = np.nonzero(near >= cut[:, None].astype("f4") - np.float32(1e-6))
        if others:
            row, col = (x[ids[col] != asker[row]] for x in (row, col))
        score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[row[a : a + 65536]], v[col[a : a + 65536]]) for a in range(0, len(row), 65536))]).round(9)
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col, score = row[first], col[first], score[first]
        return pa.RecordBatch.from_arrays([batch.column("qn").take(pa.array(row)), batch.column("query_id").take(pa.array(row)), pa.array(ids[col]), pa.array(score)], ["qn", "query_id", "example_id", "score"])

    found = "qn long, query_id long, example_id long, score double"

    def dealt(batches):
        ring, n, _, _, starts, *_ = table.value
        for batch in batches:
            at = np.searchsorted(ring, batch.column("ring").to_numpy())
            share = (batch.column("mixed").to_numpy().view("u8") >> np.uint64(33)) / 2**31
            block = (starts[at] + np.minimum((share * n[at]).astype("i8"), n[at] - 1)) // size
            for s in range(slices):
                yield pa.RecordBatch.from_arrays([pa.array(block * slices + s), batch.column("id"), batch.column("v")], ["block", "id", "v"])

    held = e.select("ring", "id", "v", F.xxhash64("id", "v").alias("mixed")).mapInArrow(dealt, "block long, id long, v binary")
    none = F.lit(None).cast("double").alias("least")
    asked = written(_usable(queries, query_id, vec_col).distinct().select(F.xxhash64("id", "v").alias("qn"), F.col("id").alias("query_id"), "v"), "asked")

    def routed(first: bool):
        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, ROUTED):
                    part, v = _rows(batch.slice(a, ROUTED), dim)
                    if len(v):
                        yield sent(part, v)

        def sent(part, v):
            ring, n, lo, hi, _, opens, ends, left, right = table.value
            each = np.arange(len(v))
            qn = part.column("qn").to_numpy()
            d = _distances(v, shared.value)[:, ring // 128]
            least = np.maximum(np.maximum(lo - d, d - hi), 0)
            if first:
                at = np.argmin(least + d + np.where(n > k, 0, 4), axis=1)
                row, block = each, opens[at] + qn % (ends[at] - opens[at] + 1)
            else:
                most = d + hi
                order = np.argsort(most, axis=1)
                enough = np.cumsum(n[order], axis=1) >= k + 1
                kth = np.where(enough[:, -1], most[each, order[each, enough.argmax(axis=1)]], 4.0)
                reach = part.column("least").to_numpy(zero_copy_only=False).astype("f8")
                bound = np.minimum(kth, np.nan_to_num(np.sqrt(np.maximum(2 - 2 * reach, 0)), nan=4.0))
                needs = np.cumsum(np.pad(least <= bound[:, None] + SLACK, ((0, 0), (1, 0))), axis=1)
                row, block = np.nonzero(needs[:, right] > needs[:, left])
            take = pa.array(row)
            return pa.RecordBatch.from_arrays(
                [pa.array(block * slices + qn[row] % slices), part.column("qn").take(take), part.column("query_id").take(take), part.column("least").take(take), pa.array([x.tobytes() for x in v[row]], pa.binary())], ["block", "qn", "query_id", "least", "q"]
            )

        return run

    wants = "block long, qn long, query_id long, least double, q binary"
    near = meeting(held, asked.select("*", none).mapInArrow(routed(True), wants), found, met, best, tasks=blocks * slices, numbered=True)
    bounds = near.groupBy("qn").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    all_ = meeting(held, asked.join(bounds, "qn", "left").mapInArrow(routed(False), wants), found, met, best, tasks=blocks * slices, numbered=True)
    rank = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("score"), "example_id"))
    return all_.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "example_id", "score")
