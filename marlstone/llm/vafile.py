"""Exact top-k inner products by a vector-approximation file.

The file holds for each vector the numbers of its cells, one byte a component: each
dimension's range over all rows is cut into 2**BITS cells. It is all that the scan
reads and ships. Rows are dealt by hash into blocks of candidates and blocks of
queries, so a task holds one block of each, of bounded size, whatever the table's
size. For each query the scan gives a lower and an upper bound of every score (one
product with the cells' centres, plus or minus half the cells' widths times the
query's absolute components); what can't be among the block's best ``k`` ends there.
The k-th best lower bound over all blocks then prunes the others.

Exact vectors are read for the survivors only, in the order of their upper bounds:
first ``FIRST * k`` of each query, then those whose bound still reaches the k-th best
exact score, which makes the result certain.

Cases: vectors that are null or hold null or non-finite components take no part;
vectors of different lengths aren't compared; ties go to the smaller id; rows
with the query's own id aren't candidates for it; repeated candidate rows count as
rows; repeated query rows are one query, and rows of one id with different vectors
are queries of their own; null ids take no part; very long vectors are read whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, made, written

BITS = 8
FIRST = 4
CANDIDATES_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 1024


def scaled(embedding: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as longs."""
    return F.expr(f"transform({embedding}, x -> cast(floor({scale}D * cast(x as double)) as bigint))")


def usable(embedding: str) -> Column:
    return F.expr(f"{embedding} is not null and not exists({embedding}, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))")


def _stacked(lists: pa.ListArray, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)


def ranges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vectors: each dimension's least and greatest component. A row a task and length comes to the driver."""

    def run(batches):
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                x = _stacked(batch.filter(pa.array(dims == d)).column("v"), d) if d else np.zeros((1, 0))
                lo, hi = x.min(axis=0), x.max(axis=0)
                seen[d] = [np.minimum(seen[d][0], lo), np.maximum(seen[d][1], hi)] if d in seen else [lo, hi]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), *(pa.array([s[i].tolist() for s in seen.values()], pa.list_(pa.float64())) for i in range(2))], ["dim", "lo", "hi"])

    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in vectors.select("dim", "v").mapInArrow(run, "dim int, lo array<double>, hi array<double>").collect():
        lo, hi = np.array(r["lo"], "f8"), np.array(r["hi"], "f8")
        out[r["dim"]] = (np.minimum(out[r["dim"]][0], lo), np.maximum(out[r["dim"]][1], hi)) if r["dim"] in out else (lo, hi)
    return out


def grid(lo: np.ndarray, hi: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The cells' widths."""
    return np.maximum((hi - lo) / (1 << bits), 1e-12)


def cells(x: np.ndarray, lo: np.ndarray, width: np.ndarray, bits: int = BITS) -> np.ndarray:
    return np.clip((x - lo) / width, 0, (1 << bits) - 1).astype("u1")


def bounds(cell: np.ndarray, q: np.ndarray, lo: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries x candidates) middles of the scores' bounds, and half their distance by query."""
    mid = (q * width) @ (cell.astype("f8") + 0.5).T + (q @ lo)[:, None]
    reach = np.maximum(np.abs(lo), np.abs(lo + width * 256))
    return mid, np.abs(q) @ (width / 2) + 1e-9 * (1 + np.abs(q) @ reach)


def survivors(ids: np.ndarray, cell: np.ndarray, qids: np.ndarray, q: np.ndarray, lo: np.ndarray, width: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the candidates' numbers that may be among its best ``k`` of the block, and the middles of their bounds."""
    mid, half = bounds(cell, q, lo, width)
    out = []
    for i in range(len(qids)):
        allowed = ids != qids[i]
        m = np.where(allowed, mid[i], -np.inf)
        near = allowed
        if len(m) > k:
            near = allowed & (m + half[i] >= np.partition(m, len(m) - k)[len(m) - k] - half[i])
        at = np.flatnonzero(near)
        out.append((at, m[at]))
    return out


def approximated(vectors: DataFrame, spans: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(id, dim, cell): the approximation file, written to the shared folder."""
    shared = vectors.sparkSession.sparkContext.broadcast(spans)  # a few numbers a dimension

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == d))
                lo, hi = shared.value[d]
                c = cells(_stacked(rows.column("v"), d), lo, grid(lo, hi)) if d else np.zeros((rows.num_rows, 0), "u1")
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("dim"), pa.array([x.tobytes() for x in c], pa.binary())], ["id", "dim", "cell"])

    return written(vectors.select("id", "dim", "v").mapInArrow(run, "id long, dim int, cell binary"), "va")


def _exact(pairs: DataFrame, c: DataFrame, q: DataFrame) -> DataFrame:
    """(qn, query_id, id, row, score) of pairs."""
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    met = pairs.join(c.select("id", "v"), "id").join(q.select("qn", F.col("v").alias("w")), "qn").filter(F.size("v") == F.size("w"))
    return met.select("qn", "query_id", "id", dot.alias("score"))


def topk(candidates: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` candidates of highest integer inner product."""
    pick = lambda df: df.filter(usable(f"`{vec_col}`")).select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled(f"`{vec_col}`", scale).alias("v")).filter("id is not null").withColumn("dim", F.size("v"))
    c, q = pick(candidates), pick(queries).distinct().withColumn("qn", F.xxhash64("id", "v"))
    mark = made()
    spans = ranges(c)
    va = approximated(c, spans)
    shared = c.sparkSession.sparkContext.broadcast(spans)
    nc, nq = max(1, -(-va.count() // CANDIDATES_PER_BLOCK)), max(1, -(-q.count() // QUERIES_PER_BLOCK))
    own = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = va.withColumn("cb", own(nc, 1)).withColumn("qb", each(nq))
    right = q.withColumn("qb", own(nq, 2)).withColumn("cb", each(nc))
    fields = ["qn", "query_id", "id", "mid", "half"]

    def task(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        dim = int(left["dim"].iloc[0]) if len(left) else 0
        if left.empty or right.empty or dim not in shared.value:
            return pd.DataFrame({f: np.zeros(0, "f8" if f in ("mid", "half") else "i8") for f in fields})
        lo, hi = shared.value[dim]
        width = grid(lo, hi)
        ids, qids = left["id"].to_numpy(), right["id"].to_numpy()
        w = np.array(right["v"].tolist(), "f8").reshape(len(right), dim)
        half = np.abs(w) @ (width / 2) + 1e-9 * (1 + np.abs(w) @ np.maximum(np.abs(lo), np.abs(lo + width * 256)))
        got = survivors(ids, np.frombuffer(b"".join(left["cell"]), "u1").reshape(len(left), dim), qids, w, lo, width, k)
        n = [len(at) for at, _ in got]
        at, mid = (np.concatenate([g[i] for g in got]) for i in range(2))
        return pd.DataFrame({"qn": np.repeat(right["qn"].to_numpy(), n), "query_id": np.repeat(qids, n), "id": ids[at.astype("i8")], "mid": mid, "half": np.repeat(half, n)})

    keys = ["cb", "qb", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(task, "qn long, query_id long, id long, mid double, half double")
    whole = Window.partitionBy("qn")
    best = whole.orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bounded = found.select("qn", "query_id", "id", (F.col("mid") - F.col("half")).alias("lower"), (F.col("mid") + F.col("half")).alias("upper"))
    pruned = bounded.withColumn("floor", F.nth_value("lower", k).over(best)).filter("floor is null or upper >= floor")
    pruned = written(pruned.withColumn("place", F.row_number().over(whole.orderBy(F.desc("upper"), "id"))).select("qn", "query_id", "id", "upper", "place"), "survivors")
    # copies of one id meet here once; the join brings each of its rows
    once = lambda df: df.select("qn", "query_id", "id").distinct()
    first = written(_exact(once(pruned.filter(F.col("place") <= FIRST * k)), c, q), "first")
    forget(c.sparkSession, mark, ("survivors", "first"))
    rank = F.row_number().over(whole.orderBy(F.desc("score"), "id"))
    kth = first.withColumn("rank", rank).filter(F.col("rank") == k).select("qn", F.col("score").alias("kth"))
    rest = pruned.filter(F.col("place") > FIRST * k).join(kth, "qn", "left").filter("kth is null or upper >= kth")
    rest = once(rest).join(once(first), ["qn", "query_id", "id"], "left_anti")
    ranked = first.unionByName(_exact(rest, c, q)).withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
