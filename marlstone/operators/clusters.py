"""Seeded k-means whose result doesn't depend on the partitioning.

Components become floor(scale * x), centres are whole numbers, and sums, distances
and shares are exact, so any order of rows and any number of tasks gives the same
centres. Starting centres are drawn in ``DRAWS`` rounds over all rows, each row by a
hash of its id and in proportion to its squared distance (about twice ``k`` a round),
and thinned to ``k`` by weight. Each step sums in tasks; what reaches the driver is
``k`` centres, whatever the number of rows.

Cases: rows with a null id or vector, or a null or non-finite component take no part;
vectors of other lengths than the first's aren't clustered; fewer distinct vectors
than ``k`` give fewer centres; ties go to the smaller centre; an empty table gives
none. Repeated rows weigh as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import matrix, meeting

ROUNDS, DRAWS, SEED = 8, 3, 17
#: Rows and centres whose distances are held at a time.
AT_ONCE = 4096


def whole(df: DataFrame, *, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, v): usable vectors in whole numbers."""
    v = f"`{vec_col}`"
    ok = df.filter(F.expr(f"{v} is not null and size({v}) > 0 and not exists({v}, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))"))
    return ok.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.expr(f"transform({v}, x -> cast(floor({scale}D * cast(x as double)) as bigint))").alias("v")).filter("id is not null")


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance); exact as long as both fit into 53 bits."""
    at, far = np.zeros(len(x), "i8"), np.zeros(len(x), "i8")
    square = (centres.astype("f8") ** 2).sum(axis=1)
    for a in range(0, len(x), AT_ONCE):
        rows = x[a : a + AT_ONCE].astype("f8")
        d = (rows**2).sum(axis=1)[:, None] - 2 * (rows @ centres.T.astype("f8")) + square
        at[a : a + AT_ONCE] = d.argmin(axis=1)
        far[a : a + AT_ONCE] = d.min(axis=1)
    return at, far


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[pa.RecordBatch, np.ndarray]:
    part = batch.filter(pa.array(batch.column("v").value_lengths().to_numpy(zero_copy_only=False) == dim))
    return part, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of each centre, the sums of their components, and the sum of squared distances."""
    shared, (k, dim) = rows.sparkSession.sparkContext.broadcast(centres), centres.shape

    def run(batches):
        n, sums, far = np.zeros(k, "i8"), np.zeros((k, dim), "i8"), 0
        for batch in batches:
            _, x = _vectors(batch, dim)
            at, d = nearest(x, shared.value)
            n += np.bincount(at, minlength=k)
            np.add.at(sums, at, x)
            far += int(d.sum())
        c, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(k), c, [0]])), pa.array(np.concatenate([np.full(k, -1), j, [-2]])), pa.array(np.concatenate([n, sums[c, j], [far]]))], ["c", "j", "n"])

    got = rows.mapInArrow(run, "c long, j long, n long").groupBy("c", "j").agg(F.sum("n").alias("n")).toArrow()
    c, j, n = (got.column(x).to_numpy() for x in ("c", "j", "n"))
    size, sums = np.zeros(k, "i8"), np.zeros((k, dim), "i8")
    size[c[j == -1]] = n[j == -1]
    sums[c[j >= 0], j[j >= 0]] = n[j >= 0]
    return size, sums, int(n[j == -2].sum())


def _drawn(rows: DataFrame, centres: np.ndarray, want: int, total: int, draw: int) -> np.ndarray:
    """Rows taken with a chance of ``want`` times their share of the squared distances."""
    shared, dim = rows.sparkSession.sparkContext.broadcast(centres), centres.shape[1]

    def run(batches):
        for batch in batches:
            part, x = _vectors(batch, dim)
            _, d = nearest(x, shared.value)
            u = part.column("u").to_numpy().astype("f8") / (1 << 30)
            yield part.filter(pa.array(u * total < d.astype("f8") * want)).select(["v"])

    u = F.pmod(F.xxhash64("id", F.lit(SEED + draw)), F.lit(1 << 30))
    got = rows.withColumn("u", u).mapInArrow(run, "v array<bigint>").distinct().limit(16 * want).collect()
    return np.array(sorted(r["v"] for r in got), "i8").reshape(-1, dim)


def centres(df: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, rounds: int = ROUNDS) -> np.ndarray:
    """(at most k, components) whole-number centres, in order."""
    rows = whole(df, id_col=id_col, vec_col=vec_col, scale=scale)
    first = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "v").select("v").first()
    if first is None:
        return np.zeros((0, 0), "i8")
    found = np.array([first["v"]], "i8")
    for draw in range(DRAWS):
        total = _summed(rows, found)[2]
        if not total:
            break
        found = np.unique(np.concatenate([found, _drawn(rows, found, 2 * k, total, draw)]), axis=0)
    size = _summed(rows, found)[0]
    keep = [int(size.argmax())]
    while len(keep) < min(k, len(found)):  # the candidates, by weight times distance
        _, d = nearest(found, found[keep])
        worth = d.astype("f8") * np.maximum(size, 1)
        if not worth.max():
            break
        keep.append(int(worth.argmax()))
    c = found[sorted(keep)]
    for _ in range(rounds):
        size, sums, _ = _summed(rows, c)
        new = np.where(size[:, None] > 0, (2 * sums + size[:, None]) // np.maximum(2 * size[:, None], 1), c)
        if (new == c).all():
            break
        c = new
    return np.unique(c, axis=0)


def assigned(df: DataFrame, c: np.ndarray, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, cluster, distance): each usable row's nearest centre and squared distance."""
    rows = whole(df, id_col=id_col, vec_col=vec_col, scale=scale)
    shared = df.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        for batch in batches:
            if len(shared.value):
                part, x = _vectors(batch, shared.value.shape[1])
                at, d = nearest(x, shared.value)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(at.astype("i4")), pa.array(d)], ["id", "cluster", "distance"])

    return rows.mapInArrow(run, "id long, cluster int, distance long").withColumnRenamed("id", id_col)


def category_scores(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, label, score, margin, place): cosines by block, best of a cluster, mean of the best three, ranked."""
    whole = lambda c: F.expr(f"transform({c}, x -> cast(x as double))")
    ok = lambda df, c: df.filter(F.expr(f"{c} is not null and not exists({c}, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))"))
    rows, queries = ok(rows, "v"), ok(queries, "q")
    dim = rows.select(F.max(F.size("v"))).first()[0] or 1
    n = max(1, rows.count() // 32768)

    def packed(name):
        def run(batches):
            for batch in batches:
                x = batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in x], pa.binary())], batch.schema.names)

        return run

    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), F.col("label").cast("long").alias("label"), F.col("cluster").cast("long").alias("cluster"), "id", whole("v").alias("v")).filter(F.size("v") == dim)
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).select("block", "query_id", whole("q").alias("q")).filter(F.size("q") == dim)
    left = left.mapInArrow(packed("v"), "block long, label long, cluster long, id long, v binary")
    right = right.mapInArrow(packed("q"), "block long, query_id long, q binary")

    def hold(t):
        key = np.stack([t.column("label").to_numpy(), t.column("cluster").to_numpy()], axis=1)
        kinds, at = np.unique(key, axis=0, return_inverse=True)
        order = np.argsort(at.ravel(), kind="stable")
        return kinds, np.searchsorted(at.ravel()[order], np.arange(len(kinds))), t.column("id").to_numpy()[order], matrix(t.column("v"), dim)[order]

    def meet(state, batch):
        kinds, first, ids, v = state  # rows in order of their kind
        score = np.round(matrix(batch.column("q"), dim) @ v.T, 9)
        score[ids[None] == batch.column("query_id").to_numpy()[:, None]] = -2
        best = np.maximum.reduceat(score, first, axis=1)
        row, col = np.nonzero(best > -2)
        return pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), pa.array(kinds[col, 0]), pa.array(kinds[col, 1]), pa.array(best[row, col])], ["query_id", "label", "cluster", "best"])

    best = meeting(left, right, "query_id long, label long, cluster long, best double", hold, meet, tasks=n).groupBy("query_id", "label", "cluster").agg(F.max("best").alias("best"))
    three = F.row_number().over(Window.partitionBy("query_id", "label").orderBy(F.desc("best"), "cluster"))
    means = best.withColumn("r", three).filter("r <= 3").groupBy("query_id", "label").agg(F.round(F.avg("best"), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "label")
    return means.select("query_id", "label", F.round("score", 6).alias("score"), F.round(F.col("score") - F.lead("score").over(w), 6).alias("margin"), F.row_number().over(w).alias("place"))
