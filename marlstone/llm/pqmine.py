"""Hard negatives by product quantisation with stored residual norms.

Each pair of components is coded by the nearest of 256 centroids, and what that leaves
over by the nearest of another 256 (``LEVELS``); centroids are learned from a bounded
sample (``SAMPLE`` vectors, drawn by hash). Every row is coded and keeps the norm of
what its codes leave over. An anchor's products with the centroids that
a row's codes stand for give its approximate score, and the anchor's norm times the row's
residual norm bounds the error (Cauchy-Schwarz), so a candidate is left out only if
it can't belong to the result. Exact integer products of the rest complete each
anchor's positives and then each positive's window of negatives.

Codes stay where they are: rows are dealt by hash into blocks, each block is held by
one task at a time, and the anchors stream past it in Arrow batches. What is shipped
is the anchors once a block, and the rows that the bounds can't rule out. Equal
vectors of one label have equal scores, so only the smallest ids among them can be in
a list of ``k``; the others are found in two salted steps and aren't scanned.

Cases: rows with a null id, label or vector, or a null or non-finite component take
no part; vectors of different lengths aren't compared; ties go to the smaller id;
rows with the anchor's own id are neither its positives nor its negatives; repeated
anchor rows are one anchor, and rows of one id with different vectors or labels are
anchors of their own; repeated other rows count as rows; an anchor without
positives, or a positive without negatives in its window, gives no row; a negative
positive score has an empty window; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, made, written
from .vafile import scaled, usable

#: Vectors of each length from which centroids are learned, centroids of a subspace and level, its width, levels, rounds of k-means.
SAMPLE, CENTROIDS, WIDTH, LEVELS, ROUNDS = 4096, 256, 2, 2, 8
#: Rows of a block; what its codes stand for is held in memory. Smaller tables are dealt into blocks of ``LEAST_BLOCK`` to use all cores.
BLOCK, LEAST_BLOCK = 65536, 2048
#: Anchors that are scored at a time: 64 x 65,536 scores of four bytes are 16 MB.
ANCHORS_AT_ONCE = 64
SALTS = 64

#: By length of vectors: for each level the centroids, (subspaces, centroids, width).
Books = dict[int, list[np.ndarray]]


def _parts(x: np.ndarray, width: int) -> np.ndarray:
    """(rows, subspaces, width), with zeros after the last component."""
    parts = -(-x.shape[1] // width)
    out = np.zeros((len(x), parts * width))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, width)


def learned(sample: np.ndarray, centroids: int = CENTROIDS, width: int = WIDTH, levels: int = LEVELS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """For each level (subspaces, centroids, width): k-means of each subspace, from evenly spread starting rows."""
    x = _parts(sample, width)
    n, k = len(x), min(centroids, len(x))
    out = []
    for _ in range(levels):
        book = np.zeros((x.shape[1], k, width))
        for s in range(x.shape[1]):
            rows = x[:, s]
            c = rows[np.argsort(np.arctan2(rows[:, -1], rows[:, 0]), kind="stable")[np.linspace(0, n - 1, k).astype(int)]].copy()
            for _ in range(rounds):
                near = nearest(rows, c)
                size = np.bincount(near, minlength=k)
                for j in range(width):
                    c[:, j] = np.where(size > 0, np.bincount(near, rows[:, j], k) / np.maximum(size, 1), c[:, j])
            book[s] = c
        out.append(book)
        x = x - book[np.arange(x.shape[1]), _codes(x, book)]
    return out


def nearest(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[a : a + 4096] @ c.T - half, axis=1) for a in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, int)


def _codes(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.stack([nearest(x[:, s], book[s]) for s in range(x.shape[1])], axis=1)


def coded(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x subspaces of all levels) codes and the residuals' norms, rounded up."""
    left = _parts(x, books[0].shape[2])
    out = []
    for book in books:
        out.append(_codes(left, book))
        left = left - book[np.arange(left.shape[1]), out[-1]]
    return np.concatenate(out, axis=1).astype("u1"), np.sqrt((left * left).sum(axis=(1, 2))) * (1 + 1e-9)


def decoded(code: np.ndarray, books: list[np.ndarray], dim: int) -> np.ndarray:
    """(rows x components) what the codes stand for: the sum of their centroids."""
    subspaces = books[0].shape[0]
    out = np.zeros((len(code), subspaces, books[0].shape[2]))
    for level, book in enumerate(books):
        out += book[np.arange(subspaces), code[:, level * subspaces : (level + 1) * subspaces]]
    return np.ascontiguousarray(out.reshape(len(code), -1)[:, :dim])


def looked_up(q: np.ndarray, code: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """(anchors x rows) approximate scores: each anchor's products with the rows' centroids, summed."""
    return q @ decoded(code, books, q.shape[1]).T


def slack(q: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """(anchors x rows) greatest error of the approximate scores, with room for rounding."""
    return np.sqrt((q * q).sum(axis=1))[:, None] * norm[None] + 1e-6


def near_best(upper: np.ndarray, lower: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the allowed rows that may be among the ``k`` best."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        low = lower[at]
        at = at[upper[at] >= np.partition(low, len(low) - k)[len(low) - k]]
    return at


def in_window(upper: np.ndarray, lower: np.ndarray, allowed: np.ndarray, most: int, share: int, k: int) -> np.ndarray:
    """The numbers of the allowed rows that may be among the ``k`` best of those from ``share`` per cent of ``most`` to ``most``."""
    at = np.flatnonzero(allowed & (100 * upper >= share * most) & (lower <= most))
    sure = at[(100 * lower[at] >= share * most) & (upper[at] <= most)]
    if len(sure) >= k:
        low = lower[sure]
        at = at[upper[at] >= np.partition(low, len(low) - k)[len(low) - k]]
    return at


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)


def codebooks(rows: DataFrame) -> Books:
    """By length: the centroids, learned from ``SAMPLE`` rows at most, which come to the driver."""
    draw = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id", "v")))
    spread = F.pmod(F.xxhash64("id", "v", F.lit(7)), F.lit(SALTS))
    first = F.row_number().over(Window.partitionBy("dim", spread).orderBy(F.xxhash64("id", "v")))
    some = rows.select("dim", "v", "id", first.alias("at")).filter(F.col("at") <= SAMPLE // SALTS).select("dim", "v", draw.alias("at")).filter(F.col("at") <= SAMPLE)
    by: dict[int, list[list[int]]] = {}
    for r in some.select("dim", "v").collect():
        by.setdefault(r["dim"], []).append(r["v"])
    return {d: learned(np.array(v, "f8").reshape(len(v), d)) for d, v in by.items() if d}


def encoded(rows: DataFrame, books: Books) -> DataFrame:
    """(id, label, dim, code, norm), written to the shared folder."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # 256 centroids a subspace

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                code, norm = coded(_vectors(part.column("v"), d), shared.value[d]) if d else (np.zeros((part.num_rows, 0), "u1"), np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), part.column("dim"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm)], ["id", "label", "dim", "code", "norm"])

    return written(rows.select("id", "label", "dim", "v").mapInArrow(run, "id long, label long, dim int, code binary, norm double"), "codes")


#: What a scan gets: first the rows of a block, then the anchors with their positives' scores.
_SCAN = "cb int, tag int, id long, an long, label long, dim int, code binary, norm double, v array<bigint>, tops array<bigint>"
_FOUND = "an long, anchor_id long, place int, id long, lower double, upper double"


def scanned(codes: DataFrame, anchors: DataFrame, books: Books, blocks: int, same: bool, share: int, k: int) -> DataFrame:
    """(an, anchor_id, place, id, lower, upper): what may be among each anchor's positives, or in the window of its positive ``place``."""
    spark = codes.sparkSession
    shared = spark.sparkContext.broadcast(books)
    none = lambda t: F.lit(None).cast(t)
    block = F.pmod(F.xxhash64("id", "code"), F.lit(blocks)).cast("int")
    left = codes.select(block.alias("cb"), F.lit(0).alias("tag"), "id", none("long").alias("an"), "label", "dim", "code", "norm", none("array<bigint>").alias("v"), none("array<bigint>").alias("tops"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    right = anchors.select(each.alias("cb"), F.lit(1).alias("tag"), "id", "an", "label", "dim", none("binary").alias("code"), none("double").alias("norm"), "v", "tops")
    names = [f.split()[0] for f in _FOUND.split(", ")]

    def run(batches):
        block, rows, held = None, [], {}
        for batch in batches:
            cb = batch.column("cb").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cb)) + 1).tolist(), len(cb)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if cb[a] != block:
                    block, rows, held = cb[a], [], {}
                tag = part.column("tag").to_numpy()
                if (tag == 0).any():
                    rows.append(part.filter(pa.array(tag == 0)).select(["id", "label", "dim", "code", "norm"]))
                if (tag == 0).all():
                    continue
                if rows:
                    held, rows = _held(rows), []
                yield from _met(part.filter(pa.array(tag == 1)), held)

    def _held(rows):
        out = {}
        t = pa.Table.from_batches(rows)
        dims = t.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            p = t.filter(pa.array(dims == d))
            order = np.argsort(p.column("label").to_numpy(), kind="stable")  # a label's rows lie together
            code = np.frombuffer(b"".join(p.column("code").to_pylist()), "u1").reshape(p.num_rows, -1)[order] if d else np.zeros((p.num_rows, 0), "u1")
            stand = decoded(code, shared.value[d], d) if d else np.zeros((p.num_rows, 0))
            out[d] = (p.column("id").to_numpy()[order], p.column("label").to_numpy()[order], stand, p.column("norm").to_numpy()[order])
        return out

    def _met(part, held):
        dims = part.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            if d not in held or not d:
                continue
            ids, labels, stand, norm = held[d]
            some = part.filter(pa.array(dims == d))
            some = some.take(pa.array(np.argsort(some.column("label").to_numpy(), kind="stable")))
            own = some.column("label").to_numpy()
            # positives only meet their label's rows
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if same else [0, len(own)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                lo, hi = np.searchsorted(labels, own[start], "left"), np.searchsorted(labels, own[start], "right")
                rows = slice(lo, hi) if same else slice(0, len(ids))
                if rows.stop > rows.start:
                    for at in range(start, stop, ANCHORS_AT_ONCE):
                        yield from _scored(some.slice(at, min(ANCHORS_AT_ONCE, stop - at)), d, ids[rows], labels[rows], stand[rows], norm[rows])

    def _scored(p, d, ids, labels, stand, norm):
        q = _vectors(p.column("v"), d)
        mid, length, most = q @ stand.T, slack(q, np.ones(1))[:, 0], norm.max()
        out = [[] for _ in names]
        for i, (an, aid, label, tops) in enumerate(zip(p.column("an").to_pylist(), p.column("id").to_pylist(), p.column("label").to_pylist(), p.column("tops").to_pylist(), strict=True)):
            near = np.arange(len(ids))
            if not same:  # what no window can hold, by the largest of the bounds
                far = length[i] * most + 1e-6
                near = np.flatnonzero((mid[i] >= share * min(tops) / 100 - far) & (mid[i] <= max(tops) + far))
            half = slack(q[i : i + 1], norm[near])[0]
            upper, lower = mid[i][near] + half, mid[i][near] - half
            allowed = ids[near] != aid if same else (ids[near] != aid) & (labels[near] != label)
            for place, top in enumerate([0] if same else tops):
                got = near_best(upper, lower, allowed, k) if same else in_window(upper, lower, allowed, top, share, k)
                for o, x in zip(out, (np.full(len(got), an), np.full(len(got), aid), np.full(len(got), place, "i4"), ids[near[got]], lower[got], upper[got]), strict=True):
                    o.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names)

    both = left.unionByName(right).repartitionById(blocks, "cb").sortWithinPartitions("cb", "tag")
    return both.mapInArrow(run, _FOUND)


def exact(pairs: DataFrame, rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(an, id, label, score) of (an, id) pairs; a row of ``rows`` gives one each."""
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    met = pairs.join(rows.select("id", "label", "v"), "id").join(anchors.select("an", F.col("v").alias("w"), F.col("label").alias("own")), "an")
    return met.filter(F.size("v") == F.size("w")).select("an", "id", "label", "own", dot.alias("score"))


def fewest(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors of one label, the rows of the ``k`` smallest ids; in two steps, so that a frequent vector isn't one task's."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    some = rows.withColumn("at", place("label", "v", salt)).filter(F.col("at") <= k)
    return some.withColumn("at", place("label", "v")).filter(F.col("at") <= k).drop("at")


def mined(rows: DataFrame, anchors: DataFrame, *, k: int = 5, negatives: int = 5, share: int = 80, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its ``k`` best rows of
    the same label, the ``negatives`` best rows of other labels that score from ``share`` per cent of the positive's score to all of it."""
    y = F.col(f"`{label}`") if isinstance(label, str) else label
    pick = lambda df: df.filter(usable(f"`{vec_col}`")).select(F.col(f"`{id_col}`").cast("long").alias("id"), y.cast("long").alias("label"), scaled(f"`{vec_col}`", scale).alias("v")).filter("id is not null and label is not null").withColumn("dim", F.size("v"))
    spark = rows.sparkSession
    mark = made()
    all_rows = written(fewest(pick(rows), max(k, negatives) + 1), "vectors")
    a = written(pick(anchors).distinct().withColumn("an", F.xxhash64("id", "label", "v")), "anchors", 1)
    n = all_rows.count()
    blocks = max(-(-n // BLOCK), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_BLOCK)), 1)
    books = codebooks(all_rows)
    codes = encoded(all_rows, books)

    none = F.array().cast("array<bigint>")
    by = lambda *c: Window.partitionBy("an", *c)
    floor = F.nth_value("lower", k).over(by().orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = scanned(codes, a.withColumn("tops", none), books, blocks, True, share, k)
    pairs = found.withColumn("floor", floor).filter("floor is null or upper >= floor").select("an", "id").distinct()
    best = exact(pairs, all_rows, a).filter("label = own").withColumn("place", F.row_number().over(by().orderBy(F.desc("score"), "id"))).filter(F.col("place") <= k)
    positives = written(best.select("an", F.col("id").alias("positive_id"), (F.col("place") - 1).alias("place"), F.col("score").alias("positive_score")), "positives")

    tops = positives.groupBy("an").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("tops"))  # k at most
    found = written(scanned(codes, a.join(tops, "an"), books, blocks, False, share, negatives), "found")
    sure = F.expr(f"case when 100 * lower >= {share} * positive_score and upper <= positive_score then lower end")
    open_ = found.join(positives, ["an", "place"]).withColumn("sure", sure)
    floor = F.nth_value("sure", negatives).over(by("place").orderBy(F.desc_nulls_last("sure")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = written(open_.withColumn("floor", floor).filter("floor is null or upper >= floor").select("an", "anchor_id", "place", "positive_id", "positive_score", "id"), "left")
    scored = exact(left.select("an", "id").distinct(), all_rows, a).filter("label <> own")
    inside = left.distinct().join(scored.select("an", "id", "score"), ["an", "id"]).filter((100 * F.col("score") >= share * F.col("positive_score")) & (F.col("score") <= F.col("positive_score")))
    ranked = inside.withColumn("rank", F.row_number().over(by("place").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= negatives)
    forget(spark, mark, ("vectors", "anchors", "left"))
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
