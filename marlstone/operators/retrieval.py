"""Chunking, BM25, exact vector search, rank fusion and evaluation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .blocks import portions

K1, B, RRF_K = 1.2, 0.75, 60


def fixed_windows(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 500, overlap: int = 100) -> DataFrame:
    """Windows of ``size`` characters that step by size - overlap and stop at the text's end."""
    step = size - overlap
    t = df.select(id_col, T.collapse(F.col(text_col)).alias("t")).filter("t <> ''")
    last = F.greatest(F.lit(0), F.ceil((F.length("t") - size) / F.lit(step)).cast("int"))
    c = t.select(id_col, "t", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return c.select(id_col, "chunk_index", F.substring(F.col("t"), F.col("chunk_index") * step + 1, F.lit(size)).alias("chunk"))


def pack_paragraphs(text: str | None, size: int = 512) -> list[str]:
    """Greedy packing of lines into chunks of ``size`` characters; longer lines are cut."""
    out: list[str] = []
    for line in (x.strip() for x in (text or "").split("\n")):
        for at in range(0, len(line), size):
            part = line[at : at + size]
            if out and len(out[-1]) + 1 + len(part) <= size:
                out[-1] += "\n" + part
            else:
                out.append(part)
    return out


def paragraph_chunks(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 512) -> DataFrame:
    """(id, chunk_index, chunk): each document's packed lines, by portions of Arrow batches."""

    def run(batches):
        for batch in batches:
            for part in portions(batch, "text"):
                made = [pack_paragraphs(t, size) for t in part.column("text").to_pylist()]
                row = pa.array([i for i, m in enumerate(made) for _ in m], pa.int64())
                at, chunk = pa.array([j for m in made for j in range(len(m))], pa.int32()), pa.array([c for m in made for c in m], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id").take(row), at, chunk], ["id", "chunk_index", "chunk"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, chunk_index int, chunk string").withColumnRenamed("id", id_col)


def _is(word: str):
    return lambda x: x == word


def bm25(df: DataFrame, query: list[str], *, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of documents that hold a query word. One pass over the texts: word counts are made in place, so only matching rows leave the scan."""
    terms = sorted(set(query))
    w = df.select(id_col, T.words(F.col(text_col)).alias("w"))
    tf = w.select(id_col, F.size("w").alias("dl"), *[F.size(F.filter("w", _is(q))).alias(f"tf{i}") for i, q in enumerate(terms)])
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    any_ = tf.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms))))
    joined = any_.crossJoin(F.broadcast(stats))  # the statistics are one row
    score = sum(
        (F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) for i in range(len(terms))),
        F.lit(0.0),
    )
    return joined.select(id_col, score.alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(df: DataFrame, query: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, score): the k rows with the highest cosine to a one-row query; ties to the smaller id."""
    q = query.select(F.col(vec_col).alias("__q")).limit(1)
    return df.filter(F.col(vec_col).isNotNull()).crossJoin(F.broadcast(q)).select(id_col, cosine(F.col(vec_col), F.col("__q")).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def ranked(df: DataFrame, id_col: str, k: int) -> DataFrame:
    """(id, rank) of the k best scores. The window sees k rows at most."""
    top = df.orderBy(F.desc("score"), id_col).limit(k)
    return top.select(id_col, F.row_number().over(Window.orderBy(F.desc("score"), id_col)).alias("rank"))


def fuse(channels: list[DataFrame], id_col: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of (id, rank) channels."""
    both = channels[0]
    for c in channels[1:]:
        both = both.unionByName(c)
    return both.groupBy(id_col).agg(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))).alias("rrf")).orderBy(F.desc("rrf"), id_col).limit(k)


def neighbours(chunks: DataFrame, *, id_col: str = "doc_id", tail: int = 200) -> DataFrame:
    """Each chunk with the end of the one before and the beginning of the one after."""
    w = Window.partitionBy(id_col).orderBy("chunk_index")
    before = F.lag("chunk").over(w)
    return chunks.select(id_col, "chunk_index", F.coalesce(F.right(before, F.lit(tail)), F.lit("")).alias("before"), F.coalesce(F.left(F.lead("chunk").over(w), F.lit(tail)), F.lit("")).alias("after"))


def recall_mrr(ranks: DataFrame, relevant: DataFrame, *, query: str, item: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Mean recall at each k and reciprocal rank at the largest, over all queries that have a relevant item."""
    hits = relevant.join(ranks, [query, item], "left")
    per = hits.groupBy(query).agg(*[(F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"recall_{k}") for k in ks], F.coalesce(F.max(F.when(F.col("rank") <= max(ks), 1 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    return per.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in ks], F.round(F.avg("rr"), 6).alias(f"mrr_{max(ks)}"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = successes / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)
