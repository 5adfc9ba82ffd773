"""Neighbour joins, the vector index, clusters and text vectors against brute force, and their stated cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone import retrieval_queries as Q
from marlstone.functions import encoding
from marlstone.operators import clusters, neighbours, vectors

SF = "/root/testdata/sf0.01"
ODD = [(7001, None), (7002, [0.0] * 4), (7003, [1.0, None, 1.0, 1.0]), (7004, [float("nan")] * 4), (None, [1.0] * 4), (7005, [1.0] * 3), (7006, [])]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


def usable(rows, dim):
    out = []
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, "f4").astype("f8")
            out.append((i, x / np.sqrt((x * x).sum())))
    return out


def brute(queries, examples, k, others=True):
    out = set()
    for i, q in queries:
        scored = sorted((-round(float(q @ v), 9), j) for j, v in examples if not others or i != j)
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)}
    return out


def same(got, want):
    assert {x[:3] for x in got} == {x[:3] for x in want}
    by = {x[:3]: x[3] for x in want}
    assert all(abs(by[x[:3]] - x[3]) < 2e-9 for x in got)


@pytest.mark.parametrize("block", [16384, 40])
def test_knn_join_with_a_skewed_pivot(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(1)
    near = rng.normal(size=4)
    # half of the rows lie around one direction, a fifth are one vector
    rows = [(i, (near + 0.05 * rng.normal(size=4)).tolist()) for i in range(200)] + [(i, rng.normal(size=4).tolist()) for i in range(200, 320)] + [(i, near.tolist()) for i in range(320, 400)] + ODD
    df = frame(spark, rows)
    for k in (1, 3):
        got = [tuple(r) for r in neighbours.knn_join(df, df, k, pivots=8).collect()]
        same(got, brute(usable(rows, 4), usable(rows, 4), k))
    plan = neighbours.knn_join(df, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_knn_join_of_few_and_of_none(spark):
    df = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (1, [1.0, 0.0])])
    assert {tuple(r)[:3] for r in neighbours.knn_join(df, df, 3).collect()} == {(1, 1, 2), (2, 1, 1), (2, 2, 1)}
    assert {tuple(r)[:3] for r in neighbours.knn_join(df, df, 1, others=False).collect()} == {(1, 1, 1), (2, 1, 2)}
    assert neighbours.knn_join(df, df.limit(0), 2).count() == 0 and neighbours.knn_join(df.limit(0), df, 2).count() == 0


def test_vector_index_recall_append_and_rebuild(spark):
    all_ = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = all_.filter("vec_id % 100 = 0")
    rows = [(r["vec_id"], r["embedding"]) for r in all_.collect()]
    dim = len(rows[0][1])
    truth = brute([x for x in usable(rows, dim) if x[0] % 100 == 0], usable(rows, dim), 10, others=False)
    want = {(q, j) for q, _, j, _ in truth}
    index = vectors.build(all_)
    probes, measured = vectors.calibrated(index, asked, 10, target=0.95)
    got = {(r["query_id"], r["id"]) for r in vectors.search(index, asked, 10, probes).collect()}
    assert len(got & want) / len(want) >= 0.9 and abs(len(got & want) / len(want) - measured) < 1e-9
    # what is read follows the probes
    few, every = vectors.files_probed(index, [0]), vectors.files_probed(index, list(range(len(index.centroids))))
    assert 0 < len(few) < len(every) and all("list=0/" in f for f in few)
    assert vectors.files_probed(index, [0, 1]) == sorted(few + vectors.files_probed(index, [1]))
    # two segments, some ids again with other vectors, and rebuilt: the same as one fresh index
    old = all_.filter("vec_id % 3 > 0").withColumn("embedding", F.when(F.col("vec_id") % 3 == 1, F.reverse("embedding")).otherwise(F.col("embedding")))
    grown = vectors.append(vectors.build(old, lists=9), all_.filter("vec_id % 3 < 2"))
    for x in (grown, vectors.rebuilt(grown)):
        same([tuple(r) for r in vectors.search(x, asked, 10, len(x.centroids)).collect()], truth)
    assert grown.live().count() == len(rows)


def test_vector_index_cases(spark):
    rows = [(1, [1.0, 0, 0, 0]), (2, [0, 1.0, 0, 0]), (2, [0, 0, 1.0, 0]), *ODD]
    index = vectors.build(frame(spark, rows))
    got = vectors.search(index, frame(spark, [(9, [1.0, 0.1, 0, 0]), (8, None), (7, [1.0])]), 5, 99).collect()
    assert [(r["query_id"], r["rank"], r["id"]) for r in got] == [(9, 1, 1), (9, 2, 2)]
    none = vectors.build(frame(spark, []))
    assert vectors.search(none, frame(spark, [(1, [1.0])]), 3, 4).count() == 0
    assert vectors.search(index, frame(spark, []), 3, 4).count() == 0 and vectors.calibrated(index, frame(spark, []), 3) == (len(index.centroids), 1.0)


def test_clusters_do_not_depend_on_partitions_and_fit_as_brute_force(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(6, 5)) * 3
    rows = [(i, (middle[i % 6] + 0.2 * rng.normal(size=5)).tolist()) for i in range(600)]
    df = frame(spark, rows + ODD)
    one, many = clusters.centres(df.coalesce(1), 6), clusters.centres(df.repartition(7, "vec_id"), 6)
    assert (one == many).all() and one.shape == (6, 5)
    x = np.floor(256 * np.array([v for _, v in rows], "f4").astype("f8")).astype("i8")
    at, far = clusters.nearest(x, one)
    assert {len(set(at[np.arange(600) % 6 == g])) for g in range(6)} == {1}
    true = np.array([x[np.arange(600) % 6 == g].mean(axis=0) for g in range(6)])
    assert far.sum() <= 1.05 * ((x - true[np.arange(600) % 6]) ** 2).sum()
    got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in clusters.assigned(df, one).collect()}
    assert all(got[i] == (at[i], far[i]) for i in range(600))
    assert clusters.centres(frame(spark, []), 3).shape == (0, 0)
    assert len(clusters.centres(frame(spark, [(1, [1.0, 1.0])] * 3), 4)) == 1


def test_category_scores_are_those_of_brute_force(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    c = {r["vec_id"]: r["cluster"] for r in clusters.assigned(v, clusters.centres(v, 16)).collect()}
    rows = v.filter("embedding is not null and label is not null").collect()
    unit = {r["vec_id"]: np.array(r["embedding"], "f8") / np.linalg.norm(np.array(r["embedding"], "f8")) for r in rows}
    out = {(r["query_id"], r["label"]): r for r in Q.category_clusters(spark, SF).collect()}
    for q in (0, 100, 300):
        best = {}
        for r in rows:
            if r["vec_id"] != q:
                key = (r["label"], c[r["vec_id"]])
                best[key] = max(best.get(key, -2), float(unit[q] @ unit[r["vec_id"]]))
        score = {y: np.mean(sorted((s for (z, _), s in best.items() if z == y), reverse=True)[:3]) for y in {k[0] for k in best}}
        ranked = sorted(score, key=lambda y: -score[y])
        assert all(abs(out[q, y]["score"] - score[y]) < 2e-6 for y in score)
        assert [out[q, y]["place"] for y in ranked] == list(range(1, len(ranked) + 1))
        assert abs(out[q, ranked[0]]["margin"] - (score[ranked[0]] - score[ranked[1]])) < 3e-6


def plain_vector(text):
    t = " " + re.sub("[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ") + " "
    out = np.zeros(64)
    for a, b, c in zip(t, t[1:], t[2:], strict=False):
        g = (ord(a) * 7919 + ord(b) * 104729 + ord(c) * 1299709) % 2147483647
        for m in (48271, 69621):
            h = g * m % 2147483647
            out[h % 64] += 1 if h // 64 % 2 == 0 else -1
    return out


def test_text_vectors_are_those_of_a_plain_reading(spark):
    texts = ["The quick brown fox", "é ñ 今天是星期五", "a", "", "  \t\n", None, "the  QUICK\nbrown fox ", "long " * 20_000]
    df = spark.createDataFrame([(i % 3, t, "x") for i, t in enumerate(texts)], "id int, text string, vector string")
    out = encoding.encoded(df, "text").collect()
    assert len(out) == len(texts) and out[0].asDict().keys() == {"id", "text", "vector"}
    for r in out:
        want = None if not (r["text"] or "").strip() else plain_vector(r["text"])
        assert (r["vector"] is None) == (want is None) and (want is None or np.array_equal(r["vector"], want))
    near = {r["text"]: np.array(r["vector"]) for r in out if r["vector"]}
    assert (near["The quick brown fox"] == near["the  QUICK\nbrown fox "]).all()


def test_a_query_is_sent_once_to_a_block(spark, monkeypatch):
    """Random directions need nearly all rings; they are sent to blocks, not to rings."""
    sent, plain = [], neighbours.meeting

    def counted(held, passing, *rest, **how):
        sent.append((passing.count(), passing.select("block").distinct().count()))
        return plain(held, passing, *rest, **how)

    monkeypatch.setattr(neighbours, "meeting", counted)
    rng = np.random.default_rng(5)
    df = frame(spark, [(i, rng.normal(size=16).tolist()) for i in range(1500)])
    neighbours.knn_join(df, df, 3)
    assert sent[0][0] == 1500 and sent[1][0] <= 1500 * 4


def test_texts_are_encoded_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "of the net"), (2, None)], "doc_id long, text string")
    assert "Exchange" not in encoding.encoded(df, "text")._jdf.queryExecution().executedPlan().toString()
