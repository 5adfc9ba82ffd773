"""Plans of requests, stores, streams, search and analytics against stated cases and brute force."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators import analytics as A
from marlstone.operators import evidence as V
from marlstone.operators import retrieval as R
from marlstone.operators import search as S
from marlstone.plans import requests as Q
from marlstone.plans.algebra import PlanError, Predicate
from marlstone.sources import files as FI
from marlstone.streaming import logs

FIELDS = {"压力": "pressure", "温度": "temp", "状态": "state"}


def test_predicates_of_questions():
    got = Q.numeric_predicates("温度高于 30 且压力不超过2kPa，温度介于5和9之间", FIELDS)
    assert [(p.field, p.op, p.value) for p in got] == [("temp", "gt", 30.0), ("pressure", "lte", 2000.0), ("temp", "between", (5.0, 9.0))]
    got = Q.categorical_predicates("状态是运行或停机，温度为空，状态不是故障", FIELDS)
    assert [(p.field, p.op, p.value) for p in got] == [("state", "in", ("运行", "停机")), ("state", "ne", "故障")]
    assert [(p.field, p.op) for p in Q.null_predicates("温度为空而压力非空", FIELDS)] == [("temp", "is_null"), ("pressure", "is_not_null")]


def test_turns():
    a = Q.Turn("s", "w", {"x": Predicate("x", "gt", 1), "y": Predicate("y", "lt", 2)}, ("o",))
    b = Q.inherit(a, Q.Turn(filters={"x": Predicate("x", "gt", 5)}))
    assert b.source == "s" and b.filters["x"].value == 5 and b.filters["y"].value == 2 and b.outputs == ("o",)
    assert Q.replaced(a, window="v").window == "v" and set(Q.cancelled(a, ["x"]).filters) == {"y"} and Q.cancelled(a) == Q.Turn()


def test_registry(spark):
    kind = T.StructType([T.StructField("a", T.LongType())])
    r = Q.Registry()
    r.register(Q.Operator("twice", lambda t, by=2: t.select((F.col("a") * by).alias("a")), {"t": kind}, kind))
    r.register(Q.Operator("put", lambda t: t, {"t": kind}, writes=True))
    df = spark.range(3).select(F.col("id").alias("a"))
    assert [x["a"] for x in r.execute("twice", {"t": df}, by=3).collect()] == [0, 3, 6] and r.names() == ["put@1", "twice@1"]
    for call in (lambda: r.execute("none", {}), lambda: r.execute("twice", {}), lambda: r.execute("twice", {"t": df.withColumnRenamed("a", "b")}), lambda: r.execute("put", {"t": df}), lambda: r.register(Q.Operator("put", None, {}))):
        with pytest.raises(PlanError):
            call()

    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[float(len(t))] for t in texts]

    out = Q.embedded(spark.createDataFrame([("a",), ("bad",), ("ccc",)], "text string").coalesce(1), embed)
    assert [r["embedding"] for r in out.collect()] == [[1.0], None, [3.0]]


def test_driver_checks():
    assert Q.bound_role({"x": {"left"}, "y": {"right"}}, "left") == "x"
    with pytest.raises(PlanError):
        Q.bound_role({"x": {"left"}, "y": {"left"}}, "left")
    assert Q.owners([{1, 2}, {2, 3}]) == {2} and Q.owners([{1}]) == set()
    assert Q.lineage({"b": ("a",), "c": ("b", "s2")}, {"a", "s2"}) == {"b": {"a"}, "c": {"a", "s2"}}
    with pytest.raises(PlanError):
        Q.lineage({"b": ("c",), "c": ("b",)}, set())
    assert Q.uncovered("abcdef", [(0, 3)], [(0, 2), (2, 5)]) == ["cde"]
    assert Q.covered({"r": {"k": 1}, "s": {"k": 2}, "t": {"k": 1}}, {"n": {"k": 1, "z": 0}}, {"t": {"s"}}) == {"r"}
    assert Q.merged_requirements([{"demand": 1, "clause": 1, "family": "f", "fields": ["a"]}, {"demand": 1, "clause": 1, "family": "f", "fields": ["b", "a"]}])[0]["fields"] == ["a", "b"]
    assert Q.blockers({"condition": "x", "order_by": "t", "keys": [], "max_gap_us": 0}, Q.EVENT_RULES) == ["gap"]
    assert Q.reliability(dict.fromkeys(Q.READINESS, 1.0)) == 0.98 and Q.reliability({"coverage": 1, "operator": 0.5}) == 0.325
    assert [s["kind"] for s in Q.retrieval_steps("answer")] == ["documents", "passages"] and len(Q.retrieval_steps("compare", ("a", "b"))) == 4
    at = Q.Attestations()
    key = at.bind(a="1", b="2")
    assert at.bind(b="2", a="1") == key and at.holds(key, a="1") and not at.holds(key, a="2")


def test_stores(spark, tmp_path):
    files = spark.createDataFrame([(bytearray(b"%PDF-a"),), (bytearray(b"bad"),), (bytearray(b"%PDF-a"),)], "content binary")
    parse = FI.chained(lambda b: 1 / 0, lambda b: {"text": b.decode()} if b.startswith(b"%PDF") else None)
    first = FI.parsed(files, None, parse, version="1", schema="text string")
    assert sorted(r["text"] or "" for r in first.collect()) == ["", "%PDF-a"]
    first.write.parquet(str(tmp_path / "cache"))
    again = FI.parsed(files, spark.read.parquet(str(tmp_path / "cache")), lambda b: {"text": "parsed twice"}, version="1", schema="text string")
    assert sorted(r["text"] or "" for r in again.collect()) == ["", "%PDF-a"]

    obj = FI.Objects(spark, str(tmp_path / "objects"))
    name = obj.publish({"b": 1, "a": "ü"})
    assert obj.publish({"a": "ü", "b": 1}) == name and obj.resolve(name) == {"a": "ü", "b": 1}
    (tmp_path / "objects" / f".{name}.json.crc").unlink()
    (tmp_path / "objects" / f"{name}.json").write_text('{"a":2}')
    with pytest.raises(ValueError):
        obj.resolve(name)

    lines = tmp_path / "l.jsonl"
    lines.write_text('{"a": 1}\n{"a": oops\n')
    rows = FI.read_json(spark, str(lines), "a int").collect()
    assert [(r["a"], r["_corrupt"] is not None) for r in rows] == [(1, False), (None, True)]
    (tmp_path / "arr.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert FI.read_json(spark, str(tmp_path / "arr.json"), "a int", array=True).count() == 2

    days = spark.createDataFrame([("2024-01-01", 1), ("2024-01-09", 2)], "d string, v int").withColumn("ts", F.to_timestamp("d")).drop("d")
    FI.append_daily(days, str(tmp_path / "days"), time="ts")
    FI.append_daily(days, str(tmp_path / "days"), time="ts")
    back = spark.read.json(str(tmp_path / "days"))
    assert back.count() == 4 and FI.kept_days(back, today=F.lit("2024-01-10").cast("date"), keep=3).count() == 2
    assert [str(r["day"]) for r in FI.old_days(back, today=F.lit("2024-01-10").cast("date"), keep=3).collect()] == ["2024-01-01"]

    v = spark.createDataFrame([(1, [1.0], "x"), (2, None, "y")], "id int, embedding array<float>, t string")
    FI.write_vectors(v, str(tmp_path / "vec"))
    assert spark.read.parquet(str(tmp_path / "vec")).count() == 1 and FI.exists(spark, str(tmp_path / "vec")) and not FI.exists(spark, str(tmp_path / "none"))
    FI.write_json(v.select("id"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2

    c = FI.Catalog(lambda: {"a": v}, lambda: {"a": v.select("id"), "b": v})
    version, fields = c.snapshot()
    assert list(fields["a"]) == ["id"] and len(version) == 16 and c.authorized({"b": ["t"]})["b"].columns == ["t"]
    assert FI.Catalog.mentions("入口温度和温度", {"温度": "t", "入口温度": "in"}) == [(0, 4, "in"), (5, 7, "t")]
    assert FI.recent(days, name="v", time="ts", most=1).first()["v"] == 2


def test_generation_clone(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "g1"))
    assert Q.cloned(spark, str(tmp_path / "g1"), str(tmp_path / "g2"), lambda df: df.withColumn("x", F.col("id") * 2), key="id") == (5, 5)
    with pytest.raises(PlanError):
        Q.cloned(spark, str(tmp_path / "g1"), str(tmp_path / "g3"), lambda df: df.filter("id > 1"), key="id")


def test_streams(spark, tmp_path):
    rows = spark.range(20000).select(F.col("id").alias("event_id"), (F.col("id") / 20000).alias("fill"))
    n = logs.sampled(rows, 0.2).count()
    assert abs(n - 4000) < 250 and logs.sampled(rows, 0.2).exceptAll(logs.sampled(rows, 0.4)).count() == 0
    assert logs.sampled(rows, 0.2, fill=F.lit(0.9)).count() < 600
    r = spark.createDataFrame([("ab\ncd\nhalf", 0), ("ab\ncd\nhalf", 3), ("é\nx", 0), ("half", 0), ("", 0)], "t string, o int").select(logs.complete_lines(F.col("t"), F.col("o")).alias("r")).collect()
    assert [(list(x["r"]["lines"]), x["r"]["next_offset"]) for x in r] == [(["ab", "cd"], 6), (["cd"], 6), (["é"], 3), ([], 0), ([], 0)]
    out = spark.createDataFrame([("k", 1, False), ("k", 2, False), ("m", 1, True), ("n", 3, False)], "key string, n int, done boolean")
    assert [(x["key"], x["n"], x["attempts"]) for x in logs.replayed(out, key="key", order="n", done="done").collect()] == [("k", 1, 2), ("n", 3, 1)]
    t = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-09 00:00:00",)], "ts string").select(F.to_timestamp("ts").alias("ts"))
    assert logs.retained(t, now=F.to_timestamp(F.lit("2024-01-10 00:00:00")), days=3).count() == 1


def test_index_finds_what_a_scan_finds(spark):
    rows = [(i, f"word{i % 7} common text word{i % 3} word{i % 3}", f"title{i % 5}") for i in range(200)] + [(None, "word1", "title1"), (300, None, None), (301, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, name string")
    index = S.build(df, {"content": F.col("text"), "title": F.col("name")})
    plain = {r["doc_id"]: r["score"] for r in R.bm25(df.filter("doc_id is not null").withColumn("text", F.coalesce("text", F.lit(""))), ["word2", "word5"]).collect()}
    found = {r["doc_id"]: r["score"] for r in S.bm25(index, ["word2", "word5"], boosts={"content": 1.0}).collect()}
    assert set(plain) == set(found) and all(abs(plain[i] - found[i]) < 1e-9 for i in plain)
    best = {r["doc_id"]: r["score"] for r in S.bm25(index, "title4 word2", boosts={"content": 1.0, "title": 8.0}).collect()}
    assert max(best, key=lambda i: (best[i], -i)) % 5 == 4 and S.bm25(index, ["nowhere"]).count() == 0 and S.bm25(index, []).count() == 0


def test_search_parts(spark):
    h = spark.createDataFrame([(1, 0, 0.5), (1, 3, 0.9), (1, 1, 0.9), (2, 0, 0.1)], "doc_id int, chunk_index int, score double")
    assert sorted(tuple(r)[:2] for r in S.best_chunk(h).select("doc_id", "chunk_index").collect()) == [(1, 1), (2, 0)]
    a = spark.createDataFrame([(1, 1), (2, 2), (1, 3)], "id int, rank int")
    b = spark.createDataFrame([(3, 1), (2, 2)], "id int, rank int")
    assert [r["id"] for r in S.fused([a, b], "id", 3).collect()] == [2, 1, 3]
    docs = spark.createDataFrame([(1, "Deep nets.pdf", "Deep nets"), (2, "x.pdf", "On Deep Nets"), (3, "deep.pdf", "y")], "doc_id int, file string, title string")
    assert [r["doc_id"] for r in S.find_document(docs, "Deep nets.pdf", file="file", title="title", id_col="doc_id").collect()] == [1, 2]
    assert S.find_document(docs, "3", file="file", title="title", id_col="doc_id").first()["doc_id"] == 3 and S.find_document(docs, " ", file="file", title="title", id_col="doc_id").count() == 0
    f = spark.createDataFrame([(i, f"fact {'gan' if i % 2 else 'esn'}", i / 10) for i in range(8)], "id int, content string, confidence double")
    assert [r["id"] for r in S.recalled(f, ["GAN"]).collect()] == [7, 5, 3, 1] and {r["id"] for r in S.recalled(f, ["zz"]).collect()} == {7, 6, 5} == {r["id"] for r in S.recalled(f, []).collect()}
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(8)], "id int, embedding array<double>")
    assert {r["id"] for r in S.recalled(f, ["gan"], v, v.filter("id = 0"), many=5, k=2).collect()} == {0, 1}
    lines = spark.createDataFrame([(["a" * 10, "b" * 10, "c" * 10],)], "l array<string>")
    assert lines.select(S.injected(F.col("l"), budget=11).alias("x")).first()["x"] == "a" * 10 + "\n" + "b" * 10 and lines.select(S.injected(F.col("l"), budget=1).alias("x")).first()["x"] == "a" * 10


def test_durations_against_brute_force(spark):
    import random

    r = random.Random(5)
    rows = [(i, 1 + i % 2, t, float(r.randint(0, 30))) for i, t in enumerate(sorted(r.sample(range(0, 4000), 300)))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, us long, value double")
    scope = [(u, s, s + r.randint(1, 600)) for u in (1, 2) for s in r.sample(range(4000), 15)]
    iv = spark.createDataFrame(scope, "user_id long, start_us long, end_us long")
    got = {(x["user_id"], x["start_us"], x["end_us"]): x["seconds"] for x in A.scoped_duration(df, F.col("value") > 15, iv, keys=["user_id"], max_gap_us=40, bucket_us=100).collect()}
    linear = {x["user_id"]: x["seconds"] for x in A.linear_duration(df, "value", 15.0, keys=["user_id"], max_gap_us=40).collect()}
    for u in (1, 2):
        mine = [(t, v) for _, k, t, v in rows if k == u]
        spans = [(a, b, v, w) for (a, v), (b, w) in zip(mine, mine[1:], strict=False) if b - a <= 40]
        for k, s, e in scope:
            if k == u:
                assert abs(got[k, s, e] - sum(max(0, min(b, e) - max(a, s)) for a, b, v, _ in spans if v > 15) / 1e6) < 1e-12
        area = sum((b - a) * (1 if v > 15 and w > 15 else 0 if v <= 15 and w <= 15 else max(v - 15, w - 15) / abs(v - w)) for a, b, v, w in spans) / 1e6
        assert abs(linear[u] - area) < 1e-9


def test_evidence(spark):
    e = spark.createDataFrame([("see [E1] and [E 2].", ["a", "b"]), ("see [E3]", ["a"]), ("none", ["a"]), ("[E1]", ["z"])], "t string, s array<string>")
    assert [r["ok"] for r in e.select(V.citations_hold(F.col("t"), F.col("s"), F.array(F.lit("a"), F.lit("b"))).alias("ok")).collect()] == [True, False, False, False]
    s = spark.createDataFrame([("Echo Belief Network", "echo state network"), ("t", "the echo-state network"), ("MCMC", ""), (None, None)], "h string, t string")
    assert [r["x"] for r in s.select(V.of_sense(F.col("h"), F.col("t"), "echo-state-network").alias("x")).collect()] == [False, True, False, False]
    assert [r["x"] for r in s.select(V.of_sense(F.col("h"), F.col("t"), "markov-chain-monte-carlo").alias("x")).collect()] == [False, False, True, False]
    c = spark.createDataFrame([(i,) for i in range(7)], "k int")
    assert [tuple(r) for r in V.page_of(c, key="k", cursor=5, limit=5).collect()] == [(5, None, False, True), (6, None, False, True)]
    a = V.aligned(spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, expected string"), spark.createDataFrame([(2, "x"), (3, "y")], "k int, predicted string"), "k")
    assert {r["k"]: r["fault"] for r in a.collect()} == {1: "missing", 2: "repeated", 3: "unknown"}
