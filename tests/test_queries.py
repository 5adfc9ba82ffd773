"""The queries against their SQL, and what SQL can't say against brute force."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone import analytics_queries, dialog_queries, queries, question_queries, retrieval_queries  # noqa: F401  they register their queries
from marlstone.functions import language as L
from marlstone.functions import text as T
from marlstone.functions import units
from marlstone.operators import events as E
from marlstone.operators import retrieval as R
from marlstone.plans import algebra as P
from marlstone.sources import tables
from marlstone.streaming import logs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))


def test_queries_without_sql(spark):
    """Each has its result's facts stated here; the operators themselves are held against brute force below and in the other files."""
    d = SF
    n = {t: spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("events", "documents", "conversations")}
    got = {k: queries.QUERIES[k](spark, d).toPandas() for k in sorted(set(queries.QUERIES) - set(queries.SQL))}
    for k in ("message_entities", "memory_cleaning"):
        assert len(got.pop(k)) == n["conversations"], k
    assert len(got["bibliography"]) == n["documents"]
    assert set(got.pop("bibliography")["document_type"]) <= {"thesis", "preprint", "conference_paper", "journal_article", "paper"}
    rows = spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id % 100 = 0").count()
    assert got.pop("indexed_vector_search").groupby("query_id").size().tolist() == [10] * rows
    c = got.pop("category_clusters")
    assert c["query_id"].nunique() == rows and set(c["place"]) == set(range(1, c["label"].nunique() + 1))
    r = got.pop("recall_queries")
    assert 0 < len(r) <= n["documents"] and r["query"].str.len().between(30, 120).all()
    assert not got


def series(spark, rows):
    return spark.createDataFrame([(i, 1 + i % 2, t, a, float(v)) for i, (t, a, v) in enumerate(rows)], "event_id long, user_id long, us long, event_type string, value double")


def random_rows(n=400, seed=1):
    r = random.Random(seed)
    return [(t, r.choice(["view", "click", "purchase", "error"]), r.randint(0, 30)) for t in r.sample(range(5000), n)]


def test_sequence(spark):
    rows = random_rows()
    got = sorted(map(tuple, E.sequence_matches(series(spark, rows), ["view", "click", "purchase"], keys=["user_id"], action="event_type", within_us=300).collect()))
    want = []
    for u in (1, 2):
        at, begun = 0, 0
        for t, a, _ in sorted(x for i, x in enumerate(rows) if 1 + i % 2 == u):
            if at and t - begun > 300:
                at = 0
            if a == ["view", "click", "purchase"][at]:
                begun = t if at == 0 else begun
                at += 1
                if at == 3:
                    want.append((u, begun, t))
                    at = 0
    assert got == sorted(want) and got


def test_limits(spark):
    rows = random_rows()
    df = series(spark, rows)
    rate = {r["event_id"]: r["admitted"] for r in E.anchored_rate_limit(df, key="user_id", limit=3, window_us=200).collect()}
    budget = {r["event_id"]: r["admitted"] for r in E.budget_admission(df, F.col("value"), key="user_id", ceiling=500.0).collect()}
    states = {r["event_id"]: r["state"] for r in E.breaker_states(df, F.col("event_type") == "error", key="user_id", failures=2, cool_us=100).collect()}
    for u in (1, 2):
        own = sorted((t, i, a, v) for i, (t, a, v) in enumerate(rows) if 1 + i % 2 == u)
        start, n, used = None, 0, 0
        state, bad, since = "closed", 0, 0
        for t, i, a, v in own:
            if start is None or t >= start + 200:
                start, n = t, 0
            n += 1
            assert rate[i] == (n <= 3)
            assert budget[i] == (used + v <= 500)
            used += v if budget[i] else 0
            if state == "open" and t >= since + 100:
                state = "half_open"
            assert states[i] == state
            if state != "open":
                bad = bad + 1 if a == "error" else 0
                if a == "error" and (state == "half_open" or bad >= 2):
                    state, since = "open", t
                elif a != "error":
                    state = "closed"


def test_partitioning_doesnt_matter(spark):
    df = series(spark, random_rows())
    f = lambda x: sorted(map(tuple, E.consecutive(x, F.col("value") > 10, keys=["user_id"], max_gap_us=100).collect()))
    assert f(df) == f(df.repartition(7).orderBy(F.desc("value")))


@pytest.mark.parametrize(
    ("start", "end", "days"),
    [("2026-08-01 23:59", "2026-08-02 00:01", [1, 2]), ("2026-08-01 23:00", "2026-08-02 00:00", [1]), ("2026-08-01 10:00", "2026-08-01 10:00", [1])],
)
def test_local_dates(spark, start, end, days):
    us = lambda s: int(datetime.datetime.fromisoformat(s + "+08:00").timestamp() * 1e6)
    df = spark.createDataFrame([(1, us(start), us(end))], "user_id long, start_us long, end_us long")
    got = sorted(r["local_date"] for r in E.local_dates(df, keys=["user_id"], offset_us=queries.OFFSET).collect())
    assert got == [datetime.date(2026, 8, d) for d in days]


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (L.mask_people, "call 13812345678 or 320101200003071234 now", "call [PII] or [PII] now"), (L.mask_people, "138****5678 7212345678901234", "[PII] 7212345678901234"),
        (T.half_width, "ＡＢ１　！", "AB1 !"), (T.clean_embed, " a​b，中文\n c!", "ab 中文 c"), (T.token_estimate, "中文abcd", 3), (T.token_estimate, "。！abcd", 3), (T.language_by_script, "a" * 5000 + "中" * 5000, "en"), (T.language_by_script, "中文", "zh"), (T.mask_ip, "1.2.3.4", "1.2.3.***"),
        (T.mask_ip, "::1", "***"), (T.normalise_query, " ＨＥＬＬＯ  World ", "hello world"), (T.words, "Ab, cd-9é", ["ab", "cd", "9é"]), (T.quality, "fine", 1.0), (T.quality, "", 0.0), (T.quality, None, 0.0),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, text, f) == want


def test_units(spark):
    at = lambda v, *a, **k: spark.range(1).select(units.convert(F.lit(float(v)), *a, **k).alias("x")).collect()[0]["x"]
    assert at(10, "celsius", "fahrenheit", delta=True) == pytest.approx(18)
    assert at(10, "celsius", "fahrenheit") == pytest.approx(50)
    assert at(36, "kilometre_per_hour", "metre_per_second") == pytest.approx(10)
    assert at(100, "kilopascal", "pascal") == pytest.approx(100000)
    for a, b in (("decibel", "ratio"), ("metre", "second"), ("nothing", "metre")):
        with pytest.raises(ValueError):
            units.convert(F.lit(1.0), a, b)


def test_pack_paragraphs():
    assert R.pack_paragraphs("a\n\nb\n" + "c" * 12, 5) == ["a\nb", "ccccc", "ccccc", "cc"]
    assert R.pack_paragraphs(None) == []


def test_plan_rejects():
    s = P.Step
    base = [s("e", "source", params={"table": "e"}), s("c", "consecutive", ("e",), {"predicates": [], "keys": ["k"], "max_gap_us": 1}), s("d", "project_date", ("c",), {"keys": ["k"]})]
    bad = [
        s("x", "union", ("c", "c")), s("x", "union", ("c", "d")), s("x", "project_date", ("e",)), s("x", "nothing"), s("x", "filter", ("y",)), s("e", "source"), s("x", "quantile", ("e",), {"q": 0}),
        s("x", "intersection", ("c",)),
    ]
    for step in bad:
        with pytest.raises(P.PlanError):
            P.validate([*base, step])
    assert P.validate([*base, s("u", "difference", ("c", "c2"))][:3])["d"].shape == "date_set"
    assert P.unsatisfiable([P.Predicate("a", "gt", 5), P.Predicate("a", "lt", 3)]) and not P.unsatisfiable([P.Predicate("a", "gt", 5), P.Predicate("b", "lt", 3)])


def test_predicates(spark):
    df = spark.createDataFrame([(1, "ab"), (5, None), (None, "b")], "n int, s string")
    n = lambda *p: df.filter(P.conjunction(list(p))).count()
    q = P.Predicate
    assert [n(q("n", "between", (1, 4))), n(q("n", "in", [1, 5])), n(q("n", "not_in", [1])), n(q("s", "contains", "b")), n(q("s", "is_null")), n(q("n", "gte", 1), q("s", "is_not_null"))] == [1, 2, 1, 2, 1, 1]
    assert df.filter(P.disjunction([[q("n", "eq", 1)], [q("s", "eq", "b")]])).count() == 2
    with pytest.raises(P.PlanError):
        q("n", "like", 1).column()


def test_keyed_tables(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, rev int, x string")
    new = spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "k int, rev int, x string")
    assert sorted((r["k"], r["x"]) for r in tables.latest_by_key(base, new, "k", "rev").collect()) == [(1, "c"), (2, "b"), (3, "d")]
    assert sorted((r["k"], r["x"]) for r in tables.partial_update(base, spark.createDataFrame([(2, "z")], "k int, x string"), "k").collect()) == [(1, "a"), (2, "z")]
    assert tables.insert_ignore(new.unionByName(new), base, "k").count() == 1
    assert sorted(map(tuple, tables.reconcile(base, new, "k").collect())) == [("left", 2), ("right", 3)]


def test_pdf_gate(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"MZ")
    assert [r["path"][-5:] for r in tables.pdf_files(spark, str(tmp_path)).select("path").collect()] == ["a.pdf"]


def test_forward_is_idempotent(spark, tmp_path):
    for i in range(2):  # a replay from an empty checkpoint adds nothing
        logs.forward(logs.stream(spark, SF), str(tmp_path / "out"), str(tmp_path / f"cp{i}")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("event_id").distinct().count() == tables.read(spark, SF, "events").count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_generation_digest_covers_all_documents(spark, tmp_path):
    import hashlib
    import itertools

    from marlstone.queries import generation_digest

    def brute(rows):
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        mark = lambda v: "n" if v is None else f"v{v}"
        level = sorted(sha(":".join((mark(i), mark(g), mark(None if t is None else sha(t))))) for i, g, t in rows)
        level = [p + sha("\n".join(x)) for p, x in itertools.groupby(level, lambda x: x[:4])]
        level = [p + sha("\n".join(x)) for p, x in itertools.groupby(level, lambda x: x[:2])]
        return sha("\n".join(level))

    rows = [(i, ("en", "de", "fr", None)[i % 4], f"text {i}" if i % 9 else None) for i in range(700)] + [(3, None, "text 3"), (3, None, "text 3")]
    seen = set()
    changed = [(i, g, "other" if i == 0 else t) for i, g, t in rows]
    for k, x in enumerate((rows, changed, rows[::-1], [])):
        spark.createDataFrame(x, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        r = generation_digest(spark, f"{tmp_path}/{k}").first()
        assert (r["digest"], r["n"]) == (brute(x), len(x))
        seen.add(r["digest"])
    assert len(seen) == 3


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_quantiles(spark, method):
    import math

    from marlstone.operators.quantiles import quantiles

    r = random.Random(2)
    groups = {"a": [r.gauss(0, 5) for _ in range(501)], "b": [3.0] * 40, "c": [1.0, 2.0], None: [r.choice([1e9, 0.0, 1.0]) for _ in range(99)], "d": [7.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"q0": 0.0, "q3": 0.37, "q5": 0.5, "q9": 0.95, "q1": 1.0}
    got = {x["g"]: [x[k] for k in qs] for x in quantiles(df, ["g"], "v", qs, method=method).collect()}

    def plain(vs, q):
        vs = sorted(vs)
        if method == "nearest":
            return vs[max(math.ceil(q * len(vs)), 1) - 1]
        at = (len(vs) - 1) * q
        low = math.floor(at)
        return vs[low] + (vs[min(low + 1, len(vs) - 1)] - vs[low]) * (at - low)

    assert set(got) == set(groups) and all(math.isclose(a, plain(groups[g], q), rel_tol=1e-12, abs_tol=1e-12) for g, xs in got.items() for a, q in zip(xs, qs.values(), strict=True))
    assert quantiles(df.filter("g = 'c'"), [], "v", {"m": 0.5}, method=method).first()["m"] == (1.5 if method == "linear" else 1.0)
    assert quantiles(df.limit(0), ["g"], "v", qs).count() == 0
