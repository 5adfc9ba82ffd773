"""Acceptance summaries, fused documents, linear durations in scopes and deletion by retention, against brute force and stated cases."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from marlstone.operators import acceptance as AC
from marlstone.operators import analytics as A
from marlstone.operators import search as S
from marlstone.sources import files as FI

PRED = "case_id long, outcome string, correct boolean, critical boolean, unnecessary boolean, rejected boolean, completed boolean, low_cost_ms double, upgrade_ms double, end_to_end_ms double"


def test_acceptance_summary(spark):
    r = random.Random(2)
    kinds = ["auto_release", "clarify", "reject", None]
    maybe = lambda: r.choice([True, False, None])
    cases = [(i, r.choice(kinds[:3]), r.choice(["multi_turn", "single", None])) for i in range(200)] + [(500, "clarify", "single"), (501, "reject", "x"), (501, "reject", "x")]
    made = [(i, r.choice(kinds), maybe(), maybe(), maybe(), maybe(), maybe(), r.choice([None, r.random() * 100]), None, r.random() * 1000) for i in range(200)]
    predictions = [*made, (501, *made[0][1:]), (900, *made[1][1:])]
    c, p = spark.createDataFrame(cases, "case_id long, expected string, stratum string"), spark.createDataFrame(predictions, PRED)
    got = AC.summary(c, p).first().asDict()
    want = {k: e for k, e, _ in cases[:200]}
    stratum = {k: s for k, _, s in cases}
    ok = lambda x: x[2] if x[2] is not None else x[1] == want[x[0]]
    out = [x for x in made if x[1] == "auto_release"]
    errors = sum(not ok(x) for x in out)
    assert (got["total"], got["faults"], got["released"], got["release_errors"], got["correct_releases"]) == (200, 3, len(out), errors, len(out) - errors)
    assert (got["critical"], got["clarified"], got["rejected"]) == tuple(sum(x[i] is True for x in made) for i in (3, 4, 5))
    assert got["completed"] == sum(x[6] is True and stratum[x[0]] == "multi_turn" for x in made)
    near = lambda xs, q: sorted(xs)[math.ceil(Fraction(str(q)) * len(xs)) - 1]
    low, whole = [x[7] for x in made if x[7] is not None], [x[9] for x in made]
    assert got["low_cost_ms_p95"] == near(low, 0.95) and got["upgrade_ms_p50"] is None and got["end_to_end_ms_p50"] == near(whole, 0.5) and got["end_to_end_ms_p95"] == near(whole, 0.95)
    assert got["error_low"] < got["error_rate"] < got["error_high"]
    none = AC.summary(c.limit(0), p.limit(0)).first()
    assert none["total"] == none["faults"] == none["released"] == 0 and none["error_rate"] == 0 and none["error_low"] is None and none["end_to_end_ms_p95"] is None


def test_category_gates(spark):
    rows = [("a", True, True, False)] * 60 + [("a", False, None, None), ("b", True, True, False), ("b", True, False, True), ("", True, True, False), (None, True, True, False), ("c", None, True, False)]
    got = {r["category"]: r for r in AC.category_gates(spark.createDataFrame(rows, "category string, released boolean, correct boolean, critical boolean"), 50).collect()}
    assert set(got) == {"a", "b", "c"} and [(got[c]["samples"], got[c]["released"], got[c]["correct"], got[c]["precision"], got[c]["passed"]) for c in "abc"] == [(61, 60, 60, 1.0, True), (2, 2, 1, 0.5, False), (1, 0, 0, 0.0, False)]
    assert not got["b"]["uncritical"] and not got["c"]["enough"]


def test_fused_documents(spark):
    docs = spark.createDataFrame([(1, 1), (2, 2), (2, 5)], "doc_id int, rank int")
    chunks = spark.createDataFrame([(3, 1, "c" * 600), (2, 2, "b"), (3, 3, "later"), (1, 9, None)], "doc_id int, rank int, text string")
    got = [(r["doc_id"], round(r["rrf"], 9), r["chunk_text"]) for r in S.fused_documents(docs, chunks, 5).collect()]
    assert got == [(2, round(1 / 62 + 1 / 62, 9), "b"), (1, round(1 / 61 + 1 / 69, 9), None), (3, round(1 / 61, 9), "c" * 500)]
    assert [r["doc_id"] for r in S.fused_documents(docs, chunks.limit(0), 1).collect()] == [1] and S.fused_documents(docs.limit(0), chunks.limit(0), 3).count() == 0


def test_scoped_linear_duration(spark):
    r = random.Random(3)
    rows = [(u, t, i, r.choice([None, 10.0, 30.0, 50.0, 35.0])) for u in (1, 2) for i, t in enumerate(sorted(r.sample(range(0, 2000), 60)))]
    df = spark.createDataFrame([(u, t, i, v) for u, t, i, v in rows], "user_id int, us long, event_id int, value double")
    scope = [(1, 0, 2000), (1, 100, 333), (1, 333, 334), (2, 500, 1500), (2, 5000, 6000), (3, 0, 10), (1, 100, 333)]
    out = A.scoped_linear_duration(df, "value", 35.0, spark.createDataFrame(scope, "user_id int, start_us long, end_us long"), keys=["user_id"], max_gap_us=80, bucket_us=50)
    got = {(x["user_id"], x["start_us"], x["end_us"]): x["seconds"] for x in out.collect()}
    want = {}
    for u, s, e in set(scope):
        own, total = [(t, v) for k, t, _, v in rows if k == u], Fraction(0)
        for (a, p), (b, q) in zip(own, own[1:], strict=False):
            if p is None or q is None or b - a > 80:
                continue
            x, y = max(a, s), min(b, e)
            if x < y:
                at = lambda t: Fraction(p) + (Fraction(q) - Fraction(p)) * Fraction(t - a, b - a) - 35  # noqa: B023, E731
                m, n = at(x), at(y)
                total += (y - x) * (1 if m > 0 and n > 0 else 0 if m <= 0 and n <= 0 else max(m, n) / abs(m - n))
        want[u, s, e] = float(total) / 1e6
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and any(want.values())


def test_old_days_are_deleted(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(i, f"2024-01-{d:02d} 10:00:00") for i, d in enumerate((1, 5, 9, 10, 10))], "i int, ts string").withColumn("ts", F.to_timestamp("ts"))
    FI.append_daily(df, path, time="ts")
    (tmp_path / "log" / "day=odd").mkdir()
    assert FI.delete_old_days(spark, path, today="2024-01-10", keep=5) == ["2024-01-01"]
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("day=")) == ["day=2024-01-05", "day=2024-01-09", "day=2024-01-10", "day=odd"]
    assert FI.delete_old_days(spark, path, today="2024-01-10", keep=5) == [] == FI.delete_old_days(spark, f"{path}-none", today="2024-01-10", keep=5)
