"""Questions, notes, memory and generations against brute force and stated cases."""

import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import language as L
from marlstone.operators import events as E
from marlstone.operators import memory as M
from marlstone.sources import generations as G


def one(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_numerals(spark):
    cases = {"二零二四": 2024, "二十四": 24, "十": 10, "两百零五": 205, "三千二百一十": 3210, "": None, "abc": None, None: None}
    assert one(spark, L.numeral, list(cases)) == list(cases.values())


def test_periods(spark):
    q = ["2025年之前", "2019年以后", "2020年以来", "2025年到2023年", "截至2021年", "近三年", "2024年3月", "papers after nothing", "", None, "近零年"]
    got = one(spark, lambda c: L.period(c, 2026), q)
    assert [g and (g["kind"], g["lower"], g["lower_open"], g["upper"], g["upper_open"]) for g in got] == [
        ("before", None, False, 2025, True), ("after", 2019, True, None, False), ("since", 2020, False, None, False), ("between", 2023, False, 2025, False), ("until", None, False, 2021, False),
        ("recent", 2024, False, 2026, False), ("year", 2024, False, 2024, False), None, None, None, None,
    ]


def test_memory_text(spark):
    texts = ["嗯嗯 俺不想去！对对对，见 https://a.example/x 或 me@b.example", "电话13812345678，共３.5元 😀", "", None, "没有。不要走", "卡6212345678901234"]
    got = one(spark, L.memory_text, texts)
    assert got[0]["text"] == "用户不想去！对，见 [URL] 或 [EMAIL]" and [(n["start"], n["end"]) for n in got[0]["negations"]] == [(1, 4)]
    assert got[1]["text"] == "电话[PII]，共3.5元 [emoji]" and got[5]["text"] == "卡[PII]"
    assert got[2]["text"] == "" and got[3]["text"] is None
    assert [(n["start"], n["end"]) for n in got[4]["negations"]] == [(0, 2), (3, 6)]


def test_lost(spark):
    df = spark.createDataFrame([("不要 12 和 7 ", "要 7"), ("电话13812345678", "电话[PII]"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(L.lost(F.col("a"), F.col("b"))).collect()] == [["12", "不", "不要"], [], []]


def test_questions(spark):
    texts = ["降维有哪些做法？顺便找两篇综述", "先说明储层的作用，另外给出年份", "对？不对？", "几篇？x7？y8？z9？", "", None]
    got = one(spark, L.questions, texts)
    assert [(g["first"], list(g["others"] or [])) for g in got[:5]] == [("降维有哪些做法", ["顺便找两篇综述"]), ("先说明储层的作用", ["另外给出年份"]), ("对？不对？", []), ("几篇", ["x7", "y8"]), ("", [])]
    assert got[5]["first"] is None


def test_tokens(spark):
    def brute(t):
        s = re.sub(r"\s+", "", t.lower())
        c = "".join(re.findall(r"[一-鿿]", s))
        return set(re.findall(r"[a-z_][a-z0-9_]*|[-+]?\d+(?:\.\d+)?", s)) | {c[i : i + 2] for i in range(len(c) - 1)}

    texts = ["GAN 网络模型 -3.5", "一", "", "网 络x", "aa AA 12"]
    assert [set(x) for x in one(spark, L.tokens, texts)] == [brute(t) for t in texts]


def test_keyed_hash(spark):
    for salt in ("s", "长" * 60):
        want = [hmac.new(salt.encode(), t.encode(), hashlib.sha256).hexdigest()[:16] if t else None for t in ("u1", "用户", "", None)]
        assert one(spark, lambda c, s=salt: L.keyed_hash(c, s), ["u1", "用户", "", None]) == want
    assert one(spark, lambda c: L.keyed_hash(c, ""), ["u1", ""]) == ["u1", None]


def test_profile(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), i, r.choice("xyz"), round(r.random(), 2)) for i in range(300)]
    got = {x["i"]: (x["held"], round(x["held_confidence"], 6)) for x in M.merged_profile(spark.createDataFrame(rows, "k string, i int, value string, confidence double"), keys=["k"], order=["i"]).collect()}
    state = {}
    for k, i, v, c in rows:
        if k not in state:
            state[k] = [v, c, set()]
        elif v == state[k][0]:
            state[k][1] = min(1.0, state[k][1] + 0.1)
        elif v in state[k][2]:
            state[k][:2] = [v, c]
        else:
            state[k][2].add(v)
        assert got[i] == (state[k][0], round(state[k][1], 6))


def test_scan_of_nothing(spark):
    none = spark.createDataFrame([], "user_id long, event_id long, us long, value double")
    assert E.budget_admission(none, F.col("value"), key="user_id", ceiling=1.0).count() == 0


def test_context(spark):
    turns = [("找论文", "find"), ("继续", "chat"), ("换个话题", "chat"), ("还有呢", "chat"), ("比较它们", "compare"), ("还有呢", None), (None, "other")]
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "c int, i int, text string, intent string")
    assert [r["held"] for r in M.continued_intent(df, keys=["c"], order=["i"]).orderBy("i").collect()] == ["find", "find", None, None, "compare", "compare", "other"]


def test_conflicts(spark):
    new = spark.createDataFrame([(10, "pref", "改为用黑色主题"), (11, "pref", "喜欢黑色主题"), (12, "fact", "其实黑色主题"), (13, "pref", None)], "id int, type string, content string")
    old = spark.createDataFrame([(1, "pref", "浅色界面"), (2, "pref", "黑色主题"), (3, "pref", "黑色")], "id int, type string, content string")
    assert [tuple(r) for r in M.conflicting(new, old, L.tokens).collect()] == [(10, 2)]


def test_generations(spark, tmp_path):
    d = str(tmp_path / "set")
    assert G.active(spark, d) == (0, None)
    for n in (1, 2):
        G.stage(spark.range(n), d, f"g{n}")
        assert G.activate(spark, d, f"g{n}", seen=n - 1, rows=n) == n
    assert G.read_active(spark, d).count() == 2
    with pytest.raises(G.StaleRevision):
        G.activate(spark, d, "g1", seen=1)
    with pytest.raises(ValueError):
        G.activate(spark, d, "g1", seen=2, rows=5)
    assert G.rollback(spark, d) == 3 and G.read_active(spark, d).count() == 1
