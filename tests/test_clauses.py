"""Clauses, roles, inheritance, signatures, memory commands and sampled queries against stated cases."""

import threading

import pytest
from pyspark.sql import functions as F

from marlstone.functions import clauses as C
from marlstone.functions import text as X
from marlstone.operators import memory as M
from marlstone.plans import requests as Q
from marlstone.plans.algebra import PlanError


CLAUSES = [
    ("2019年的储层论文有哪些，还有关于降维的", ["2019年的储层论文有哪些", "还有关于降维的"]), ("前年发了哪些论文，今年呢", ["前年发了哪些论文", "今年呢"]), ("2019年的论文，讲降维的那篇", ["2019年的论文讲降维的那篇"]),
    ("2019年的综述有哪些 储层的也行", ["2019年的综述有哪些", "储层的也行"]), ("停电期间，公共数据的论文有哪些", ["停电期间", "公共数据的论文有哪些"]), ("找降维的论文，顺便看看储层的", ["找降维的论文", "顺便看看储层的"]),
    ("降维和储层哪个好", ["降维和储层哪个好"]), ("我想知道，储层的原理是什么", ["储层的原理是什么"]), ("不要旧的综述文章，只要最近发表的论文", ["不要旧的综述文章，只要最近发表的论文"]), ("分别计算均值，方差以及极差；最终输出完整的表格", ["分别计算均值，方差以及极差", "最终输出完整的表格"]),
    ("列出供水管网模型和电网负荷数据", ["列出供水管网模型和", "电网负荷数据"]), ("查论文，并帮我列出全部作者的单位", ["查论文", "列出全部作者的单位"]), ("", []), ("好", ["好"]),
    ("2020年和2021年的论文", ["2020年和2021年的论文"]), ("3月和4月的文献", ["3月和4月的文献"]), ("统计最大值和最小值", ["统计最大值和最小值"]), ("2021年以及以前的文献有哪些", ["2021年以及以前的文献有哪些"]),
    ("告诉我X9什么时候上市的，现在最轻的相机是什么", ["X9什么时候上市的", "现在最轻的相机是什么"]), ("论文有哪些，还有关于降维的，王小明的呢", ["论文有哪些", "还有关于降维的", "王小明的呢"]),
    ("每次降价的幅度是多少，同期粮食价格增速从多少变化到了多少，请按月列出时间线", ["每次降价的幅度是多少", "同期粮食价格增速从多少变化到了多少", "按月列出时间线"]), ("一共发了多少次公告，每次公告的日期是多少", ["一共发了多少次公告", "每次公告的日期是多少"]),
    ("提取该日期前5个交易日和后3个交易日内，股票的最高价和最低价", ["提取该日期前5个交易日和后3个交易日内，股票的最高价和最低价"]), ("我想知道论文里有没有讲降维的", ["论文里有没有讲降维的"]), ("水泵销量和阀门数量", ["水泵销量和", "阀门数量"]),
]


def test_clauses(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLAUSES)], "i int, t string")
    got = {r["i"]: [x["text"] for x in r["c"]] for r in df.select("i", C.clause_list(F.col("t")).alias("c")).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(CLAUSES)} == dict(CLAUSES)
    plan = df.select(C.clause_list(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_clauses_are_worked_out_once(spark):
    """the pattern of edges ran twice a question, and a run of blanks took its length cubed."""
    df = spark.createDataFrame([(0, "查论文" + " " * 5000 + "，" + " " * 5000 + "并帮我列出全部作者的单位"), (1, "储层" + " " * 5000 + "网络")], "i int, t string")
    out = df.select("i", C.clause_list(F.col("t")).alias("c"))
    assert out._jdf.queryExecution().executedPlan().toString().count(C._edges()) == 1
    sc = spark.sparkContext
    late = threading.Timer(60, sc.cancelAllJobs)
    late.start()
    try:
        got = [[x["text"] for x in r["c"]] for r in out.orderBy("i").collect()]
    finally:
        late.cancel()
    assert got == [["查论文", "列出全部作者的单位"], ["储层" + " " * 5000 + "网络"]]


def test_edges_after_lists_and_dates(spark):
    """A list to compute hides edges for 400 characters, a date those of the nouns after it for 12."""
    texts = ["计算" + "甲" * n + "，" + "乙" * 8 + "还有" + "丙" * 8 for n in (3, 399, 400, 401)] + ["2019年" + "甲" * n + "和乙丙丁戊己庚辛" for n in (12, 13)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [[len(x["text"]) for x in r["c"]] for r in df.select("i", C.clause_list(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [[24], [410, 10], [411, 10], [403, 8, 10], [25], [19, 7]]


def test_clause_column_and_roles(spark):
    df = spark.createDataFrame([(0, "查论文，并帮我列出全部作者的单位"), (1, None), (2, " ")], "i int, t string")
    got = [r["c"] for r in df.select("i", C.clause_list(F.col("t")).alias("c")).orderBy("i").collect()]
    assert [x["text"] for x in got[0]] == ["查论文", "列出全部作者的单位"] and got[1] is None and got[2] == []
    says = [("当前日期是5月", False, "time"), ("每季度末月末披露", False, "constraint"), ("分析门店销售数据", False, "context"), ("按年份汇总", False, "output"), ("只要英文的", False, "constraint"), ("从春到夏", False, "time"), ("2020年", True, "time"), ("2020年有几篇", True, "main"), ("论文", False, "main")]
    df = spark.createDataFrame([(i, t, h) for i, (t, h, _) in enumerate(says)], "i int, t string, h boolean")
    assert [r["r"] for r in df.select("i", C.role(F.col("t"), F.col("h"), F.lit(False)).alias("r")).orderBy("i").collect()] == [w for *_, w in says]


def test_inheritance(spark):
    rows = [(1, 0, "time", "T1", None), (1, 1, "main", None, "a"), (1, 2, "main", None, None), (1, 3, "time", "T2", None), (1, 4, "time", "T3", None), (1, 5, "main", None, None), (1, 6, "main", "T4", "b"), (1, 7, "output", None, None), (1, 8, "main", None, None), (2, 0, "main", None, None)]
    out = C.inherited(spark.createDataFrame(rows, "q int, p int, role string, time string, author string"), query="q", place="p", attributes=("author",)).orderBy("q", "p").collect()
    assert [list(r["times"]) if r["times"] is not None else None for r in out] == [None, ["T1"], ["T1"], None, None, ["T2", "T3"], ["T4"], None, ["T4"], []]
    assert [r["author"] for r in out if r["role"] == "main"] == ["a", "a", "a", "b", "b", None]


def test_rejoined(spark):
    rows = [(1, 0, "储层有哪些", "ask", None), (1, 1, "降维有哪些", "ask", 0.9), (1, 2, "它的数据", "mark", 0.6), (1, 3, "还有图表", "", 0.99), (1, 4, "别的", "mark", 0.2)]
    out = C.rejoined(spark.createDataFrame(rows, "q int, p int, text string, edge string, similarity double"), query="q", place="p").orderBy("p").collect()
    assert [(r["p"], r["text"]) for r in out] == [(0, "储层有哪些"), (1, "降维有哪些，它的数据"), (3, "还有图表"), (4, "别的")]


def test_signatures(spark):
    c = F.col("x")
    assert Q.applied("avg", [(c, "number", "m")])[1] == "m" and Q.applied("ratio", [(c, "number", "m"), (c, "number", "m")])[1] == "ratio" and Q.applied("count", [(c, "string", None)])[1] is None
    assert spark.range(4).select(F.col("id").alias("x")).agg(Q.applied("max_of_product", [(c, "number", "m"), (c, "number", None)])[0].alias("v")).first()["v"] == 9
    for bad in (("sum", [(c, "string", None)]), ("ratio", [(c, "number", None)]), ("max_of_product", [(c, "number", "m"), (c, "number", "s")]), ("none", [])):
        with pytest.raises(PlanError):
            Q.applied(*bad)
    assert len(Q.signatures()) == 10


def test_memory_commands(spark):
    rows = [(f"e{i}", 1, f"f{i % 4}", "fact", f"v{i}", 0.1 * i, 0, f"2024-01-0{i + 1}", False) for i in range(6)] + [("x", 1, "f3", "fact", "v", 0.5, 0, "2024-01-09", True), ("y", 2, "f0", "fact", "other", 0.5, 0, "2024-01-01", False)]
    c = spark.createDataFrame(rows, "event_id string, user_id int, id string, type string, value string, confidence double, retrieval_count int, ts string, deleted boolean").withColumn("ts", F.to_timestamp("ts"))
    run = lambda x, cmd, **k: M.administered(x, cmd, user=1, **k)
    assert [r["id"] for r in run(c, "list", limit=2).collect()] == ["f1", "f0"] and {r["id"] for r in run(c, "export").collect()} == {"f0", "f1", "f2"}
    assert run(c, "get", fact="f1").first()["value"] == "v5" and run(c, "stats").first()["n"] == 3
    now = F.to_timestamp(F.lit("2024-06-01"))
    after = c.unionByName(run(c, "delete", fact="f0", now=now), allowMissingColumns=True)
    assert {r["id"] for r in run(after, "export").collect()} == {"f1", "f2"}
    after = c.unionByName(run(c, "fix", fact="f1", value=" new ", now=now), allowMissingColumns=True)
    assert run(after, "get", fact="f1").first()["value"] == "new" and run(after, "get", fact="f1").first()["revision"] == 3
    assert run(c.unionByName(run(c, "clear", now=now), allowMissingColumns=True), "export").count() == 0
    assert {r["id"] for r in run(c, "archive_stale", now=now).collect()} == {"f0", "f1", "f2"}
    for k in ({"command": "none"}, {"command": "fix", "fact": "f1"}):
        with pytest.raises(ValueError):
            M.administered(c, k.pop("command"), user=1, **k)


def test_feedback_and_sampled_queries(spark):
    r = spark.createDataFrame([("a", "x", 0.9, "correct"), ("a", "y", 0.95, "correct"), ("b", "x", 0.7, "correct"), ("c", "x", 0.9, None), ("d", "x", 0.9, "correct")], "text string, intent string, confidence double, feedback string")
    assert [tuple(x) for x in M.synced(r, spark.createDataFrame([("d",)], "text string")).collect()] == [("a", "y")]
    pages = spark.createDataFrame([(i, " ".join(f"word{i}x{j}" for j in range(n))) for i, n in ((1, 50), (1, 60), (2, 2), (3, 30))], "doc_id int, text string")
    got = M.sampled_queries(pages, X.clean_embed, doc="doc_id", per_doc=2).collect()
    assert sorted(x["doc_id"] for x in got) == [1, 1, 3] and all(30 <= len(x["query"]) <= 120 for x in got)
    texts = [p["text"] for p in pages.collect()]
    assert all(any(x["query"] in t for t in texts) for x in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.sampled_queries(pages.repartition(3), X.clean_embed, doc="doc_id", per_doc=2).collect()))
