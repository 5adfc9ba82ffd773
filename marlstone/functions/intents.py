"""Intents and domains of questions by ordered rules; the first that holds counts.

Rules are regular expressions and flags of what was found in the question (``found``:
time, document ids, author, other attributes, exclusions). Built-in expressions only.

Cases: null and empty questions are ``invalid``; questions that no rule knows get a
null intent with confidence 0, as for a model to judge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of each rule and its confidence.
CALCULATES = "增长率|增速|环比|同比|差值|占比|比例|百分比|翻了几倍|翻几倍|翻了几番|翻几番|倍数|涨了多少|增长了多少|增长多少|增长更快|增速差|差多少|平均每年增长|年均增长|增长率是多少|增长速率|速率差异|幅度是多少|变化到了多少|波动率|收益率|方差|标准差|极差|复合增长率"
CITES = "引用|参考文献|reference|references|引用了|引用列表|参考文献列表|citation"
LEAVES_OUT_CITATIONS = "(不要|除了|排除|不含|别|剔除|去掉).{0,6}(引用|参考文献)"
COMPARES = "区别|对比|比较|异同|有什么不同|差别|相比|相较|vs|哪个好|谁更好|区别在哪|不同之处"
COUNTS = "几篇|多少|总数|统计|占比|数量|篇数|合计|一共"
LISTS = "列出|所有|哪些|几篇|盘点|统计|分别|都有哪些|全部|总数|多少篇|盘一下|罗列|理一理|列一下|整理下|列举|枚举|一共|合计|多少次"
FACTS = "作者|哪年|年份|doi|期刊|页数|标题|谁写的|出版社|第几页|页码|出版时间|刊名|卷号|期号|哪个期刊|哪里发的"
MEANS = "关于|相关|方法|主题|怎么样|如何|内容|讲|介绍|了解|说说|知道|用了|使用|哪个好"
POINTS = "这篇|该文|那篇|那份|本文|上面|刚才|那个|这个"
FINDS = "找找|找一下|帮我找|搜一下|搜索|查一下"
CONTENT = "方法|内容|讲了|讲什么|如何|怎么样|用了|摘要|结论"
DOCUMENTS = "论文|文献|那篇|这篇|两篇|文件"
IN_SET = "(?:这些|上述|以上|其中|刚才的)(?:论文|文献|文档)"
NOT_KNOWLEDGE = (
    "写.{0,8}(代码|脚本|程序|函数)", "改.{0,8}(代码|脚本|程序|bug)", "(写|做|出).{0,4}(方案|设计|计划|报告)(?!.*(论文|文献))", "翻译.{0,8}(这篇|文档|pdf|文件|文章)", "(删除|移除|改名|重命名|排序|整理).{0,6}(文档|文件|论文|文献)",
    "(今天|现在).{0,3}(几号|几点|星期|时间|日期)", "天气|你叫什么|你是谁|谢谢|再见|你好呀?$|在吗", "分析.{0,6}(代码|pdf|文件|数据|报错|乱码|方案)(?!.*(论文|文献))",
)
#: Share of agreement that a cascade needs at each step.
TAKE_RULE, TAKE_NEAR, LOOK_NEAR, AGREE, DISAGREE, CONTEXT, LAST = 0.95, 0.95, 0.85, 0.85, 0.90, 0.7, 0.3


def _says(c: Column, p: str) -> Column:
    return F.coalesce(c.rlike(f"(?i){p}"), F.lit(False))


def intent(c: Column, found: dict[str, Column]) -> Column:
    """(intent, confidence, rule) of a question. ``found``: booleans has_time, precise_time, several_times, sorts, doc_ids, author, attribute, excludes."""
    q = F.trim(F.coalesce(c, F.lit("")))
    flag = lambda n: F.coalesce(found.get(n, F.lit(False)), F.lit(False))
    points, lists, counts, means = _says(q, POINTS), _says(q, LISTS), _says(q, COUNTS), _says(q, MEANS)
    some = flag("attribute") | flag("author")
    one = flag("doc_ids") | points
    content = _says(q, CONTENT)
    # The rules' names, order, intents and confidences.
    rules = [
        ("calc_strong", _says(q, CALCULATES), "numerical_calculation", 0.99),
        ("exclude_citation", _says(q, LEAVES_OUT_CITATIONS), "inventory", 0.99),
        ("citation", _says(q, CITES) & ~F.contains(q, F.lit("引用格式")), "citation_query", 0.98),
        ("compare_docs", _says(q, COMPARES) & (_says(q, DOCUMENTS) | flag("doc_ids")), "cross_doc_synthesis", 0.98),
        ("compare_concepts", _says(q, COMPARES), "semantic_retrieval", 0.96),
        ("metadata_doc", one & _says(q, FACTS), "metadata_query", 0.99),
        ("doc_qa_content", (one | flag("author")) & (content | (flag("author") & points)), "doc_qa", 0.99),
        ("doc_qa_plain", one & ~flag("has_time") & ~_says(q, FINDS), "doc_qa", 0.97),
        ("scope_semantic", _says(q, IN_SET) & means, "hybrid", 0.98),
        ("year_semantic", flag("has_time") & means, "hybrid", 0.98),
        ("year_stat", flag("has_time") & counts, "inventory", 0.98),
        ("year_enum", flag("has_time") & lists, "attribute_filter", 0.97),
        ("year_plain", flag("has_time"), "attribute_filter", 0.95),
        ("enum_stat", lists & counts, "inventory", 0.98),
        ("enum_attr", lists & (some | flag("excludes") | flag("sorts")), "attribute_filter", 0.97),
        ("enum_semantic", lists & means, "hybrid", 0.97),
        ("enum_plain", lists, "inventory", 0.94),
        ("exclude_only", flag("excludes"), "attribute_filter", 0.98),
        ("attr_plain", some & ~means, "attribute_filter", 0.95),
    ]
    marks = F.size(F.split(q, "[,，;；]|以及|同时")) - 1
    loose = flag("precise_time") | flag("several_times") | (F.length(q) > 80) | (marks >= 2)
    out = F.struct(F.lit(None).cast("string").alias("intent"), F.lit(0.0).alias("confidence"), F.lit("unclassified").alias("rule"))
    for name, holds, says, sure in reversed(rules):
        conf = F.when(loose, {"year_enum": 0.88, "year_plain": 0.82}.get(name, sure)).otherwise(sure)
        out = F.when(holds, F.struct(F.lit(says).alias("intent"), conf.alias("confidence"), F.lit(name).alias("rule"))).otherwise(out)
    other = F.lit(False)
    for p in NOT_KNOWLEDGE:
        other = other | _says(q, p)
    fixed = lambda x: F.struct(F.lit(x).alias("intent"), F.lit(1.0).alias("confidence"), F.lit(x).alias("rule"))
    return F.when((q == "") | q.rlike(r"(?U)^[\s\W_]+$"), fixed("invalid")).when(other, fixed("non_kb")).otherwise(out)


def routed(rule: Column, context: Column, near: Column, model: Column) -> Column:
    """(intent, confidence, source) from four judges in turn: a sure rule, the context, near examples (with a model's second look), the rule after all, else plain search.

    Each judge is (intent, confidence); null where it doesn't say."""
    as_ = lambda x, s: F.struct(x["intent"].alias("intent"), x["confidence"].alias("confidence"), F.lit(s).alias("source"))
    says = lambda x: F.coalesce(x["intent"].isNotNull(), F.lit(False))
    low = says(near) & (near["confidence"] < TAKE_NEAR) & (near["confidence"] >= LOOK_NEAR)
    agreed = says(model) & (model["confidence"] >= F.when(model["intent"] == near["intent"], AGREE).otherwise(DISAGREE))
    held = says(context)
    return (
        F.when(says(rule) & (rule["intent"].isin("invalid", "non_kb", "clarification") | (rule["confidence"] >= TAKE_RULE)), as_(rule, "rule"))
        .when(held, F.struct(context["intent"].alias("intent"), F.lit(CONTEXT).alias("confidence"), F.lit("context").alias("source")))
        .when(says(near) & (near["confidence"] >= TAKE_NEAR), as_(near, "near"))
        .when(low & agreed, as_(model, "model"))
        .when(low & says(rule) & (rule["confidence"] >= near["confidence"]), as_(rule, "rule_candidate"))
        .when(low, as_(near, "near_low"))
        .when(says(rule), as_(rule, "rule_candidate"))
        .otherwise(F.struct(F.lit("semantic_retrieval").alias("intent"), F.lit(LAST).alias("confidence"), F.lit("fallback").alias("source")))
    )


def domain(c: Column, rules: list[tuple[str, str, float]], *, otherwise: str = "clarify_domain") -> Column:
    """(domain, confidence) of a question by ordered (pattern, domain, confidence) rules; short or unknown questions ask back."""
    q = F.trim(F.coalesce(c, F.lit("")))
    say = lambda d, x: F.struct(F.lit(d).alias("domain"), F.lit(x).alias("confidence"))
    out = F.when(F.length(q) <= 2, say(otherwise, 0.70)).otherwise(say(otherwise, 0.0))
    for p, d, x in reversed(rules):
        out = F.when(_says(q, p), say(d, x)).otherwise(out)
    return F.when(q == "", say(otherwise, 1.0)).otherwise(out)


def window_of(c: Column, words: dict[str, str], *, otherwise: str | None = None) -> Column:
    """The window class of the longest vague word that a text holds."""
    out = F.lit(otherwise)
    for w in sorted(words, key=len):
        out = F.when(F.contains(c, F.lit(w)), words[w]).otherwise(out)
    return out
